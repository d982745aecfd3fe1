"""Data sets and stores beyond Parquet tables: JSON conversations in, scored items and vector rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = 1024  # fixed values of the vector store: dimensions, and characters of content
CONTENT = 4096


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """sample, session, dia_id, speaker, text of a JSON data set of conversations: files hold one sample or a list of
    samples, whose `sessions` are lists of {session, turns: [{dia_id, speaker, text}]}. Missing fields are null."""
    turn = "dia_id string, speaker string, text string"
    schema = f"sample_id string, sessions array<struct<session: string, turns: array<struct<{turn.replace(' string', ': string')}>>>>"
    samples = spark.read.schema(schema).option("multiLine", True).json(path)
    each = samples.select(F.col("sample_id").alias("sample"), F.explode("sessions").alias("s"))
    return each.select("sample", F.col("s.session").alias("session"), F.explode("s.turns").alias("t")).select("sample", "session", "t.*")


def write_scores(items: DataFrame, path: str) -> None:
    """Scored items as JSON lines, and beside them `report`: items, evaluated items and mean score by category."""
    items.write.mode("overwrite").json(f"{path}/items")
    report = items.groupBy("category").agg(F.count("*").alias("n"), F.count("score").alias("evaluated"), F.round(F.avg("score"), 4).alias("mean"))
    report.write.mode("overwrite").json(f"{path}/report")


def to_dims(vector: Column, dims: int = DIMS) -> Column:
    """The vector cut or padded with zeros to `dims`; a null vector is all zeros."""
    zeros = F.array_repeat(F.lit(0).cast("float"), dims)
    return F.slice(F.concat(F.coalesce(vector.cast("array<float>"), F.array().cast("array<float>")), zeros), 1, dims)


def embedded(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """texts (id, text) with `vector` from the cache (text_hash, vector) and `cached`; texts that the cache lacks get zeros,
    to be replaced by whoever computes them. The cache holds one row a hash."""
    keyed = texts.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    known = cache.select("text_hash", F.col("vector").alias("known"))
    return keyed.join(known, "text_hash", "left").select(*texts.columns, F.col("known").isNotNull().alias("cached"), to_dims(F.col("known")).alias("vector"))


def write_vectors(memories: DataFrame, path: str) -> None:
    """Rows of the vector store (memory_id, user_id, content, valence, vector of DIMS) from memories, as Parquet."""
    rows = memories.select(F.col("id").alias("memory_id"), "user_id", F.left("content", F.lit(CONTENT)).alias("content"), "valence", to_dims(F.col("embedding")).alias("vector"))
    rows.write.mode("overwrite").parquet(path)
