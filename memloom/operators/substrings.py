"""Substring joins by an index of q-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZES = (1, 2, 4, 8, 16)


def _windows(text: str, sizes: list[int]) -> F.Column:
    """The distinct substrings of the given sizes."""
    of = lambda g: F.when(F.length(text) >= g, F.transform(F.sequence(F.lit(1), F.length(text) - (g - 1)), lambda i: F.substring(F.col(text), i, F.lit(g)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[of(g) for g in sizes])))


def contains_join(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """needle, hay: every pair of distinct texts of which the second contains the first. Null and empty texts take no part.

    A needle is looked up by the rarest of its grams, whose size is the largest of 1, 2, 4, 8 and 16 that fits into it, so a gram covers half
    of it or more (up to 32 letters); a needle with a gram that no text has is dropped. What is left is checked. No pairs but those that share a rarest gram are made.
    Spark takes the grams for as large as the column they come from, so the joins ask for a merge: a broadcast of them would fill the driver."""
    needles = needles.where("needle <> ''").select("needle").distinct()
    hay = hay.where("hay <> ''").select("hay").distinct()
    size = F.coalesce(*[F.when(F.length("needle") >= g, F.lit(g)) for g in reversed(SIZES)])
    needles = needles.withColumn("size", size)
    sizes = sorted(r[0] for r in needles.select("size").distinct().collect())  # five at most
    if not sizes:
        return needles.select("needle").join(hay.limit(0), F.lit(True), "inner")
    grams = hay.select("hay", F.explode(_windows("hay", sizes)).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("n"))
    own = needles.select("needle", F.explode(F.coalesce(*[F.when(F.col("size") == g, _windows("needle", [g])) for g in sizes])).alias("gram"))
    rarest = (
        own.join(often.hint("merge"), "gram", "left").groupBy("needle").agg(F.count("*").alias("all"), F.count("n").alias("known"), F.min(F.struct("n", "gram")).alias("least"))
        .where(F.col("all") == F.col("known")).select("needle", F.col("least.gram").alias("gram"))
    )
    return rarest.join(grams.hint("merge"), "gram").where(F.contains("hay", "needle")).select("needle", "hay")


def contains_either_way(queries: DataFrame, names: DataFrame) -> DataFrame:
    """query, name: pairs of texts of which one contains the other."""
    q, n = queries.select("query"), names.select("name")
    inside = contains_join(q.withColumnRenamed("query", "needle"), n.withColumnRenamed("name", "hay")).select(F.col("needle").alias("query"), F.col("hay").alias("name"))
    around = contains_join(n.withColumnRenamed("name", "needle"), q.withColumnRenamed("query", "hay")).select(F.col("hay").alias("query"), F.col("needle").alias("name"))
    return inside.unionByName(around).distinct()
