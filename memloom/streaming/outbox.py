"""The outbox stream: windows over events and retry state. Keyed state in event-time order is in `state.py`.

Event time is the events' own `ts`; streams carry it as TIMESTAMP (watermarks reject TIMESTAMP_NTZ), in a
UTC session. All queries run with `availableNow` over files or continuously over any other source.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.sources.session import shared_dir

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """The event files of a folder as a stream (poll, at most so many files a trigger)."""
    pattern = f"{folder[:-1]}[{folder[-1]}]"  # a glob also where the path is a single file
    raw = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", "1 hour").groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"))


def sliding(events: DataFrame, size: str = "1 hour", step: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", "1 hour").groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def apply_batch(state: DataFrame, batch: DataFrame, retries: int = 5) -> DataFrame:
    """New outbox state from state and one batch of outcomes (event_id, outcome): pending events that
    succeeded are done; failures go back to pending until `retries`, then to the dead-letter queue."""
    last = batch.groupBy("event_id").agg(F.max_by("outcome", "seq").alias("outcome"))
    j = state.join(last, "event_id", "left")
    tries = F.when(F.col("outcome") == "failed", F.col("retry_count") + 1).otherwise(F.col("retry_count"))
    status = (
        F.when(F.col("outcome").isNull() | (F.col("status") != "pending"), F.col("status"))
        .when(F.col("outcome") == "ok", "done").when(tries >= retries, "dlq").otherwise("pending")
    )
    return j.select("event_id", status.alias("status"), F.when(F.col("status") == "pending", tries).otherwise(F.col("retry_count")).alias("retry_count"))


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What the stream gives for all input there is now (one run with availableNow), as a table."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/memloom/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
