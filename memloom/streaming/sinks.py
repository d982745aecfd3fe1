"""A sink for several tables that appear together or not at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def together(path: str, split: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. Each table of a batch goes to a folder of the batch's number, over whatever an earlier try left there; the batch is
    done when its marker is written, after all tables. So a batch that is tried again counts once, and one that broke in between counts not at all."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, rows in split(batch).items():
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
            batch.sparkSession.range(1).write.mode("overwrite").parquet(f"{path}/done/batch={number}")
        finally:
            batch.unpersist()

    return write


def done(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Table `name` of the batches that are done, with the number of its `batch`."""
    marks = spark.read.parquet(f"{path}/done").select("batch").distinct()
    return spark.read.parquet(f"{path}/{name}").join(F.broadcast(marks) if marks.count() < 1_000_000 else marks, "batch", "left_semi")
