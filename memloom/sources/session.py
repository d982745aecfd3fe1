"""Session helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers. Where the repository is already on PYTHONPATH
    (or is the working directory) there is nothing to do; else it goes along as a py-file, once."""
    on_path = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    sc = spark.sparkContext
    if str(ROOT) in on_path or getattr(sc, "_memloom_shipped", False):
        return spark
    bundle = Path(tempfile.mkdtemp(prefix="memloom-src-")) / "memloom_src.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for p in sorted((ROOT / "memloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(bundle))
    sc._memloom_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A session on this machine alone may leave it unset and gets
    a temporary one; on a cluster that is an error, as executors would not see each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_memloom_dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = spark.sparkContext._memloom_dir = f"file://{tempfile.mkdtemp(prefix='memloom-')}"
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: what several later steps read is computed once, and a lost
    executor costs a re-read."""
    path = f"{shared_dir(df.sparkSession)}/memloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads, and release."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, which it does when the driver collects its garbage; they would else stay until the end."""
    gc.collect()
    spark._jvm.System.gc()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and bench.py; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MEMLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
