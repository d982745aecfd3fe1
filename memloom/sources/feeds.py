"""Feeds as a Spark data source, in batch and as a stream: one fetch a file of a source, with retries, a circuit breaker and a fan-in that outlives a failed source.

`Feed` reads folders `source=<name>` of Parquet files (what `publish` writes, in the shared folder that every executor reaches); a deployment overrides `fetch` with
its own client. A fetch is tried `tries` times, with `base` ** attempt seconds in between; after `limit` failures in a row a source's breaker stays open for `rest`
seconds and its fetches fail at once. A fetch that fails gives one row with its `error` and no page, so the other sources go on.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from memloom.sources.session import shared_dir

SCHEMA = "source string, page_id long, url string, html string, error string"
_ARROW = pa.schema([("source", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("error", pa.string())])


class BreakerOpen(Exception):
    pass


class Breaker:
    """Lets calls through until `limit` have failed in a row; then none for `rest` seconds, and after that one as a trial."""

    def __init__(self, limit: int = 5, rest: float = 60, clock: Callable[[], float] = time.monotonic):
        self.limit, self.rest, self.clock, self.failed, self.since = limit, rest, clock, 0, 0.0

    def call(self, f: Callable):
        if self.failed >= self.limit and self.clock() - self.since < self.rest:
            raise BreakerOpen(f"closed off after {self.failed} failures")
        try:
            got = f()
        except Exception:
            self.failed, self.since = self.failed + 1, self.clock()
            raise
        self.failed = 0
        return got


def with_retry(f: Callable, tries: int = 3, base: float = 2, wait: Callable[[float], None] = time.sleep):
    """f(), tried again after base ** attempt seconds; the last failure is raised."""
    for attempt in range(tries):
        try:
            return f()
        except Exception:
            if attempt == tries - 1:
                raise
            wait(base**attempt)


class Files(InputPartition):
    def __init__(self, source: str, paths: list[str]):
        self.source, self.paths = source, paths


class Feed(DataSource):
    """Options: path; tries, base, limit, rest (above); files, how many files of a source are one task."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self)

    def number(self, key: str, default: float) -> float:
        return float(self.options.get(key, default))

    def listed(self) -> list[tuple[int, str, str]]:
        """(time written, path, source) of every file, in that order."""
        fs, root = pa.fs.FileSystem.from_uri(self.options["path"])
        found = fs.get_file_info(pa.fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = [f for f in found if f.is_file and not f.base_name.startswith((".", "_"))]
        return sorted((f.mtime_ns or 0, f.path, unquote(f.path.rsplit("/source=", 1)[1].split("/", 1)[0])) for f in files if "/source=" in f.path)

    def tasks(self, files: list[tuple[int, str, str]]) -> list[Files]:
        each, by = int(self.number("files", 8)), {}
        for _, path, source in files:
            by.setdefault(source, []).append(path)
        return [Files(s, p[i : i + each]) for s, p in by.items() for i in range(0, len(p), each)]

    def fetch(self, source: str, path: str) -> Iterator[pa.RecordBatch]:
        """page_id, url, html of one file."""
        fs, _ = pa.fs.FileSystem.from_uri(self.options["path"])
        yield from pa.parquet.ParquetFile(path, filesystem=fs).iter_batches(columns=["page_id", "url", "html"], batch_size=1000)

    def pages(self, task: Files) -> Iterator[pa.RecordBatch]:
        breaker = Breaker(int(self.number("limit", 5)), self.number("rest", 60))
        for path in task.paths:
            try:
                got = breaker.call(lambda path=path: with_retry(lambda: list(self.fetch(task.source, path)), int(self.number("tries", 3)), self.number("base", 2)))
            except Exception as e:  # a failed fetch is a row, whatever its kind
                yield pa.RecordBatch.from_pylist([{"source": task.source, "page_id": None, "url": None, "html": None, "error": f"{type(e).__name__}: {e}"}], _ARROW)
                continue
            for b in got:
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([task.source] * n, pa.string()), b["page_id"].cast(pa.int64()), b["url"].cast(pa.string()), b["html"].cast(pa.string()), pa.nulls(n, pa.string())], schema=_ARROW)


class _Batch(DataSourceReader):
    def __init__(self, feed: Feed):
        self.feed = feed

    def partitions(self) -> list[Files]:
        return self.feed.tasks(self.feed.listed()) or [Files("", [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.feed.pages(partition)


class _Stream(DataSourceStreamReader):
    """Offsets are the time and path of the last file taken."""

    def __init__(self, feed: Feed):
        self.feed = feed

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.feed.listed()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        at = lambda o: (o["time"], o["path"])
        return self.feed.tasks([f for f in self.feed.listed() if at(start) < f[:2] <= at(end)])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.feed.pages(partition)

    def commit(self, end: dict) -> None:
        pass


def publish(pages: DataFrame, path: str | None = None) -> str:
    """Write pages (page_id, url, html) by the host of their address, adding to what is there; the folder. A large host is split over tasks."""
    path = path or f"{shared_dir(pages.sparkSession)}/memloom/feeds-{uuid.uuid4().hex}"
    rows = pages.select("page_id", "url", "html", F.coalesce(F.nullif(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("")), F.lit("none")).alias("source"))
    rows.hint("rebalance", "source").write.mode("append").partitionBy("source").parquet(path)
    return path


def read(spark: SparkSession, path: str, feed: type[Feed] = Feed, **options) -> DataFrame:
    spark.dataSource.register(feed)
    return spark.read.format(feed.name()).option("path", path).options(**options).load()


def fan_in(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, failures by source) of all sources."""
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL").groupBy("source").agg(F.count("*").alias("failed"), F.min("error").alias("error"))
