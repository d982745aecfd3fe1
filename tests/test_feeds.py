"""Feeds: retries, breaker, a source that fails, and the same as a stream."""

import pytest
from pyspark.sql import functions as F

from memloom.sources import feeds
from memloom.sources.feeds import Breaker, BreakerOpen, Feed, with_retry


def pages(spark, n, first=0):
    return spark.range(first, first + n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), F.element_at(F.array(F.lit("a.org"), F.lit("a.org"), F.lit("b.org"), F.lit("c d.org")), (F.col("id") % 4 + 1).cast("int")), F.lit("/x")).alias("url"), F.lit("<p>").alias("html"))


def test_retry():
    waits, left = [], [3]

    def flaky():
        left[0] -= 1
        if left[0]:
            raise ValueError("again")
        return "got"

    assert with_retry(flaky, 3, 2, waits.append) == "got" and waits == [1, 2]
    left[0] = 9
    with pytest.raises(ValueError, match="again"):
        with_retry(flaky, 3, 2, waits.append)
    assert left[0] == 6


def test_breaker():
    now, calls = [0.0], [0]
    b = Breaker(5, 60, lambda: now[0])

    def bad():
        calls[0] += 1
        raise ValueError

    for _ in range(5):
        with pytest.raises(ValueError):
            b.call(bad)
    with pytest.raises(BreakerOpen):
        b.call(bad)
    assert calls[0] == 5
    now[0] = 61
    assert b.call(lambda: 1) == 1 and b.failed == 0
    with pytest.raises(ValueError):
        b.call(bad)
    assert b.call(lambda: 2) == 2


def test_all_sources(spark, tmp_path):
    path = feeds.publish(pages(spark, 40), f"file://{tmp_path}/f")
    got, failed = feeds.fan_in(feeds.read(spark, path))
    assert {(r.source, r["count"]) for r in got.groupBy("source").count().collect()} == {("a.org", 20), ("b.org", 10), ("c d.org", 10)}
    assert failed.collect() == []


def test_a_failing_source(spark, tmp_path):
    class FailingFeed(Feed):
        """One source never answers."""

        @classmethod
        def name(cls):
            return "failing_feed"

        def fetch(self, source, path):
            if source == "b.org":
                raise ConnectionError("no answer")
            yield from super().fetch(source, path)

    path = feeds.publish(pages(spark, 40), f"file://{tmp_path}/f")
    got, failed = feeds.fan_in(feeds.read(spark, path, FailingFeed, base=0))
    assert {(r.source, r["count"]) for r in got.groupBy("source").count().collect()} == {("a.org", 20), ("c d.org", 10)}
    (bad,) = failed.collect()
    assert bad.source == "b.org" and bad.failed >= 1 and bad.error == "ConnectionError: no answer"


def test_open_breaker_stops_asking(tmp_path):
    asked = []

    class Dead(Feed):
        def fetch(self, source, path):
            asked.append(path)
            raise OSError("down")

    feed = Dead({"path": "file:///", "tries": "2", "base": "0", "limit": "3"})
    rows = [r for b in feed.pages(feeds.Files("s", [f"p{i}" for i in range(6)])) for r in b.to_pylist()]
    assert len(rows) == 6 and len(asked) == 6 and [r["error"].split(":")[0] for r in rows] == ["OSError"] * 3 + ["BreakerOpen"] * 3


def test_stream(spark, tmp_path):
    path = feeds.publish(pages(spark, 12), f"file://{tmp_path}/f")
    spark.dataSource.register(Feed)

    def run():
        stream = spark.readStream.format("feed").option("path", path).load()
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.page_id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == list(range(12))
    feeds.publish(pages(spark, 8, 12), path)
    assert run() == list(range(20)) == run()


def test_no_pages(spark, tmp_path):
    assert feeds.read(spark, f"file://{tmp_path}/nothing").collect() == []
