"""Every registered query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from memloom import plans
from memloom.sources.adapters import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(data, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    show = lambda v: "<null>" if v is None else str(v) if isinstance(v, bool) or not isinstance(v, int | float) else repr(round(float(v), 5) + 0.0)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("key", sorted(plans.ORACLE))
def test_matches_sql(spark, duck, key):
    df = plans.QUERIES[key](spark, SF)
    got = duck.execute(plans.ORACLE[key])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(got.fetchall(), cols)


def test_diversify_limits(spark):
    from memloom.operators.folds import diversify

    data = [(1, i, f"s{i % 2}", "t", 1.0 - i / 10) for i in range(6)]
    out = diversify(spark.createDataFrame(data, "user_id long, id long, source string, tag string, score double"), 3, 1, 2).collect()
    assert [(r.rank, r.id) for r in sorted(out, key=lambda r: r.rank)] == [(1, 0), (2, 1)]


def test_outbox_batch(spark):
    from memloom.streaming.outbox import apply_batch

    state = spark.createDataFrame([(1, "pending", 0), (2, "pending", 4), (3, "done", 1), (4, "pending", 0)], "event_id long, status string, retry_count int")
    batch = spark.createDataFrame([(1, "ok", 1), (2, "failed", 1), (3, "failed", 1)], "event_id long, outcome string, seq int")
    assert {tuple(r) for r in apply_batch(state, batch).collect()} == {(1, "done", 0), (2, "dlq", 5), (3, "done", 1), (4, "pending", 0)}


def test_stream_equals_batch(spark, tmp_path):
    from memloom.streaming import outbox

    (spark.range(200).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id * 7 as int),0) as ts", "id % 5 as user_id", "'click' as event_type", "cast(id as double) as value")
        .write.parquet(str(tmp_path / "e")))
    q = outbox.tumbling(outbox.read_events(spark, str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from tumbled").first()[0] == 200


def test_global_rank_ties_and_nulls(spark):
    from memloom.operators.ranking import global_rank

    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 2 END AS v", "id")
    got = {r.id: r.p for r in global_rank(rows, ["v", "id"], "p", bounds=7).collect()}
    want = sorted(range(5000), key=lambda i: (-1 if i % 3 == 0 else i % 2, i))
    assert got == {i: p + 1 for p, i in enumerate(want)}
    assert global_rank(rows.where("id < 0"), ["v", "id"], "p").collect() == []
