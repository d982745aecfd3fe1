"""Stores and streams, and rules against the values that the inventory's fixtures give."""

import json

import pytest
from pyspark.sql import functions as F

from memloom.plans import services
from memloom.sources import stores
from memloom.sources.adapters import DUCK, SPARK


def test_json_sessions(spark, tmp_path):
    data = [{"sample_id": "a", "sessions": [{"session": "1", "turns": [{"dia_id": "D1:1", "speaker": "x", "text": "hi"}, {"dia_id": "D1:2", "speaker": "y"}]}]}, {"sample_id": "b", "sessions": []}]
    (tmp_path / "d.json").write_text(json.dumps(data, indent=1))
    got = sorted(tuple(r) for r in stores.read_sessions(spark, str(tmp_path)).collect())
    assert got == [("a", "1", "D1:1", "x", "hi"), ("a", "1", "D1:2", "y", None)]


def test_score_sink(spark, tmp_path):
    stores.write_scores(spark.createDataFrame([(1, "c", 1.0), (2, "c", None), (3, "d", 0.0)], "id long, category string, score double"), str(tmp_path))
    assert spark.read.json(f"{tmp_path}/items").count() == 3
    assert {(r.category, r.n, r.evaluated, r.mean) for r in spark.read.json(f"{tmp_path}/report").collect()} == {("c", 2, 1, 1.0), ("d", 1, 1, 0.0)}


def test_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7, "x" * 5000, 0.5, [1.0, 2.0]), (2, 7, None, 0.0, None), (3, 7, "", 0.1, [1.0] * 2000)], "id long, user_id long, content string, valence double, embedding array<float>")
    stores.write_vectors(rows, f"{tmp_path}/v")
    got = {r.memory_id: r for r in spark.read.parquet(f"{tmp_path}/v").collect()}
    assert len(got[1].content) == 4096 and {len(r.vector) for r in got.values()} == {1024}
    assert got[1].vector[:3] == [1.0, 2.0, 0.0] and sum(got[2].vector) == 0 and sum(got[3].vector) == 1024
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id long, text string")
    cache = spark.createDataFrame([("a", [1.0])], "text string, vector array<float>").select(F.sha2("text", 256).alias("text_hash"), "vector")
    assert sorted((r.id, r.cached, r.vector[0]) for r in stores.embedded(texts, cache).collect()) == [(1, True, 1.0), (2, False, 0.0), (3, True, 1.0), (4, False, 0.0)]


@pytest.mark.parametrize("text, want", [("it is fine", "approved"), ("a secret thing", "rejected"), ("copyright 2020", "flagged"), ("jihad and copyright", "rejected")])
def test_safety_verdict(spark, text, want):
    assert spark.sql(f"SELECT {services.verdict('x')} AS v FROM VALUES ('{text}') t(x)").first().v == want


def test_weighted_valence(spark):
    row = spark.sql(f"SELECT {services.weighted('x', services.WEIGHTS_UP, services.EMOJI_UP)} AS p, {services.weighted('x', services.WEIGHTS_DOWN, services.EMOJI_DOWN)} AS n FROM VALUES ('开心又感谢😊') t(x)").first()
    assert (round(row.p, 6), row.n) == (1.7, 0)


@pytest.mark.parametrize("text, want", [("小明住在北京", ("小明", "LIVES_IN", "北京")), ("我的妈妈是王芳", ("我", "CHILD_OF", "王芳")), ("nothing here", None)])
def test_triples(spark, text, want):
    got = {(r.subject, r.rel, r.object) for r in spark.sql(services.triples(SPARK, f"(SELECT 1 AS id, '{text}' AS content) s", "id", "content")).collect()}
    assert (want in got) if want else not got


def test_support_check():
    import duckdb

    ask = lambda a, e, q: duckdb.sql(f"SELECT {services.supported(DUCK, 'a', 'e', 'q')} FROM (SELECT '{a}' AS a, '{e}' AS e, '{q}' AS q) z").fetchall()[0][0]
    assert ask("in 2021", "it was 2020", "which year") == "Unknown" and ask("in 2020", "it was in 2020", "which year") == "in 2020"
    assert ask("a red house", "the blue house", "what") == "Unknown" and ask("I am unknown", "x", "") == "I am unknown" and ask("abc", "", "") == "abc"


def test_value_at(spark):
    """The lags of the inventory's fixture, and a bracket that narrows."""
    from memloom.operators.ranking import value_at

    lags = spark.createDataFrame([(float(v),) for v in (100, 150, 200, 180, 220, 500, 800, 1000, 1200, 5000, 10000, 25000)], "lag double")
    p50 = value_at(lags, "lag", "v", lambda n: n // 2 + 1).first().v
    p95 = value_at(lags, "lag", "v", lambda n: min(int(n * 0.95) + 1, n)).first().v
    assert p50 < 2000 and p95 < 30000 and (p50, p95) == (800.0, 25000.0)
    rows = spark.range(100_000).selectExpr("(id * 7919) % 100000 AS v")
    for want in (1, 777, 50_000, 100_000):
        assert value_at(rows, "v", "v", lambda n, k=want: k, few=500).first().v == want - 1
    assert value_at(lags.where("lag < 0"), "lag", "v", lambda n: 1).count() == 0
