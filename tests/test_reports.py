"""Answers, sketches, metrics and changed rows against values worked out by hand."""

import random

from pyspark.sql import functions as F

from memloom.functions import answers
from memloom.plans import reports
from memloom.streaming import state


def test_dates(spark):
    cases = {
        "on 2023-05-07 or 8 May 2023": "2023-05-07", "7 May 2023": "2023-05-07", "17 may, 2023!": "2023-05-17", "May 7, 2023": "2023-05-07", "DECEMBER 31 1999": "1999-12-31",
        "7 Foo 2023": None, "Foo 7, 2023": None, "no date": None, "": None, None: None, "7 Foo 2023, May 8, 2023": "2023-05-08",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", answers.iso_date(F.col("t")).alias("iso")).collect()
    assert {r.t: r.iso for r in rows} == cases


def test_exact_match(spark):
    cases = [
        ("7 May 2023", "May 7, 2023", 2, True), ("7 May 2023", "May 7, 2023", 1, False), ("7 May 2023", "it was 2023-05-08", 2, False), ("A  cat!", "a cat", 4, True), ("in May", "in  May.", 2, True),
        ("...", "!!", 1, False), (None, None, 2, False), ("x", None, None, False), ("Été", "été", None, True),
    ]
    rows = spark.createDataFrame([(a, b, c, w) for a, b, c, w in cases], "a string, b string, c int, want boolean")
    assert rows.where(answers.exact_match(F.col("a"), F.col("b"), F.col("c")) != F.col("want")).collect() == []


def test_questions_and_minutes(spark):
    rows = spark.createDataFrame([("你住在哪里",), ("我住在北京",), ("really? ",), ("really",), ("你认识他",)], "t string")
    assert [r[0] for r in rows.select(answers.is_question(F.col("t"))).collect()] == [True, False, True, False, True]
    times = spark.createDataFrame([("08:00",), ("23:59",), ("0:05",), ("24:00",), ("12:60",), ("noon",), (None,)], "t string")
    assert [r[0] for r in times.select(answers.minutes(F.col("t"))).collect()] == [480, 1439, 5, None, None, None, None]


def test_median(spark):
    """The lag sample whose median and 95 % point must hold the limits."""
    lags = [float(x) for x in (100, 150, 200, 180, 220, 500, 800, 1000, 1200, 5000, 10000, 25000)]
    rows = spark.createDataFrame([(x,) for x in lags] + [(None,)], "lag double")
    assert reports.median(rows, "lag").first()[0] == 650.0 < reports.P50_MS
    assert reports.median(rows.where("lag < 150"), "lag").first()[0] == 100.0
    assert reports.median(rows.where("lag < 0"), "lag").first()[0] is None


def test_sketches_keep_their_error(spark):
    rng = random.Random(9)
    lags = [(i, 1_704_067_200 + i % 3600, rng.paretovariate(1.2) * 100) for i in range(20_000)]
    rows = spark.createDataFrame(lags, "id long, s long, lag_ms double").select("id", F.timestamp_seconds("s").alias("ts"), "lag_ms")
    got = state.replayed(rows, lambda s: reports.lag_windows(s, "1 hour", "1 hour"), 2, "sketch").where("n > 0")
    got = got.select("n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.5, 0.95)]).collect()
    assert [r.n for r in got] == [20_000]
    values = sorted(x for _, _, x in lags)
    for q, v in ((0.5, got[0].q50), (0.95, got[0].q95)):
        assert abs(sum(x <= v for x in values) / len(values) - q) < 0.01


def test_changed_rows_are_dated(spark):
    old = spark.createDataFrame([(1, "a", "x", "2020"), (2, "b", None, "2020"), (3, "c", "z", "2020"), (4, None, "w", "2020")], "id long, status string, other string, updated_at string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (3, None), (4, "d"), (9, "new")], "id long, status string")
    got = sorted(map(tuple, reports.touched(old, new, "id", "2024").collect()))
    assert got == [(1, "a", "x", "2020"), (2, "B", None, "2024"), (3, "c", "z", "2020"), (4, "d", "w", "2024")]
