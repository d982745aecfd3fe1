"""Keyed streams give the same rows in 1, 3 and 10 micro-batches, with late files; their state ends; twin tables appear together."""

import random

import pytest
from pyspark.sql import functions as F

from memloom.streaming import state
from memloom.streaming.sinks import done, together

MIN = 60_000_000
T0 = 1_704_067_200_000_000  # 2024-01-01


@pytest.fixture(scope="module")
def events(spark):
    """Bursts, equal times and long pauses for a few keys; a column that names the file each row comes in, up to 20 minutes late."""
    rng = random.Random(8)
    rows, us = [], T0
    for i in range(240):
        us += rng.choice([0, 0, MIN // 2, MIN, 7 * MIN, 90 * MIN])
        rows.append((i, us, rng.choice(["a", "a", "b", "c"]), us + rng.choice([0, 0, 19 * MIN])))
    df = spark.createDataFrame(rows, "id long, us long, who string, comes long")
    return df.select(F.timestamp_micros("us").alias("ts"), "id", "who", "comes"), sorted((u, i, w) for i, u, w, _ in rows)


def parts(n):
    """Predicates that cut the rows by the time they come, so that some come after younger ones."""
    span = 240 * 16 * MIN
    cut = [T0 + span * k // n for k in range(n + 1)]
    return [(F.col("comes") >= (cut[k] if k else 0)) & (F.col("comes") < (cut[k + 1] if k < n - 1 else 1 << 62)) for k in range(n)]


def stream(spark, events, n, rule, kept, out, row="us long, id long", extra=()):
    rows = events.select("ts", "id", "who", "comes", *extra)
    return state.replayed(rows, lambda s: state.in_order(s, ["who"], rule, row, kept, out, delay="1 hour"), parts(n), "test")


def fold(rule, rows):
    """The rule over one key's rows in order, without Spark."""
    import heapq

    by, out = {}, []
    for us, i, who in rows:
        by.setdefault(who, []).append((us, i))
    for who, heap in by.items():
        kept = None
        heapq.heapify(heap)
        while heap:
            row = heapq.heappop(heap)
            if kept is not None and rule.ends(kept) is not None and rule.ends(kept) <= row[0]:
                out += [(who, *r) for r in rule.ended((who,), kept)]
                kept = None
            kept, rows_out, more = rule.step((who,), kept, row)
            out += [(who, *r) for r in rows_out]
            for r in more:
                heapq.heappush(heap, r)
        if kept is not None and rule.ends(kept) is not None:
            out += [(who, *r) for r in rule.ended((who,), kept)]
    return sorted(out)


RULES = {
    "once": (state.Once(600), "since long", "event long"),
    "counted": (state.Counted(600), "last long, n long", "event long, n long"),
    "sessions": (state.Sessions(600), "since long, last long, n long", "since long, last long, n long"),
    "polls": (state.Polls(30, 2), "last long, taken long", "event long, poll long"),
}


@pytest.mark.parametrize("name", sorted(RULES))
def test_any_cut_gives_the_fold(spark, events, name):
    df, rows = events
    rule, kept, out = RULES[name]
    want = fold(rule, rows)
    for n in (1, 3, 10) if name == "once" else (3,):
        got = stream(spark, df, n, rule, kept, out)
        assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 10


def test_state_ends(spark, events):
    df, _ = events
    rule, kept, out = RULES["sessions"]
    got = stream(spark, df, 3, rule, kept, out)
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in got._progress if p["stateOperators"]]
    assert max(totals) > 0 and totals[-1] == 0


def test_walk_in_any_cut(spark, events):
    df, rows = events
    step = (F.col("id") % 7 - 3).cast("double") / 4
    want, x = {}, {}
    for _, i, who in rows:
        x[who] = min(1.0, max(0.0, x.get(who, 0.5) + (i % 7 - 3) / 4))
        want[i] = round(x[who], 9)
    for n in (10,):
        got = stream(spark, df, n, state.Walk(0.0, 1.0, 0.5), "x double", "event long, x double", "us long, id long, m double, c double", [F.lit(1.0).alias("m"), step.alias("c")])
        assert {r.event: round(r.x, 9) for r in got.collect()} == want


def test_polls_take_a_hundred_at_most():
    rule, kept, got = state.Polls(30, 100), None, []
    for i in range(350):
        kept, rows, _ = rule.step((), kept, (T0 + 1, i))
        got += rows
    first = -(-(T0 + 1) // 30_000_000)
    assert [p for _, p in got] == [first + k // 100 for k in range(350)]
    assert rule.step((), None, (30_000_000 * 5, 1))[1] == [(1, 5)]


def test_attempts_back_off():
    rule, due, told = state.Attempts(), [(0, 1, 9, 1, 0), (0, 2, 9, 0, 0), (0, 3, 2, 1, 0)], []
    while due:
        _, rows, more = rule.step((), None, due.pop(0))
        told += rows
        due = sorted(due + more)
    last = {e: (a, s, us // 1_000_000) for e, a, s, us in told}
    assert last == {1: (5, "dlq", 31), 2: (5, "pending_review", 31), 3: (2, "done", 3)}
    assert [us // 1_000_000 for e, _, _, us in told if e == 1] == [0, 1, 3, 7, 15, 31]


def test_a_batch_counts_once(spark, tmp_path):
    path = f"file://{tmp_path}/twins"
    write = together(path, lambda b: {"memories": b.select("id"), "events": b.selectExpr("id", "id * 2 AS twice")})
    write(spark.range(5), 0)
    write(spark.range(5, 9), 1)
    write(spark.range(5, 9), 1)  # tried again
    assert sorted(r.id for r in done(spark, path, "memories").collect()) == list(range(9))

    def broken(b):
        return {"memories": b.select("id"), "events": b.selectExpr("raise_error('no') AS id", "1L AS twice")}

    with pytest.raises(Exception, match="no"):
        together(path, broken)(spark.range(20, 30), 2)
    both = lambda: (done(spark, path, "memories").count(), done(spark, path, "events").count())
    assert both() == (9, 9)
    write(spark.range(20, 30), 2)
    assert both() == (19, 19)


def test_late_rows_are_dropped_once_the_watermark_is_past(spark, events):
    df, rows = events
    late = F.col("id") == 0
    got = state.replayed(df, lambda s: state.in_order(s, ["who"], state.Once(1), "us long, id long", "since long", "event long"), [~late, late], "late")
    assert 0 not in {r.event for r in got.collect()}


def test_empty_table(spark, events):
    rule, kept, out = RULES["once"]
    assert stream(spark, events[0].where("id < 0"), 1, rule, kept, out).collect() == []
    assert state.replayed(events[0].where("id < 0"), lambda s: state.in_order(s, ["who"], rule, "us long, id long", kept, out)).collect() == []
