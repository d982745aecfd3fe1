"""Recommendations, opposed statements and the graph's history on small inputs with values worked out by hand or by plain enumeration."""

import datetime
import math
import random

from memloom.plans import composites
from memloom.plans.catalog import CATALOG
from memloom.sources.adapters import SPARK


def test_tea(spark):
    """The three statements about tea: the second opposes the first and the third."""
    memo = spark.createDataFrame([(1, 7, "我喜欢茶"), (2, 7, "我讨厌茶"), (3, 7, "我喜欢淡淡的茶"), (4, 8, "我讨厌茶"), (5, 7, "我讨厌咖啡"), (6, 7, None), (7, 7, "茶")], "id long, owner long, content string")
    said = composites.statements(memo, composites.OPPOSITES, composites.TOPICS)
    assert [tuple(r) for r in composites.sides(said).collect()] == [(7, "茶", 0, 1, 2, 2, 1)]
    assert sorted((r.id, r.side, r.n_opposed) for r in composites.opposed(said).collect()) == [(1, 0, 1), (2, 1, 2), (3, 0, 1)]


def test_a_memory_on_both_sides(spark):
    memo = spark.createDataFrame([(1, 1, "不喜欢茶")], "id long, owner long, content string")
    said = composites.statements(memo, composites.OPPOSITES, composites.TOPICS)
    assert {(r.pair, r.side) for r in said.collect()} == {(0, 0), (1, 0), (1, 1)}
    assert composites.sides(said).collect() == [] == composites.opposed(said).collect()
    more = said.union(spark.createDataFrame([(2, 1, "茶", 1, 0)], said.schema))
    assert sorted((r.id, r.side, r.n_opposed) for r in composites.opposed(more).collect()) == [(1, 1, 1), (2, 0, 1)]


def test_timeline(spark):
    rng = random.Random(2)
    start, end = datetime.date(2024, 1, 1), datetime.date(2024, 3, 1)
    edges = [(rng.choice([0.05, 0.1, 0.3, 0.9]), rng.choice([0.0, 0.01, 0.05, 0.5]), datetime.datetime(2023, 11, 1) + datetime.timedelta(days=rng.randrange(150), hours=rng.choice([0, 0, 7]))) for _ in range(200)]
    got = {r.day: (r.edges, round(r.weight, 6)) for r in composites.timeline(spark.createDataFrame(edges, "weight double, decay_rate double, updated_at timestamp_ntz"), start, end).collect()}
    want = {}
    for k in range((end - start).days + 1):
        day = datetime.datetime.combine(start, datetime.time()) + datetime.timedelta(days=k)
        alive = [w * math.exp(-r * (day - u).days) for w, r, u in edges if u <= day]
        alive = [w for w in alive if w > 0.1]
        want[day.date()] = (len(alive), round(sum(alive), 6))
    assert got == want
    none = composites.timeline(spark.createDataFrame([], "weight double, decay_rate double, updated_at timestamp_ntz"), start, start)
    assert [tuple(r) for r in none.collect()] == [(start, 0, 0.0)]


def test_recommend(spark):
    users = spark.createDataFrame([(1, None), (2, ["b"])], "user_id long, sources array<string>")
    wanted = spark.createDataFrame([(1, "tea"), (1, "news"), (2, "tea")], "user_id long, tag string")
    rows = [(10, "a", "tea", ["tea", "news"], 1.0, 0.5), (11, "a", "tea", ["tea"], 1.0, 0.9), (12, "b", "tea", ["tea"], 2.0, 0.5), (13, "b", "cup", ["cup"], 1.0, 0.6), (14, "c", "tea", [], None, 0.1), (15, None, "x", None, 3.0, 0.2)]
    content = spark.createDataFrame(rows, "id long, source string, main_tag string, tags array<string>, hours double, quality_score double")
    history = spark.createDataFrame([(2, 12)], "user_id long, id long")
    score = lambda n, h, q: 0.5 * 0.3 * min(n / 3, 1) + 0.3 * (math.exp(-0.05 * h) if h is not None else 0.5) + 0.2 * q
    assert score(1, 1.0, 0.9) > score(2, 1.0, 0.5) > score(0, 1.0, 0.6) > score(1, 2.0, 0.5) * 0.3
    got = sorted(map(tuple, composites.recommend(users, wanted, content, history).collect()))
    # one of a source: for 1 the best of a, then of b (12 before 13 by its tag), then no source; for 2 the other of b
    assert score(1, 2.0, 0.5) > score(0, 1.0, 0.6) and got == [(1, 1, 11), (1, 2, 12), (1, 3, 15), (2, 1, 13)]


def test_interests_are_filled_up(spark):
    rows = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.4), (2, "c", 0.1)] + [(3, f"t{i:02}", 0.6) for i in range(12)], "user_id long, tag string, weight double")
    got = {}
    for r in composites.interests(rows).collect():
        got.setdefault(r.user_id, []).append(r.tag)
    assert sorted(got[1]) == sorted(["a", "科技", "生活"]) and sorted(got[2]) == sorted(["科技", "生活", "新闻"]) and sorted(got[3]) == [f"t{i:02}" for i in range(10)]


def over(spark, key, name, sql):
    """A catalog query over one view that is given here."""
    return spark.sql(f"WITH {name} AS ({sql}) {CATALOG[key](SPARK)}").collect()


def test_declining_and_archive(spark):
    """30 points, 7 days; a declining meme of 30 days is archived; only approved ones."""
    row = "SELECT {} AS id, '{}' AS status, {} AS popularity_score, TIMESTAMP_NTZ '2024-01-30 00:00:00' AS first_seen_at"
    sql = " UNION ALL ".join(row.format(*x) for x in [(8, "approved", "10D"), (6, "approved", "10D"), (9, "approved", "40D"), (30, "approved", "90D"), (25, "approved", "1D"), (37, "candidate", "1D"), (38, "approved", "33D")])
    assert {r.id: r.action for r in over(spark, "st18_declining", "memes", sql)} == {8: "declining", 6: "keep", 9: "keep", 30: "archive", 25: "keep", 37: "keep", 38: "declining"}


def test_time_difference_is_rounded_down(spark):
    """Ten hours later is the same day, ten hours earlier is not: whole days are rounded down before their size is taken."""
    row = "SELECT {} AS id, TIMESTAMP_NTZ '2024-01-10 {}:00:00' AS created_at"
    sql = " UNION ALL ".join(row.format(*x) for x in [(0, 20), (15, 10), (1, 10), (16, 20), (2, 10), (17, 10)])
    assert {r.first_id: r.verdict for r in over(spark, "v5_resolve_by_time", "memories", sql)} == {0: "clarify", 1: "second", 2: "clarify"}


def test_timeline_reads_the_edges_once(spark, monkeypatch, tmp_path):
    """A union of the edges that come and those that go, read again for the rates, made the distinct edges four times."""
    scans, real = [], composites.staged

    def keep(df, name):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("parquet"))
        return real(df, name)

    monkeypatch.setattr(composites, "staged", keep, raising=False)
    spark.createDataFrame([(0.9, 0.01, datetime.datetime(2024, 1, 2)), (0.3, 0.5, datetime.datetime(2024, 1, 1, 7))], "weight double, decay_rate double, updated_at timestamp_ntz").write.parquet(str(tmp_path / "e"))
    day = datetime.date(2024, 1, 1)
    got = composites.timeline(spark.read.parquet(str(tmp_path / "e")), day, day + datetime.timedelta(days=2))
    assert [r.edges for r in got.orderBy("day").collect()] == [0, 2, 2] and scans == [1]


def test_candidates_are_listed_by_choice_and_not_by_user(spark, monkeypatch):
    """Each user's hundred candidates were rows of their own and sorted three times: one task took most of them, as few pools are asked for."""
    sizes, real = {}, composites.staged

    def keep(df, name):
        sizes[name] = real(df, name)
        return sizes[name]

    monkeypatch.setattr(composites, "staged", keep)
    users = spark.range(500).selectExpr("id AS user_id", "CASE id % 3 WHEN 0 THEN array('b', 'a') WHEN 1 THEN array('a', 'b', 'a') END AS sources")
    content = spark.range(150).selectExpr("id", "concat('s', id % 5) AS source", "'t' AS main_tag", "array('t') AS tags", "CAST(id AS DOUBLE) AS hours", "0.5D AS quality_score").unionByName(
        spark.createDataFrame([(900, "a", "x", None, 1.0, 0.9), (901, "b", "y", ["y"], None, 0.1)], "id long, source string, main_tag string, tags array<string>, hours double, quality_score double")
    )
    wanted, history = spark.createDataFrame([(2, "t")], "user_id long, tag string"), spark.createDataFrame([(0, 900), (0, 900), (5, 7)], "user_id long, id long")
    got = {}
    for r in composites.recommend(users, wanted, content, history).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append(r.id)
    assert sizes["lists"].count() == 2 and len(got) == 500
    assert got[0] == [901, 900] and got[1] == [900, 901] == got[3] and got[2] == got[5] == got[8] == [900, 0, 1]
