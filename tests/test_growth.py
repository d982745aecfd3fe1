"""What must hold for larger tables, shown on small ones."""

from __future__ import annotations

import random
from pathlib import Path

import pandas as pd
import pytest

from memloom.operators import graph
from memloom.operators.substrings import contains_either_way
from memloom.plans import retrieval
from memloom.sources import session
from memloom.streaming import state


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _read(spark, path, rows, schema):
    """rows from a file: of those Spark knows the size."""
    spark.createDataFrame(rows, schema).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_grams_are_never_broadcast(spark, tmp_path):
    """Explode multiplies rows, but Spark estimates the size of its input: under the usual threshold the grams of a few MB of names went through the driver."""
    queries, names = _read(spark, tmp_path / "q", [("ring",), ("large ring 1",)], "query string"), _read(spark, tmp_path / "n", [("large ring",), ("ring",)], "name string")
    got = contains_either_way(queries, names)
    assert "BroadcastExchange" not in _plan(got)
    assert sorted(map(tuple, got.collect())) == [("large ring 1", "large ring"), ("large ring 1", "ring"), ("ring", "large ring"), ("ring", "ring")]


def test_walks_are_never_broadcast(spark, tmp_path):
    edges = _read(spark, tmp_path / "e", [("c1", "n1", "A", 0.5), ("n1", "r1", "B", 0.4), ("s1", "n1", "A", 0.9)], "src string, dst string, rel string, weight double")
    names = _read(spark, tmp_path / "k", [("c1", "one"), ("n1", "land"), ("r1", "part of the world"), ("s1", "seller")], "node string, name string")
    roots = spark.createDataFrame([("one", "c1", 1)], "query string, node string, at int")
    got = graph.facts_at(roots, graph.entity_facts(edges, names, asked=roots))
    assert "BroadcastExchange" not in _plan(got)
    want = [("one", 1, "one", "A", "land", 0.5), ("one", 2, "one", "A -> land -> B", "part of the world", 0.2)]
    assert sorted(map(tuple, got.collect())) == want
    every = graph.entity_facts(edges, names)
    assert sorted(map(tuple, graph.facts_at(roots, every).collect())) == want


class _List:
    def __init__(self, calls):
        self.rows, self.calls = [], calls

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls.append("get")
        return iter(list(self.rows))

    def put(self, rows):
        self.calls.append("put")
        self.rows = list(rows)

    def appendList(self, rows):
        self.calls.append("append")
        self.rows += rows

    def clear(self):
        self.rows = []


class _Handle:
    def __init__(self):
        self.calls, self.timers = [], []

    def getListState(self, name, schema):
        return _List(self.calls)

    def registerTimer(self, at):
        self.timers.append(at)


class _Until:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_state_store_is_asked_by_shard_and_not_by_key():
    handle, rule = _Handle(), state.Once(10)
    made = state.InOrder(rule, "us long, id long", "since long", ["key__", "id"], ["us", "id"])
    made.init(handle)
    rows = pd.DataFrame([(i * 1000 + 5_000_000, i, f"k{i % 500}") for i in range(1000)], columns=["us", "id", "key__"])
    made.handleInputRows((0,), iter([rows]), _Until(0))
    got = pd.concat(made.handleExpiredTimer((0,), _Until(10_000), None))
    assert sorted(got["id"]) == list(range(500)) and len(handle.calls) <= 5
    assert not list(made.handleExpiredTimer((0,), _Until(60_000), None)) and not made.kept.rows and not made.pending.rows


def test_shards_go_with_the_table(spark):
    assert state.shards(spark.range(10)) == 64 and state.shards(spark.range(1_000_001)) == 101


def test_vector_search_asks_all_users(spark):
    """r2 had been narrowed to the query's own user: a 15th of the memories."""
    import __spark_entry__

    got = __spark_entry__.queries()["r2_vector_search"](spark, "/root/testdata/sf0.001").select("query_id", "id").collect()
    assert any(r.query_id // 20 % 15 != r.id % 15 for r in got)
    assert "m.user_id = q.vec_id" not in __spark_entry__.oracle_sql()["r2_vector_search"]


def test_only_candidates_before_the_bar_are_shuffled(spark):
    rows = spark.createDataFrame([("a", 0.5, 0.4, "m"), ("b", 0.4, 0.4, "m"), ("z", 0.4, 0.4, "m"), ("c", 0.3, 0.4, "m"), ("d", 0.3, None, None)], "target string, w double, _bar double, _last string")
    assert sorted(r.target for r in graph.within(rows).collect()) == ["a", "b", "d"]


@pytest.mark.parametrize("weights", [[0.9], [0.5, 0.7, 0.9, 1.0], [i / 97 for i in range(20, 97)]])
def test_neighbours_in_two_passes(spark, weights):
    """Lists longer than their head, ties and short lists: as with every path made."""
    rng = random.Random(7)
    edges = {(f"n{rng.randrange(8)}", f"m{rng.randrange(60)}"): rng.choice(weights) for _ in range(250)}
    side: dict = {}
    for (a, b), w in edges.items():
        side.setdefault(a, {})[b] = side.setdefault(b, {})[a] = w
    reach = {v: {t: (w, -1) for t, w in far.items()} for v, far in side.items()}
    level = {v: {t: w for t, w in far.items()} for v, far in side.items()}
    for d in (2, 3):
        level = {v: {t: max(w * level[u][t] for u, w in far.items() if t in level[u]) for t in {t for u in far for t in level[u]} if t != v} for v, far in side.items()}
        for v, far in level.items():
            for t, w in far.items():
                if w > 0.1:
                    reach[v][t] = max(reach[v].get(t, (0, 0)), (w, -d))
    want = [(v, t, round(w, 9), rn) for v, far in reach.items() for rn, (t, (w, _)) in enumerate(sorted(far.items(), key=lambda x: (-round(x[1][0], 9), x[0]))[:10], 1)]
    rows = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, w double")
    got = [(r.node, r.target, round(r.w, 9), r.rn) for r in graph.best_neighbours(rows, 3, 0.1, 10, 3).collect()]
    assert sorted(got) == sorted(want)


def test_neighbours_leave_one_table_and_shuffle_nothing_more(spark):
    """Every round's tables stayed on disk, and the last lists, ranked already, were shuffled and ranked again."""
    folder = Path(session.shared_dir(spark).removeprefix("file://")) / "memloom"
    before = set(folder.glob("*"))
    rows = spark.createDataFrame([(f"n{i % 3}", f"m{i}", 0.9) for i in range(90)], "src string, dst string, w double")
    got = graph.best_neighbours(rows, 3, 0.1, 10, 3)
    assert [p.name.split("-")[0] for p in set(folder.glob("*")) - before] == ["hop3"]
    assert "Exchange" not in _plan(got) and "Window" not in _plan(got)
    assert {(r.node, r.rn) for r in got.collect()} == {(v, rn) for v in {f"n{i}" for i in range(3)} | {f"m{i}" for i in range(90)} for rn in range(1, 11)}


def test_an_edge_is_shuffled_once_for_both_its_ends(spark):
    rows = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.7), ("a", "a", 0.9), ("c", "a", 0.1), ("c", None, 0.9), ("b", "c", 0.4)], "src string, dst string, w double")
    links = graph.undirected(rows, 0.1)
    assert sorted(map(tuple, links.collect())) == [("a", "b", 0.7), ("b", "a", 0.7), ("b", "c", 0.4), ("c", "b", 0.4)]
    assert "Union" not in _plan(links)


def test_only_wanted_mentions_are_made_distinct(spark):
    found = spark.createDataFrame([(20, 3), (20, 4)], "query_id long, id long")
    mentions = spark.createDataFrame([(20, "a"), (20, "a"), (3, "a"), (4, "b"), (5, "a")], "memory_id long, node string")
    assert sorted(map(tuple, retrieval.mentioned(mentions, found).collect())) == [(3, "a"), (4, "b"), (20, "a")]


def test_only_edges_near_the_asked_are_walked(spark, monkeypatch):
    """Facts about a few nodes: every edge of the graph had been named, sorted and shuffled for each hop."""
    sizes, real = {}, graph.staged

    def keep(df, name):
        sizes[name] = real(df, name)
        return sizes[name]

    monkeypatch.setattr(graph, "staged", keep)
    chain = [("a0", "a1", "R", 0.9), ("a1", "a2", "R", 0.8), ("a2", "a3", "R", 0.7), ("a3", "a4", "R", 0.6), ("b0", "a0", "R", 0.5), ("b1", "b0", "R", 0.9), ("u1", "a0", "R", 0.9)]
    edges = spark.createDataFrame(chain + [(f"x{i}", f"y{i % 7}", "R", 0.5) for i in range(300)], "src string, dst string, rel string, weight double")
    names = spark.createDataFrame([(n, n.upper()) for n in {x for e in edges.collect() for x in (e.src, e.dst)}], "node string, name string")
    asked = spark.createDataFrame([("q", "a0", 1)], "query string, node string, at int")
    got = graph.facts_at(asked, graph.entity_facts(edges, names, hidden="u", asked=asked))
    want = sorted((r.hop, r.entity, r.relation, r.target) for r in got.collect())
    assert sizes["named_edges"].count() < 10
    sizes.clear()
    monkeypatch.setattr(graph, "FEW", 0)  # the way for many asked nodes
    every = graph.facts_at(asked, graph.entity_facts(edges, names, hidden="u", asked=asked))
    assert sorted((r.hop, r.entity, r.relation, r.target) for r in every.collect()) == want and sizes["named_edges"].count() == 307
    assert want == [(1, "A0", "R", "A1"), (1, "B0", "R", "A0"), (2, "A0", "R -> A1 -> R", "A2"), (2, "B1", "R -> B0 -> R", "A0"), (3, "A0", "R -> A1 -> R -> A2 -> R", "A3")]


def test_mentions_of_other_entities_are_not_shuffled(spark, tmp_path):
    """latest_memories joined every mention with the memories before it looked at the entities asked for."""
    mentions = _read(spark, tmp_path / "m", [(1, "a", 1, 0.5, None), (2, "b", 1, 0.5, None)], "memory_id long, node string, seq int, confidence double, created_at timestamp_ntz")
    stored = _read(spark, tmp_path / "s", [(1, 7, "committed", None), (2, 7, "committed", None)], "id long, user_id long, status string, created_at timestamp_ntz")
    wanted = _read(spark, tmp_path / "w", [(7, "a")], "user_id long, via string")
    got = retrieval.latest_memories(mentions, stored.hint("merge"), wanted)
    lines = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert sum("LeftSemi" in x for x in lines) == 2
    assert [tuple(r) for r in got.collect()] == [(7, "a", 1)]


def test_edges_are_merged_as_numbers_and_read_once(spark):
    """g3 made the names of every line item's edge, read the edges twice and put both in one more shuffle."""
    import __spark_entry__
    from memloom.plans.graph import merged

    got = __spark_entry__.queries()["g3_merge_edge_max"](spark, "/root/testdata/sf0.001")
    assert _plan(got).count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in _plan(got)
    rows = spark.createDataFrame([("FROM", 1, 2, 0.3), ("FROM", 1, 2, 0.6), ("RELATED_TO", 1, None, 0.5), ("RELATED_TO", 1, None, None), ("LIVES_IN", 1, 2, None)], "rel_type string, a long, b long, weight double")
    assert sorted(map(str, map(tuple, merged(rows).collect()))) == ["('c1', 'n2', 'LIVES_IN', None)", "('p1', None, 'RELATED_TO', 0.5)", "('s1', 'n2', 'FROM', 0.6)"]


def test_critic_counts_without_an_order(spark):
    """v1 put all mentions in order twice to number those that it only counts. Orders that are there twice or not at all, unknown entities."""
    from memloom.plans import dataframes

    mentions = spark.createDataFrame([(1, 5, 0.9), (1, 5, 0.7), (1, 11, 0.9), (1, 5, 0.1), (1, None, 0.9), (1, None, 0.8), (1, 7, None), (2, 5, 0.9), (2, 22, 0.3), (3, 5, 0.9), (None, 5, 0.9)], "memory_id long, entity_id long, confidence double")
    orders = spark.createDataFrame([(1,), (2,), (2,), (9,), (None,)], "memory_id long")
    got = dataframes.reasons(mentions, orders, 3)
    assert "Window" not in _plan(got)
    assert {r.reason: r.n for r in got.collect()} == {"low_confidence": 3, "bad_type": 1, "duplicate": 3, "kept": 3}
    assert dataframes.reasons(mentions.limit(0), orders, 3).collect() == []
