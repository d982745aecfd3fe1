"""Walks from every node and substring joins against plain enumeration, on graphs with cycles, loops and parallel edges."""

import random

import pytest

from memloom.operators import graph
from memloom.operators.substrings import contains_either_way, contains_join


def some_graph(seed, n=9, m=30):
    rng = random.Random(seed)
    seen = {}
    for _ in range(m):
        seen[f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(["A", "B"])] = rng.randrange(1, 10) / 10
    return [(s, d, r, w) for (s, d, r), w in seen.items()]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize(("depth", "most"), [(1, 3), (2, 4), (3, 50)])
def test_best_neighbours(spark, seed, depth, most):
    edges = some_graph(seed)
    best = {}

    def walk(start, at, w, used):
        for i, (s, d, _, x) in enumerate(edges):
            if i in used or x <= 0.1 or at not in (s, d):
                continue
            to = d if at == s else s
            if w * x > 0.1:
                if to != start:
                    key = (round(w * x, 9), -len(used) - 1)
                    best[start, to] = max(best.get((start, to), key), key)
                if len(used) + 1 < depth:
                    walk(start, to, w * x, used | {i})

    nodes = {x for e in edges for x in e[:2]}
    for v in nodes:
        walk(v, v, 1.0, frozenset())
    want = []
    for v in nodes:
        ranked = sorted((-w, t, -h) for (s, t), (w, h) in best.items() if s == v)[:most]
        want += [(v, t, -w, h, i + 1) for i, (w, t, h) in enumerate(ranked)]
    rows = spark.createDataFrame(edges, "src string, dst string, rel string, w double")
    got = sorted((r.node, r.target, round(r.w, 9), r.hops, r.rn) for r in graph.best_neighbours(rows, depth, 0.1, most).collect())
    assert got == sorted(want)


def plain_facts(edges, names, caps, hidden):
    title = lambda v: names.get(v, v)
    out = []
    for way in (0, 1):
        step = [(d, s, r, w) if way else (s, d, r, w) for s, d, r, w in edges]
        step = [e for e in step if not e[1].startswith(hidden)]
        walks = [[(e,)] for e in step]
        walks = [(e,) for e in step]
        for h in range(1, len(caps) + 2):
            by = {}
            for p in walks:
                by.setdefault(p[0][0], []).append(p)
            for node, ps in by.items():
                def weight(p):
                    w = p[-1][3]
                    for e in reversed(p[:-1]):
                        w = e[3] * w
                    return w
                ps = sorted(ps, key=lambda p: (-round(weight(p), 9), [e[1] for e in p], [e[2] for e in p]))
                for p in ps[: caps[h - 2]] if h > 1 else ps:
                    mids, rels, far = [title(e[1]) for e in p[:-1]], [e[2] for e in p], title(p[-1][1])
                    if way:
                        mids, rels = mids[::-1], rels[::-1]
                    text = rels[0] + "".join(f" -> {m} -> {r}" for m, r in zip(mids, rels[1:], strict=True))
                    a, b = (far, title(node)) if way else (title(node), far)
                    out.append((node, 2 * (h - 1) + way, h, a, text, b, round(weight(p), 9)))
            walks = [(e, *p) for p in walks for e in step if e[1] == p[0][0] and all(e[:3] != x[:3] for x in p)]
    return sorted(out)


@pytest.mark.parametrize("seed", [4, 5])
def test_entity_facts(spark, seed):
    edges = some_graph(seed, 7, 22) + [("u1", "n1", "OWNS", 0.9), ("n2", "u1", "LIKES", 0.8)]
    names = {f"n{i}": f"name {i % 4}" for i in range(6)}
    rows = spark.createDataFrame(edges, "src string, dst string, rel string, weight double")
    got = graph.entity_facts(rows, spark.createDataFrame(list(names.items()), "node string, name string"), (4, 3), hidden="u")
    assert sorted((*r[:6], round(r[6], 9)) for r in got.select("node", "block", "hop", "entity", "relation", "target", "weight").collect()) == plain_facts(edges, names, (4, 3), "u")


def test_facts_of_query(spark):
    names = spark.createDataFrame([("a1", "tea"), ("a2", "tea"), ("a3", "green tea"), ("b", "cup")], "node string, name string")
    edges = spark.createDataFrame([("a1", "b", "IN", 0.5), ("a2", "b", "IN", 0.9), ("a3", "b", "IN", None)], "src string, dst string, rel string, weight double")
    facts = graph.entity_facts(edges, names)
    matched = contains_either_way(spark.createDataFrame([("tea",), ("the green tea",)], "query string"), names.select("name"))
    got = sorted(map(tuple, graph.facts_of(matched.select("query").distinct(), matched, names, facts, most=2).collect()))
    assert got == [("tea", 1, "tea", "IN", "cup", 0.5), ("the green tea", 1, "tea", "IN", "cup", 0.5)]
    more = {r.query: r.weight for r in graph.facts_of(matched.select("query").distinct(), matched, names, facts).where("entity = 'green tea'").collect()}
    assert more == {"tea": 0.5, "the green tea": 0.5}


@pytest.mark.parametrize("seed", [1, 2])
def test_contains(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 20))) for _ in range(150)} | {"a" * 40, "ab" * 20, "zz"}
    hay = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 45))) for _ in range(150)} | {"a" * 40}
    one = lambda c, xs: spark.createDataFrame([(x,) for x in [*xs, None, "", *list(xs)[:3]]], f"{c} string")
    got = {tuple(r) for r in contains_join(one("needle", words), one("hay", hay)).collect()}
    assert got == {(n, h) for n in words for h in hay if n in h} and got
    both = contains_either_way(one("query", words), one("name", hay)).collect()
    assert {tuple(r) for r in both} == {(n, h) for n in words for h in hay if n in h or h in n} and len(both) == len(set(both))
    assert contains_join(one("needle", []), one("hay", hay)).collect() == [] == contains_join(one("needle", words), one("hay", [])).collect()


def test_no_nested_loops(spark):
    rows = spark.createDataFrame([("abc",)], "needle string")
    plan = contains_join(rows, rows.withColumnRenamed("needle", "hay"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
