"""The blocked top-k join against a plain search, and its plan."""

import random

import numpy as np
import pytest

from memloom.operators.topk import top_k_join

Q, V = "query_id long, user string, vector array<double>", "id long, user string, vector array<float>"


def plain(queries, items, k, by, cosine):
    out = []
    for q, u, x in queries:
        scored = []
        for i, w, y in items:
            if i is None or q is None or x is None or y is None or None in x or None in y or i == q or (by and (u is None or u != w)):
                continue
            a, b = np.array(x), np.array(y, np.float32).astype(float)
            if cosine:
                a, b = (z / np.linalg.norm(z) if np.linalg.norm(z) else z for z in (a, b))
            scored.append((-round(float(a @ b), 9) + 0.0, i))
        out += [(q, i, -s + 0.0, r + 1) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("by", ["user", None])
@pytest.mark.parametrize("cosine", [True, False])
@pytest.mark.parametrize("block", [7, 8192])
def test_against_plain_search(spark, by, cosine, block):
    rng = random.Random(4)
    vec = lambda: [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]  # noqa: E731  many ties
    user = lambda: "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
    items = [(i, user(), vec()) for i in range(90)] + [(90, "hot", None), (91, "hot", [1.0, None, 0.0, 0.0]), (None, "hot", vec()), (92, "a", [0.0] * 4)]
    queries = [(i, user(), vec()) for i in range(0, 60, 3)] + [(500, "hot", None), (501, "nobody", vec()), (502, None, vec()), (None, "hot", vec()), (503, "b", [0.0] * 4)]
    got = top_k_join(spark.createDataFrame(queries, Q), spark.createDataFrame(items, V), 6, by, cosine, block)
    assert sorted((r.query_id, r.id, r.score + 0.0, r.rn) for r in got.collect()) == plain([q for q in queries if q[0] is not None], items, 6, by, cosine)


def test_empty_sides(spark):
    none, one = spark.createDataFrame([], Q), spark.createDataFrame([(1, "a", [1.0])], V)
    assert top_k_join(none, one, 3, "user").collect() == [] == top_k_join(spark.createDataFrame([(1, "a", [1.0])], Q), spark.createDataFrame([], V), 3).collect()


def test_pairs_are_not_moved(spark):
    rows = spark.range(1000).selectExpr("id", "CAST(id % 7 AS STRING) AS user", "array(CAST(id AS FLOAT), 1F) AS vector")
    plan = top_k_join(rows.withColumnRenamed("id", "query_id"), rows, 3, "user")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "FlatMapCoGroupsInPandas" in plan
