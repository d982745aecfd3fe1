"""The k best partners of every query by cosine or inner product, without moving pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEW = 1_000_000  # rows of (key, counts) that may be broadcast: about 32 MB


def _matrix(vectors: pd.Series, unit: bool) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    if unit:
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    return x


def _best(q: pd.DataFrame, v: pd.DataFrame, k: int, unit: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, item ids, scores) of the k best items for each query, ties to the smaller id."""
    items, ids = _matrix(v["vector"], unit), v["id"].to_numpy(np.int64)
    for at in range(0, len(q), 256):
        part = q.iloc[at : at + 256]
        scores = np.round(_matrix(part["vector"], unit) @ items.T, 9)
        for own, s in zip(part["query_id"].tolist(), scores, strict=True):
            s[ids == own] = -np.inf
            near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
            near = near[np.isfinite(s[near])]
            order = near[np.lexsort((ids[near], -s[near]))][:k]
            yield own, ids[order], s[order]


def top_k_join(queries: DataFrame, items: DataFrame, k: int, by: str | None = None, cosine: bool = True, block: int = 8192) -> DataFrame:
    """query_id, id, score, rn: the k best items of each query, best first, ties to the smaller id; scores have nine places.

    queries: query_id, vector and `by`; items: id, vector and `by`, a key that partners share (null has no partner). An item is no partner of the query of its own id.
    Items of a key are cut into slices of about `block` rows and queries likewise, so a frequent key is many groups; a group is one matrix product in an Arrow worker that
    hands on k rows a query. What is shuffled is the vectors, once for each block of the other side, and k rows a query and slice. A vector of length 0 has similarity 0;
    null vectors, and vectors that hold null, take no part."""
    key = F.col(by) if by else F.lit(0)
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    q = queries.where(whole("vector")).select(F.col("query_id").cast("long").alias("query_id"), key.alias("_by"), F.col("vector").cast("array<double>").alias("vector"))
    v = items.where(whole("vector")).select(F.col("id").cast("long").alias("id"), key.alias("_by"), F.col("vector").cast("array<double>").alias("vector"))
    q, v = q.where("query_id IS NOT NULL AND _by IS NOT NULL"), v.where("id IS NOT NULL AND _by IS NOT NULL")
    cut = lambda rows, name: rows.groupBy("_by").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    large = cut(v, "_slices").join(cut(q, "_blocks"), "_by").where("_slices > 1 OR _blocks > 1")
    if large.limit(FEW + 1).count() <= FEW:  # a key has over `block` rows, so there are few
        large = F.broadcast(large)
    number = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    q = q.join(large, "_by", "left").withColumn("_block", number("query_id", F.col("_blocks"))).withColumn("_slice", every(F.col("_slices")))
    v = v.join(large, "_by", "left").withColumn("_slice", number("id", F.col("_slices"))).withColumn("_block", every(F.col("_blocks")))
    group = ["_by", "_slice", "_block"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = list(_best(left, right, k, cosine)) if len(left) and len(right) else []
        if not found:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        own = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
        return pd.DataFrame({"query_id": own, "id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    pick = lambda rows, c: rows.select(c, "vector", *group).groupBy(*group)
    best = pick(q, "query_id").cogroup(pick(v, "id")).applyInPandas(run, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rn", rank).where(F.col("rn") <= k)
