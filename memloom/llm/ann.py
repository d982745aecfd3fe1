"""Approximate nearest neighbours by balanced posting lists (operator 5).

Centroids are fitted on a bounded sample, with a penalty on full clusters. Inner-product search becomes
distance search by one more coordinate, sqrt(max norm^2 - norm^2), which is 0 for queries. Every vector
goes to its nearest centroid and, if it lies near a boundary, to each further one within
`boundary` times that distance. A query walks a neighbour graph over the centroids in memory and takes lists
in distance order: first, whatever their distance, until their sizes sum to `floor` (at least `copies * (k + 1)`,
so that they hold k other rows if there are so many), then those within `prune` times the distance reached, up
to a number that grows with the root of the number of centroids. Members are scored exactly.

Equal vectors are one entry with their smallest `k + 1` ids, which are all that can be among a query's
k nearest, and one search serves all queries with that vector. Lists longer than `part` are read in
parts by several tasks, and so are the queries of a list, so a crowded region does not meet in one.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components take no part; ties go to the smaller vec_id; rows that repeat a vec_id with
another vector are candidates of their own; fewer than k candidates: all found; no vectors: empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import stage


@dataclass(frozen=True)
class AnnConfig:
    k: int = 20
    sample: int = 20_000  # bound of the training sample
    list_size: int = 200  # vectors per centroid, about
    most_centroids: int = 8192  # bound of what each task holds in memory
    boundary: float = 1.15  # distance ratio up to which a vector joins further lists
    copies: int = 4
    lists: int = 48  # lists of a query beyond the floor: at most this, or
    lists_root: float = 6.0  # this times the root of the number of centroids, if that is more
    floor: int = 2000  # summed list sizes that a query reads whatever the distance
    prune: float = 1.6  # ratio to the distance at the floor beyond which a list is skipped
    degree: int = 24  # of the centroid graph
    part: int = 2000  # members of a list that one unit of work reads
    every: int = 20  # queries: ids divisible by this
    seed: int = 5


def fit_centroids(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means in which a cluster's fill adds to its distance, so that lists stay near one size."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    fill, scale = np.zeros(k), 0.0
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * x @ c.T + scale * fill
        at = d.argmin(1)
        size = np.bincount(at, minlength=k)
        fill = size / max(len(x) / k, 1) - 1
        scale = 0.02 * float(np.maximum((x * x).sum(1).mean(), 1e-9))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.integers(0, len(x), k)])
    return c


@dataclass
class CentroidGraph:
    c: np.ndarray
    near: list[np.ndarray]  # for each centroid the numbers of its nearest others, and of those it is nearest to
    starts: np.ndarray

    @staticmethod
    def build(c: np.ndarray, cfg: AnnConfig) -> CentroidGraph:
        d = (c * c).sum(1) - 2 * c @ c.T
        out = np.argsort(d, axis=1)[:, 1 : cfg.degree + 1]
        a, b = np.repeat(np.arange(len(c)), out.shape[1]), out.ravel()
        edges = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]), axis=0)  # one-way edges lose regions
        near = np.split(edges[:, 1], np.searchsorted(edges[:, 0], np.arange(1, len(c))))
        rng = np.random.default_rng(cfg.seed)
        return CentroidGraph(c, near, rng.choice(len(c), min(len(c), max(32, len(c) // 8)), replace=False))

    def lists(self, q: np.ndarray, size: np.ndarray, cfg: AnnConfig) -> np.ndarray:
        """The lists a query reads, of which `size` has the members."""
        most = max(cfg.lists, math.ceil(cfg.lists_root * math.sqrt(len(self.c))))
        floor = min(max(cfg.floor, cfg.copies * (cfg.k + 1)), size.sum())
        at, dist = self.search(q, most)
        if size[at].sum() < floor:
            dist = np.sqrt(((self.c - q) ** 2).sum(1))
            at = np.argsort(dist, kind="stable")
            dist = dist[at]
        least = int(np.searchsorted(np.cumsum(size[at]), floor)) + 1
        within = int((dist <= cfg.prune * dist[least - 1] + 1e-12).sum())
        return at[: max(least, min(within, most))]

    def search(self, q: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """The `want` nearest centroids and their distances: best-first over the graph, with a pool of
        twice that size and entry points spread over all centroids."""
        seen = np.zeros(len(self.c), bool)
        pool = self.starts
        seen[pool] = True
        dist = np.sqrt(((self.c[pool] - q) ** 2).sum(1))
        done = np.zeros(len(pool), bool)
        size = 2 * want
        while not done.all():
            open_ = np.flatnonzero(~done)[:8]
            done[open_] = True
            new = np.unique(np.concatenate([self.near[i] for i in pool[open_]]))
            new = new[~seen[new]]
            if len(new):
                seen[new] = True
                pool = np.concatenate([pool, new])
                dist = np.concatenate([dist, np.sqrt(((self.c[new] - q) ** 2).sum(1))])
                done = np.concatenate([done, np.zeros(len(new), bool)])
                best = np.argsort(dist, kind="stable")[:size]
                pool, dist, done = pool[best], dist[best], done[best]
        best = np.argsort(dist, kind="stable")[:want]
        return pool[best], dist[best]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    ok = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), v.alias("v")).where(fine)
    usual = ok.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return ok.where(F.size("v") == (usual[0].n if usual else 0))


def search(vectors: DataFrame, cfg: AnnConfig = AnnConfig()) -> DataFrame:
    """query_id, rank, vec_id, score for every query row of vectors (vec_id, embedding)."""
    spark, k = vectors.sparkSession, cfg.k
    vec = usable(vectors).withColumn("h", F.xxhash64("v"))
    first = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))  # tasks keep k + 1 rows before the shuffle
    few = vec.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = vec.where(F.col("vec_id") % cfg.every == 0).groupBy("h", "v").agg(F.count("*").alias("_n"))
    few = stage(few.join(asked, ["h", "v"], "left").withColumn("ask", F.col("_n").isNotNull()).drop("_n"), "distinct")
    total = few.count()
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    out = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], out)
    most = few.agg(F.max(norm2)).first()[0]
    x = np.array([r.v for r in few.select("v", "h").orderBy("h").limit(cfg.sample).collect()])
    lift = lambda y: np.concatenate([y, np.sqrt(np.maximum(most - (y * y).sum(1), 0))[:, None]], 1)
    n = int(min(max(1, total // cfg.list_size), cfg.most_centroids, len(x)))
    graph = spark.sparkContext.broadcast(CentroidGraph.build(fit_centroids(lift(x), n, cfg.seed), cfg))  # bounded by most_centroids

    def post(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = graph.value.c
        for pdf in it:
            for a in range(0, len(pdf), 2000):
                y = lift(np.stack(pdf["v"].iloc[a : a + 2000].to_numpy()))
                d = np.sqrt(np.maximum((y * y).sum(1)[:, None] + (c * c).sum(1) - 2 * y @ c.T, 0))
                top = np.argsort(d, axis=1, kind="stable")[:, : cfg.copies]
                near = np.take_along_axis(d, top, 1)
                i, j = np.nonzero(near <= cfg.boundary * near[:, :1] + 1e-12)
                yield pd.DataFrame({"list": top[i, j], "h": pdf["h"].to_numpy()[a + i], "v": pdf["v"].to_numpy()[a + i], "ids": pdf["ids"].to_numpy()[a + i]})

    def ask(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(h, low, v, graph.value.lists(np.append(v, 0.0), sizes.value, cfg)) for h, low, v in zip(pdf["h"], pdf["low"], pdf["v"], strict=True)]
            yield pd.DataFrame(rows, columns=["qh", "low", "q", "list"])

    posted = stage(few.select("h", "v", "ids").mapInPandas(post, "list long, h long, v array<double>, ids array<long>"), "postings")
    size = stage(posted.groupBy("list").agg(F.count("*").alias("members")), "sizes")
    filled = np.zeros(n, np.int64)
    for row in size.collect():  # one row per centroid
        filled[row["list"]] = row["members"]
    sizes = spark.sparkContext.broadcast(filled)
    parts = F.greatest(F.lit(1), F.ceil(F.col("members") / cfg.part))
    posted = posted.join(F.broadcast(size), "list").withColumn("part", F.pmod("h", parts)).drop("members")  # one row per centroid
    asks = few.where("ask").select("h", F.col("ids")[0].alias("low"), "v").mapInPandas(ask, "qh long, low long, q array<double>, list array<long>")
    asks = stage(asks, "asks").withColumn("list", F.explode("list"))
    # queries of a popular list are dealt out too, as many to a unit of work as it has members
    chunks = stage(asks.groupBy("list").agg(F.ceil(F.count("*") / cfg.part).alias("chunks")), "chunks")
    asks = asks.join(F.broadcast(size), "list").join(F.broadcast(chunks), "list").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))

    def score(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            right = right.drop_duplicates(["h"], ignore_index=True) if right["h"].duplicated().any() else right
            y, first = np.stack(right["v"].to_numpy()), np.array([z[0] for z in right["ids"]])
            for qh, low, q in zip(left["qh"], left["low"], left["q"], strict=True):
                s = np.einsum("nd,d->n", y, np.asarray(q))  # one order of summing for every row
                for j in np.lexsort((first, -s))[: k + 1]:
                    rows.append((qh, low, right["ids"].iloc[j], float(s[j])))
        return pd.DataFrame(rows, columns=["qh", "low", "ids", "score"])

    units = asks.select("qh", "low", "q", "list", "part", F.pmod("qh", "chunks").alias("chunk"))
    data = posted.join(F.broadcast(chunks), "list").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    got = units.groupBy("list", "part", "chunk").cogroup(data.groupBy("list", "part", "chunk")).applyInPandas(score, "qh long, low long, ids array<long>, score double")
    flat = got.select("qh", "low", "score", F.explode("ids").alias("vec_id")).distinct()
    best = F.row_number().over(Window.partitionBy("qh", "low").orderBy(F.desc("score"), "vec_id"))
    flat = flat.withColumn("r", best).where(F.col("r") <= k + 1)
    near = flat.groupBy("qh", "low").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    near = near.join(few.where("ask").select(F.col("h").alias("qh"), F.col("ids")[0].alias("low"), F.col("v").alias("q")), ["qh", "low"])
    who = vec.where(F.col("vec_id") % cfg.every == 0).select(F.col("vec_id").alias("query_id"), F.col("h").alias("qh"), F.col("v").alias("q"))
    mine = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return who.join(near, ["qh", "q"]).select("query_id", F.posexplode(mine).alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )


def op5(vectors: DataFrame, cfg: AnnConfig = AnnConfig()) -> DataFrame:
    return search(vectors, cfg)
