"""N-gram Jaccard join over count-vector R-trees (operator 9).

A text's set holds its distinct 4-word shingles, as 64-bit hashes. Tokens are hashed into groups;
a set's group counts are its point, and for two sets the summed coordinate minima bound their overlap.

1. `shingle_sets` reads every text once and gives its set size, its set's identity (`node`; equal sets
   are one node) and its block keys. Keys: with the tokens hashed into m groups, m above the largest
   symmetric difference a linked pair of that size can have plus a slack e, a linked pair agrees
   exactly on more than e groups. A key is the hash of one group's tokens, so linked pairs share keys.
   Groups that are empty give no key, unless the set has more than e of them.
2. Star rounds: each block has a lead (the first of its nodes in an order that changes by round), and
   each node is verified against the lead it shares most keys with. Links are contracted to components,
   and only blocks still holding several components go on. A large group of near copies collapses here
   with one pair for each copy and round.
3. In the blocks that are left, an R-tree join: points are packed into leaves by size and counts, leaves
   into boxes of as many levels as the block needs; boxes meet where their bound allows a link, points
   meet where their own bound does.
4. Before a pair's sets are made, the same bound is taken on finer counts (about four tokens a group), which
   leaves hardly a pair that does not link. Pairs of different components are verified on whole sets.

Every linked pair of different components is verified or has both ends already connected, so the
components are exact. Pairs inside a component are never expanded.

Defined cases: null text, or a text without words: n_shingles 0, linked with nothing; under four words:
one shingle, the whole sequence; rows that repeat a doc_id are documents of their own, and so are rows with
a null doc_id, which only give no component_id; empty table: empty result. Shingle identity is a
64-bit hash, of which verification reads 48 bits (for two sets of 1,000 a chance of 4e-9 to miscount).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import Words, discard, give_back, ints, mix64, small_batches, stage, whole_row


@dataclass(frozen=True)
class JaccardConfig:
    words: int = 4
    percent: int = 85  # link when 100 * intersection >= percent * union
    groups: int = 64  # coordinates of a box, and of a point at least
    most_groups: int = 512  # coordinates of a point at most
    class_ratio: float = 1.6  # sizes of one block class lie within this ratio
    leaf: int = 512  # points of an R-tree leaf
    best: int = 2  # partners of a node that are verified before all others
    fan: int = 16  # boxes under a box of the next level
    sent: int = 100_000  # wanted nodes (24 bytes each) up to which they are sent to the texts
    star_rounds: int = 6  # at most
    worth: float = 0.8  # a further star round must leave less than this share of the block rows


_C = mix64(np.arange(101, 133, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased)."""
    w = Words(texts)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    h = w.hashes(lower[w.buf])
    out = []
    full = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        full += h[j : j + len(full)] * _C[j]
    full = mix64(full)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(full[a : b - k + 1]))
        elif b > a:
            out.append(mix64(np.array([(h[a:b] * _C[8 : 8 + b - a]).sum(dtype=np.uint64)], np.uint64) ^ _C[16 + b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def size_classes(n: int, cfg: JaccardConfig) -> list[tuple[int, int, int]]:
    """(class, groups, slack) under which a set of n tokens gives keys: its own class, and the one
    below if a set of that class can still be its smaller partner."""
    t, out = cfg.percent / 100, []
    own = int(math.log(n) / math.log(cfg.class_ratio) + 1e-9)
    for c in (own, own - 1):
        top = cfg.class_ratio ** (c + 1)  # sizes of class c lie below
        if c < 0 or c != own and n * t >= top + 1:
            continue
        differ = int((1 - t) / t * (top + 1))  # largest symmetric difference with a partner
        slack = 2 + differ // 50
        out.append((c, differ + 1 + slack, slack))
    return out


def block_keys(u: np.ndarray, cfg: JaccardConfig) -> np.ndarray:
    keys = []
    for c, m, slack in size_classes(len(u), cfg):
        g = (u % np.uint64(m)).astype(np.int64)
        total = np.zeros(m, np.uint64)
        order = np.argsort(g, kind="stable")
        gs = g[order]
        at = np.flatnonzero(np.concatenate([[True], gs[1:] != gs[:-1]]))
        total[gs[at]] = np.add.reduceat(mix64(u[order] ^ _C[30]), at)
        use = gs[at] if m - len(at) <= slack else np.arange(m)
        keys.append(mix64(total[use] + use.astype(np.uint64) * _C[28] + np.full(1, c, np.uint64) * _C[29]))
    return np.concatenate(keys).view(np.int64)


def _node(u: np.ndarray) -> int:
    whole = np.array([mix64(u ^ _C[25]).sum(dtype=np.uint64), len(u)], np.uint64) * _C[26:28]
    return int(mix64(whole[:1] ^ mix64(whole[1:])).view(np.int64)[0])


def shingle_sets(docs: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """doc_id, h (hash of the text), n, node, fine (counts), keys. Copies within a task give their keys once; sets of
    fewer than six tokens link only with equal sets and give none."""
    least = math.ceil(cfg.percent / (100 - cfg.percent))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in it:
            for ids, texts in small_batches(list(zip(pdf["doc_id"], pdf["h"], strict=True)), list(pdf["text"])):
                rows = []
                for (i, h), u in zip(ids, shingles(texts, cfg.words), strict=True):
                    node = _node(u) if len(u) else None
                    fresh = len(u) >= least and node not in seen
                    if fresh:
                        seen.add(node)
                    rows.append((i, h, len(u), node, fine_counts(u, cfg) if fresh else None, block_keys(u, cfg) if fresh else None))
                i, h, n, node, fine, keys = zip(*rows, strict=True)
                yield pd.DataFrame({"doc_id": ints(i), "h": h, "n": n, "node": ints(node), "fine": fine, "keys": keys})
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).mapInPandas(run, "doc_id long, h long, n long, node long, fine binary, keys array<long>")


def fine_counts(u: np.ndarray, cfg: JaccardConfig) -> bytes:
    """Tokens counted in a power of two of groups: about four groups to a token in small sets, where a few chance
    meetings weigh much, and four tokens to a group in large ones. Group g of fewer groups is the sum of the groups that
    are g modulo their number, so counts of two sizes compare in the coarser one."""
    n = len(u)
    groups = 1 << max(cfg.groups.bit_length() - 1, min(4 * n, 1024).bit_length() - 1, (n // 4).bit_length())
    return packed_counts(np.bincount((u >> np.uint64(20)).astype(np.int64) % groups, minlength=groups))


def packed_counts(counts: np.ndarray) -> bytes:
    """One byte a count, or four where one needs more; the first byte says which."""
    return b"\1" + counts.astype(np.uint8).tobytes() if counts.max() < 256 else b"\4" + counts.astype(np.int32).tobytes()


def groups_of(packed: bytes) -> int:
    return (len(packed) - 1) // packed[0]


def folded(packed: bytes, groups: int) -> np.ndarray:
    return np.frombuffer(packed, np.uint8 if packed[0] == 1 else np.int32, offset=1).reshape(-1, groups).sum(0, dtype=np.int32)


def node_sets(docs: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """node and set (48 bits of each of its hashes) of the given documents; copies within a task once."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in it:
            pdf = pdf[~(pdf["node"].isin(seen) | pdf["node"].duplicated())]
            seen.update(pdf["node"])
            for want, texts in small_batches(list(pdf["node"]), list(pdf["text"])):
                us = shingles(texts, cfg.words)
                rows = [(i, u.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()) for i, u in zip(want, us, strict=True) if len(u) and _node(u) == i]
                yield pd.DataFrame(rows, columns=["node", "set"])
        give_back()

    return docs.select("node", "text").mapInPandas(run, "node long, set binary")


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _linked(cfg: JaccardConfig):
    p = cfg.percent

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = _wide(x), _wide(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= p * (len(x) + len(y) - both))
        return pd.Series(out)

    return linked


def bound_allows(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """For points a (or upper corners) against b: can the overlap, at most the summed coordinate
    minima, still give 100 * overlap >= percent * union? na, nb: set sizes (or least sizes)."""
    most = np.minimum(a, b).sum(-1)
    return (100 + percent) * most >= percent * (na + nb)


def _may(cfg: JaccardConfig):
    p, g = cfg.percent, cfg.groups

    @F.pandas_udf("boolean")
    def may(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        x, y = (np.stack([folded(z, g) for z in s]) if len(s) else np.zeros((0, g), np.int32) for s in (a, b))
        return pd.Series(bound_allows(x, y, na.to_numpy(), nb.to_numpy(), p))

    return may


def _point(cfg: JaccardConfig):
    """A node's point: its counts in half as many groups, and in at most cfg.most_groups."""
    g, most = cfg.groups, cfg.most_groups

    @F.pandas_udf("binary")
    def point(fine: pd.Series) -> pd.Series:
        return pd.Series([packed_counts(folded(x, min(most, max(g, groups_of(x) // 2)))) for x in fine])

    return point


def _finely(cfg: JaccardConfig):
    p = cfg.percent

    @F.pandas_udf("boolean")
    def finely(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        out = []
        for x, y, n in zip(a, b, na + nb, strict=True):
            g = min(groups_of(x), groups_of(y))
            out.append((100 + p) * int(np.minimum(folded(x, g), folded(y, g)).sum()) >= p * n)
        return pd.Series(out, dtype=bool)

    return finely


def within_bound(pairs: DataFrame, nodes: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """Pairs (a, b) whose sizes and fine counts allow a link."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("fine").alias("fa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("fb"))
    both = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * cfg.percent)
    return both.where(_finely(cfg)("fa", "fb", "na", "nb")).drop("na", "nb", "fa", "fb")


def verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """Those of the distinct node pairs (a, b), a staged table, that link: checked on whole sets made from the
    texts. nodes: node, and the id (0 for null) and text hash of one row that has it. Texts stay where they are
    while the wanted nodes are few enough to be sent to them (`cfg.sent`, counted), else both are shuffled."""
    few = 2 * pairs.count() <= cfg.sent
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "_i", "_h"), "node")
    rows = docs.withColumn("_i", F.coalesce("doc_id", F.lit(0))).withColumn("_h", F.xxhash64("text")).join(F.broadcast(wanted) if few else wanted, ["_i", "_h"])
    by_node = node_sets(rows, cfg).repartition("node").dropDuplicates(["node"])  # one exchange for both sides
    left = by_node.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = by_node.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    return stage(pairs.join(left, "a").join(right, "b").where(_linked(cfg)("sa", "sb")).select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of links (a, b): label is the component's smallest node. Rounds of
    taking the smallest neighbouring label and then the label's own label, until nothing changes."""
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    tasks = 8 + both.count() // 200_000  # tables of few rows are handled by few tasks
    lab = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    lab = stage(lab.coalesce(tasks), "labels")
    while True:
        near = both.join(lab.select(F.col("node").alias("b"), "label"), "b").coalesce(tasks).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = lab.join(near, "node").coalesce(tasks).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = lab.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = stage(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")).coalesce(tasks), "labels")
        done = new.where("old <> label").isEmpty()
        discard(lab, *([both] if done else []), free=done)
        lab = new.select("node", "label")
        lab._staged_at = new._staged_at
        if done:
            return lab


def with_label(df: DataFrame, col: str, lab: DataFrame | None, name: str) -> DataFrame:
    """df and the component label of its node column; a node without links is its own label."""
    if lab is None:
        return df.withColumn(name, F.col(col))
    return df.join(lab.select(F.col("node").alias(col), F.col("label").alias("_l")), col, "left").withColumn(name, F.coalesce("_l", col)).drop("_l")


def _box(cfg: JaccardConfig):
    """The box of a group of boxes or points: least and greatest size, upper corner."""
    g = cfg.groups

    def box(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top = np.stack([folded(x, g) for x in pdf["top"]]).max(0)
        return pd.DataFrame({"key": [key[0]], "no": [key[1]], "low": [pdf["low"].min()], "high": [pdf["high"].max()], "top": [packed_counts(top)]})

    return box


def meeting(boxes: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """key, i, j (i <= j) of the boxes (key, no, low, high, top) of one block whose bound allows a link. Where a block has
    more than `cfg.fan` squared boxes, `cfg.fan` of them in a row get a box of the next level, and only children of
    meeting parents are compared."""
    one = boxes.select("key", F.col("no").alias("i"), F.col("low").alias("li"), F.col("high").alias("hi"), F.col("top").alias("ti"))
    two = boxes.select("key", F.col("no").alias("j"), F.col("low").alias("lj"), F.col("high").alias("hj"), F.col("top").alias("tj"))
    p = cfg.percent
    sizes = (F.col("hi") * 100 >= F.col("lj") * p) & (F.col("hj") * 100 >= F.col("li") * p) & (F.col("i") <= F.col("j"))
    if boxes.groupBy("key").count().where(F.col("count") > cfg.fan**2).isEmpty():
        pairs = one.join(two, "key")
    else:
        up = F.floor(F.col("no") / cfg.fan)
        higher = stage(boxes.withColumn("up", up).groupBy("key", "up").applyInPandas(_box(cfg), "key long, no long, low long, high long, top binary"), "boxes")
        over = meeting(higher, cfg).select("key", F.col("i").alias("ui"), F.col("j").alias("uj"))
        pairs = over.join(one.withColumn("ui", F.floor(F.col("i") / cfg.fan)), ["key", "ui"]).join(two.withColumn("uj", F.floor(F.col("j") / cfg.fan)), ["key", "uj"])
    return pairs.where(sizes).where(_may(cfg)("ti", "tj", "li", "lj")).select("key", "i", "j")


def rtree_pairs(blocks: DataFrame, cfg: JaccardConfig, best: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b) of one block and different labels whose points allow a link, and fit, the bound's share of both sizes.
    With `best`, of the pairs found in one bucket of work only each node's so many of greatest fit. Also the staged tables
    that the pairs are read from.

    blocks: key, lead_label, members (rows of the block), node, label, n, point. Leaves of a block hold about cfg.leaf points near in
    size and counts (a block of many rows is first dealt into slices, each packed on its own); each pair of leaves that
    may hold a link is one unit of work with its own members only."""
    p, g, leaf = cfg.percent, cfg.groups, cfg.leaf
    slices = F.ceil(F.col("members") / (leaf * 200))
    blocks = blocks.withColumn("slice", F.pmod(F.xxhash64("node"), slices))
    w = Window.partitionBy("key", "slice").orderBy("n", "point", "node")
    packed = stage(blocks.withColumn("leaf", F.col("slice") * (1 << 20) + F.floor((F.row_number().over(w) - 1) / leaf)).drop("slice", "members"), "leaves")
    many = packed.where("leaf > 0").select("key").distinct()
    points = many.join(packed, "key").select("key", F.col("leaf").alias("no"), F.col("n").alias("low"), F.col("n").alias("high"), F.col("point").alias("top"))
    boxes = stage(points.groupBy("key", "no").applyInPandas(_box(cfg), "key long, no long, low long, high long, top binary"), "boxes")
    meet = stage(meeting(boxes, cfg).where("i < j"), "meet")
    within = packed.select("key", F.col("leaf").alias("i"), F.col("leaf").alias("j"), F.lit(0).alias("side"), "node", "label", "n", "point", "lead_label")
    rest = ["node", "label", "n", "point", "lead_label"]
    first = meet.join(packed.withColumnRenamed("leaf", "i"), ["key", "i"]).select("key", "i", "j", F.lit(0).alias("side"), *rest)
    second = meet.join(packed.withColumnRenamed("leaf", "j"), ["key", "j"]).select("key", "i", "j", F.lit(1).alias("side"), *rest)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        """All units of a bucket, by the coarsest counts in each: rows of a unit stand together, and row x meets x + d
        for d = 1, 2, ..."""
        pdf = pdf.sort_values(["key", "i", "j"], kind="stable", ignore_index=True)
        unit = pdf.groupby(["key", "i", "j"], sort=False).ngroup().to_numpy()
        groups = pdf["point"].map(groups_of).to_numpy()
        least = np.minimum.reduceat(groups, np.flatnonzero(np.append(True, unit[1:] != unit[:-1])))[unit]
        out, held = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "fit": np.zeros(0)})], 0
        for g in np.unique(least):
            rows = np.flatnonzero(least == g)
            own, pts = unit[rows], np.stack([folded(x, g) for x in pdf["point"].to_numpy()[rows]])
            n, node, label, side = (pdf[c].to_numpy()[rows] for c in ("n", "node", "label", "side"))
            cross = (pdf["i"] != pdf["j"]).to_numpy()[rows]
            x, d = np.arange(len(rows)), 0
            while len(x):
                d += 1
                x = x[x + d < len(rows)]
                x = x[own[x] == own[x + d]]
                y = x + d
                ok = (label[x] != label[y]) & (~cross[x] | (side[x] != side[y])) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * p)
                for a, b in zip(*(np.array_split(z[ok], len(x) // 4096 + 1) for z in (x, y)), strict=True):
                    most = np.minimum(pts[a], pts[b]).sum(1)
                    hit = (100 + p) * most >= p * (n[a] + n[b])
                    a, b, most = a[hit], b[hit], most[hit]
                    if len(a):
                        out.append(pd.DataFrame({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b]), "fit": most / (n[a] + n[b])}))
                        held += len(a)
                    if held > 300_000:
                        out = [sifted(out)]
                        held = len(out[0]) // 2
        found = sifted(out)
        give_back()
        return found

    def sifted(parts: list[pd.DataFrame]) -> pd.DataFrame:
        found = pd.concat(parts, ignore_index=True).drop_duplicates(["a", "b"])
        if best is None:
            return found
        found = found.sort_values("fit", ascending=False, kind="stable")
        return found[(found.groupby("a").cumcount() < best) | (found.groupby("b").cumcount() < best)]

    units = within.union(first).union(second)
    # blocks of one lead mostly share their pairs: they are searched together, as many rows as make a bucket
    size = 5000
    buckets = 1 + (packed.count() + 2 * leaf * meet.count()) // size
    salts = stage(units.groupBy("lead_label").agg(F.ceil(F.count("*") / size).alias("salts")).where("salts > 1"), "salts")
    dealt = units.join(F.broadcast(salts) if salts.count() < cfg.sent else salts, "lead_label", "left").withColumn("salt", F.pmod(F.xxhash64("key", "i", "j"), F.coalesce("salts", F.lit(1))))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("lead_label", "salt"), F.lit(buckets))).drop("lead_label", "salts", "salt")
    return dealt.groupBy("bucket").applyInPandas(search, "a long, b long, fit double").groupBy("a", "b").agg(F.max("fit").alias("fit")), [packed, boxes, meet, salts]


def pending(blocks: DataFrame, lab: DataFrame | None, r: int) -> DataFrame:
    """Rows of the blocks that hold more than one component: key, node, label, members (rows of the block) and the block's
    lead in round r. What a block is judged by is aggregated before it meets its rows, so a hot block can be split."""
    x = with_label(blocks, "node", lab, "label")
    lead = F.min(F.struct(_order("label", r).alias("o"), F.col("label"), F.col("node"))).alias("_p")
    per = x.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count("*").alias("members"), lead).where("_lo < _hi")
    return x.join(per.select("key", "members", F.col("_p.label").alias("lead_label"), F.col("_p.node").alias("lead")), "key")


def labelled(docs: DataFrame, cfg: JaccardConfig = JaccardConfig()) -> DataFrame:
    """doc_id, h (hash of the text), n and label, null for n = 0, of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    full = stage(shingle_sets(docs, cfg), "shingles")
    keyed = full.where("keys is not null").select(F.explode("keys").alias("key"), "node")
    shared = keyed.groupBy("key").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).where("_lo < _hi").select("key")
    blocks = stage(keyed.join(shared, "key").distinct(), "blocks")
    inside = blocks.select("node").distinct()
    one = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")).alias("m")
    heads = full.where("n > 0").join(inside, "node").groupBy("node").agg(F.first("n").alias("n"), F.max("fine").alias("fine"), one)
    nodes = stage(heads.select("node", "n", "fine", F.coalesce("m.doc_id", F.lit(0)).alias("_i"), F.col("m.h").alias("_h")), "points")
    sets = stage(full.drop("keys", "fine"), "nodes")
    discard(full)
    lab, links = None, []

    def join_up(pairs: DataFrame) -> None:
        """Verify pairs of a staged table and let the labels follow the links found."""
        nonlocal lab
        got = verify(pairs, docs, nodes, cfg)
        discard(pairs)
        if got.isEmpty():
            discard(got)
            return
        links.append(got)
        new = components(functools.reduce(DataFrame.union, links))
        discard(*([] if lab is None else [lab]), free=False)
        lab = new

    open_blocks, left = blocks, None
    for r in range(cfg.star_rounds + 1):
        marked = stage(pending(open_blocks, lab, r), "pending")
        discard(open_blocks)
        open_blocks = marked.select("key", "node")
        open_blocks._staged_at = marked._staged_at
        rows = marked.count()
        if not rows or r == cfg.star_rounds or left is not None and rows > cfg.worth * left:
            break  # what is left are blocks of sets that do not link
        left = rows
        met = marked.where("lead_label <> label").groupBy(F.col("lead").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared"))
        star = met.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
        join_up(stage(within_bound(star, nodes, cfg), "pairs"))
    points = nodes.select("node", "n", _point(cfg)("fine").alias("point"))
    for best in (cfg.best, None) if rows else ():
        # each node's best-bounded partners first: most other pairs then lie within a component and are never made
        if best is None:
            marked = stage(pending(open_blocks, lab, cfg.star_rounds), "pending")
            discard(open_blocks)
            open_blocks = marked
        near, used = rtree_pairs(marked.select("key", "lead_label", "members", "node", "label").join(points, "node"), cfg, best)
        if best is not None:
            ends = near.select("a", "b", "fit", F.explode(F.array("a", "b")).alias("end"))
            top = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("fit"), "a", "b"))
            near = ends.withColumn("r", top).where(F.col("r") <= best).select("a", "b").distinct()
        pairs = stage(within_bound(near.select("a", "b"), nodes, cfg), "pairs")
        discard(*used)
        join_up(pairs)
    discard(open_blocks, nodes, *links)
    return with_label(sets.select("doc_id", "h", "n", "node"), "node", lab, "label").drop("node")


def classes(docs: DataFrame, cfg: JaccardConfig = JaccardConfig()) -> DataFrame:
    """doc_id, n, component_id for every row of docs (doc_id, text)."""
    rows = labelled(docs, cfg)
    named = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("head"))
    return rows.join(named, "label", "left").select("doc_id", "n", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("head")).alias("component_id"))


def _order(col: str, r: int) -> Column:
    return F.col(col) if r == 0 else F.xxhash64(col, F.lit(r))


def op9(docs: DataFrame, cfg: JaccardConfig = JaccardConfig()) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return classes(docs, cfg).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, cfg: JaccardConfig = JaccardConfig()) -> DataFrame:
    """docs with one row of each component: the one of smallest id, null ids last, then of smallest
    hash of the text, then of smallest hash of the row. Rows without words all stay."""
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")).alias("m")
    keys = labelled(docs, cfg).where("label is not null").groupBy("label").agg(pick)
    keys = keys.select(F.coalesce("m.doc_id", F.lit(0)).alias("_i"), F.col("m.h").alias("_h"))
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(words).select(whole_row(docs).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_i"), F.xxhash64("text").alias("_h"))
    order = [F.col("row")[c] for c in docs.columns]
    first = F.row_number().over(Window.partitionBy("_i", "_h").orderBy(F.col("row.doc_id").isNull(), F.xxhash64("row"), *order))
    rows = rows.join(keys.distinct(), ["_i", "_h"], "left_semi").withColumn("_r", first).where("_r = 1")
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns]).union(docs.where(~words))
