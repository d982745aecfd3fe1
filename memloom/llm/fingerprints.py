"""Document fingerprints: digests of improbable features (operator 11).

1. Every 24-byte window of a text has an entropy, in thousandths of the largest possible. How often each of these 1001 values
   occurs in the corpus (`fit_rarity`, all windows of all texts) ranks them: the rarer, the better; nearly constant windows never count.
2. Of every 32 neighbouring windows the best ranked (the first of equals) is named; a window named 8 times or more is a feature.
   That depends on the bytes around it alone, so texts with a part in common have features in common there.
3. A text's distinct features, in order, go into a chain of Bloom filters of 2048 bits, five bits a feature, 160 features a filter.
   The fingerprint is the filters' bits in base64.
4. Two filters are compared by their common bits, less those that chance gives, over what the fuller one could have in common;
   two fingerprints by each filter's best partner, weighted by bits, both ways.

Defined cases: null text: the empty one, whose fingerprint is empty (likeness to itself 1, to others 0); a text under 24 bytes is one
feature; a text without a named window gives its best one; windows may cut a character; rows that repeat a doc_id are documents of
their own, in the order of their texts' hash; a null doc_id comes after all ids; empty table: empty result. Long texts are
worked through in blocks of a megabyte, with one byte kept for each of theirs; comparing texts of n bytes takes n^2 / 10^8 filter pairs.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import give_back, ints, prefix_hash, share, small_batches, span_hash


@dataclass(frozen=True)
class DigestConfig:
    window: int = 24  # bytes of a feature
    around: int = 32  # windows of which one is named
    named: int = 8  # times a feature is named at least
    weak: int = 100  # thousandths of the largest entropy, below which a window is no feature
    filter_bits: int = 2048  # a power of two
    hashes: int = 5
    per_filter: int = 160


BLOCK = 1 << 20
_NEVER, _NONE = 1 << 19, 1 << 20  # ranks of nearly constant windows and of places where no window starts
_POS = np.int64((1 << 40) - 1)


def entropy_bins(buf: np.ndarray, w: int) -> np.ndarray:
    """The entropy of each window of w bytes, in thousandths of log2(w), rounded down. Sums are exact in integers."""
    n = len(buf) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    g = np.array([0] + [round(c * np.log2(c) * (1 << 24)) for c in range(1, w + 1)], np.int64)
    step = np.diff(g, prepend=0)
    order = np.argsort(buf, kind="stable")
    key = buf[order].astype(np.int64) * (len(buf) + 2 * w) + order  # the places of each byte value, one value after another
    place = np.arange(len(buf))
    ahead, behind = np.empty(len(buf), np.int64), np.empty(len(buf), np.int64)
    ahead[order] = np.searchsorted(key, key + w) - place  # how often a byte's value stands in the w bytes from it on
    behind[order] = place - np.searchsorted(key, key - w, side="right") + 1  # and in the w bytes up to it
    total = np.empty(n, np.int64)
    total[0] = g[np.bincount(buf[:w], minlength=256)].sum()
    total[1:] = total[0] + np.cumsum(step[behind[w:]] - step[ahead[: n - 1]])
    entropy = np.log2(w) - total / (w * float(1 << 24))
    return np.clip((entropy * (1000 / np.log2(w)) + 1e-4).astype(np.int64), 0, 1000)


class Joined:
    """Texts one after another, so far apart that no window has neighbours in the next text."""

    def __init__(self, texts: list[bytes], cfg: DigestConfig):
        self.cfg, self.texts = cfg, texts
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size + cfg.around)])
        self.buf = np.frombuffer(bytes(cfg.around).join([*texts, b""]), np.uint8)

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(offset, entropy, whether a window starts there) for each block of window starts."""
        w, n = self.cfg.window, len(self.buf) - self.cfg.window + 1
        for a in range(0, max(n, 0), BLOCK):
            b = min(n, a + BLOCK)
            text = np.searchsorted(self.start, np.arange(a, b), side="right") - 1
            yield a, entropy_bins(self.buf[a : b + w - 1], w), np.arange(a, b) + w <= (self.start[:-1] + self.size)[text]


def fit_rarity(docs: DataFrame, cfg: DigestConfig = DigestConfig()) -> np.ndarray:
    """The rank of each of the 1001 entropies, rarest first, over all windows of all texts."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1001, np.int64)
        for pdf in it:
            for _, raws in small_batches([0] * len(pdf), list(pdf["text"]), 1 << 19):
                for _, bins, whole in Joined(raws, cfg).blocks():
                    total += np.bincount(bins[whole], minlength=1001)
        give_back()
        yield pd.DataFrame({"bin": np.arange(1001), "n": total})

    rows = docs.select("text").mapInPandas(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(1001, np.int64)
    count[rows["bin"].to_numpy(int)] = rows["n"].to_numpy(np.int64)
    rank = np.empty(1001, np.int64)
    rank[np.lexsort((np.arange(1001), count))] = np.arange(1001)
    rank[: cfg.weak] = _NEVER
    return rank


def features(texts: list[bytes], rank: np.ndarray, cfg: DigestConfig) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct features of each text, in order."""
    j, w, k = Joined(texts, cfg), cfg.window, cfg.around
    n = len(j.buf)
    named = np.zeros(n, np.uint8)  # at most k times
    best = np.full(len(texts), np.iinfo(np.int64).max)
    tail = np.zeros(0, np.int64)  # windows whose neighbours lie in the next block
    for a, bins, whole in j.blocks():
        v = np.where(whole, rank[bins], _NONE) << 40 | np.arange(a, a + len(bins))
        if whole.any():
            text = np.searchsorted(j.start, np.arange(a, a + len(bins))[whole], side="right") - 1
            first = np.flatnonzero(np.diff(text, prepend=-1))
            best[text[first]] = np.minimum(best[text[first]], np.minimum.reduceat(v[whole], first))
        v = np.concatenate([tail, v])
        last = a + len(bins) >= n - w + 1
        full = len(v) if last else len(v) - k + 1
        padded = np.concatenate([v, np.full(k + -(len(v) + k) % k, np.iinfo(np.int64).max)]).reshape(-1, k)
        fore = np.minimum.accumulate(padded, axis=1).ravel()
        back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        s = np.arange(full)
        least = np.minimum(back[s], fore[s + k - 1])
        ok = (v[:full] >> 40 < _NONE) & (least >> 40 < _NEVER)
        hit, times = np.unique(least[ok] & _POS, return_counts=True)
        named[hit] += times.astype(np.uint8)
        tail = v[full:]
    pos = np.flatnonzero(named >= cfg.named)
    text = np.searchsorted(j.start, pos, side="right") - 1
    end = pos + w
    bare = np.setdiff1d(np.flatnonzero(j.size > 0), text)
    if len(bare):
        short = j.size[bare] < w
        own = np.where(short, j.start[bare], best[bare] & _POS)
        text, pos = np.concatenate([text, bare]), np.concatenate([pos, own])
        end = np.concatenate([end, np.where(short, own + j.size[bare], own + w)])
    if not len(pos):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = hashes_at(j.buf, pos, end)
    order = np.lexsort((pos, h, text))
    again = (text[order][1:] == text[order][:-1]) & (h[order][1:] == h[order][:-1])
    keep = np.sort(order[np.concatenate([[True], ~again])])
    keep = keep[np.lexsort((pos[keep], text[keep]))]
    return text[keep], h[keep]


def hashes_at(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end], block by block."""
    if len(buf) <= 4 * BLOCK:
        return span_hash(prefix_hash(buf), start, end)
    out = np.empty(len(start), np.uint64)
    block = start // BLOCK
    for b in np.unique(block).tolist():
        at = np.flatnonzero(block == b)
        a = b * BLOCK
        out[at] = span_hash(prefix_hash(buf[a : int(end[at].max())]), start[at] - a, end[at] - a)
    return out


def digests(texts: list[bytes], rank: np.ndarray, cfg: DigestConfig) -> list[np.ndarray]:
    """Each text's filters, a row of bytes each."""
    text, h = features(texts, rank, cfg)
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    chain = -(-np.diff(first) // cfg.per_filter)
    offset = np.concatenate([[0], np.cumsum(chain)])
    row = offset[text] + (np.arange(len(text)) - first[text]) // cfg.per_filter
    bits = np.zeros((int(offset[-1]), cfg.filter_bits), bool)
    width = cfg.filter_bits.bit_length() - 1
    for i in range(cfg.hashes):
        bits[row, (h >> np.uint64(i * width)).astype(np.int64) & (cfg.filter_bits - 1)] = True
    packed = np.packbits(bits, axis=1) if len(bits) else np.zeros((0, cfg.filter_bits // 8), np.uint8)
    return [packed[a:b] for a, b in zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True)]


def written(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def read(fingerprint: str, cfg: DigestConfig = DigestConfig()) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, cfg.filter_bits // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1 for two chains of filters; 1 for equal ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    size = a.shape[1] * 8
    y = np.unpackbits(b, axis=1).astype(np.float32)
    ny = y.sum(axis=1, dtype=np.float64)
    best_b, total, weight = np.zeros(len(b)), 0.0, float(ny.sum())
    for at in range(0, len(a), 64):
        x = np.unpackbits(a[at : at + 64], axis=1).astype(np.float32)
        nx = x.sum(axis=1, dtype=np.float64)
        chance = np.outer(nx, ny) / size
        s = np.clip((x @ y.T - chance) / (np.maximum(nx[:, None], ny) - chance), 0, 1)
        total += float(nx @ s.max(axis=1))
        weight += float(nx.sum())
        best_b = np.maximum(best_b, s.max(axis=0))
    return round((total + float(ny @ best_b)) / weight, 9)


def fingerprints(docs: DataFrame, rank: np.ndarray | None = None, cfg: DigestConfig = DigestConfig()) -> DataFrame:
    """doc_id, fingerprint of every document; rank: of another corpus, if fingerprints are to be compared across corpora."""
    rank = fit_rarity(docs, cfg) if rank is None else rank

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for ids, raws in small_batches(list(pdf["doc_id"]), list(pdf["text"]), 1 << 19):
                yield pd.DataFrame({"doc_id": ids, "fingerprint": [written(f) for f in digests(raws, rank, cfg)]})
        give_back()

    given = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return given.mapInPandas(run, "doc_id string, fingerprint string").select(F.col("doc_id").cast("long").alias("doc_id"), "fingerprint")


def likeness_of(a: Column | str, b: Column | str) -> Column:
    """Likeness of two columns of fingerprints; null where one is."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else likeness(read(x), read(y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(a, b)


# ---- each document beside the next one ---------------------------------------------------------------
_KEY = "struct<given:int,id:long,th:long>"


def order_key() -> Column:
    """Descending, this is the order by doc_id, nulls last, then by the hash of the text."""
    return F.struct(F.col("doc_id").isNotNull().cast("int").alias("given"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("th"))


def in_order(docs: DataFrame, sample: int = 1 << 15) -> DataFrame:
    """part, tail, doc_id, text: the documents by descending id, cut into parts; after the rows of a part (in order, tail 0) comes the
    row that follows them (tail 1): the first of the next part, and after the last part the very first.

    Parts begin at rows drawn by a hash of the key, about `sample` of them at most reach the driver; the first row of a part thus is known
    by its key alone and is sent to two parts. Texts are shuffled once, and no task sees more than its parts."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", order_key())
    parts = min(1 << 16, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    total, top = docs.count(), rows.agg(F.max("key")).first()[0]
    drawn = rows.where(share(F.xxhash64("key"), min(sample, 16 * parts), total)).select("key").distinct().collect()
    keys = sorted({tuple(r.key) for r in drawn} | ({tuple(top)} if top is not None else set()), reverse=True)
    keys = keys[:: max(1, len(keys) // parts)]
    step = max(1, int(len(keys) ** 0.5))
    bounds = spark.createDataFrame([(keys,)], f"b array<{_KEY}>").select("b").scalar()
    rows = rows.withColumn("_b", bounds)
    coarse = F.size(F.filter("_b", lambda x, i: (i % step == 0) & (x >= F.col("key")))) - 1  # the last of every step-th bound not below
    rows = rows.withColumn("_c", coarse)
    fine = F.size(F.filter(F.slice("_b", F.col("_c") * step + 1, step), lambda x: x >= F.col("key"))) - 1
    rows = rows.withColumn("part", F.col("_c") * step + fine)
    head = F.element_at("_b", F.col("part") + 1) == F.col("key")
    here = F.struct(F.col("part").alias("part"), F.lit(0).alias("tail"))
    before = F.struct(F.pmod(F.col("part") - 1, F.lit(max(1, len(keys)))).alias("part"), F.lit(1).alias("tail"))
    sent = rows.select("doc_id", "text", "key", F.explode(F.when(head, F.array(here, before)).otherwise(F.array(here))).alias("to"))
    out = sent.select("to.*", "key", F.col("doc_id").cast("string").alias("doc_id"), "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
    return out.sortWithinPartitions("part", "tail", F.desc("key")).select("part", "tail", "doc_id", "text")


def op11(docs: DataFrame, cfg: DigestConfig = DigestConfig()) -> DataFrame:
    """Fingerprints of each document and of its text with the last half from the next document, and likenesses to that and to the next."""
    rank = fit_rarity(docs, cfg)

    def pairs(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        """Results of all rows but the last, and of those before a change of part."""
        raws = [r[3].encode("utf-8", "surrogatepass") for r in rows]
        prints = digests(raws, rank, cfg)
        own = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
        mixed = []
        for i in own:
            text, half = rows[i][3], len(rows[i][3]) // 2
            mixed.append((text[: len(text) - half] + rows[i + 1][3][:half]).encode("utf-8", "surrogatepass"))
        edited = digests(mixed, rank, cfg)
        out = pd.DataFrame(
            {
                "n_chars": [len(rows[i][3]) for i in own],
                "edited_sha256": [hashlib.sha256(m).hexdigest() for m in mixed],
                "fingerprint": [written(prints[i]) for i in own],
                "edited_fingerprint": [written(f) for f in edited],
                "near_edited": [likeness(prints[i], f) for i, f in zip(own, edited, strict=True)],
                "near_next": [likeness(prints[i], prints[i + 1]) for i in own],
            }
        )
        out.insert(0, "doc_id", ints([rows[i][2] for i in own]))
        if own:
            yield out

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for pdf in it:
            for row in zip(pdf["part"].tolist(), pdf["tail"].tolist(), pdf["doc_id"], pdf["text"], strict=True):
                held.append(row)
                size += len(row[3])
                if size > 1 << 18 and len(held) > 1:
                    yield from pairs(held)
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield from pairs(held)
        give_back()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs).mapInPandas(run, schema)
