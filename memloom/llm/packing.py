"""Harmonic packing of documents into training sequences (operator 3).

Class k holds pieces of capacity/(k+1) to capacity/k tokens, and a sequence of class k takes exactly
k of them, so sequences fill without comparing lengths and without talk between workers. A document is
cut greedily at reciprocal capacities: full sequences first, then the largest capacity/(k+1) that the
rest holds, until the rest is of class `whole_from` or above; so almost every piece fills its share.

Pieces are ranked within (class, bucket); bucket counts, summed up per class, turn ranks into global
ones, and rank div k is the sequence. What is left of each class (fewer than k pieces, so a bounded
number altogether) is packed first-fit by decreasing length.

Defined cases: null text: the empty document, one piece with the end id alone; rows that repeat a
doc_id are packed each; a null doc_id is packed too; very long texts give many full pieces; empty
table: empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import ints, stage
from memloom.llm.tokens import byte_bpe


@dataclass(frozen=True)
class PackConfig:
    capacity: int = 2048
    end_id: int = 1
    whole_from: int = 16  # pieces of this class and above are not cut further
    bucket_rows: int = 50_000
    vocabulary: str | None = None  # path of the ranks file; None: the public byte_bpe_50k


def cuts(length: int, cfg: PackConfig) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `length` ids."""
    c, at, out = cfg.capacity, 0, []
    while at < length:
        rest = length - at
        if rest >= c:
            take = c
        else:
            k = c // rest
            take = rest if k >= cfg.whole_from or rest == c // k else c // (k + 1)
        out.append((at, take))
        at += take
    return out


def pieces(docs: DataFrame, cfg: PackConfig) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, end = byte_bpe(cfg.vocabulary), np.array([cfg.end_id], "<u4").tobytes()
        for pdf in it:
            rows = []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = memoryview(bpe.encode(text) + end)
                n = len(ids) // 4
                rows += [(i, a, k, zlib.crc32(ids[4 * a : 4 * (a + k)]), n) for a, k in cuts(n, cfg)]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.assign(doc_id=ints([r[0] for r in rows]))

    text = F.coalesce("text", F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long"), text).mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit(pdf: pd.DataFrame, capacity: int, base: int) -> pd.DataFrame:
    """sequence_id and offset for a bounded set of pieces, longest first into the first that has room."""
    pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], ignore_index=True)
    fill: list[int] = []
    seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
    for j, need in enumerate(pdf["length"].tolist()):
        s = next((s for s, f in enumerate(fill) if f + need <= capacity), len(fill))
        if s == len(fill):
            fill.append(0)
        seq[j], off[j] = base + s, fill[s]
        fill[s] += need
    return pdf.assign(sequence_id=seq, offset=off)


def pack(docs: DataFrame, cfg: PackConfig = PackConfig()) -> DataFrame:
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = stage(pieces(docs, cfg), "pieces")
    buckets = max(1, -(-got.count() // cfg.bucket_rows))
    got = got.withColumn("k", F.floor(F.lit(cfg.capacity) / F.col("length")).cast("long")).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets))
    )
    counts = got.groupBy("k", "bucket").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(by_class), F.lit(0)))
    kinds = got.groupBy("k").agg(F.count("*").alias("total")).withColumn("bins", F.floor(F.col("total") / F.col("k")))
    # at most 2 * sqrt(capacity) classes
    order = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("base", F.coalesce(F.sum("bins").over(order), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("k", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    placed = got.withColumn("rank", rank).join(counts, ["k", "bucket"]).join(F.broadcast(kinds), "k")
    placed = placed.withColumn("at", F.col("before") + F.col("rank") - 1).withColumn("full", F.col("at") < F.col("bins") * F.col("k"))
    placed = stage(placed.select(*cols, "k", "at", "full", (F.col("base") + F.floor(F.col("at") / F.col("k"))).alias("sequence_id")), "placed")
    within = Window.partitionBy("sequence_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    full = placed.where("full").select(*cols, "sequence_id", F.coalesce(F.sum("length").over(within), F.lit(0)).alias("offset"))
    base, capacity = (full.agg(F.max("sequence_id")).first()[0] or 0) + 1, cfg.capacity
    rest = placed.where("not full").select(*cols).groupBy().applyInPandas(
        lambda pdf: first_fit(pdf, capacity, base), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return full.union(rest)


def op3(docs: DataFrame, cfg: PackConfig = PackConfig()) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(docs, cfg)
