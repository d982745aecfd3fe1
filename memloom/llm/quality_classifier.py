"""Quality classifier by positive-unlabelled learning (operator 8).

A logistic model over hashed byte trigrams and a few shape statistics is fitted by minimising the
non-negative unbiased risk: trusted positives, unlabelled web text, and a class prior estimated from
the labelled training rows, all of them. The rows whose texts are trained on are a bounded sample, the lowest
share of a hash (`PuConfig`); every document is scored over its whole text.

Defined cases: null text scores as the empty text; rows of a repeated doc_id are scored one by one;
a null doc_id is never held out and never trained on; without any positive training row every score
is 0.5; an empty table gives an empty result. Labels that disagree for one doc_id count as their mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from memloom.llm.common import Words, fold, free_name, give_back, share, small_batches


@dataclass(frozen=True)
class PuConfig:
    bins: int = 512  # hashed byte trigrams
    positives: int = 3000  # expected bound of the trusted sample; twice as many rows are the most
    unlabelled: int = 6000  # expected bound of the unlabelled sample; twice as many rows are the most
    epochs: int = 30
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 8


N_SHAPE = 14


def features(texts: list[bytes], bins: int) -> np.ndarray:
    """One float32 row per text: square roots of trigram shares, then shape statistics."""
    n = len(texts)
    w = Words(texts)
    buf, lens = w.buf, w.lens
    doc = np.repeat(np.arange(n), lens + 1)
    b = buf.astype(np.uint32)
    tri = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    tri = (tri >> np.uint32(16)).astype(np.int64) % bins
    pos = np.arange(len(tri))
    inside = pos + 2 < w.doc_start[doc[: len(tri)] + 1] - 1
    hist = np.bincount((doc[: len(tri)] * bins + tri)[inside], minlength=n * bins).reshape(n, bins).astype(np.float32)
    grams = np.sqrt(hist / np.maximum(hist.sum(1, keepdims=True), 1))

    kind = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 beyond ASCII
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 1, 2, 3, 6
    kind[[32, 9, 11, 12, 13]], kind[10] = 4, 5
    share = np.bincount(doc * 7 + kind[buf], minlength=n * 7).reshape(n, 7).astype(np.float64)
    share /= np.maximum(lens + 1, 1)[:, None]

    count = np.diff(w.first).astype(np.float64)
    per = np.maximum(count, 1)
    h = w.hashes()
    wlen = (w.end - w.start).astype(np.float64)
    total = lambda x, d: np.bincount(d, weights=x, minlength=n)
    same = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    order = np.lexsort((h, w.doc))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    alnum = np.isin(kind, (1, 2, 3, 6))
    tail = ~alnum[buf[w.end - 1]] if len(w.end) else np.zeros(0, bool)
    tail2 = tail & ~alnum[buf[np.maximum(w.end - 2, 0)]] if len(w.end) else tail
    shape = np.stack(
        [
            share[:, 1], share[:, 2] * 4, share[:, 3] * 4, share[:, 0] * 4, share[:, 6], share[:, 5] * 20,
            total(same.astype(float), w.doc[1:]) / per if len(h) else np.zeros(n),
            total(fresh.astype(float), w.doc[order]) / per,
            total(wlen, w.doc) / per / 8, np.log1p(count) / 8,
            total(tail.astype(float), w.doc) / per, total(tail2.astype(float), w.doc) / per * 2,
            total((wlen == 1).astype(float), w.doc) / per, (count == 0).astype(float),
        ],
        axis=1,
    ).astype(np.float32)
    return np.concatenate([grams, shape], axis=1)


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, cfg: PuConfig) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights, bias, mean and scale of the logistic model of least non-negative unbiased risk."""
    rng = np.random.default_rng(cfg.seed)
    mean, scale = unl.mean(0), unl.std(0) + 1e-3
    p, u = (pos - mean) / scale, (unl - mean) / scale
    w, b = np.zeros(p.shape[1]), 0.0
    m, v, t = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    soft = lambda z: np.logaddexp(0, z)
    steps = max(1, len(u) // 256)
    for _ in range(cfg.epochs):
        pi, ui = np.array_split(rng.permutation(len(p)), steps), np.array_split(rng.permutation(len(u)), steps)
        for x, y in zip(pi, ui, strict=True):
            a, c = (p[x] if len(x) else p), u[y]
            za, zc = a @ w + b, c @ w + b
            # risk of calling text negative: that of unlabelled text less that of its positive part
            rest = soft(zc).mean() - prior * soft(za).mean()
            ga, gc = prior * (sig(za) - 1) / len(za), np.zeros(len(zc))
            if rest >= 0:
                ga, gc = ga - prior * sig(za) / len(za), sig(zc) / len(zc)
            else:  # the estimate is below what any classifier can have: undo it
                ga, gc = prior * sig(za) / len(za), -sig(zc) / len(zc)
            grad = np.append(a.T @ ga + c.T @ gc + cfg.decay * w, ga.sum() + gc.sum())
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            step = cfg.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
    return w, float(b), mean, scale


def _feature_rows(docs: DataFrame, seed: int, bound: int, cfg: PuConfig) -> np.ndarray:
    """Features of a frame of texts, computed where the texts are; of more than `bound` rows those of least hash."""
    bins = cfg.bins

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for h, texts in small_batches(list(pdf["h"]), list(pdf["text"])):
                yield pd.DataFrame({"h": h, "x": [r.tobytes() for r in features(texts, bins)]})

    rows = docs.select(F.xxhash64("doc_id", "text", F.lit(seed)).alias("h"), "text").mapInPandas(run, "h long, x binary").orderBy("h").limit(bound).collect()
    return np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float32).reshape(len(rows), bins + N_SHAPE)


def train(docs: DataFrame, labels: DataFrame, cfg: PuConfig = PuConfig()) -> tuple | None:
    """The model, from text and labels alone; held-out ids (crc32 mod 5 = 0) give no label. Texts are read for the rows
    of the bounded samples only and never shuffled."""
    known = labels.where(F.col("quality").isNotNull() & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    rows, positive = known.agg(F.count("*"), F.sum("good")).first()
    if not positive:
        return None
    good = known.where("good = 1")
    key = F.xxhash64("doc_id", F.lit(cfg.seed))
    chosen = good.where(share(key, cfg.positives, positive)).orderBy(key).limit(2 * cfg.positives).select("doc_id")
    trusted = docs.join(F.broadcast(chosen), "doc_id", "left_semi")
    # ids may repeat, so their rows and their shares have no bound of their own
    pos = _feature_rows(docs.join(F.broadcast(chosen), "doc_id", "left_semi"), cfg.seed, 2 * cfg.positives, cfg)
    unl = _feature_rows(docs.where(share(F.xxhash64("doc_id", "text", F.lit(cfg.seed + 1)), cfg.unlabelled, docs.count())), cfg.seed, 2 * cfg.unlabelled, cfg)
    if not len(pos) or not len(unl):
        return None
    return fit_nnpu(pos.astype(np.float64), unl.astype(np.float64), min(positive / rows, 0.99), cfg)


def score(docs: DataFrame, model: tuple | None, keep: list[str], cfg: PuConfig = PuConfig()) -> DataFrame:
    """docs' columns `keep` and `score`, from whole texts, batch by batch. Names of docs are its own: the text and
    the score travel under names that no column of docs has."""
    spark, bins = docs.sparkSession, cfg.bins
    shared = spark.sparkContext.broadcast(model)  # fixed size: bins + N_SHAPE weights
    text, out_name = free_name(keep, "text"), free_name(keep, "score")
    schema = StructType([*docs.select(*keep).schema, StructField(out_name, DoubleType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = np.full(len(pdf), 0.5)
            if shared.value is not None:
                w, b, mean, scale = shared.value
                at = 0
                for _, texts in small_batches(range(len(pdf)), list(pdf[text])):
                    z = ((features(texts, bins) - mean) / scale) @ w + b
                    out[at : at + len(texts)] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                    at += len(texts)
            res = pdf[keep].copy()
            res[out_name] = out
            yield res
        give_back()

    return docs.select(*keep, F.col("text").alias(text)).mapInPandas(run, schema)


def op8(docs: DataFrame, labels: DataFrame, cfg: PuConfig = PuConfig()) -> DataFrame:
    """doc_id, held_out, score, predicted (1 where score >= 0.3) for every document."""
    scored = score(docs.select("doc_id", "text"), train(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), cfg), ["doc_id"], cfg)
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, cfg: PuConfig = PuConfig()) -> DataFrame:
    """docs without the rows whose score is below 0.3; columns as they came."""
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), cfg)
    name = free_name(docs.columns, "score")
    return score(docs, model, docs.columns, cfg).where(F.col(name) >= 0.3).select(docs.columns)
