"""Language identification by a byte convolutional network (operator 1).

Windows of `window` bytes go through byte embeddings, filters of several widths, max pooling over the
window and a softmax. The network is trained in numpy on all windows of the whole texts of a bounded sample of each
language, the lowest share of a hash; every text is then read whole, window by window, and its windows' probabilities are averaged
by length. As input bytes are discrete, embedding times filter is one table row per byte.

Defined cases: null text or text without a letter: `und`, score 0; null lang is never learned; a null
doc_id is not held out and not learned; without any labelled row all texts are `und`; empty table: empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import fold, small_batches


@dataclass(frozen=True)
class ByteConvConfig:
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8  # of each width
    dim: int = 8
    per_language: int = 150  # expected bound of the sample: documents of each language; twice as many are the most
    most_languages: int = 500  # the commonest are learned
    epochs: int = 10
    rate: float = 0.01
    seed: int = 1


PAD = 256


def to_windows(raw: bytes, size: int) -> np.ndarray:
    """The text's bytes in rows of `size`, the last one padded."""
    n = -(-len(raw) // size)
    out = np.full(n * size, PAD, np.int16)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, size)


class ByteConv:
    def __init__(self, cfg: ByteConvConfig, langs: list[str]):
        rng = np.random.default_rng(cfg.seed)
        self.cfg, self.langs = cfg, langs
        self.E = rng.normal(0, 0.3, (PAD + 1, cfg.dim))
        self.W = [rng.normal(0, 0.3, (k, cfg.dim, cfg.filters)) for k in cfg.widths]
        self.b = np.zeros(len(cfg.widths) * cfg.filters)
        self.V = rng.normal(0, 0.1, (len(self.b), len(langs)))
        self.c = np.zeros(len(langs))

    def tables(self) -> list[np.ndarray]:
        return [np.einsum("vd,kdf->kvf", self.E, w).astype(np.float32) for w in self.W]

    def pooled(self, x: np.ndarray, tables: list[np.ndarray], where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of every filter over each window, and where it is."""
        tops, places = [], []
        for t in tables:
            k, L = len(t), x.shape[1]
            s = t[0][x[:, : L - k + 1]]
            for j in range(1, k):
                s += t[j][x[:, j : L - k + 1 + j]]
            if where:
                places.append(s.argmax(1))
            tops.append(s.max(1))
        return np.concatenate(tops, 1) + self.b, places

    def probs(self, p: np.ndarray) -> np.ndarray:
        z = np.maximum(p, 0) @ self.V + self.c
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray) -> ByteConv:
        cfg, rng = self.cfg, np.random.default_rng(self.cfg.seed)
        params = [self.E, *self.W, self.b, self.V, self.c]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        weight = (len(y) / (len(self.langs) * np.maximum(np.bincount(y, minlength=len(self.langs)), 1)))[y]
        for _ in range(cfg.epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                xb, yb = x[at], y[at]
                p, places = self.pooled(xb, self.tables(), where=True)
                g = self.probs(p)
                g[np.arange(len(yb)), yb] -= 1
                g *= (weight[at] / len(yb))[:, None]
                act = np.maximum(p, 0)
                gp = (g @ self.V.T) * (p > 0)
                gE, gW, f0 = np.zeros_like(self.E), [], 0
                for w, place in zip(self.W, places, strict=True):
                    gf = gp[:, f0 : f0 + cfg.filters]
                    f0 += cfg.filters
                    gw = np.zeros_like(w)
                    for j in range(len(w)):
                        b = np.take_along_axis(xb, place + j, 1)  # the byte under filter f at its best place
                        gw[j] = np.einsum("nfd,nf->df", self.E[b], gf)
                        np.add.at(gE, b, gf[:, :, None] * w[j].T[None])
                    gW.append(gw)
                grads = [gE, *gW, gp.sum(0), act.T @ g, g.sum(0)]
                t += 1
                for i, (q, d) in enumerate(zip(params, grads, strict=True)):
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    q -= cfg.rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self


def train(docs: DataFrame, cfg: ByteConvConfig = ByteConvConfig()) -> ByteConv | None:
    """Fitted on text and non-null lang of documents that are not held out (crc32 mod 4 is not 2)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 4) != 2)).select("lang", "text", F.xxhash64("doc_id", "text", F.lit(cfg.seed)).alias("h"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(cfg.most_languages)
    least = F.pmod("h", F.lit(1 << 40)) < F.ceil(F.least(F.lit(1.0), cfg.per_language / F.col("count")) * (1 << 40))
    chosen = rows.join(F.broadcast(counts), "lang").where(least)  # counts: most_languages rows at most
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # of the sample alone; Spark keeps the first of each task
    sample = chosen.withColumn("nth", order).where(F.col("nth") <= 2 * cfg.per_language).select("lang", "h", "text")
    size = cfg.window

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for lang, h, text in zip(pdf["lang"], pdf["h"], pdf["text"], strict=True):
                w = to_windows(text.encode("utf-8", "surrogatepass"), size)
                yield pd.DataFrame({"lang": lang, "h": h, "k": np.arange(len(w)), "w": [r.tobytes() for r in w]})

    got = sample.mapInPandas(cut, "lang string, h long, k int, w binary").collect()
    got.sort(key=lambda r: (r.lang, r.h, r.k, r.w))
    langs = sorted({r.lang for r in got})
    if not langs:
        return None
    rng, x, y = np.random.default_rng(cfg.seed), [], []
    for r in got:
        row = np.frombuffer(r.w, np.int16).copy()
        if r.k % 2:  # short texts occur too
            row[int(rng.integers(8, cfg.window)) :] = PAD
        x.append(row)
        y.append(langs.index(r.lang))
    return ByteConv(cfg, langs).train(np.array(x), np.array(y))


def predict(docs: DataFrame, model: ByteConv | None) -> DataFrame:
    """doc_id, lang_pred, score for every row, from whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: one small network

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        tables = net.tables() if net else []
        for pdf in it:
            lang, score, at = ["und"] * len(pdf), np.zeros(len(pdf)), 0
            texts = pdf["text"].where(pdf["letters"], "")
            for _, raws in small_batches(range(len(pdf)), list(texts)) if net else ():
                wins = [to_windows(r, net.cfg.window) for r in raws]
                count = [len(w) for w in wins]
                x = np.concatenate(wins)
                p = np.concatenate([net.probs(net.pooled(x[a : a + 64], tables)[0]) for a in range(0, len(x), 64)]) if len(x) else np.zeros((0, len(net.langs)))
                p *= (x != PAD).sum(1)[:, None]
                end = np.cumsum(count)
                for j, (n, e) in enumerate(zip(count, end, strict=True)):
                    if n:
                        q = p[e - n : e].sum(0) / len(raws[j])
                        lang[at + j], score[at + j] = net.langs[int(q.argmax())], min(float(q.max()), 1.0)
                at += len(raws)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": lang, "score": score})

    text = F.coalesce("text", F.lit(""))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text.alias("text"), F.regexp_like(text, F.lit(r"\p{L}")).alias("letters")).mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")


def op1(docs: DataFrame, cfg: ByteConvConfig = ByteConvConfig()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    got = predict(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang"), cfg))
    return got.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
