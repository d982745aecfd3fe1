"""Quality rules by hashed n-gram log-likelihood ratio (operator 2), in DataFrame functions only.

Words and 3-word windows are hashed into `buckets` counters. Two multinomials are counted: one of all text, over the
whole corpus, and one of the trusted target, over documents labelled quality 1 (a bounded sample of them, the lowest
share of a hash, whose ids are sent to the texts; texts are never shuffled). A document's score is the sum of its
n-grams' log ratios over their number; below `threshold` it is not kept. Ratios are rounded to thousandths and summed
as integers, so every document's verdict is the same in every run.

Defined cases: null text has no words (all counts 0, base_failed); a text of fewer than three words has no window; a
null doc_id is kept as a row; labels that repeat count once; without trusted documents the ratios are 0
and the base rules decide; empty table: empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import share


@dataclass(frozen=True)
class LlrConfig:
    buckets: int = 1 << 13
    smooth: float = 1.0
    threshold: int = -50  # thousandths per n-gram
    least_words: int = 50
    trusted: int = 20_000  # expected bound of the trusted sample
    seed: int = 2


#: Fixed values of the base rules.
SPACES = ("\t", "\n", "\x0b", "\f", "\r")
SYMBOLS = r"[#*$%&|<>]"


def blanked(text: Column) -> Column:
    """The text with every white space a blank."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words(blank: Column) -> Column:
    return F.array_remove(F.split(blank, " "), "")


def ratios(docs: DataFrame, labels: DataFrame, cfg: LlrConfig) -> list[int]:
    """The log ratio of every bucket in thousandths, from counts over all documents."""
    trusted = labels.where("quality = 1").select("doc_id").distinct()
    chosen = trusted.where(share(F.xxhash64("doc_id", F.lit(cfg.seed)), cfg.trusted, trusted.count())).withColumn("good", F.lit(1))
    w = docs.join(F.broadcast(chosen), "doc_id", "left").select("good", words(blanked(F.coalesce("text", F.lit("")))).alias("w"))
    grams = w.select("good", F.explode(F.concat(F.transform("w", lambda x: F.xxhash64(x)), windows3(F.col("w")))).alias("h"))
    n, a = cfg.buckets, cfg.smooth
    raw, target = np.zeros(n), np.zeros(n)
    for r in grams.groupBy(F.pmod("h", F.lit(n)).alias("b")).agg(F.count("*").alias("raw"), F.count("good").alias("target")).collect():  # at most `buckets` rows
        raw[r.b], target[r.b] = r.raw, r.target
    if not target.sum():
        return [0] * n
    llr = np.log((target + a) / (target.sum() + a * n)) - np.log((raw + a) / (raw.sum() + a * n))
    return [int(x) for x in np.round(1000 * llr)]


def windows3(w: Column) -> Column:
    """Hashes of the 3-word windows. Sorted with their places, equal neighbours mark what repeats."""
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))


def base(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, w (words), g (hashes of the 3-word windows) and the base counts of every document."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select(*keep, text.alias("t"), blanked(text).alias("r")).withColumn("w", words(F.col("r")))
    d = d.withColumn("n_words", F.size("w").cast("long")).withColumn("g", windows3(F.col("w")))
    d = d.withColumn("twice", F.size("g") > F.size(F.array_distinct("g")))
    pairs = F.when(F.col("twice"), F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.lit([]).cast("array<struct<h:bigint,i:int>>"))
    d = d.withColumn("p", pairs)
    at = F.transform("p", lambda x, j: F.when((F.get("p", j - 1)["h"] == x["h"]) | (F.get("p", j + 1)["h"] == x["h"]), x["i"]).otherwise(-1))
    d = d.withColumn("at", F.array_sort(F.filter(at, lambda x: x >= 0)))
    # windows at sorted places cover three words each, less what the next one covers again
    gaps = F.zip_with(F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0))), F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.aggregate(gaps, F.lit(3), lambda acc, x: acc + x)
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return d.select(
        *keep, "w", "g", "n_words", F.length(F.replace("r", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.col("twice"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def op2(docs: DataFrame, labels: DataFrame, cfg: LlrConfig = LlrConfig()) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and llr (thousandths, summed) over n_grams."""
    weights = F.expr(f"array({', '.join(map(str, ratios(docs, labels, cfg)))})")  # `buckets` numbers, whatever the corpus
    weight = lambda h: F.get(weights, F.pmod(h, F.lit(cfg.buckets)).cast("int"))
    zero = F.lit(0).cast("long")
    d = base(docs, ["doc_id"])
    d = d.withColumn("llr", F.aggregate("w", zero, lambda acc, x: acc + weight(F.xxhash64(x))) + F.aggregate("g", zero, lambda acc, h: acc + weight(h)))
    failed = (F.col("n_words") < cfg.least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    n = F.size("w") + F.size("g")
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("llr") >= cfg.threshold * n)).alias("kept"), "llr", n.cast("long").alias("n_grams"),
    )
