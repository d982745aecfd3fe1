"""The corpus pipeline: quality classifier, n-gram Jaccard join, suffix-array dedup, secret scan, packing.

Defined cases, for every stage: null text counts as empty; a null doc_id is a document like others; rows that repeat a
doc_id are documents of their own; other columns, whatever their names, pass through unchanged; an empty table gives an
empty table. Without labels the classifier keeps everything. Of equal rows the Jaccard stage keeps one (texts without
words all stay), and the suffix stage drops a document of which nothing is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.llm import jaccard_join, packing, quality_classifier, secret_scan, suffix_dedup
from memloom.llm.common import stage, table
from memloom.sources.session import ship


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts (score of 0.3 or more); a null text is scored as the empty one."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest id."""
    return jaccard_join.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 256-byte strings that occur elsewhere too: 50 words are 400 bytes only if they are long."""
    return suffix_dedup.remove_repeats(docs, suffix_dedup.RepeatConfig(length=256, gram=48))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a placeholder."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return packing.op3(docs)


STAGES = [("quality_classifier", classify), ("jaccard_join", near_duplicates), ("suffix_dedup", repeats), ("secret_scan", secrets), ("packing", pack)]

#: The classifier and the packing order have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = table(ship(spark), sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
