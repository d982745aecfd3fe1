"""Queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memloom.llm import ann, collocations, fingerprints, jaccard_join, lang_id, oracles, packing, periodic_runs, piece_codec, quality_classifier, quality_rules, secret_scan, suffix_dedup, token_counts
from memloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.op1(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op3(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op4(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op5(table(spark, sf_dir, "embeddings"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op6(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.op7(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op9(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op10(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.op11(table(spark, sf_dir, "documents"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.op12(table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.op13(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_lang_id": op1,
    "op2_quality_rules": op2,
    "op3_packing": op3,
    "op4_suffix_dedup": op4,
    "op5_ann": op5,
    "op6_secret_scan": op6,
    "op7_piece_codec": op7,
    "op8_quality_classifier": op8,
    "op9_jaccard_join": op9,
    "op10_token_counts": op10,
    "op11_fingerprints": op11,
    "op12_collocations": op12,
    "op13_periodic_runs": op13,
}

ORACLE: dict[str, str] = {"op4_suffix_dedup": oracles.SUFFIX_DEDUP, "op9_jaccard_join": oracles.JACCARD_JOIN, "op12_collocations": collocations.SQL}
