"""Feeds read through the data source (inventory IO20 to IO25), over all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators.graph import first
from memloom.sources import feeds

ENTRIES = 10  # of a source, as its feed gives no more


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = feeds.publish(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return feeds.fan_in(feeds.read(spark, path))[0]


def io20_feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest entries of every source, with title and tag."""
    title = F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)</title>", 1)), F.lit(""))
    return first(_pages(spark, sf_dir), ["source"], [F.desc("page_id"), "url"], ENTRIES).select("source", "page_id", "url", F.length(F.coalesce(title, F.lit(""))).alias("title_length"), "rn")


def io24_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every source, all sources in one."""
    return _pages(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("letters"), F.max("page_id").alias("newest"))


QUERIES = {f.__name__: f for f in (io20_feed_entries, io24_fan_in)}
_SOURCE = "SELECT coalesce(nullif(split_part(url, '/', 3), ''), 'none') AS source, * FROM pages"
ORACLE = {
    "io20_feed_entries": f"SELECT source, page_id, url, length(trim(coalesce(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1), ''))) AS title_length, rn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page_id DESC, url) AS rn FROM ({_SOURCE}) x) y WHERE rn <= 10",
    "io24_fan_in": f"SELECT source, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS letters, max(page_id) AS newest FROM ({_SOURCE}) x GROUP BY source",
}
