"""Positions in one total order over a whole table, without a task that sees every row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 4096  # rows that place the range bounds; they decide balance, never results


def global_rank(rows: DataFrame, order: list[str], position: str, bounds: int = 256) -> DataFrame:
    """rows with `position`, counted from 1 in ascending `order`, whose last column is an id.

    Rows are cut into ranges of the whole order key, so equal values spread by their id; each range is
    ranked by itself and shifted by the rows of the ranges before it. What passes through the driver is
    a sample of SAMPLE keys, and the window without a key sees one row a range. Nulls come first."""
    key = F.struct(*order)
    picked = rows.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    sample = picked.orderBy("k").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    step = F.greatest(F.lit(1), F.ceil(F.size("ks") / bounds))
    cuts = sample.select(F.filter("ks", lambda _, i: i % step == step - 1)).scalar()
    # two steps of at most 16 comparisons: first among every sixteenth cut, then among the cuts after it
    coarse = F.filter("_cuts", lambda _, i: i % 16 == 15)
    ranged = rows.withColumn("_cuts", cuts).withColumn("_coarse", coarse).withColumn("_at", 16 * F.size(F.filter("_coarse", lambda c: c < key)))
    ranged = ranged.withColumn("_range", F.col("_at") + F.size(F.filter(F.slice("_cuts", F.col("_at") + 1, 16), lambda c: c < key))).drop("_cuts", "_coarse", "_at")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    shift = F.broadcast(sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before")))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_inside", inside).join(shift, "_range").withColumn(position, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def value_at(rows: DataFrame, col: str, name: str, index: Callable[[int], int], few: int = 1_000_000) -> DataFrame:
    """One row: the value of `col` at a position (from 1, a function of the number of rows) of its ascending order, nulls
    left out; no row if there are none.

    The values are narrowed to a bracket around the position by approximate percentiles, with the rows below it counted,
    until at most `few` rows are inside; only their distinct values are then put in order. No row is shuffled."""
    rows = rows.select(F.col(col).alias("v")).where("v is not null")
    n = rows.count()
    want, below, inside = index(n) if n else 0, 0, n
    lo = hi = None
    while n and inside > few and (lo is None or lo < hi):
        part = rows if lo is None else rows.where(F.col("v").between(lo, hi))
        at = (want - below) / inside
        new_lo, new_hi = part.agg(F.percentile_approx("v", [max(0.0, at - 0.001), min(1.0, at + 0.001)], 10_000)).first()[0]
        below_new, upto = rows.agg(F.count(F.when(F.col("v") < new_lo, 1)), F.count(F.when(F.col("v") <= new_hi, 1))).first()
        if not below_new < want <= upto or upto - below_new >= inside:
            break  # the estimate missed the position or narrows no more: go on with the bracket at hand
        lo, hi, below, inside = new_lo, new_hi, below_new, upto - below_new
    part = rows if lo is None else rows.where(F.col("v").between(lo, hi))
    upto = F.sum("n").over(Window.orderBy("v"))
    counted = part.groupBy("v").agg(F.count("*").alias("n")).withColumn("upto", upto + F.lit(below))
    return counted.where(F.col("upto") >= want).agg(F.min("v").alias(name)).where(F.col(name).isNotNull())
