"""Ordered folds per key that a plain window cannot express."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def walk(pdf: pd.DataFrame, start: float) -> list[float]:
    """States after each row, a row mapping x to min(_b, max(_a, _m * x + _c))."""
    after, x = [], start
    for m, c, a, b in zip(pdf["_m"], pdf["_c"], pdf["_a"], pdf["_b"], strict=True):
        x = min(b, max(a, m * x + c))
        after.append(x)
    return after


def clipped_fold(rows: DataFrame, key: str, order: list[str], block: Column, mult: Column, add: Column, low: float, high: float, start: float) -> DataFrame:
    """key, order columns and `state`: from start, each row in order maps x to clip(mult * x + add).

    mult must not be negative. Such maps compose to one of the same form, so each block of a key's
    history (block must grow with the order) is composed by itself, the few composed maps of a key give
    every block's first state, and blocks then run apart: a key with very many rows is spread over its
    blocks. A null mult or add leaves the state as it is."""
    known = mult.isNotNull() & add.isNotNull()
    given = rows.select(
        key, *order, block.alias("_block"), F.when(known, mult).otherwise(1.0).cast("double").alias("_m"), F.when(known, add).otherwise(0.0).cast("double").alias("_c"),
        F.lit(low).alias("_a"), F.lit(high).alias("_b"),
    )
    clip = lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x))
    one = F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("c"), F.lit(float("-inf")).alias("a"), F.lit(float("inf")).alias("b"))
    step = lambda f, x: F.struct((f["m"] * x["_m"]).alias("m"), (f["c"] * x["_m"] + x["_c"]).alias("c"), clip(f["a"] * x["_m"] + x["_c"]).alias("a"), clip(f["b"] * x["_m"] + x["_c"]).alias("b"))
    listed = F.array_sort(F.collect_list(F.struct(*order, "_m", "_c")))
    whole = given.groupBy(key, "_block").agg(F.aggregate(listed, one, step).alias("f")).select(key, "_block", *(F.col(f"f.{x}").alias(f"_{x}") for x in "mcab"))

    types = dict(given.dtypes)
    by_key = whole.withColumn("_first", F.lit(start)).repartition(key).sortWithinPartitions(key, "_block")
    heads = by_key.mapInPandas(_walker([key], [key, "_block"], 0, "_first"), f"{key} {types[key]}, _block {types['_block']}, _first double")
    by_block = given.join(heads, [key, "_block"]).repartition(key, "_block").sortWithinPartitions(key, "_block", *order)
    out = ", ".join(f"{c} {types[c]}" for c in (key, *order))
    return by_block.mapInPandas(_walker([key, "_block"], [key, *order], 1, "state"), f"{out}, state double")


def _walker(group: list[str], keep: list[str], which: int, name: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Walks rows that come sorted by group and order, batch by batch: each group starts from its
    `_first`. Gives the keep columns and the state before (which = 0) or after (1) each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, x = None, 0.0
        for pdf in batches:
            states = []
            ids = zip(*(pdf[c] for c in group), strict=True)
            for now, first, m, c, a, b in zip(ids, *(pdf[f] for f in ("_first", "_m", "_c", "_a", "_b")), strict=True):
                if now != last:
                    last, x = now, first
                after = min(b, max(a, m * x + c))
                states.append(after if which else x)
                x = after
            yield pdf[keep].assign(**{name: states})

    return run


def clipped_scores(rows: DataFrame, low: float, high: float, start: float) -> DataFrame:
    """user_id, id, score: deltas added in time order, the sum clipped to [low, high] after each."""
    hour = F.date_trunc("hour", "created_at")
    out = clipped_fold(rows, "user_id", ["created_at", "id"], hour, F.lit(1.0), F.col("delta"), low, high, start)
    return out.select("user_id", "id", F.col("state").alias("score"))


def moving_average(rows: DataFrame, key: str, order: list[str], block: Column, value: Column, alpha: float, start: float) -> DataFrame:
    """key, order columns and `state`: alpha * value + (1 - alpha) * state, row by row; null values are skipped."""
    return clipped_fold(rows, key, order, block, F.lit(1 - alpha), value * alpha, float("-inf"), float("inf"), start)


def cooled_down(rows: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Rows (keys, sent_at, id) that go out when each of them silences its key for so many seconds.

    A row that long after the one before it goes out whatever came earlier, so a key's history falls
    apart there; only runs of closer rows are walked, each apart from the others."""
    w = Window.partitionBy(*keys).orderBy("sent_at", "id")
    gap = F.unix_micros(F.col("sent_at").cast("timestamp")) - F.unix_micros(F.lag("sent_at").over(w).cast("timestamp"))
    fresh = F.when(gap < seconds * 1_000_000, 0).otherwise(1)
    runs = rows.select(*keys, "sent_at", "id", fresh.alias("_fresh")).withColumn("_run", F.sum("_fresh").over(w)).drop("_fresh")

    group = [*keys, "_run"]

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, until, pause = None, None, pd.Timedelta(seconds=seconds)
        for pdf in batches:
            goes = []
            for now, at in zip(zip(*(pdf[c] for c in group), strict=True), pdf["sent_at"], strict=True):
                goes.append(now != last or at >= until)
                if goes[-1]:
                    last, until = now, at + pause
            yield pdf.loc[goes, [*keys, "sent_at", "id"]]

    types = dict(runs.dtypes)
    apart = runs.repartition(*group).sortWithinPartitions(*group, "sent_at", "id")
    return apart.mapInPandas(pick, ", ".join(f"{c} {types[c]}" for c in (*keys, "sent_at", "id")))


def diversify(rows: DataFrame, k: int, per_source: int, per_tag: int, pool: int = 100) -> DataFrame:
    """user_id, rank, id: greedy choice by falling score, at most per_source of a source and per_tag of a
    main tag, from each user's `pool` best."""
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "id")
    best = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= pool)
    lists = best.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("r", "id", "source", "tag"))).alias("c"))
    return picked(lists, k, per_source, per_tag)


def picked(lists: DataFrame, k: int, per_source: int, per_tag: int) -> DataFrame:
    """user_id, rank, id: the same choice from lists (user_id, c) in falling order of items with id, source and tag."""
    none = F.lit([]).cast("array<struct<id:bigint,source:string,tag:string>>")
    chosen = F.aggregate(
        "c", none,
        lambda acc, x: F.when(
            (F.size(acc) < k)
            & (F.size(F.filter(acc, lambda y: y["source"] == x["source"])) < per_source)
            & (F.size(F.filter(acc, lambda y: y["tag"] == x["tag"])) < per_tag),
            F.concat(acc, F.array(F.struct(x["id"].alias("id"), x["source"].alias("source"), x["tag"].alias("tag")))),
        ).otherwise(acc),
    )
    return lists.select("user_id", F.posexplode(chosen).alias("pos", "x")).select("user_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("id"))
