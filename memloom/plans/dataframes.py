"""Queries whose Spark form is not SQL text: ordered folds, greedy selection, session windows."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators.folds import clipped_scores, cooled_down, diversify, moving_average
from memloom.operators.ranking import global_rank, value_at
from memloom.sources.adapters import oracle, run


def w5_clipped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT user_id, id, created_at, emotion_valence AS delta FROM affinity_history")
    return clipped_scores(rows, low=0.0, high=1.0, start=0.5).select("user_id", "id", F.round("score", 6).alias("score"))


def k9_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT id % 15 AS user_id, id, source, main_tag AS tag, quality_score AS score FROM content_library")
    return diversify(rows, k=3, per_source=1, per_tag=2)


def st9_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT user_id, created_at FROM affinity_history")
    by = rows.groupBy("user_id", F.session_window("created_at", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return by.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def w6_result_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT id, -popularity_score AS worse FROM memes")
    return global_rank(rows, ["worse", "id"], "rank_position").select("id", "rank_position")


def k12_stable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT id, -quality_score AS worse FROM content_library")
    return global_rank(rows, ["worse", "id"], "pos").select("id", "pos")


def a21_lag_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_at(run(spark, sf_dir, "SELECT lag_ms FROM lags"), "lag_ms", "p95", lambda n: min(int(n * 0.95) + 1, n))


def a22_p50_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_at(run(spark, sf_dir, "SELECT lag_ms FROM lags"), "lag_ms", "p50", lambda n: n // 2 + 1)


def io3_named_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan with named parameters: values are bound, never spliced into the text."""
    sql = "SELECT id, new_score FROM affinity_history WHERE user_id = :person AND created_at >= :since"
    return run(spark, sf_dir, sql, {"person": 7, "since": datetime.datetime(2024, 1, 10)})


def c3_replay_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log day by day: each user's score after the day (deltas added in order, clipped to -1 .. 1), each entity's
    mentions up to the day, and the day on which an edge from a user to an entity is appended with weight 1."""
    events = run(spark, sf_dir, "SELECT user_id, id, created_at, emotion_valence AS delta FROM affinity_history")
    states = clipped_scores(events, low=-1.0, high=1.0, start=0.0).join(events.select("user_id", "id", "created_at"), ["user_id", "id"])
    last = states.groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.max_by("score", F.struct("created_at", "id")).alias("v"))
    score = last.select(F.lit("score").alias("kind"), "day", F.concat(F.lit("u"), "user_id").alias("name"), F.round("v", 6).alias("value"))
    rest = run(spark, sf_dir, _REPLAY)
    return score.unionByName(rest)


_REPLAY = """SELECT 'mentions' AS kind, day, concat('p', entity_id) AS name, CAST(sum(n) OVER (PARTITION BY entity_id ORDER BY day) AS DOUBLE) AS value
 FROM (SELECT entity_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM memory_entities GROUP BY entity_id, CAST(created_at AS DATE)) m
 UNION ALL SELECT 'edge', min(CAST(created_at AS DATE)), concat('u', user_id, '|p', entity_id), 1e0 FROM memory_entities GROUP BY user_id, entity_id"""


def m20_message_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moving average of a person's message lengths after each message (weight 0.1, first state 0)."""
    rows = run(spark, sf_dir, "SELECT session_id, turn, length(content) AS n FROM conversation_turns WHERE role = 'user'")
    out = moving_average(rows, "session_id", ["turn"], F.floor(F.col("turn") / 64), F.col("n"), alpha=0.1, start=0.0)
    return out.select("session_id", "turn", F.round("state", 4).alias("average"))


def st7_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers that go out under a cooldown of 24 hours per user and trigger."""
    rows = run(spark, sf_dir, "SELECT user_id, trigger_event, created_at AS sent_at, id FROM affinity_history")
    return cooled_down(rows, ["user_id", "trigger_event"], 24 * 3600).select("user_id", "trigger_event", "id")


PER_PART = 250_000  # mentions of a part of the table that one task sees


def reasons(mentions: DataFrame, orders: DataFrame, parts: int) -> DataFrame:
    """reason, n: the mentions (memory_id, entity_id, confidence) that a critic drops for low confidence or a bad type, or as one more of an entity that
    its memory keeps, and those it keeps; each counts as often as orders (memory_id) has its memory.

    Which of equal mentions is kept does not change how many are, so they are counted and not put in order. Both tables are dealt by memory over `parts` tasks."""
    reason = F.when(F.col("confidence") < 0.5, "low").when(F.col("entity_id") % 11 == 0, "bad").otherwise("good")
    lines = mentions.where("confidence IS NOT NULL AND memory_id IS NOT NULL").select("memory_id", "entity_id", reason.alias("r"))
    own = orders.repartition(parts, "memory_id").groupBy("memory_id").agg(F.count("*").alias("times"))
    n = lambda r: F.count(F.when(F.col("r") == r, 1)).alias(r)
    per = lines.repartition(parts, "memory_id").groupBy("memory_id", "entity_id").agg(n("low"), n("bad"), n("good"))
    kept = F.when(F.col("good") > 0, 1).otherwise(0)
    per = per.groupBy("memory_id").agg(F.sum("low").alias("low"), F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum(kept).alias("kept")).join(own.hint("merge"), "memory_id")
    total = per.agg(*[F.sum(c).alias(k) for k, c in (("low_confidence", F.col("low") * F.col("times")), ("bad_type", F.col("bad") * F.col("times")), ("duplicate", F.col("good") * F.col("times") - F.col("kept")), ("kept", F.col("kept")))])
    return total.unpivot([], ["low_confidence", "bad_type", "duplicate", "kept"], "reason", "n").where("n > 0")


def v1_entity_critic(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = run(spark, sf_dir, "SELECT l_orderkey AS memory_id, l_partkey AS entity_id, CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_discount AS DOUBLE) * 10 END AS confidence FROM lineitem")
    parts = 4 + mentions.count() // PER_PART
    return reasons(mentions, run(spark, sf_dir, "SELECT o_orderkey AS memory_id FROM orders"), parts)


QUERIES = {
    f.__name__: f
    for f in (v1_entity_critic, io3_named_parameters, c3_replay_day, w5_clipped_scores, k9_diversify, st9_sessions, w6_result_rank, k12_stable_order, a21_lag_p95, a22_p50_index, m20_message_average, st7_cooldown)
}

ORACLE = {
    "a21_lag_p95": oracle("SELECT lag_ms AS p95 FROM (SELECT lag_ms, row_number() OVER (ORDER BY lag_ms) AS rn, count(*) OVER () AS n FROM lags) z WHERE rn = least(CAST(floor(n * 0.95) AS BIGINT) + 1, n)"),
    "a22_p50_index": oracle("SELECT lag_ms AS p50 FROM (SELECT lag_ms, row_number() OVER (ORDER BY lag_ms) AS rn, count(*) OVER () AS n FROM lags) z WHERE rn = n // 2 + 1"),
    "io3_named_parameters": oracle("SELECT id, new_score FROM affinity_history WHERE user_id = 7 AND created_at >= TIMESTAMP '2024-01-10 00:00:00'"),
    "c3_replay_day": oracle(
        """WITH RECURSIVE numbered AS (SELECT user_id, id, created_at, emotion_valence AS delta, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS rn FROM affinity_history),
 walk AS (SELECT user_id, rn, created_at, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, delta)) AS score FROM numbered WHERE rn = 1
 UNION ALL SELECT n.user_id, n.rn, n.created_at, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, w.score + n.delta)) FROM walk w JOIN numbered n ON n.user_id = w.user_id AND n.rn = w.rn + 1)
 SELECT 'score' AS kind, day, concat('u', user_id) AS name, round(score, 6) AS value FROM (SELECT user_id, CAST(created_at AS DATE) AS day, score, row_number() OVER (PARTITION BY user_id, CAST(created_at AS DATE) ORDER BY rn DESC) AS k FROM walk) y WHERE k = 1
 UNION ALL """ + _REPLAY
    ),
    "k9_diversify": oracle(
        """WITH RECURSIVE best AS (SELECT * FROM (SELECT id % 15 AS user_id, id, source, main_tag AS tag, row_number() OVER (PARTITION BY id % 15 ORDER BY quality_score DESC, id) AS r FROM content_library) y WHERE r <= 100),
 tried AS (SELECT user_id, r, source IS NULL OR true AS goes, [source] AS sources, [tag] AS tags, id FROM best WHERE r = 1
 UNION ALL SELECT user_id, r, goes, CASE WHEN goes THEN list_append(sources, source) ELSE sources END, CASE WHEN goes THEN list_append(tags, tag) ELSE tags END, id
 FROM (SELECT b.user_id, b.r, b.id, b.source, b.tag, t.sources, t.tags,
  len(t.sources) < 3 AND len(list_filter(t.sources, lambda s: s = b.source)) < 1 AND len(list_filter(t.tags, lambda s: s = b.tag)) < 2 AS goes
  FROM tried t JOIN best b ON b.user_id = t.user_id AND b.r = t.r + 1) step)
 SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY r) AS INT) AS rank, id FROM tried WHERE goes"""
    ),
    "m20_message_average": oracle(
        """WITH RECURSIVE numbered AS (SELECT session_id, turn, length(content) AS n, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS rn
 FROM conversation_turns WHERE role = 'user'),
 walk AS (SELECT session_id, turn, rn, CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE n * 0.1::DOUBLE END AS s FROM numbered WHERE rn = 1
 UNION ALL SELECT m.session_id, m.turn, m.rn, CASE WHEN m.n IS NULL THEN w.s ELSE w.s * 0.9::DOUBLE + m.n * 0.1::DOUBLE END FROM walk w JOIN numbered m ON m.session_id = w.session_id AND m.rn = w.rn + 1)
 SELECT session_id, turn, round(s, 4) AS average FROM walk"""
    ),
    "st7_cooldown": oracle(
        """WITH RECURSIVE numbered AS (SELECT user_id, trigger_event, created_at, id, row_number() OVER (PARTITION BY user_id, trigger_event ORDER BY created_at, id) AS rn FROM affinity_history),
 walk AS (SELECT user_id, trigger_event, id, rn, created_at AS last_sent, true AS sent FROM numbered WHERE rn = 1
 UNION ALL SELECT m.user_id, m.trigger_event, m.id, m.rn, CASE WHEN m.created_at >= w.last_sent + INTERVAL 24 HOUR THEN m.created_at ELSE w.last_sent END, m.created_at >= w.last_sent + INTERVAL 24 HOUR
 FROM walk w JOIN numbered m ON m.user_id = w.user_id AND m.trigger_event = w.trigger_event AND m.rn = w.rn + 1)
 SELECT user_id, trigger_event, id FROM walk WHERE sent"""
    ),
    "w5_clipped_scores": oracle(
        """WITH RECURSIVE numbered AS (SELECT user_id, id, emotion_valence AS delta, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS rn
 FROM affinity_history),
 walk AS (SELECT user_id, id, rn, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 + delta)) AS score FROM numbered WHERE rn = 1
 UNION ALL SELECT n.user_id, n.id, n.rn, greatest(0.0::DOUBLE, least(1.0::DOUBLE, w.score + n.delta)) FROM walk w JOIN numbered n ON n.user_id = w.user_id AND n.rn = w.rn + 1)
 SELECT user_id, id, round(score, 6) AS score FROM walk"""
    ),
    "st9_sessions": oracle(
        """WITH marked AS (SELECT user_id, created_at, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM affinity_history),
 numbered AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY created_at) AS s FROM marked),
 sized AS (SELECT user_id, s, count(*) AS n FROM numbered GROUP BY user_id, s)
 SELECT user_id, count(*) AS sessions, max(n) AS longest FROM sized GROUP BY user_id"""
    ),
}
