"""Streams over the events, replayed in three parts and run to their end (inventory ST1 to ST5, ST7, ST9, ST12, ST13, IO14).

Each is held against a batch form in SQL, written apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.sources.adapters import oracle, run
from memloom.streaming import state
from memloom.streaming.sinks import done, together

DAY = 86_400


def _events(spark: SparkSession, sf_dir: str, *columns: Column | str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL")
    return rows.select("ts", "id", *columns)


def _keyed(rows: DataFrame, keys: list[str], rule, kept: str, out: str, row: str = "us long, id long", name: str = "stream") -> DataFrame:
    dealt = state.shards(rows)
    return state.replayed(rows, lambda s: state.in_order(s, keys, rule, row, kept, out, dealt=dealt), name=name)


def st1_poll_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30-second poll that takes each pending event: oldest first, at most 100 a poll and shard of the outbox."""
    pending = _events(spark, sf_dir, (F.col("user_id") % 8).alias("shard"), "event_type").where("event_type = 'click'").drop("event_type")
    got = _keyed(pending, ["shard"], state.Polls(30, 100), "last long, taken long", "event_id long, poll long", name="st1")
    return got.select("event_id", "poll")


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number of their failures and what fails (1: the write)."""
    kind = F.col("event_type").isin("signup", "error").cast("long")
    return _events(spark, sf_dir, (F.col("id") % 8).alias("fails"), kind.alias("kind"), F.lit(0).cast("long").alias("attempt"))


_MACHINE = {"kept": "none long", "out": "event_id long, attempt long, status string, at_us long", "row": "us long, id long, fails long, kind long, attempt long"}


def st2_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attempt at every event: retried after 1, 2, 4, 8 and 16 seconds, then done, to review or dead."""
    return _keyed(_attempts(spark, sf_dir), ["id"], state.Attempts(), name="st2", **_MACHINE).drop("id")


def st3_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dead letters that the same stream puts beside its main output, in one step with it."""

    def split(batch: DataFrame) -> dict[str, DataFrame]:
        return {"outcomes": batch.where("status <> 'dlq'"), "dead": batch.where("status = 'dlq'")}

    rows = _attempts(spark, sf_dir)
    dealt = state.shards(rows)
    build = lambda s: state.in_order(s, ["id"], state.Attempts(), _MACHINE["row"], _MACHINE["kept"], _MACHINE["out"], dealt=dealt)
    got = state.replayed(rows, build, name="st3", sink=lambda path: together(path, split))
    return done(spark, got._path, "dead").select("event_id", "attempt", "at_us")


def st4_live_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in the state that lives for 1800 seconds."""
    got = _keyed(_events(spark, sf_dir, "user_id"), ["user_id"], state.Counted(1800), "last long, n long", "event_id long, n long", name="st4")
    return got


def st5_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are consumed: those that find no record of their idempotency key, which lives for 24 hours."""
    keyed = _events(spark, sf_dir, F.concat(F.lit("k"), F.col("id") % 5000).alias("idempotency_key"))
    return _keyed(keyed, ["idempotency_key"], state.Once(DAY), "since long", "event_id long", name="st5")


def st7_cooldown_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """st7_cooldown as a stream."""
    kind = F.expr("CASE event_type WHEN 'click' THEN 'conversation' WHEN 'view' THEN 'conversation' WHEN 'purchase' THEN 'gratitude' WHEN 'signup' THEN 'explicit_feedback' ELSE 'silence_decay' END")
    got = _keyed(_events(spark, sf_dir, "user_id", kind.alias("trigger_event")), ["user_id", "trigger_event"], state.Once(DAY), "since long", "id long", name="st7")
    return got


def st9_silence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch of a user's activity once a silence of 12 hours has ended it."""
    got = _keyed(_events(spark, sf_dir, "user_id"), ["user_id"], state.Sessions(DAY // 2), "since long, last long, n long", "since_us long, last_us long, n long", name="st9")
    return got


def _walk(spark: SparkSession, sf_dir: str, rule: state.Walk, mult: Column, add: Column, name: str) -> DataFrame:
    rows = _events(spark, sf_dir, "user_id", mult.cast("double").alias("m"), add.cast("double").alias("c")).where("m IS NOT NULL AND c IS NOT NULL")
    return _keyed(rows, ["user_id"], rule, "x double", "event_id long, state double", "us long, id long, m double, c double", name)


def st12_running_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's moving average of values after each event (weight 0.1, first state 0)."""
    got = _walk(spark, sf_dir, state.Walk(float("-inf"), float("inf"), 0.0), F.lit(0.9), F.col("value") * 0.1, "st12")
    return got.select("user_id", "event_id", F.round("state", 7).alias("average"))


def st13_running_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's clipped score after each event."""
    got = _walk(spark, sf_dir, state.Walk(0.0, 1.0, 0.5), F.lit(1.0), (F.col("id") % 21 - 10).cast("double") / 10, "st13")
    return got.select("user_id", "event_id", F.round("state", 6).alias("score"))


def io14_dual_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What people say becomes a pending memory and its outbox event in one step; each memory beside its event."""
    turns = run(spark, sf_dir, "SELECT CAST(created_at AS TIMESTAMP) AS ts, session_id * 1000 + turn AS id, session_id, turn, content FROM conversation_turns WHERE role = 'user' AND session_id IS NOT NULL AND turn IS NOT NULL")

    def split(batch: DataFrame) -> dict[str, DataFrame]:
        rows = batch.where("id IS NOT NULL").withColumn("memory_id", F.md5(F.concat_ws("|", "session_id", "turn")))
        payload = F.to_json(F.struct("memory_id", F.col("session_id").alias("conversation_id"), F.length("content").alias("size")))
        return {
            "memories": rows.select("memory_id", "session_id", "content", F.lit("pending").alias("status")),
            "events": rows.select(F.md5(F.concat(F.lit("event|"), "memory_id")).alias("event_id"), "memory_id", payload.alias("payload"), F.lit("pending").alias("status")),
        }

    got = state.replayed(turns, lambda s: s, name="io14", sink=lambda path: together(path, split))
    memories, events = done(spark, got._path, "memories"), done(spark, got._path, "events")
    return memories.join(events.select("memory_id", "event_id", "payload", F.col("status").alias("event_status")), "memory_id", "full").select("memory_id", "event_id", "session_id", "status", "event_status", F.get_json_object("payload", "$.size").cast("long").alias("size"))


QUERIES = {
    f.__name__: f
    for f in (st1_poll_pending, st2_state_machine, st3_dead_letters, st4_live_count, st5_idempotent, st7_cooldown_stream, st9_silence_stream, st12_running_average, st13_running_affinity, io14_dual_insert)
}

# ---- batch forms for DuckDB --------------------------------------------------------------------------
_TRIES = """tries AS (SELECT event_id, epoch_us(ts) AS us, event_id % 8 AS fails, CASE WHEN event_type IN ('signup', 'error') THEN 1 ELSE 0 END AS kind, unnest(range(0, CAST(least(event_id % 8, 5) + 1 AS BIGINT))) AS attempt FROM events),
 told AS (SELECT event_id, attempt, CASE WHEN attempt = fails THEN 'done' WHEN attempt < 5 THEN 'retry' WHEN kind = 1 THEN 'dlq' ELSE 'pending_review' END AS status, us + (CAST(pow(2, attempt) AS BIGINT) - 1) * 1000000 AS at_us FROM tries)"""
_WALK = """WITH RECURSIVE numbered AS (SELECT user_id, event_id, {value} AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events{where}),
 walk AS (SELECT user_id, event_id, rn, {first} AS s FROM numbered WHERE rn = 1
 UNION ALL SELECT n.user_id, n.event_id, n.rn, {next} FROM walk w JOIN numbered n ON n.user_id = w.user_id AND n.rn = w.rn + 1)"""
_ONCE = """WITH RECURSIVE numbered AS (SELECT {keys}, event_id, ts, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS rn FROM ({rows}) r),
 walk AS (SELECT {keys}, event_id, rn, ts AS since, true AS taken FROM numbered WHERE rn = 1
 UNION ALL SELECT {mine}, n.event_id, n.rn, CASE WHEN n.ts >= w.since + INTERVAL 24 HOUR THEN n.ts ELSE w.since END, n.ts >= w.since + INTERVAL 24 HOUR FROM walk w JOIN numbered n ON {on} AND n.rn = w.rn + 1)"""
_TRIGGER = "CASE event_type WHEN 'click' THEN 'conversation' WHEN 'view' THEN 'conversation' WHEN 'purchase' THEN 'gratitude' WHEN 'signup' THEN 'explicit_feedback' ELSE 'silence_decay' END"
ORACLE = {
    # the k-th of a shard can be taken with its own poll, or one poll after the one 100 places before it
    "st1_poll_pending": """WITH queue AS (SELECT event_id, user_id % 8 AS shard, CAST(ceil(epoch_us(ts) / 30000000.0::DOUBLE) AS BIGINT) AS own, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS k FROM events WHERE event_type = 'click')
 SELECT event_id, max(own - k // 100) OVER (PARTITION BY shard, k % 100 ORDER BY k) + k // 100 AS poll FROM queue""",
    "st2_state_machine": f"WITH {_TRIES} SELECT event_id, attempt, status, at_us FROM told",
    "st3_dead_letters": f"WITH {_TRIES} SELECT event_id, attempt, at_us FROM told WHERE status = 'dlq'",
    "st4_live_count": """WITH marked AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS fresh FROM events),
 lived AS (SELECT user_id, event_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS life FROM marked)
 SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, life ORDER BY ts, event_id) AS n FROM lived""",
    "st5_idempotent": _ONCE.format(keys="idempotency_key", rows="SELECT concat('k', event_id % 5000) AS idempotency_key, event_id, ts FROM events", mine="n.idempotency_key", on="n.idempotency_key = w.idempotency_key") + " SELECT idempotency_key, event_id FROM walk WHERE taken",
    "st7_cooldown_stream": _ONCE.format(keys="user_id, trigger_event", rows=f"SELECT user_id, {_TRIGGER} AS trigger_event, event_id, ts FROM events", mine="n.user_id, n.trigger_event", on="n.user_id = w.user_id AND n.trigger_event = w.trigger_event") + " SELECT user_id, trigger_event, event_id AS id FROM walk WHERE taken",
    "st9_silence_stream": """WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
 numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM marked)
 SELECT user_id, epoch_us(min(ts)) AS since_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM numbered GROUP BY user_id, s""",
    "st12_running_average": _WALK.format(value="value", where=" WHERE value IS NOT NULL", first="v * 0.1::DOUBLE", next="0.9::DOUBLE * w.s + n.v * 0.1::DOUBLE") + " SELECT user_id, event_id, round(s, 7) AS average FROM walk",
    "st13_running_affinity": _WALK.format(value="CAST(event_id % 21 - 10 AS DOUBLE) / 10", where="", first="greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 + v))", next="greatest(0.0::DOUBLE, least(1.0::DOUBLE, w.s + n.v))") + " SELECT user_id, event_id, round(s, 6) AS score FROM walk",
    "io14_dual_insert": oracle("SELECT md5(concat(session_id, '|', turn)) AS memory_id, md5(concat('event|', md5(concat(session_id, '|', turn)))) AS event_id, session_id, 'pending' AS status, 'pending' AS event_status, length(content) AS size FROM conversation_turns WHERE role = 'user'"),
}
