"""Metrics, alerts, the dashboard, answers and changed rows (inventory ST10, ST16, A20, A24, IO13, IO15, IO29, R13, C2, D8, F17, F18, F27, X4).

The SQL they are held against is written apart from the Spark form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import answers
from memloom.operators.graph import first
from memloom.operators.ranking import value_at
from memloom.operators.substrings import contains_join
from memloom.plans.services import _SAID, triples
from memloom.sources.adapters import DUCK, SPARK, oracle, run
from memloom.sources.session import staged
from memloom.streaming import state

NOW = "2024-01-20 12:00:00"  # the moment of the metrics

# SLO limits in milliseconds, backlog limits, share of pending memories.
P95_MS, P50_MS, DLQ_MANY, STALE_MANY, PENDING_SHARE = 30_000, 2_000, 100, 10, 0.01


def median(rows: DataFrame, col: str) -> DataFrame:
    """p50: the middle value, or the mean of the two middle ones, found by narrowing brackets; no task holds all values."""
    low, high = value_at(rows, col, "v", lambda n: (n + 1) // 2), value_at(rows, col, "v", lambda n: n // 2 + 1)
    return low.union(high).agg(F.avg("v").alias("p50"))


def a20_lag_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    lags = run(spark, sf_dir, "SELECT lag_ms FROM lags")
    mean = lags.agg(F.avg("lag_ms").alias("mean"))
    return median(lags, "lag_ms").withColumn("one", F.lit(1)).join(mean.withColumn("one", F.lit(1)), "one").select(F.round("p50", 6).alias("p50"), F.round("mean", 6).alias("mean"))


def a24_slo_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    lags = run(spark, sf_dir, "SELECT lag_ms FROM lags")
    n = lags.agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    return median(lags, "lag_ms").withColumn("one", F.lit(1)).join(n, "one").select(F.when(F.col("p50") < P50_MS, "ok").otherwise("late").alias("p50_verdict"), "n")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, label, value: the gauges of the outbox and the memories at NOW."""
    memory = run(spark, sf_dir, "SELECT 'memories_total' AS name, status AS label, CAST(count(*) AS DOUBLE) AS value FROM memories GROUP BY status")
    events = run(spark, sf_dir, "SELECT 'outbox_events_total' AS name, status AS label, CAST(count(*) AS DOUBLE) AS value FROM outbox_events GROUP BY status")
    count = lambda name, where: run(spark, sf_dir, f"SELECT '{name}' AS name, '' AS label, CAST(count(*) AS DOUBLE) AS value FROM outbox_events WHERE {where}")
    recent = staged(run(spark, sf_dir, f"SELECT {SPARK.seconds('processed_at', 'created_at')} * 1000 AS lag_ms FROM outbox_events WHERE status = 'done' AND processed_at >= TIMESTAMP_NTZ '{NOW}' - INTERVAL '1' HOUR AND processed_at <= TIMESTAMP_NTZ '{NOW}'"), "recent")
    lag = lambda label, rows: rows.toDF("value").where("value IS NOT NULL").select(F.lit("outbox_lag_ms").alias("name"), F.lit(label).alias("label"), "value")
    parts = [
        memory, events, count("outbox_stale_count", f"status = 'pending' AND created_at < TIMESTAMP_NTZ '{NOW}' - INTERVAL '30' SECOND"), count("dlq_count", "status = 'failed'"),
        lag("0.5", median(recent, "lag_ms")), lag("0.95", value_at(recent, "lag_ms", "v", lambda n: min(int(n * 0.95), n - 1) + 1)), lag("avg", recent.agg(F.avg("lag_ms"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def io29_metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gauges as lines of the text format."""
    label = F.when(F.col("label") == "", "").otherwise(F.concat(F.lit("{"), F.when(F.col("name") == "outbox_lag_ms", "quantile").otherwise("status"), F.lit('="'), "label", F.lit('"}')))
    number = F.when(F.col("name") == "outbox_lag_ms", F.format_string("%.2f", "value")).otherwise(F.col("value").cast("long").cast("string"))
    return metrics(spark, sf_dir).select(F.concat("name", label, F.lit(" "), number).alias("line"))


def st16_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each alert rule over the gauges: its value, and whether it fires. A gauge without a value fires nothing."""
    of = lambda name, label="": F.max(F.when((F.col("name") == name) & (F.col("label") == label), F.col("value")))
    m = metrics(spark, sf_dir).agg(
        of("outbox_lag_ms", "0.95").alias("p95"), of("outbox_lag_ms", "0.5").alias("p50"), of("dlq_count").alias("dlq"), of("outbox_stale_count").alias("stale"),
        of("memories_total", "pending").alias("pending"), of("memories_total", "committed").alias("committed"),
    )
    share = F.try_divide("pending", "committed")
    rules = [("OutboxLagHigh", "critical", "p95", P95_MS), ("OutboxLagWarning", "warning", "p50", P50_MS), ("DLQBacklog", "warning", "dlq", 0), ("DLQBacklogCritical", "critical", "dlq", DLQ_MANY), ("OutboxStale", "warning", "stale", STALE_MANY), ("DataMismatchHigh", "warning", share, PENDING_SHARE)]
    each = [F.struct(F.lit(a).alias("alert"), F.lit(s).alias("severity"), F.round(F.col(v) if isinstance(v, str) else v, 6).alias("value"), F.lit(float(limit)).alias("limit")) for a, s, v, limit in rules]
    return m.select(F.inline(F.array(*each))).select("alert", "severity", "value", F.coalesce(F.col("value") > F.col("limit"), F.lit(False)).cast("int").alias("firing"))


def st10_lag_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag quantiles of each hour, every ten minutes, as a stream: a mergeable sketch for each window (k = 400, rank error under one percent), so a window's state
    does not grow with its events. hour, n, p50, p95."""
    rows = run(spark, sf_dir, f"SELECT event_id AS id, CAST(processed_at AS TIMESTAMP) AS ts, {SPARK.seconds('processed_at', 'created_at')} * 1000 AS lag_ms FROM outbox_events WHERE status = 'done' AND processed_at IS NOT NULL")
    return state.replayed(rows, lag_windows, name="st10").where("n > 0").select("hour", "n", F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("p50"), F.kll_sketch_get_quantile_double("sketch", F.lit(0.95)).alias("p95"))


def lag_windows(rows: DataFrame, size: str = "1 hour", step: str = "10 minutes", k: int = 400) -> DataFrame:
    """hour (start of the window), n, sketch of lag_ms. Rows without id only move the watermark."""
    kept = F.when(F.col("id").isNotNull(), F.col("lag_ms"))
    per = rows.withWatermark("ts", "1 hour").groupBy(F.window("ts", size, step).alias("w")).agg(F.count(kept).alias("n"), F.kll_sketch_agg_double(F.coalesce(kept, F.lit(0.0)), F.lit(k)).alias("sketch"))
    return per.select(F.col("w.start").alias("hour"), "n", "sketch")


def r13_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's relation, days known, memories, three commonest topics with their share, trend of the mood over 30 days, feedback, and a reminder of health where it is due."""
    base = run(spark, sf_dir, f"SELECT user_id, {SPARK.days(SPARK.ts(), 'min(created_at)')} AS days_known, count(*) AS events, least(100, count(CASE WHEN emotion_valence < -0.3 THEN 1 END)) AS loneliness FROM affinity_history GROUP BY user_id")
    score = run(spark, sf_dir, "SELECT user_id, new_score FROM latest_affinity")
    s = F.col("new_score")
    relation = F.when(s <= 20, "stranger").when(s <= 50, "acquaintance").when(s <= 80, "friend").otherwise("close_friend")
    per = run(spark, sf_dir, "SELECT user_id, trigger_event, count(*) AS n FROM affinity_history GROUP BY user_id, trigger_event")
    best = first(per, ["user_id"], [F.desc("n"), "trigger_event"], 3)
    line = F.struct("rn", "trigger_event", "n")
    topics = best.groupBy("user_id").agg(F.array_sort(F.collect_list(line)).alias("t"))
    mood = run(spark, sf_dir, f"SELECT user_id, round(avg(CASE WHEN created_at >= TIMESTAMP_NTZ '2024-01-16 00:00:00' THEN emotion_valence END) - avg(CASE WHEN created_at < TIMESTAMP_NTZ '2024-01-16 00:00:00' THEN emotion_valence END), 6) AS trend FROM affinity_history WHERE created_at >= {SPARK.ts()} - INTERVAL '30' DAY GROUP BY user_id")
    told = run(spark, sf_dir, "SELECT user_id, count(*) AS memories FROM memories WHERE status <> 'deleted' GROUP BY user_id")
    said = run(spark, sf_dir, "SELECT user_id, count(CASE WHEN feedback = 'like' THEN 1 END) AS likes, count(CASE WHEN feedback = 'click' THEN 1 END) AS favorites FROM recommendations GROUP BY user_id")
    rows = base.join(score, "user_id", "left")
    for more in (topics, mood, told, said):
        rows = rows.join(more, "user_id", "left")
    share = F.array_join(F.transform("t", lambda x: F.concat(x["trigger_event"], F.lit(":"), F.floor(100 * x["n"] / F.col("events")).cast("string"))), ",")
    level = F.when(F.col("loneliness") >= 80, "watch").when(F.col("loneliness") >= 60, "concern").when(F.col("loneliness") >= 30, "attention")
    return rows.select("user_id", relation.alias("state"), F.round("new_score", 6).alias("score"), "days_known", F.coalesce("memories", F.lit(0)).alias("memories"), share.alias("topics"), "trend", F.coalesce("likes", F.lit(0)).alias("likes"), F.coalesce("favorites", F.lit(0)).alias("favorites"), level.alias("reminder"))


def c2_keyword_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best memes of each question: a half for each of its words in the text, 0.3 for each in the entity, of those seen by day 20. Words meet distinct texts by their
    grams; of memes with equal text and entity only the first five can be among the best."""
    words = staged(run(spark, sf_dir, "SELECT item_id, text FROM benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("needle")).where("needle <> ''"), "words")
    memes = run(spark, sf_dir, f"SELECT id, lower(text_description) AS content, lower(source_platform) AS entity FROM memes WHERE first_seen_at <= TIMESTAMP_NTZ '{NOW}'")
    kinds = staged(first(memes, ["content", "entity"], ["id"], 5), "kinds")

    def hits(col: str, weight: float) -> DataFrame:
        met = contains_join(words.select("needle"), kinds.select(F.col(col).alias("hay")))
        return words.join(met, "needle").groupBy("item_id", F.col("hay").alias(col)).agg((weight * F.count("*")).alias(f"in_{col}"))

    pairs = kinds.select("content", "entity").distinct()
    text, entity = hits("content", 0.5), hits("entity", 0.3)
    found = text.join(pairs, "content").select("item_id", "content", "entity").union(entity.join(pairs, "entity").select("item_id", "content", "entity")).distinct()
    scored = found.join(text, ["item_id", "content"], "left").join(entity, ["item_id", "entity"], "left")
    scored = scored.withColumn("score", F.round(F.coalesce("in_content", F.lit(0.0)) + F.coalesce("in_entity", F.lit(0.0)), 6))
    return first(scored.join(kinds, ["content", "entity"]).drop("rn"), ["item_id"], [F.desc("score"), "id"], 5).select("item_id", "id", "score", "rn")


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in four ways, by the rows of memories: what is predicted, and the reference."""
    rows = run(spark, sf_dir, "SELECT id, 1 + id % 28 AS d, 1 + id % 14 AS m FROM memories")
    name = F.coalesce(F.get(F.array(*[F.lit(x.capitalize()) for x in answers.MONTHS]), F.col("m") - 1), F.lit("Nomonth"))
    iso = F.format_string("2023-%02d-%02d", "m", "d")
    forms = [F.concat(F.lit("on "), "d", F.lit(" "), name, F.lit(" 2023")), F.concat(name, F.lit(" "), "d", F.lit(", 2023.")), F.concat(F.lit("It was "), iso), F.lit("No Date, here!")]
    kind = lambda c: F.get(F.array(*forms), c.cast("int"))
    return rows.select("id", (F.col("id") % 3 + 1).alias("category"), kind(F.col("id") % 4).alias("reference"), kind(F.floor(F.col("id") / 4) % 4).alias("prediction"))


def f17_iso_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases(spark, sf_dir).select("id", answers.iso_date(F.col("reference")).alias("iso"))


def f18_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases(spark, sf_dir).select("id", answers.exact_match(F.col("reference"), F.col("prediction"), F.col("category")).cast("int").alias("exact"))


def f27_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations found by rule in what is said, questions left out."""
    said = run(spark, sf_dir, f"SELECT id, content FROM {_SAID} s").where(~answers.is_question(F.coalesce("content", F.lit(""))))
    return spark.sql(triples(SPARK, "{said}", "id", "content"), said=said)


def d8_hhmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of day of every event, written as HH:MM and read again."""
    return run(spark, sf_dir, "SELECT id, created_at FROM affinity_history").select("id", answers.minutes(F.date_format("created_at", "HH:mm")).alias("minute"))


def without(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, keys of the rows that go): a delete by id."""
    return rows.join(ids.select(key), key, "left_anti"), rows.join(ids.select(key), key, "left_semi").select(key)


def io13_vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are left when those of deleted memories are gone."""
    gone = run(spark, sf_dir, "SELECT id AS vec_id FROM memories WHERE status = 'deleted'")
    return without(run(spark, sf_dir, "SELECT vec_id, label FROM embeddings"), gone, "vec_id")[0]


def io15_delete_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that this delete returns."""
    gone = run(spark, sf_dir, "SELECT id AS vec_id FROM memories WHERE status = 'deleted'")
    return without(run(spark, sf_dir, "SELECT vec_id, label FROM embeddings"), gone, "vec_id")[1]


def touched(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """old with the values of new where there are any; rows that change get `at` as updated_at, the others keep theirs."""
    cols = [c for c in new.columns if c != key]
    j = old.alias("o").join(new.alias("n"), key, "left")
    differs = F.lit(False)
    for c in cols:
        differs |= F.col(f"n.{c}").isNotNull() & ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    when = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in cols else F.col(f"o.{c}")
    out = [F.col(key)] + [when(c).alias(c) for c in old.columns if c not in (key, "updated_at")]
    return j.select(*out, F.when(differs, F.lit(at).cast(old.schema["updated_at"].dataType)).otherwise(F.col("o.updated_at")).alias("updated_at"))


def x4_updated_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memes after a change of status, with the time of their last change."""
    old = run(spark, sf_dir, "SELECT id, status, first_seen_at AS updated_at FROM memes")
    new = run(spark, sf_dir, "SELECT id, CASE WHEN popularity_score >= 60 THEN 'approved' WHEN popularity_score < 50 THEN 'rejected' END AS status FROM memes")
    return touched(old, new, "id", "2024-01-31 00:00:00")


QUERIES = {
    f.__name__: f
    for f in (a20_lag_median, a24_slo_verdict, io29_metrics_text, st16_alerts, st10_lag_sketch, r13_dashboard, c2_keyword_retrieval, f17_iso_date, f18_exact_match, f27_triples, d8_hhmm, io13_vector_delete, io15_delete_returning, x4_updated_at)
}

# ---- the same by hand for DuckDB ---------------------------------------------------------------------
_RECENT = f"""recent AS (SELECT {DUCK.seconds('processed_at', 'created_at')} * 1000 AS lag_ms FROM outbox_events WHERE status = 'done' AND processed_at BETWEEN TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AND TIMESTAMP '{NOW}'),
 placed AS (SELECT lag_ms, row_number() OVER (ORDER BY lag_ms) - 1 AS k, count(*) OVER () AS n FROM recent),
 metrics AS (SELECT 'memories_total' AS name, status AS label, CAST(count(*) AS DOUBLE) AS value FROM memories GROUP BY status UNION ALL SELECT 'outbox_events_total', status, count(*) FROM outbox_events GROUP BY status
 UNION ALL SELECT 'outbox_stale_count', '', count(*) FROM outbox_events WHERE status = 'pending' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 30 SECOND UNION ALL SELECT 'dlq_count', '', count(*) FROM outbox_events WHERE status = 'failed'
 UNION ALL SELECT 'outbox_lag_ms', '0.5', median(lag_ms) FROM recent HAVING count(*) > 0 UNION ALL SELECT 'outbox_lag_ms', 'avg', avg(lag_ms) FROM recent HAVING count(*) > 0
 UNION ALL SELECT 'outbox_lag_ms', '0.95', lag_ms FROM placed WHERE k = least(CAST(floor(n * 0.95) AS BIGINT), n - 1))"""
_MONTH = "['January','February','March','April','May','June','July','August','September','October','November','December']"
_PHRASES = f"""parts AS (SELECT id, 1 + id % 28 AS d, 1 + id % 14 AS m, coalesce({_MONTH}[CAST(1 + id % 14 AS INT)], 'Nomonth') AS month FROM memories),
 forms AS (SELECT id, d, m, month, ['on ' || d || ' ' || month || ' 2023', month || ' ' || d || ', 2023.', 'It was ' || printf('2023-%02d-%02d', m, d), 'No Date, here!'] AS f FROM parts),
 told AS (SELECT id, d, m, month, id % 3 + 1 AS category, id % 4 AS rk, id // 4 % 4 AS pk, f[CAST(id % 4 AS INT) + 1] AS reference, f[CAST(id // 4 % 4 AS INT) + 1] AS prediction FROM forms),
 dated AS (SELECT *, CASE WHEN rk = 3 OR (rk < 2 AND m > 12) THEN NULL ELSE printf('2023-%02d-%02d', m, d) END AS riso, CASE WHEN pk = 3 OR (pk < 2 AND m > 12) THEN NULL ELSE printf('2023-%02d-%02d', m, d) END AS piso,
  trim(regexp_replace(lower(reference), '[^a-z0-9_]+', ' ', 'g')) AS rn, trim(regexp_replace(lower(prediction), '[^a-z0-9_]+', ' ', 'g')) AS pn FROM told)"""
_STATE = "CASE WHEN l.new_score <= 20 THEN 'stranger' WHEN l.new_score <= 50 THEN 'acquaintance' WHEN l.new_score <= 80 THEN 'friend' ELSE 'close_friend' END"
_ASKED = " OR ".join(f"contains(content, '{m}')" for m in answers.QUESTION_MARKS)
ORACLE = {
    "a20_lag_median": oracle("SELECT round(median(lag_ms), 6) AS p50, round(avg(lag_ms), 6) AS mean FROM lags"),
    "a24_slo_verdict": oracle("SELECT CASE WHEN median(lag_ms) < 2000 THEN 'ok' ELSE 'late' END AS p50_verdict, count(*) AS n FROM lags"),
    "io29_metrics_text": oracle(f"""WITH {_RECENT} SELECT CASE WHEN label = '' THEN name WHEN name = 'outbox_lag_ms' THEN concat(name, chr(123), 'quantile="', label, '"', chr(125)) ELSE concat(name, chr(123), 'status="', label, '"', chr(125)) END || ' ' || CASE WHEN name = 'outbox_lag_ms' THEN printf('%.2f', value) ELSE CAST(CAST(value AS BIGINT) AS VARCHAR) END AS line FROM metrics"""),
    "st16_alerts": oracle(f"""WITH {_RECENT}, rules(alert, severity, name, label, low) AS (VALUES ('OutboxLagHigh', 'critical', 'outbox_lag_ms', '0.95', 30000), ('OutboxLagWarning', 'warning', 'outbox_lag_ms', '0.5', 2000), ('DLQBacklog', 'warning', 'dlq_count', '', 0), ('DLQBacklogCritical', 'critical', 'dlq_count', '', 100), ('OutboxStale', 'warning', 'outbox_stale_count', '', 10))
 SELECT r.alert, r.severity, round(m.value, 6) AS value, CASE WHEN m.value > r.low THEN 1 ELSE 0 END AS firing FROM rules r LEFT JOIN metrics m ON m.name = r.name AND m.label = r.label
 UNION ALL SELECT 'DataMismatchHigh', 'warning', round(p.value / c.value, 6), CASE WHEN p.value / c.value > 0.01 THEN 1 ELSE 0 END FROM (SELECT max(value) AS value FROM metrics WHERE name = 'memories_total' AND label = 'pending') p, (SELECT max(value) AS value FROM metrics WHERE name = 'memories_total' AND label = 'committed') c"""),
    "r13_dashboard": oracle(f"""WITH per AS (SELECT user_id, trigger_event, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, trigger_event) AS k FROM affinity_history GROUP BY user_id, trigger_event),
 base AS (SELECT user_id, {DUCK.days(DUCK.ts(), 'min(created_at)')} AS days_known, count(*) AS events, least(100, count(CASE WHEN emotion_valence < -0.3 THEN 1 END)) AS lonely,
  round(avg(emotion_valence) FILTER (created_at >= TIMESTAMP '2024-01-16' AND created_at >= {DUCK.ts()} - INTERVAL 30 DAY) - avg(emotion_valence) FILTER (created_at < TIMESTAMP '2024-01-16' AND created_at >= {DUCK.ts()} - INTERVAL 30 DAY), 6) AS trend FROM affinity_history GROUP BY user_id)
 SELECT b.user_id, {_STATE} AS state, round(l.new_score, 6) AS score, b.days_known, (SELECT count(*) FROM memories m WHERE m.user_id = b.user_id AND m.status <> 'deleted') AS memories,
 (SELECT string_agg(concat(p.trigger_event, ':', CAST(floor(100.0::DOUBLE * p.n / b.events) AS BIGINT)), ',' ORDER BY p.k) FROM per p WHERE p.user_id = b.user_id AND p.k <= 3) AS topics, b.trend,
 (SELECT count(*) FROM recommendations r WHERE r.user_id = b.user_id AND r.feedback = 'like') AS likes, (SELECT count(*) FROM recommendations r WHERE r.user_id = b.user_id AND r.feedback = 'click') AS favorites,
 CASE WHEN lonely >= 80 THEN 'watch' WHEN lonely >= 60 THEN 'concern' WHEN lonely >= 30 THEN 'attention' END AS reminder FROM base b LEFT JOIN latest_affinity l ON l.user_id = b.user_id"""),
    "c2_keyword_retrieval": oracle(f"""WITH words AS (SELECT item_id, unnest(list_distinct(string_split_regex(lower(text), '[^a-z]+'))) AS w FROM benchmark),
 met AS (SELECT k.item_id, m.id, round(sum(CASE WHEN contains(lower(m.text_description), k.w) THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN contains(lower(m.source_platform), k.w) THEN 0.3::DOUBLE ELSE 0 END), 6) AS score FROM words k JOIN memes m ON k.w <> '' AND m.first_seen_at <= TIMESTAMP '{NOW}'
  AND (contains(lower(m.text_description), k.w) OR contains(lower(m.source_platform), k.w)) GROUP BY k.item_id, m.id)
 SELECT item_id, id, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rn FROM met) y WHERE rn <= 5"""),
    "f17_iso_date": oracle(f"WITH {_PHRASES} SELECT id, riso AS iso FROM dated"),
    "f18_exact_match": oracle(f"WITH {_PHRASES} SELECT id, CASE WHEN category = 2 AND riso IS NOT NULL AND piso IS NOT NULL THEN CAST(riso = piso AS INT) ELSE CAST(rn <> '' AND rn = pn AS INT) END AS exact FROM dated"),
    "f27_triples": oracle(triples(DUCK, f"(SELECT * FROM {_SAID} t WHERE NOT ({_ASKED} OR suffix(trim(content), '?'))) s", "id", "content")),
    "d8_hhmm": oracle("SELECT id, hour(created_at) * 60 + minute(created_at) AS minute FROM affinity_history"),
    "io13_vector_delete": oracle("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT id FROM memories WHERE status = 'deleted')"),
    "io15_delete_returning": oracle("SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT id FROM memories WHERE status = 'deleted')"),
    "x4_updated_at": oracle("SELECT id, CASE WHEN popularity_score >= 60 THEN 'approved' WHEN popularity_score < 50 THEN 'rejected' ELSE status END AS status, CASE WHEN (popularity_score >= 60 AND status <> 'approved') OR (popularity_score < 50 AND status <> 'rejected') THEN TIMESTAMP '2024-01-31 00:00:00' ELSE first_seen_at END AS updated_at FROM memes"),
}
