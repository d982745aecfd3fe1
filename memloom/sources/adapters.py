"""Memory-shaped relations over the driver's tables, as one text for Spark SQL and DuckDB.

A `Dialect` renders the few expressions the two engines spell differently. In Spark every view is a
temporary view over parquet, so filters and column pruning reach the scan; for the oracle the views a
query uses are put before it as common table expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
AS_OF = "2024-01-31 00:00:00"


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def ts(self, text: str = AS_OF) -> str:
        return f"TIMESTAMP_NTZ '{text}'" if self.spark else f"TIMESTAMP '{text}'"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')" if self.spark else f"json_extract_string({x}, '$.{key}')"

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', '{by}')" if self.spark else f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def like(self, x: str, pattern: str) -> str:
        return f"({x} rlike r'{pattern}')" if self.spark else f"regexp_matches({x}, '{pattern}')"

    def grab(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, r'{pattern}', {group})" if self.spark else f"regexp_extract({x}, '{pattern}', {group})"

    def seconds(self, a: str, b: str) -> str:
        """a - b in seconds, as a double."""
        if self.spark:
            return f"((unix_micros(CAST({a} AS TIMESTAMP)) - unix_micros(CAST({b} AS TIMESTAMP))) / 1000000.0D)"
        return f"(CAST(epoch_us({a}) - epoch_us({b}) AS DOUBLE) / 1000000.0)"

    def days(self, a: str, b: str) -> str:
        """Whole elapsed days, rounded down."""
        return f"CAST(floor({self.seconds(a, b)} / 86400.0) AS BIGINT)"

    def cosine(self, a: str, b: str) -> str:
        if self.spark:
            dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0.0D, (s, x) -> s + x)"
            return f"({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"
        return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

    def norm(self, a: str) -> str:
        return f"sqrt({self.dot(a, a)})"

    def dot(self, a: str, b: str) -> str:
        if self.spark:
            return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0.0D, (s, x) -> s + x)"
        return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def count(self, x: str, pattern: str) -> str:
        return f"CAST(regexp_count({x}, r'{pattern}') AS BIGINT)" if self.spark else f"CAST(len(regexp_extract_all({x}, '{pattern}')) AS BIGINT)"

    def median(self, x: str) -> str:
        return f"percentile({x}, 0.5)" if self.spark else f"quantile_cont({x}, 0.5)"

    def joined(self, x: str, order: str, sep: str) -> str:
        if self.spark:
            return f"array_join(transform(array_sort(collect_list(named_struct('o', {order}, 'v', {x}))), z -> z.v), '{sep}')"
        return f"string_agg({x}, '{sep}' ORDER BY {order})"

    def double(self, x: str) -> str:
        return f"CAST({x} AS DOUBLE)"


SPARK, DUCK = Dialect(True), Dialect(False)


#: Views a query reads more than once, as a rule.
SHARED = ("edges", "decayed_edges")


def views(d: Dialect) -> dict[str, str]:
    now = d.ts()
    ends = "concat('p', l_partkey), concat('s', l_suppkey), 'RELATED_TO', CAST(l_partkey AS BIGINT)"
    # the same rows: Spark makes the names of distinct pairs only, so that pairs of numbers are hashed and shuffled
    supplied = f"SELECT {ends} FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) p" if d.spark else f"SELECT DISTINCT {ends} FROM lineitem"
    return {
        "affinity_history": """SELECT event_id AS id, user_id, ts AS created_at,
  CASE event_type WHEN 'click' THEN 'conversation' WHEN 'view' THEN 'conversation' WHEN 'purchase' THEN 'gratitude'
    WHEN 'signup' THEN 'explicit_feedback' ELSE 'silence_decay' END AS trigger_event,
  least(value, CAST(100 AS DOUBLE)) AS new_score, CAST(event_id % 21 - 10 AS DOUBLE) / 10 AS emotion_valence, props AS signals FROM events""",
        "outbox_events": """SELECT event_id, event_id % 1000 AS memory_id, user_id,
  CASE event_type WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'done' WHEN 'click' THEN 'pending' WHEN 'signup' THEN 'failed' ELSE 'dlq' END AS status,
  event_id % 7 AS retry_count, concat('k', event_id % 5000) AS idempotency_key, ts AS created_at,
  CASE WHEN event_type IN ('purchase', 'view') THEN ts + INTERVAL '1' SECOND * CAST(event_id % 40 AS INT) END AS processed_at FROM events""",
        "memories": f"""SELECT doc_id AS id, doc_id % 15 AS user_id, text AS content, CAST(doc_id % 21 - 10 AS DOUBLE) / 10 AS valence,
  CASE WHEN doc_id % 5 = 0 THEN 'pending' WHEN doc_id % 5 = 1 THEN 'deleted' ELSE 'committed' END AS status,
  {now} - INTERVAL '1' DAY * CAST(doc_id % 60 AS INT) AS created_at, embedding FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
        "memory_entities": """SELECT o_custkey AS user_id, l_orderkey AS memory_id, l_partkey AS entity_id, l_linenumber AS seq,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_discount AS DOUBLE) * 10 END AS confidence, l_shipdate AS created_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
        "mentions": """SELECT l_orderkey AS memory_id, concat('p', l_partkey) AS node, l_linenumber AS seq, CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_discount AS DOUBLE) * 10 END AS confidence, l_shipdate AS created_at FROM lineitem
  UNION ALL SELECT l_orderkey, concat('s', l_suppkey), l_linenumber, CAST(0.5 AS DOUBLE), l_shipdate FROM lineitem""",
        "entity_names": """SELECT concat('c', c_custkey) AS node, c_name AS name FROM customer UNION ALL SELECT concat('s', s_suppkey), s_name FROM supplier UNION ALL SELECT concat('n', n_nationkey), n_name FROM nation
  UNION ALL SELECT concat('r', r_regionkey), r_name FROM region UNION ALL SELECT concat('p', p_partkey), p_name FROM part""",
        "edges": f"""SELECT src, dst, rel_type, CAST(3 + k % 7 AS DOUBLE) / 10 AS weight, CAST(1 + k % 5 AS DOUBLE) / 100 AS decay_rate,
  {now} - INTERVAL '1' DAY * CAST(k % 90 AS INT) AS updated_at FROM (
  SELECT concat('c', c_custkey) AS src, concat('n', c_nationkey) AS dst, 'LIVES_IN' AS rel_type, CAST(c_custkey AS BIGINT) AS k FROM customer
  UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), 'FROM', CAST(s_suppkey AS BIGINT) FROM supplier
  UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), 'LOCATED_IN', CAST(n_nationkey AS BIGINT) FROM nation
  UNION ALL {supplied}) e""",
        # the edges as they are told, ends as numbers, told again as often as the tables do
        "told_edges": """SELECT rel_type, a, b, CAST(3 + k % 7 AS DOUBLE) / 10 AS weight FROM (
  SELECT 'LIVES_IN' AS rel_type, c_custkey AS a, CAST(c_nationkey AS BIGINT) AS b, CAST(c_custkey AS BIGINT) AS k FROM customer
  UNION ALL SELECT 'FROM', s_suppkey, s_nationkey, CAST(s_suppkey AS BIGINT) FROM supplier
  UNION ALL SELECT 'LOCATED_IN', n_nationkey, n_regionkey, CAST(n_nationkey AS BIGINT) FROM nation
  UNION ALL SELECT 'RELATED_TO', l_partkey, l_suppkey, CAST(l_partkey AS BIGINT) FROM lineitem) t""",
        "content_library": f"""SELECT d.doc_id AS id, source, lang AS main_tag, text AS title, concat('http://c/', d.doc_id % 900) AS content_url,
  CAST(CASE WHEN quality = 1 THEN 0.9 WHEN quality = 0 THEN 0.3 ELSE 0.5 END AS DOUBLE) AS quality_score,
  {now} - INTERVAL '1' HOUR * CAST(d.doc_id % 72 AS INT) AS published_at, d.doc_id % 10 <> 0 AS is_active
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
        "memes": f"""SELECT p_partkey AS id, p_name AS text_description, p_brand AS source_platform,
  least(CAST(p_retailprice AS DOUBLE) / 20, CAST(100 AS DOUBLE)) AS popularity_score,
  CASE p_size % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'rejected' ELSE 'approved' END AS status,
  {now} - INTERVAL '1' HOUR * CAST(p_partkey % 500 AS INT) AS first_seen_at FROM part""",
        "meme_usage_history": """SELECT event_id AS id, user_id, event_id % 200 AS meme_id, ts AS used_at,
  CASE event_type WHEN 'purchase' THEN 'liked' WHEN 'view' THEN 'ignored' WHEN 'error' THEN 'disliked' END AS user_reaction FROM events""",
        "conversation_turns": """SELECT conv_id AS session_id, turn, role, text AS content,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST(conv_id * 60 + turn AS INT) AS created_at FROM conversations""".replace(
            "TIMESTAMP '2024", "TIMESTAMP_NTZ '2024" if d.spark else "TIMESTAMP '2024"
        ),
        "conflicts": f"""SELECT doc_id AS id, doc_id % 15 AS user_id, doc_id AS first_id, doc_id + 15 AS second_id, CAST(7 + doc_id % 3 AS DOUBLE) / 10 AS confidence,
  CASE doc_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'asked' ELSE 'resolved' END AS status, {now} - INTERVAL '1' HOUR * CAST(doc_id % 50 AS INT) AS created_at FROM documents""",
        "recommendations": """SELECT event_id AS id, user_id, event_id % 1000 AS content_id, ts AS recommended_at,
  CASE event_type WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'dislike' END AS feedback FROM events""",
        "scored_items": """SELECT doc_id AS id, doc_id % 5 + 1 AS category, CASE WHEN toxic = 1 THEN 'adversarial' ELSE 'factual' END AS task_type,
  quality = 1 AS correct, quality = 1 AND doc_id % 3 = 0 AS exact_match FROM labels""",
        "decayed_edges": f"""SELECT src, dst, rel_type, weight, decay_rate, updated_at, {d.days(now, 'updated_at')} AS days,
  weight * exp(-decay_rate * {d.days(now, 'updated_at')}) AS current_weight FROM edges""",
        "latest_affinity": """SELECT user_id, new_score, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM affinity_history) z WHERE rn = 1""",
        "vectors": f"SELECT vec_id, label, embedding, {d.norm('embedding')} AS norm FROM embeddings",
        "lags": f"""SELECT event_id, {d.seconds('processed_at', 'created_at')} * 1000 AS lag_ms FROM outbox_events WHERE status = 'done' AND processed_at IS NOT NULL""",
    }


def used(sql: str, all_views: dict[str, str]) -> list[str]:
    """Names of the views that sql reads, those they read themselves first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in all_views:
            if name not in out and re.search(rf"\b{name}\b", text):
                visit(all_views[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def run(spark: SparkSession, sf_dir: str, sql: str, args: dict | None = None) -> DataFrame:
    """sql over the driver's tables and the views, in Spark; args: its named parameters (`:name`). Views are common table
    expressions and tables frames handed over by name, so the session's catalog stays as the caller left it."""
    all_views = views(SPARK)
    need = used(sql, all_views)
    text = " ".join([sql, *(all_views[v] for v in need)])
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", text)}
    ctes = [f"{t} AS (SELECT * FROM {{{t}}})" for t in frames] + [f"{v} AS ({braced(all_views[v])})" for v in need]
    recursive, rest = re.match(r"(?s)^(?:WITH (RECURSIVE )?)?(.*)$", braced(sql)).groups() if sql.startswith("WITH ") else (None, braced(sql))
    join = ", " if sql.startswith("WITH ") else " "
    whole = f"WITH {recursive or ''}{', '.join(ctes)}{join}{rest}" if ctes else rest
    return spark.sql(whole, args=args, **frames) if frames else spark.sql(whole, args=args)


def braced(sql: str) -> str:
    """sql for a formatter that takes braces as its own."""
    return sql.replace("{", "{{").replace("}", "}}")


def oracle(sql: str) -> str:
    """The same query for DuckDB, its views as common table expressions."""
    all_views = views(DUCK)
    need = used(sql, all_views)
    if not need:
        return sql
    ctes = ", ".join(f"{v} AS {'MATERIALIZED ' if v in SHARED else ''}({all_views[v]})" for v in need)
    return f"WITH {'RECURSIVE ' if sql.startswith('WITH RECURSIVE') else ''}{ctes}, {re.sub(r'^WITH (RECURSIVE )?', '', sql)}" if sql.startswith("WITH ") else f"WITH {ctes} {sql}"
