"""Joins, graph writes, state changes, conflicts, retrieval and reports (inventory P, J, G, DM, ST, V, R, C)."""

from __future__ import annotations

from memloom.plans.catalog import register


def chosen(base: str, **given: str | None) -> str:
    """base with a WHERE of the predicates that are given."""
    parts = [p for p in given.values() if p]
    return base + (" WHERE " + " AND ".join(parts) if parts else "")


def ranked(rows: str, cols: str, by: str, order: str, most: int) -> str:
    """The first `most` rows of each group of `rows`."""
    over = f"PARTITION BY {by} ORDER BY {order}" if by else f"ORDER BY {order}"
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER ({over}) AS rn FROM ({rows}) y) z WHERE rn <= {most}"


def collected(d, x: str) -> str:
    """Sorted distinct values of a group as one string."""
    return f"array_join(array_sort(collect_set({x})), ',')" if d.spark else f"array_to_string(list_sort(list(DISTINCT {x})), ',')"


STATES = "CASE WHEN new_score <= 20 THEN 0 WHEN new_score <= 50 THEN 1 WHEN new_score <= 80 THEN 2 ELSE 3 END"
_BOTH = "SELECT src AS a, dst AS b, rel_type, current_weight AS w, concat(src, '|', dst, '|', rel_type) AS eid FROM decayed_edges UNION ALL SELECT dst, src, rel_type, current_weight, concat(src, '|', dst, '|', rel_type) FROM decayed_edges"
_PRIMARY = ranked("SELECT memory_id, entity_id, coalesce(confidence, 0.8e0) AS c, created_at, seq FROM memory_entities", "memory_id, entity_id", "memory_id", "c DESC, created_at DESC, entity_id, seq", 1)

register("p12_optional_predicates", lambda d: chosen("SELECT id, source FROM content_library", since=f"published_at > {d.ts()} - INTERVAL '2' DAY", sources="source IN ('src1', 'src2', 'src3')", tag=None))
register("p14_label_predicate", "SELECT src, dst FROM edges WHERE left(dst, 1) <> 'n'")
register("p18_pick_other", "SELECT id, preferred, CASE WHEN preferred = first_id THEN second_id ELSE first_id END AS other FROM (SELECT id, first_id, second_id, CASE WHEN id % 2 = 0 THEN first_id ELSE second_id END AS preferred FROM conflicts) z")
register("p23_ordinal_state", f"SELECT user_id, CASE WHEN {STATES} >= 2 THEN 1 ELSE 0 END AS allowed FROM latest_affinity")
register("p25_trigger_window", "SELECT id, CASE WHEN hour(created_at) * 60 + minute(created_at) BETWEEN 480 AND 510 THEN 'morning' WHEN hour(created_at) * 60 + minute(created_at) BETWEEN 1320 AND 1350 THEN 'night' ELSE 'none' END AS due FROM affinity_history")
register("p27_not_exists", "SELECT id FROM memories m WHERE NOT EXISTS (SELECT 1 FROM outbox_events o WHERE o.memory_id = m.id AND o.status = 'done')")
register("p28_in_subquery", "SELECT id FROM memories WHERE status = 'pending' AND id IN (SELECT memory_id FROM outbox_events WHERE status = 'done')")

register("j2_double_join", "SELECT c.id, a.status AS first_status, b.status AS second_status FROM conflicts c JOIN memories a ON a.id = c.first_id JOIN memories b ON b.id = c.second_id WHERE c.status = 'pending'")
register("j3_join_latest", "SELECT l.user_id, c.id FROM latest_affinity l JOIN (" + ranked("SELECT user_id, id, created_at FROM conflicts", "user_id, id", "user_id", "created_at DESC, id", 1) + ") c ON c.user_id = l.user_id")
register("j5_three_way_distinct", "SELECT DISTINCT l.user_id FROM latest_affinity l JOIN recommendations r ON r.user_id = l.user_id JOIN memories m ON m.user_id = l.user_id WHERE l.new_score > 20")
register("j6_silent_users", lambda d: f"WITH quiet AS (SELECT user_id, max(created_at) AS last_at FROM affinity_history GROUP BY user_id) SELECT q.user_id, {d.days(d.ts(), 'q.last_at')} AS days FROM quiet q JOIN (SELECT DISTINCT user_id FROM recommendations) p ON p.user_id = q.user_id WHERE q.last_at < {d.ts()} - INTERVAL '12' HOUR")
register("j11_optional_collect", lambda d: f"SELECT m.id, coalesce({collected(d, 'CAST(e.entity_id AS VARCHAR(12))')}, '') AS participants, count(DISTINCT g.dst) AS places FROM memories m LEFT JOIN memory_entities e ON e.memory_id = m.id LEFT JOIN edges g ON g.src = concat('c', m.id) AND g.rel_type = 'LIVES_IN' GROUP BY m.id")
register("j20_entity_backfill", f"SELECT m.id, coalesce(p.entity_id, -1) AS entity_id FROM memories m LEFT JOIN ({_PRIMARY}) p ON p.memory_id = m.id")
register("j23_lookup", "SELECT s.id, s.category, CASE WHEN b.item_id IS NULL THEN 'missing' ELSE md5(b.text) END AS answer FROM scored_items s LEFT JOIN benchmark b ON b.item_id = s.id")
register("j27_not_recommended", "SELECT id FROM content_library c WHERE is_active AND NOT EXISTS (SELECT 1 FROM recommendations r WHERE r.content_id = c.id AND CAST(r.recommended_at AS DATE) = CAST('2024-01-15' AS DATE))")

register("g2_merge_edge_reset", "SELECT e.src, e.dst, e.rel_type, CASE WHEN n.src IS NULL THEN e.weight ELSE 1e0 END AS weight FROM edges e LEFT JOIN (SELECT DISTINCT concat('c', o_custkey) AS src FROM orders) n ON n.src = e.src")
register("g4_refresh_edge", lambda d: f"SELECT src, dst, rel_type, CASE WHEN src = 'c7' THEN 1e0 ELSE weight END AS weight, CASE WHEN src = 'c7' THEN {d.ts()} ELSE updated_at END AS updated_at FROM edges")
register("g9_user_graph", "SELECT 'root' AS src, node AS dst, 'HAS' AS rel_type, 1e0 AS w FROM (SELECT DISTINCT src AS node FROM edges WHERE rel_type = 'LIVES_IN') n UNION ALL SELECT src, dst, rel_type, round(current_weight, 6) FROM decayed_edges")
register("g11_episode_edges", "SELECT DISTINCT concat('m', memory_id) AS src, concat('p', entity_id) AS dst, 'INVOLVES' AS rel_type FROM memory_entities UNION ALL SELECT concat('m', id), concat('u', user_id), 'LOCATED_AT' FROM memories")
register("g12_episode_range", lambda d: f"SELECT m.id, m.created_at, count(e.entity_id) AS participants FROM memories m LEFT JOIN memory_entities e ON e.memory_id = m.id WHERE m.created_at BETWEEN {d.ts('2024-01-10 00:00:00')} AND {d.ts('2024-01-25 00:00:00')} GROUP BY m.id, m.created_at ORDER BY m.created_at DESC, m.id LIMIT 20")
register("g13_recent_entities", ranked("SELECT user_id, entity_id, max(created_at) AS last_at FROM memory_entities GROUP BY user_id, entity_id", "user_id, entity_id", "user_id", "last_at DESC, entity_id", 50))

register("dm2_insert_select", "SELECT memory_id, user_id, status FROM outbox_events UNION ALL SELECT id, user_id, 'pending' FROM memories m WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM outbox_events o WHERE o.memory_id = m.id)")
register("dm3_scalar_subquery", "SELECT m.id, coalesce((SELECT max(l.new_score) FROM latest_affinity l WHERE l.user_id = m.user_id), 50e0) AS old_score FROM memories m")
register("dm6_dynamic_update", "SELECT c.id, coalesce(n.source, c.source) AS source, coalesce(n.main_tag, c.main_tag) AS main_tag FROM content_library c LEFT JOIN (SELECT id, CASE WHEN id % 2 = 0 THEN 'manual' END AS source, CAST(NULL AS VARCHAR(10)) AS main_tag FROM conflicts) n ON n.id = c.id")
register("dm8_delete_with_audit", "SELECT id, 'deleted' AS status, 'memory' AS kind FROM memories WHERE user_id = 3 UNION ALL SELECT user_id, CAST(count(*) AS VARCHAR(12)), 'audit' FROM memories WHERE user_id = 3 GROUP BY user_id")
register("dm9_physical_delete", lambda d: ranked(f"SELECT id, created_at FROM memories WHERE status = 'deleted' AND created_at < {d.ts()} - INTERVAL '72' HOUR", "id", "", "created_at, id", 1000))
register("dm12_feedback", "SELECT id, content_id, CASE WHEN feedback = 'click' THEN 1 ELSE 0 END AS clicked, CASE WHEN feedback IN ('like', 'dislike') THEN feedback END AS reaction FROM recommendations")

register("st2_event_states", "SELECT status, next, count(*) AS n FROM (SELECT status, CASE WHEN status = 'pending' THEN 'processing' WHEN status = 'failed' AND retry_count >= 5 THEN 'dlq' WHEN status = 'failed' THEN 'pending' ELSE status END AS next FROM outbox_events) z GROUP BY status, next")
register("st6_rate_limit", lambda d: f"SELECT id, CASE WHEN n > 100 THEN 1 ELSE 0 END AS limited, n FROM (SELECT id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS n FROM (SELECT id, user_id, CAST(floor({d.seconds('created_at', d.ts('1970-01-01 00:00:00'))}) AS BIGINT) AS s FROM affinity_history) y) z")
register("st17_meme_lifecycle", lambda d: f"SELECT min(id) AS id, h, CASE WHEN {d.like('max(lower(text_description))', '(black|ghost)')} THEN 'rejected' WHEN max(popularity_score) >= 60 THEN 'approved' ELSE 'candidate' END AS status, round(max(popularity_score), 6) AS score FROM (SELECT id, text_description, popularity_score, md5(lower(trim(text_description))) AS h FROM memes) z GROUP BY h")
register("st20_repair_events", "SELECT m.id AS memory_id, 'repair_vector' AS kind FROM memories m WHERE m.status = 'committed' AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = m.id)")
register("st21_consistency_report", "SELECT user_id, count(*) AS checked, count(CASE WHEN embedding IS NULL THEN 1 END) AS missing, CASE WHEN count(CASE WHEN embedding IS NULL THEN 1 END) * 100 <= count(*) THEN 'ok' ELSE 'breach' END AS verdict FROM memories WHERE status = 'committed' GROUP BY user_id")
register("st22_dlq_backlog", "SELECT count(CASE WHEN status = 'dlq' THEN 1 END) AS dlq, count(CASE WHEN status = 'failed' THEN 1 END) AS failed, CASE WHEN count(CASE WHEN status = 'dlq' THEN 1 END) > 100 THEN 1 ELSE 0 END AS alarm FROM outbox_events")

register("v3_critic_stats", "SELECT count(*) AS total, count(CASE WHEN confidence < 0.5 THEN 1 END) AS low_confidence, count(CASE WHEN confidence >= 0.5 AND entity_id % 11 = 0 THEN 1 END) AS bad_type, count(CASE WHEN confidence IS NULL THEN 1 END) AS no_confidence, count(CASE WHEN confidence >= 0.5 AND entity_id % 11 <> 0 THEN 1 END) AS kept FROM memory_entities")
register("v6_ask_gate", lambda d: f"SELECT user_id, id FROM ({ranked('SELECT user_id, id, confidence FROM conflicts WHERE confidence >= 0.8', 'user_id, id', 'user_id', 'confidence DESC, id', 1)}) b WHERE NOT EXISTS (SELECT 1 FROM conflicts p WHERE p.user_id = b.user_id AND p.status = 'asked' AND p.created_at > {d.ts()} - INTERVAL '1' HOUR)")
register("v7_clarification", "SELECT c.id, s.choice, CASE s.choice WHEN 'first' THEN c.first_id WHEN 'second' THEN c.second_id END AS preferred FROM conflicts c JOIN (SELECT session_id, CASE WHEN contains(lower(content), 'a') THEN 'first' WHEN contains(lower(content), 'b') THEN 'second' END AS choice FROM conversation_turns WHERE turn = 0) s ON s.session_id = c.id")
register("v8_pending_conflicts", ranked("SELECT c.id, c.user_id, a.valence AS first_valence, b.valence AS second_valence, c.created_at FROM conflicts c JOIN memories a ON a.id = c.first_id JOIN memories b ON b.id = c.second_id WHERE c.status = 'pending'", "id, user_id, first_valence, second_valence", "user_id", "created_at DESC, id", 5))

_FACTS = f"""WITH links AS ({_BOTH}), seed AS (SELECT concat('c', c_custkey) AS id FROM customer WHERE c_mktsegment = 'BUILDING'),
 hop1 AS ({ranked("SELECT s.id AS root, l.b AS node, l.w, 1 AS hop FROM seed s JOIN links l ON l.a = s.id", 'root, node, w, hop', 'root', 'w DESC, node', 15)}),
 hop2 AS ({ranked("SELECT h.root, l.b AS node, h.w * l.w AS w, 2 AS hop FROM hop1 h JOIN links l ON l.a = h.node WHERE l.rel_type = 'LOCATED_IN' AND l.b <> h.root", 'root, node, w, hop', 'root', 'w DESC, node', 10)}),
 facts AS (SELECT root, node, w, hop FROM hop1 UNION ALL SELECT root, node, w, hop FROM hop2)"""
register("r6_fallback_expand", _FACTS + ", missing AS (SELECT concat('s', s_suppkey) AS id FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.root = concat('s', s_suppkey))) " + ranked("SELECT m.id AS root, e.dst AS node, e.rel_type, e.weight FROM missing m JOIN edges e ON e.src = m.id", "root, node, rel_type", "root", "weight DESC, node", 20))
register("r8_unified_context", "SELECT source, count(*) AS n FROM (SELECT 'memories' AS source FROM memories WHERE status = 'committed' UNION ALL SELECT 'facts' FROM edges UNION ALL SELECT 'history' FROM conversation_turns UNION ALL SELECT 'profile' FROM latest_affinity UNION ALL SELECT 'content' FROM content_library WHERE is_active UNION ALL SELECT 'memes' FROM memes WHERE status = 'approved') z GROUP BY source")
register("r10_interests", lambda d: ranked(f"SELECT src, dst AS interest, current_weight AS w FROM decayed_edges WHERE rel_type IN ('RELATED_TO', 'LIVES_IN') AND weight > 0.5 AND updated_at > {d.ts()} - INTERVAL '30' DAY UNION ALL SELECT DISTINCT src, x.interest, x.w FROM edges JOIN (SELECT 'news' AS interest, -1e0 AS w UNION ALL SELECT 'music', -2e0 UNION ALL SELECT 'travel', -3e0) x ON rel_type = 'LIVES_IN'", "src, interest", "src", "w DESC, interest", 10))
register("r11_likes", "SELECT src, dst, CASE WHEN weight >= 0.6 THEN 'like' ELSE 'dislike' END AS tag FROM edges WHERE rel_type = 'RELATED_TO'")
register("r12_resolve_reference", ranked("SELECT user_id, entity_id, max(created_at) AS last_at FROM memory_entities GROUP BY user_id, entity_id", "user_id, entity_id, CASE WHEN rn = 1 THEN 'best' ELSE 'alternative' END AS kind", "user_id", "last_at DESC, entity_id", 5))

register("c5_ui_state", "SELECT id, CASE WHEN new_score < 20 THEN 'stranger' WHEN new_score < 50 THEN 'acquaintance' WHEN new_score < 80 THEN 'friend' ELSE 'close_friend' END AS state FROM affinity_history")
register("c6_cutoff_last", lambda d: ranked(f"SELECT user_id, new_score, id, CAST({d.grab('day_label', 'Day ([0-9]+)', 1)} AS INT) AS day_no FROM (SELECT user_id, new_score, id, concat('Day ', CAST(day(created_at) AS VARCHAR(3))) AS day_label FROM affinity_history) x WHERE CAST({d.grab('day_label', 'Day ([0-9]+)', 1)} AS INT) <= 15", "user_id, new_score, day_no", "user_id", "day_no DESC, id DESC", 1))
# lines of 20 facts, so that no row holds all edges of a node
register("c8_facts_by_entity", lambda d: f"SELECT src, part, {d.joined('phrase', 'rn', '、')} AS line FROM (SELECT src, phrase, rn, CAST(floor((rn - 1) / 20) AS BIGINT) AS part FROM (SELECT src, concat(CASE rel_type WHEN 'FROM' THEN 'comes from ' WHEN 'LIVES_IN' THEN 'lives in ' ELSE 'knows ' END, dst) AS phrase, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rn FROM edges) y) z GROUP BY src, part")
register("c11_context_text", "SELECT user_id, concat_ws(' / ', concat('memories: ', CAST(count(*) AS VARCHAR(12))), concat('committed: ', CAST(count(CASE WHEN status = 'committed' THEN 1 END) AS VARCHAR(12)))) AS text_block FROM memories GROUP BY user_id")
register("c12_judge_clamp", lambda d: f"SELECT id, greatest(0e0, least(5e0, coalesce({'try_cast' if d.spark else 'TRY_CAST'}({d.grab('reply', chr(34) + 'score' + chr(34) + ': (-?[0-9.]+)', 1)} AS DOUBLE), 0e0))) AS score FROM (SELECT id, CASE WHEN id % 4 = 0 THEN 'not json' ELSE concat('```json {{\"score\": ', CAST(id % 9 - 1 AS VARCHAR(5)), '}}```') END AS reply FROM scored_items) z")
register("c13_run_delta", "SELECT a.category, round(b.acc - a.acc, 6) AS delta FROM (SELECT category, avg(CASE WHEN exact_match THEN 1e0 ELSE 0e0 END) AS acc FROM scored_items GROUP BY category) a JOIN (SELECT category, avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END) AS acc FROM scored_items GROUP BY category) b ON a.category = b.category")
register("c14_latest_run", ranked("SELECT user_id, id, created_at FROM affinity_history", "user_id, id", "user_id", "created_at DESC, id DESC", 2))
register("c16_name_lookup", ranked("SELECT lower(p_name) AS name, p_partkey FROM part", "name, p_partkey", "name", "p_partkey DESC", 1))
register("c17_session_stats", "SELECT session_id, count(*) AS turns, CASE WHEN count(CASE WHEN role = 'user' THEN 1 END) > 0 THEN 1 ELSE 0 END AS has_user FROM conversation_turns GROUP BY session_id")


def quantiles(source: str, key: str, col: str, shares: dict[str, float]) -> str:
    """Interpolated quantiles of each key from counts of equal values: the values next to the place (n - 1) * share, by running counts. No task holds a key's values in memory."""
    place = lambda q, side: f"min(CASE WHEN upto > {side}((total - 1) * {q}e0) THEN {col} END)"
    each = ", ".join(f"round({place(q, 'floor')} + ({place(q, 'ceil')} - {place(q, 'floor')}) * (max((total - 1) * {q}e0) - floor(max((total - 1) * {q}e0))), 4) AS {name}" for name, q in shares.items())
    per = f"SELECT {key}, {col}, count(*) AS n FROM {source} GROUP BY {key}, {col}"
    return f"SELECT {key}, {each} FROM (SELECT {key}, {col}, sum(n) OVER (PARTITION BY {key} ORDER BY {col}) AS upto, sum(n) OVER (PARTITION BY {key}) AS total FROM ({per}) x) y GROUP BY {key}"


_USER_LAGS = "(SELECT user_id, lag_ms FROM lags JOIN outbox_events USING (event_id) WHERE lag_ms IS NOT NULL)"
register("c19_percentiles", lambda d: quantiles(f"{_USER_LAGS} u", "user_id", "lag_ms", {"p95": 0.95, "p99": 0.99}) if d.spark else f"SELECT user_id, round(quantile_cont(lag_ms, 0.95), 4) AS p95, round(quantile_cont(lag_ms, 0.99), 4) AS p99 FROM {_USER_LAGS} u GROUP BY user_id")
register("c21_trigger_text", f"SELECT user_id, message FROM (SELECT user_id, concat(CASE WHEN {STATES} >= 2 THEN 'Good to see you' ELSE 'Hello' END, CASE WHEN user_id % 2 = 0 THEN ', how was your day?' ELSE ', you must answer' END) AS message FROM latest_affinity) z WHERE NOT contains(message, 'must')")
register("c22_merge_outputs", "SELECT id, task_type, 'factual' AS origin FROM scored_items WHERE task_type = 'factual' UNION ALL SELECT id, task_type, 'adversarial' FROM scored_items WHERE task_type = 'adversarial'")
