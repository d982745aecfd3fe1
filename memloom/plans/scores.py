"""Score formulas, aggregates, windows, orders and sets (inventory M, A, W, K, U). Weights are fixed values."""

from __future__ import annotations

from memloom.plans.catalog import register
from memloom.plans.text_rules import NEGATIVE, POSITIVE, hits


register("m5_recency_boost", lambda d: f"SELECT id, round(valence * CASE WHEN {d.days(d.ts(), 'created_at')} <= 7 THEN 1.15e0 ELSE 1e0 END, 6) AS boosted FROM memories")
register("m6_recommend_score", lambda d: f"SELECT c.id, u.user_id, round(greatest(0, least(1, (0.5e0 * CASE WHEN c.id % 3 = u.user_id % 3 THEN 0.8e0 ELSE 0.2e0 END + 0.3e0 * exp(-0.05e0 * {d.seconds(d.ts(), 'c.published_at')} / 3600) + 0.2e0 * c.quality_score) * CASE WHEN r.content_id IS NULL THEN 1e0 ELSE 0.3e0 END)), 6) AS score FROM content_library c JOIN (SELECT DISTINCT user_id FROM memories) u ON c.id % 15 = u.user_id LEFT JOIN (SELECT DISTINCT user_id, content_id FROM recommendations) r ON r.user_id = u.user_id AND r.content_id = c.id")
register("m10_delta_v1", "SELECT id, round(CASE WHEN trigger_event = 'conversation' THEN 0.01e0 ELSE 0e0 END + CASE WHEN emotion_valence > 0 THEN 0.005e0 * emotion_valence ELSE 0e0 END + CASE WHEN trigger_event = 'gratitude' THEN 0.01e0 ELSE 0e0 END - CASE WHEN id % 11 = 0 THEN 0.02e0 ELSE 0e0 END - CASE WHEN emotion_valence < -0.5 THEN 0.01e0 ELSE 0e0 END - 0.005e0 * (id % 4), 6) AS delta FROM affinity_history")
register("m11_delta_v2", "SELECT id, round((CASE WHEN emotion_valence > 0 THEN 0.8e0 * emotion_valence * 0.5e0 WHEN emotion_valence < 0 THEN -0.3e0 * abs(emotion_valence) * 0.5e0 ELSE 0e0 END + CASE WHEN emotion_valence > 0.7 THEN 10e0 * emotion_valence ELSE 0e0 END + CASE WHEN trigger_event = 'conversation' THEN 0.5e0 ELSE 0e0 END + CASE WHEN hour(created_at) >= 22 OR hour(created_at) < 5 THEN 3e0 ELSE 0e0 END + CASE WHEN id % 9 = 0 THEN 2e0 ELSE 0e0 END + CASE WHEN id % 13 = 0 THEN -4e0 ELSE 0e0 END) * (1 + CAST(id % 5 AS DOUBLE) / 5), 6) AS delta FROM affinity_history")
register("m15_health_state", "SELECT user_id, score, CASE WHEN score > 80 OR days >= 25 THEN 'watch' WHEN score > 60 THEN 'concern' WHEN score > 30 THEN 'attention' ELSE 'normal' END AS health, CASE WHEN score > 80 OR days >= 25 THEN 3 WHEN score > 60 THEN 2 WHEN score > 30 THEN 1 ELSE 0 END AS level FROM (SELECT user_id, least(100, count(CASE WHEN emotion_valence < -0.3 THEN 1 END)) AS score, count(DISTINCT CAST(created_at AS DATE)) AS days FROM affinity_history GROUP BY user_id) z")
register("m16_silence_decay", lambda d: f"SELECT user_id, round(CASE WHEN deep = 1 THEN greatest(21e0, s - rate * days) ELSE greatest(0e0, s - rate * days) END, 6) AS new_score FROM (SELECT l.user_id, l.new_score AS s, {d.days(d.ts(), 'l.created_at')} AS days, p.deep, CASE WHEN l.new_score <= 20 THEN 2e0 WHEN l.new_score <= 50 THEN 1.5e0 WHEN l.new_score <= 80 THEN 0.8e0 ELSE 0.5e0 END * CASE WHEN p.deep = 1 THEN 0.5e0 ELSE 1e0 END * CASE WHEN p.thanks = 1 THEN 0.7e0 ELSE 1e0 END AS rate FROM latest_affinity l JOIN (SELECT user_id, max(CASE WHEN emotion_valence > 0.9 THEN 1 ELSE 0 END) AS deep, max(CASE WHEN trigger_event = 'gratitude' THEN 1 ELSE 0 END) AS thanks FROM affinity_history GROUP BY user_id) p ON p.user_id = l.user_id) z")
register("m18_feed_quality", lambda d: f"SELECT id, round(least(1e0, 0.5e0 + CASE WHEN title IS NOT NULL THEN 0.1e0 ELSE 0e0 END + CASE WHEN source IS NOT NULL THEN 0.1e0 ELSE 0e0 END + CASE WHEN length(title) BETWEEN 10 AND 100 THEN 0.1e0 ELSE 0e0 END + CASE WHEN {d.days(d.ts(), 'published_at')} = 0 THEN 0.2e0 WHEN {d.days(d.ts(), 'published_at')} <= 1 THEN 0.1e0 ELSE 0e0 END), 6) AS quality FROM content_library")
register("m19_resolution_confidence", "SELECT memory_id, round(least(1e0, CASE WHEN count(*) = 1 THEN 0.9e0 WHEN count(*) = 2 THEN 0.7e0 ELSE 0.5e0 END + CASE WHEN min(entity_id) % 4 = 0 THEN 0.1e0 ELSE 0e0 END + CASE WHEN max(seq) <= 2 THEN 0.1e0 ELSE 0e0 END), 6) AS confidence FROM memory_entities GROUP BY memory_id")
_P, _N = hits("lower(content)", POSITIVE), hits("lower(content)", NEGATIVE)
register("m21_keyword_valence", f"SELECT session_id, turn, round(CASE WHEN p > n THEN least(0.8e0, 0.3e0 + 0.1e0 * p) WHEN n > p THEN greatest(-0.8e0, -0.3e0 - 0.1e0 * n) ELSE 0e0 END, 6) AS valence FROM (SELECT session_id, turn, {_P} AS p, {_N} AS n FROM conversation_turns) z")
register("m22_relation_weights", "SELECT e.src, e.dst, e.rel_type, coalesce(w.weight, 0.5e0) AS weight, coalesce(w.decay, 0.03e0) AS decay FROM edges e LEFT JOIN (SELECT 'LIVES_IN' AS rel_type, 0.8e0 AS weight, 0.01e0 AS decay UNION ALL SELECT 'FROM', 0.7e0, 0.005e0) w ON w.rel_type = e.rel_type")
register("m23_path_weight", "SELECT a.src, b.dst, round(sum(a.current_weight * b.current_weight), 6) AS weight FROM decayed_edges a JOIN decayed_edges b ON a.dst = b.src GROUP BY a.src, b.dst")
register("m24_rounding", "SELECT id, round(new_score, 2) AS two, round(new_score / 7, 4) AS four, CAST(floor(new_score * 100) AS BIGINT) AS cents FROM affinity_history")

register("a13_affected", "SELECT count(CASE WHEN current_weight < 0.05 THEN 1 END) AS deleted, count(CASE WHEN current_weight >= 0.05 THEN 1 END) AS updated FROM decayed_edges")
register("a14_ordered_counts", "SELECT source, count(*) AS n FROM content_library GROUP BY source ORDER BY n DESC, source")
register("a15_error_histogram", "SELECT coalesce(CASE WHEN status = 'failed' THEN concat('retry ', CAST(retry_count AS VARCHAR(5))) END, 'none') AS error, count(*) AS n FROM outbox_events WHERE status IN ('failed', 'dlq') GROUP BY 1")
register("a22_p50_index", "SELECT lag_ms AS p50 FROM (SELECT lag_ms, row_number() OVER (ORDER BY lag_ms, event_id) AS rn, count(*) OVER () AS n FROM lags) z WHERE rn = CAST(floor(n / 2e0) AS BIGINT) + 1")
register("a23_mean_lag", "SELECT round(avg(lag_ms), 6) AS mean_ms, count(*) AS n FROM lags")
register("a26_evaluated_mean", "SELECT task_type, round(avg(score), 6) AS mean_score, count(score) AS evaluated, count(*) AS total, count(CASE WHEN score <= 1 THEN 1 END) AS low, count(CASE WHEN score >= 4 THEN 1 END) AS high FROM (SELECT task_type, CASE WHEN id % 7 = 0 THEN NULL WHEN exact_match THEN 5e0 WHEN correct THEN 4e0 ELSE 1e0 END AS score FROM scored_items) z GROUP BY task_type")
register("a28_failure_reasons", "SELECT category, CASE WHEN task_type = 'adversarial' THEN 'adversarial' WHEN category IN (1, 2) THEN 'recall' ELSE 'other' END AS reason, count(*) AS n FROM scored_items WHERE NOT correct GROUP BY 1, 2")
register("a30_keyword_totals", f"SELECT session_id, sum({_P}) AS positive, sum({_N}) AS negative, round(greatest(-1e0, least(1e0, (CAST(sum({_P}) AS DOUBLE) - sum({_N})) / (sum({_P}) + sum({_N}) + 1))), 6) AS optimism FROM conversation_turns GROUP BY session_id")
register("a31_mean_vector", lambda d: "SELECT label, pos, round(sum(w * x) / sum(w), 4) AS mean FROM (SELECT label, CAST(1 + vec_id % 3 AS DOUBLE) AS w, {} FROM embeddings{}) z GROUP BY label, pos".format(*(("t.pos AS pos, CAST(t.x AS DOUBLE) AS x", " LATERAL VIEW posexplode(embedding) t AS pos, x") if d.spark else ("generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x", ""))))
register("a32_progress", "SELECT count(*) AS total, count(CASE WHEN status = 'committed' THEN 1 END) AS done, round(100e0 * count(CASE WHEN status = 'committed' THEN 1 END) / count(*), 2) AS pct FROM memories")
register("a34_audit_rollup", lambda d: f"SELECT CAST(created_at AS DATE) AS day, count(*) AS checks, count(CASE WHEN status = 'failed' THEN 1 END) AS failed, count(CASE WHEN status = 'dlq' THEN 1 END) AS dlq, round(avg(retry_count), 6) AS mean_retries FROM outbox_events WHERE created_at > {d.ts()} - INTERVAL '14' DAY GROUP BY CAST(created_at AS DATE)")

register("w2_days_since", lambda d: f"SELECT user_id, {d.days(d.ts(), 'created_at')} AS days FROM latest_affinity")
register("w6_result_rank", "SELECT id, row_number() OVER (ORDER BY popularity_score DESC, id) AS rank_position FROM memes")
register("w9_recent_of_type", "SELECT user_id, entity_id, rn FROM (SELECT user_id, entity_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, memory_id DESC, seq) AS rn FROM memory_entities WHERE entity_id % 4 = 1) z WHERE rn <= 10")
_FACTS = "SELECT 1 AS hop, src, dst, current_weight AS weight FROM decayed_edges WHERE src = 'c7' UNION ALL SELECT 2, a.src, b.dst, a.current_weight * b.current_weight FROM decayed_edges a JOIN decayed_edges b ON a.dst = b.src WHERE a.src = 'c7'"
register("k4_total_order_limit", "SELECT src, dst, weight FROM edges WHERE rel_type = 'RELATED_TO' ORDER BY weight DESC, src, dst LIMIT 15")
register("k8_first_trigger", "SELECT user_id, action FROM (SELECT u.user_id, r.action, row_number() OVER (PARTITION BY u.user_id ORDER BY r.priority DESC, r.action) AS rn FROM latest_affinity u JOIN (SELECT 'greet' AS action, 20 AS least_score, 1 AS priority UNION ALL SELECT 'share', 50, 2 UNION ALL SELECT 'care', 80, 3) r ON u.new_score >= r.least_score) z WHERE rn = 1")
register("k10_active_hours", lambda d: "SELECT user_id, array_join(slice(h, greatest(1, size(h) - 9), 10), ',') AS hours FROM (SELECT user_id, array_sort(collect_set(hour(created_at))) AS h FROM affinity_history GROUP BY user_id) z" if d.spark else "SELECT user_id, array_to_string(list_sort(list(DISTINCT hour(created_at)))[-10:], ',') AS hours FROM affinity_history GROUP BY user_id")
register("k11_best_conflict", "SELECT user_id, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, id) AS rn FROM conflicts) z WHERE rn = 1")
register("k12_stable_order", "SELECT id, row_number() OVER (ORDER BY quality_score DESC, id) AS pos FROM content_library")

register("u1_union_all", f"SELECT src, dst, round(weight, 6) AS weight, 'fact' AS kind FROM ({_FACTS}) z UNION ALL SELECT CAST(user_id AS VARCHAR(20)), CAST(id AS VARCHAR(20)), round(valence, 6), 'memory' FROM memories")
register("u6_common_words", lambda d: "SELECT a.p_partkey, size(array_intersect(split(a.p_name, ' '), split(b.p_name, ' '))) AS common FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1" if d.spark else "SELECT a.p_partkey, len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) AS common FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
register("u9_ordered_distinct", lambda d: "SELECT p_partkey, array_join(array_distinct(concat(array(p_brand), split(p_name, ' '), array(p_brand))), ',') AS tags FROM part" if d.spark else "SELECT p_partkey, array_to_string([x for x, i in t if list_position(t, x) = i], ',') AS tags FROM (SELECT p_partkey, list_concat([p_brand], string_split(p_name, ' '), [p_brand]) AS t FROM part) y")
register("u10_distinct", "SELECT DISTINCT dst, rel_type FROM edges")
register("u11_exclude_seen", "SELECT DISTINCT b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.rel_type = 'RELATED_TO' AND NOT EXISTS (SELECT 1 FROM edges s WHERE s.src = a.src AND s.dst = b.dst)")
