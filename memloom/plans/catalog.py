"""Queries of the memory engine. Each is a function Dialect -> SQL; `register` keeps them by key.

Keys start with the inventory id they implement. Every "now" is the fixed `as_of`; ties are broken by id.
"""

from __future__ import annotations

from collections.abc import Callable

from memloom.sources.adapters import Dialect

CATALOG: dict[str, Callable[[Dialect], str]] = {}


def register(key: str, sql: str | Callable[[Dialect], str]) -> None:
    CATALOG[key] = sql if callable(sql) else lambda d: sql


# ---- projections and predicates -----------------------------------------------------------------
register("p1_projection", "SELECT memory_id AS id, entity_id AS entity, coalesce(confidence, 0.8) AS confidence FROM memory_entities")
register("p2_tenant_filter", "SELECT id, status FROM memories WHERE user_id = 3")
register("p3_equality_conjunction", "SELECT id, popularity_score FROM memes WHERE status = 'approved' AND source_platform = 'Brand#13'")
register("p4_inequality", "SELECT id, user_id FROM affinity_history WHERE trigger_event <> 'silence_decay'")
register("p5_in_list", "SELECT event_id, status FROM outbox_events WHERE status IN ('failed', 'dlq')")
register("p6_any_array", lambda d: f"SELECT id, source FROM content_library WHERE {'array_contains(array(' if d.spark else 'list_contains(['}'src1','src5'{')' if d.spark else ']'}, source)")
register("p7_not_null", "SELECT id, user_reaction FROM meme_usage_history WHERE user_reaction IS NOT NULL")
register("p8_range", "SELECT event_id FROM outbox_events WHERE retry_count < 5 AND retry_count > 1")
register("p9_relative_window", lambda d: f"SELECT id, user_id FROM affinity_history WHERE created_at > {d.ts()} - INTERVAL '7' DAY")
register("p10_calendar_day", "SELECT id FROM affinity_history WHERE created_at >= CAST('2024-01-15' AS DATE) AND created_at < CAST('2024-01-16' AS DATE)")
register("p11_closed_range", lambda d: f"SELECT session_id, turn FROM conversation_turns WHERE created_at BETWEEN {d.ts('2024-01-02 00:00:00')} AND {d.ts('2024-01-05 12:00:00')}")
register("p15_relation_alternation", "SELECT rel_type, count(*) AS n FROM edges WHERE rel_type IN ('LIVES_IN', 'RELATED_TO') GROUP BY rel_type")
register("p16_coalesce_default", "SELECT memory_id, entity_id, seq, round(coalesce(confidence, CAST(0.8 AS DOUBLE)), 6) AS confidence FROM memory_entities")
register("p17_searched_case", "SELECT src, dst, rel_type, CASE WHEN rel_type = 'FROM' THEN greatest(weight, CAST(0.5 AS DOUBLE)) ELSE weight END AS kept_weight FROM edges WHERE rel_type <> 'RELATED_TO'")
register("p19_state_v1", "SELECT id, CASE WHEN new_score / 100 < 0.2 THEN 'stranger' WHEN new_score / 100 < 0.4 THEN 'acquaintance' WHEN new_score / 100 < 0.6 THEN 'friend' WHEN new_score / 100 < 0.8 THEN 'close_friend' ELSE 'best_friend' END AS state FROM affinity_history")
register("p20_state_v2", "SELECT id, CASE WHEN new_score <= 20 THEN 'stranger' WHEN new_score <= 50 THEN 'acquaintance' WHEN new_score <= 80 THEN 'friend' ELSE 'close_friend' END AS state FROM affinity_history")
register("p21_trend_level", "SELECT id, CASE WHEN popularity_score < 30 THEN 'emerging' WHEN popularity_score < 60 THEN 'rising' WHEN popularity_score < 85 THEN 'hot' ELSE 'peak' END AS trend_level FROM memes")
register("p22_tone", "SELECT user_id, CASE WHEN new_score / 100 >= 0.7 THEN 'warm' WHEN new_score / 100 >= 0.5 THEN 'friendly' WHEN new_score / 100 >= 0.3 THEN 'polite' ELSE 'formal' END AS tone FROM latest_affinity")
register("p24_quiet_hours", "SELECT id, CASE WHEN hour(created_at) * 60 + minute(created_at) >= 1320 OR hour(created_at) * 60 + minute(created_at) <= 480 THEN 1 ELSE 0 END AS quiet FROM affinity_history")
register("p26_casts", lambda d: f"SELECT id, CAST({d.json('signals', 'k')} AS INT) AS k FROM affinity_history")
register("p29_ilike", "SELECT p_partkey FROM part WHERE p_name ILIKE '%RED%'")
register("p30_transitions", "SELECT status, next, CASE WHEN (status = 'candidate' AND next IN ('approved', 'rejected')) OR (status = 'approved' AND next = 'archived') THEN 1 ELSE 0 END AS allowed, count(*) AS n FROM (SELECT status, CASE WHEN id % 3 = 0 THEN 'approved' WHEN id % 3 = 1 THEN 'archived' ELSE 'rejected' END AS next FROM memes) z GROUP BY 1, 2, 3")
register("p31_domain_check", "SELECT count(*) AS n, CAST(sum(CASE WHEN new_score BETWEEN 0 AND 100 AND emotion_valence BETWEEN -1 AND 1 THEN 0 ELSE 1 END) AS BIGINT) AS violations FROM affinity_history")

# ---- joins ---------------------------------------------------------------------------------------
register("j1_inner", "SELECT m.id, e.entity_id, e.seq FROM memory_entities e JOIN memories m ON m.id = e.memory_id WHERE m.status <> 'deleted'")
register("j7_left_outer", "SELECT m.id, m.status, count(o.event_id) AS events FROM memories m LEFT JOIN outbox_events o ON o.memory_id = m.id AND o.status = 'pending' GROUP BY m.id, m.status")
register("j8_left_anti", "SELECT id FROM memories m WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM outbox_events o WHERE o.memory_id = m.id AND o.status = 'pending')")
register("j9_left_semi", "SELECT event_id FROM outbox_events WHERE memory_id IN (SELECT id FROM memories WHERE status = 'committed')")
register("j4_fact_dim", "SELECT u.id, u.user_id, m.text_description FROM meme_usage_history u JOIN memes m ON u.meme_id = m.id WHERE CAST(u.used_at AS DATE) = CAST('2024-01-20' AS DATE)")
register("j12_existence", "SELECT m.id, CASE WHEN e.src IS NULL THEN 1 ELSE 0 END AS missing FROM memories m LEFT JOIN (SELECT DISTINCT src FROM edges) e ON concat('c', m.id) = e.src")
register("j13_not_in_vectors", "SELECT doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
register("j15_one_hop", "SELECT src AS entity, rel_type, dst AS other, 'out' AS dir, weight FROM edges WHERE src IN ('n1', 'c7', 's3', 'p11') UNION ALL SELECT dst, rel_type, src, 'in', weight FROM edges WHERE dst IN ('n1', 'c7', 's3', 'p11')")
register("j16_two_hop", lambda d: "SELECT a.src, a.dst AS via, b.dst, concat_ws(' ', a.src, a.rel_type, a.dst, b.rel_type, b.dst) AS path, round(a.weight * b.weight, 6) AS weight FROM edges a JOIN edges b ON a.dst = b.src WHERE a.rel_type = 'LIVES_IN'")
register("j17_three_hop", "WITH two AS (SELECT a.src, b.dst, count(*) AS n, max(a.weight * b.weight) AS w FROM edges a JOIN edges b ON a.dst = b.src WHERE a.rel_type = 'RELATED_TO' GROUP BY a.src, b.dst) SELECT t.src, c.dst, CAST(sum(t.n) AS BIGINT) AS paths, round(max(t.w * c.weight), 6) AS weight FROM two t JOIN edges c ON t.dst = c.src GROUP BY t.src, c.dst")
register("j21_full_outer_fusion", "SELECT coalesce(v.id, g.id) AS id, round(0.6 * coalesce(v.s, 0) + 0.4 * coalesce(g.s, 0), 6) AS score FROM (SELECT id, emotion_valence AS s FROM affinity_history WHERE trigger_event = 'conversation') v FULL OUTER JOIN (SELECT id, new_score / 100 AS s FROM affinity_history WHERE new_score > 50) g ON v.id = g.id")
register("j22_endpoint_semi", "SELECT src, dst FROM edges WHERE src IN (SELECT concat('s', s_suppkey) FROM supplier) AND dst IN (SELECT concat('n', n_nationkey) FROM nation)")
# in Spark the band is cut into cells of its width, so the join is on equal cells
register("j24_band", lambda d: "SELECT b.item_id, d.doc_id FROM (SELECT item_id, lo, hi, explode(sequence(floor(lo / 5), floor(hi / 5))) AS cell FROM (SELECT item_id, item_id * 10 - 2 AS lo, item_id * 10 + 2 AS hi FROM benchmark) w) b JOIN documents d ON floor(d.doc_id / 5) = b.cell AND d.doc_id BETWEEN b.lo AND b.hi" if d.spark
         else "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON d.doc_id BETWEEN b.item_id * 10 - 2 AND b.item_id * 10 + 2")
register("j25_date_prefix", "SELECT id FROM affinity_history WHERE CAST(created_at AS DATE) = CAST('2024-01-09' AS DATE)")
register("j26_window_context", "SELECT DISTINCT c.session_id, c.turn FROM conversation_turns e JOIN conversation_turns c ON c.session_id = e.session_id AND c.turn BETWEEN e.turn - 1 AND e.turn + 1 WHERE length(e.content) > 60")
register("j28_rule_user", "SELECT u.user_id, r.action FROM latest_affinity u CROSS JOIN (SELECT 'greet' AS action, 20 AS least_score UNION ALL SELECT 'share', 50 UNION ALL SELECT 'care', 80) r WHERE u.new_score >= r.least_score")
register("j29_dangling", "SELECT e.src, e.dst FROM edges e WHERE e.src IN (SELECT concat('c', c_custkey) FROM customer) AND e.dst IN (SELECT concat('n', n_nationkey) FROM nation)")

# ---- aggregates ----------------------------------------------------------------------------------
register("a1_latest", "SELECT user_id, new_score FROM latest_affinity")
register("a2_days_known", lambda d: f"SELECT user_id, {d.days(d.ts(), 'min(created_at)')} AS days_known FROM affinity_history GROUP BY user_id")
register("a3_count_filtered", "SELECT count(*) AS n FROM affinity_history WHERE emotion_valence < 0")
register("a4_active_days", "SELECT user_id, count(DISTINCT CAST(created_at AS DATE)) AS days FROM affinity_history GROUP BY user_id")
register("a5_response_rate", "SELECT user_id, round(coalesce(CAST(sum(CASE WHEN user_reaction = 'liked' THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0), 0.5), 6) AS rate FROM meme_usage_history GROUP BY user_id")
register("a6_pivot_counts", "SELECT user_id, count(CASE WHEN status = 'pending' THEN 1 END) AS pending, count(CASE WHEN status = 'done' THEN 1 END) AS done, count(CASE WHEN status = 'dlq' THEN 1 END) AS dlq FROM outbox_events GROUP BY user_id")
register("a7_status_counts", "SELECT status, count(*) AS n FROM outbox_events GROUP BY status")
register("a8_best_hour", "SELECT hour(created_at) AS hour, count(*) AS n FROM affinity_history GROUP BY hour(created_at) ORDER BY n DESC, hour LIMIT 1")
register("a9_silent_users", lambda d: f"SELECT user_id, max(created_at) AS last_at FROM affinity_history GROUP BY user_id HAVING max(created_at) < {d.ts()} - INTERVAL '36' HOUR")
register("a10_two_keys", "SELECT user_id, trigger_event, count(*) AS n, max(created_at) AS last_at FROM affinity_history GROUP BY user_id, trigger_event")
register("a11_message_style", "SELECT role, round(avg(length(content)), 6) AS mean_length, count(*) AS n, CASE WHEN avg(length(content)) < 20 THEN 'brief' WHEN avg(length(content)) < 50 THEN 'medium' ELSE 'long' END AS style FROM conversation_turns GROUP BY role")
register("a12_collect_distinct", lambda d: "SELECT user_id, array_join(array_sort(collect_set(trigger_event)), ',') AS events FROM affinity_history GROUP BY user_id" if d.spark else "SELECT user_id, array_to_string(list_sort(list(DISTINCT trigger_event)), ',') AS events FROM affinity_history GROUP BY user_id")
register("a16_graph_stats", "SELECT rel_type, count(*) AS n, round(avg(weight), 6) AS mean_weight FROM edges GROUP BY rel_type")
register("a17_acceptance", "SELECT round(coalesce(avg(CASE WHEN user_reaction = 'liked' THEN 1.0 ELSE 0.0 END), 0), 6) AS rate FROM meme_usage_history WHERE user_reaction IS NOT NULL".replace("1.0 ELSE 0.0", "CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE)"))
register("a18_reaction_stats", "SELECT user_id, count(*) AS total, count(CASE WHEN user_reaction = 'liked' THEN 1 END) AS liked, round(CAST(100 AS DOUBLE) * count(CASE WHEN user_reaction = 'liked' THEN 1 END) / count(*), 2) AS liked_pct FROM meme_usage_history WHERE user_reaction IS NOT NULL GROUP BY user_id")
register("a19_pool_statistics", "SELECT count(*) AS total, count(CASE WHEN status = 'approved' THEN 1 END) AS approved, count(CASE WHEN status = 'candidate' THEN 1 END) AS candidates, count(CASE WHEN popularity_score >= 85 THEN 1 END) AS peak, round(avg(popularity_score), 6) AS mean_score FROM memes")
register("a21_lag_p95", "SELECT lag_ms AS p95 FROM (SELECT lag_ms, row_number() OVER (ORDER BY lag_ms, event_id) AS rn, count(*) OVER () AS n FROM lags) z WHERE rn = least(CAST(floor(CAST(0.95 AS DOUBLE) * n) AS BIGINT) + 1, n)")
register("a25_accuracy_sets", "SELECT task_type, category, count(*) AS n, round(avg(CASE WHEN correct THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS accuracy, round(avg(CASE WHEN exact_match THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS exact FROM scored_items GROUP BY GROUPING SETS ((task_type), (category), ())")
register("a27_extreme_category", lambda d: ("SELECT {0}(category, acc) AS worst, {1}(category, acc) AS best FROM (SELECT category, avg(CASE WHEN correct THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) + CAST(category AS DOUBLE) / 1000000 AS acc FROM scored_items GROUP BY category) z").format("min_by", "max_by"))
register("a29_prefix_stats", lambda d: "SELECT split_part(url, '/', 3) AS host, count(*) AS n FROM pages GROUP BY split_part(url, '/', 3)")
register("a33_active_users", lambda d: f"SELECT DISTINCT user_id FROM affinity_history WHERE created_at > {d.ts()} - INTERVAL '5' DAY")
register("a36_source_counts", "SELECT source, count(*) AS n FROM content_library WHERE is_active GROUP BY source")

# ---- windows, order, sets ------------------------------------------------------------------------
register("w1_primary_entity", lambda d: "SELECT memory_id, entity_id FROM (SELECT memory_id, entity_id, row_number() OVER (PARTITION BY memory_id ORDER BY coalesce(confidence, CAST(0.8 AS DOUBLE)) DESC, created_at DESC, entity_id, seq) AS rn FROM memory_entities) z WHERE rn = 1")
register("w3_eviction", lambda d: f"SELECT id, user_id FROM (SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY valence * {d.days(d.ts(), 'created_at')}, id) AS rn FROM memories) z WHERE rn > 20")
register("w4_previous", "SELECT id, round(coalesce(lag(new_score) OVER (PARTITION BY user_id ORDER BY created_at, id), CAST(50 AS DOUBLE)), 6) AS old_score, round(new_score - coalesce(lag(new_score) OVER (PARTITION BY user_id ORDER BY created_at, id), CAST(50 AS DOUBLE)), 6) AS delta FROM affinity_history")
register("w7_last_turns", "SELECT session_id, turn FROM (SELECT session_id, turn, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM conversation_turns) z WHERE rn <= 3")
register("w8_neighbours", "SELECT session_id, turn, max(CASE WHEN length(content) > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near_evidence FROM conversation_turns")
register("w10_position", "SELECT session_id, turn, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS pos FROM conversation_turns")
register("k1_topk", "SELECT id, popularity_score FROM memes ORDER BY popularity_score DESC, id LIMIT 20")
register("k2_mixed_order", "SELECT id, quality_score FROM content_library ORDER BY quality_score DESC, published_at DESC, id LIMIT 25")
register("k5_per_group_topk", "SELECT user_id, id, rn FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY valence DESC, id) AS rn FROM memories) z WHERE rn <= 3")
register("k6_weakest_edges", "SELECT src, dst, round(current_weight, 6) AS current_weight FROM decayed_edges WHERE current_weight > 0.1 ORDER BY current_weight, src, dst LIMIT 20")
register("k7_fifo", "SELECT event_id FROM outbox_events WHERE status = 'pending' ORDER BY created_at, event_id LIMIT 100")
register("u2_first_wins", "SELECT src, dst, rel_type FROM (SELECT src, dst, rel_type, row_number() OVER (PARTITION BY dst, rel_type ORDER BY src) AS rn FROM edges) z WHERE rn = 1")
register("u3_md5_dedup", "SELECT min(id) AS id, md5(concat(title, '|', content_url)) AS h, count(*) AS n FROM content_library GROUP BY md5(concat(title, '|', content_url))")
register("u4_sha_dedup", lambda d: f"SELECT min(page_id) AS page_id, {d.sha256(chr(39).join(['concat(lower(trim(html)), ', '|', ', lower(split_part(url, ', '?', ', 1)))']))} AS h FROM pages GROUP BY 2")
register("u5_insert_absent", "SELECT id FROM content_library c WHERE NOT EXISTS (SELECT 1 FROM content_library o WHERE o.content_url = c.content_url AND o.id < c.id)")
register("u7_union", "SELECT src AS id FROM edges UNION SELECT dst FROM edges")
register("u8_difference", "SELECT doc_id AS id FROM documents EXCEPT SELECT doc_id FROM labels")

# ---- scalar functions ----------------------------------------------------------------------------
register("f3_char_counts", lambda d: f"SELECT id, {d.count('content', '[!?.]')} AS marks FROM memories")
register("f4_html_clean", lambda d: f"SELECT page_id, md5(trim({d.sub(d.sub('html', '<[^>]+>', ''), '[ ]+', ' ')})) AS h FROM pages")
register("f6_summary", "SELECT id, CASE WHEN length(content) <= 200 THEN content ELSE concat(left(content, 200), '...') END AS summary FROM memories")
register("f7_url_normalise", "SELECT page_id, lower(trim(split_part(split_part(url, '?', 1), '#', 1))) AS url FROM pages")
register("f8_hashes", lambda d: f"SELECT id, left(md5(title), 16) AS short, {d.sha256('title')} AS long FROM content_library")
register("f16_normalise", lambda d: f"SELECT item_id, trim({d.sub(d.sub('lower(text)', '[^a-z0-9]', ' '), ' +', ' ')}) AS norm FROM benchmark")
register("f25_question", lambda d: f"SELECT session_id, turn, CASE WHEN {d.like('content', '[?]')} THEN 1 ELSE 0 END AS asks FROM conversation_turns")
register("f28_slug", "SELECT p_partkey, concat(p_name, '_', left(md5(p_name), 8)) AS slug FROM part")
register("f33_reason", "SELECT id, CASE WHEN correct THEN 'ok' WHEN task_type = 'adversarial' THEN 'adversarial' WHEN category IN (1, 2) THEN 'recall' ELSE 'other' END AS reason FROM scored_items")
register("f36_row_line", "SELECT s_suppkey, concat_ws(' | ', s_name, CAST(s_nationkey AS VARCHAR(10))) AS line FROM supplier")
register("d1_elapsed_days", lambda d: f"SELECT id, {d.days(d.ts(), 'created_at')} AS days FROM affinity_history")
register("d3_fractional", lambda d: f"SELECT id, round({d.seconds(d.ts(), 'first_seen_at')} / 3600, 6) AS hours FROM memes")
register("d4_extract", "SELECT id, hour(created_at) AS h, day(created_at) AS d, month(created_at) AS m FROM affinity_history")
register("d6_late_night", "SELECT user_id, count(*) AS n, count(CASE WHEN hour(created_at) >= 22 OR hour(created_at) < 5 THEN 1 END) AS late FROM affinity_history GROUP BY user_id")
register("m1_decay", "SELECT src, dst, rel_type, round(current_weight, 6) AS current_weight FROM decayed_edges")
register("m2_recency", lambda d: f"SELECT id, round(exp(-CAST({d.days(d.ts(), 'created_at')} AS DOUBLE) / 30), 6) AS recency FROM memories")
register("m3_trend", lambda d: f"SELECT id, round(greatest(0, least(100, popularity_score * CASE WHEN {d.seconds(d.ts(), 'first_seen_at')} < 86400 THEN CAST(1.2 AS DOUBLE) ELSE exp(-0.1 * {d.seconds(d.ts(), 'first_seen_at')} / 86400) END)), 6) AS trend FROM memes")
register("m9_cosine", lambda d: f"SELECT a.vec_id AS a, b.vec_id AS b, round({d.cosine('a.embedding', 'b.embedding')}, 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
register("m12_normalise", "SELECT id, round(CASE WHEN new_score < 0 THEN (greatest(new_score, -1) + 1) / 2 WHEN new_score <= 1 THEN new_score ELSE least(new_score, 100) / 100 END, 6) AS score FROM affinity_history")
register("m13_loneliness", "SELECT user_id, round(greatest(0, least(100, 0.3 * count(CASE WHEN hour(created_at) >= 22 OR hour(created_at) < 5 THEN 1 END) + 0.4 * count(CASE WHEN emotion_valence < -0.3 THEN 1 END) + 0.5 * count(CASE WHEN trigger_event = 'silence_decay' THEN 1 END) - 0.3 * count(CASE WHEN trigger_event = 'gratitude' THEN 1 END))), 6) AS loneliness FROM affinity_history GROUP BY user_id".replace("0.3 * count", "CAST(0.3 AS DOUBLE) * count").replace("0.4 * count", "CAST(0.4 AS DOUBLE) * count").replace("0.5 * count", "CAST(0.5 AS DOUBLE) * count"))
register("m14_overdependence", "SELECT user_id, CASE WHEN days >= 14 THEN 1 ELSE 0 END + CASE WHEN late > 0.6 THEN 1 ELSE 0 END + CASE WHEN social < 0.2 THEN 1 ELSE 0 END AS triggers, CASE WHEN CASE WHEN days >= 14 THEN 1 ELSE 0 END + CASE WHEN late > 0.6 THEN 1 ELSE 0 END + CASE WHEN social < 0.2 THEN 1 ELSE 0 END >= 2 THEN 1 ELSE 0 END AS dependent FROM (SELECT user_id, count(DISTINCT CAST(created_at AS DATE)) AS days, CAST(count(CASE WHEN hour(created_at) >= 22 OR hour(created_at) < 5 THEN 1 END) AS DOUBLE) / count(*) AS late, CAST(count(CASE WHEN trigger_event = 'gratitude' THEN 1 END) AS DOUBLE) / count(*) AS social FROM affinity_history GROUP BY user_id) z")
register("m17_importance", "SELECT session_id, round(least(1, 0.5 + CASE WHEN n >= 10 THEN 0.2 WHEN n >= 5 THEN 0.1 ELSE 0 END + CASE WHEN roles >= 5 THEN 0.15 WHEN roles >= 2 THEN 0.1 ELSE 0 END), 6) AS importance FROM (SELECT session_id, count(*) AS n, count(DISTINCT role) AS roles FROM conversation_turns GROUP BY session_id) z".replace("least(1, 0.5 + ", "least(CAST(1 AS DOUBLE), CAST(0.5 AS DOUBLE) + "))

# ---- graph, state changes, audits ----------------------------------------------------------------
register("g1_merge_node", "SELECT entity_id, count(*) AS mention_count, min(memory_id) AS first_memory, max(created_at) AS last_at FROM memory_entities GROUP BY entity_id")
register("g3_merge_edge_max", "SELECT src, dst, rel_type, max(weight) AS weight FROM (SELECT src, dst, rel_type, weight FROM edges UNION ALL SELECT src, dst, rel_type, CAST(0.6 AS DOUBLE) FROM edges WHERE rel_type = 'FROM') z GROUP BY src, dst, rel_type")
register("g6_drop_decayed", "SELECT count(CASE WHEN current_weight < 0.05 THEN 1 END) AS dropped, count(CASE WHEN current_weight >= 0.05 THEN 1 END) AS kept FROM decayed_edges")
register("g7_detach_delete", "SELECT e.src, e.dst FROM edges e WHERE e.src NOT IN (SELECT concat('s', s_suppkey) FROM supplier WHERE s_suppkey % 4 = 0) AND e.dst NOT IN (SELECT concat('s', s_suppkey) FROM supplier WHERE s_suppkey % 4 = 0)")
register("g8_soft_delete", "SELECT id, CASE WHEN user_id = 2 THEN 'deleted' ELSE status END AS status FROM memories")
register("dm1_on_conflict_nothing", "SELECT idempotency_key, min(event_id) AS event_id FROM outbox_events GROUP BY idempotency_key")
register("dm4_guarded_update", "SELECT event_id, CASE WHEN status IN ('pending', 'failed') THEN 'processing' ELSE status END AS status, CASE WHEN status IN ('pending', 'failed') THEN 1 ELSE 0 END AS changed FROM outbox_events")
register("dm5_increment", "SELECT m.id, count(u.id) AS usage_count, max(u.used_at) AS last_used FROM memes m LEFT JOIN meme_usage_history u ON u.meme_id = m.id GROUP BY m.id")
register("dm7_retention", lambda d: f"SELECT count(CASE WHEN published_at < {d.ts()} - INTERVAL '2' DAY THEN 1 END) AS deleted, count(*) AS total FROM content_library")
register("dm11_default_rows", "SELECT u.user_id, coalesce(p.enabled, 0) AS enabled FROM (SELECT DISTINCT user_id FROM affinity_history) u LEFT JOIN (SELECT user_id, max(1) AS enabled FROM meme_usage_history WHERE user_reaction = 'liked' GROUP BY user_id) p ON u.user_id = p.user_id")
register("st3_retry_dlq", "SELECT event_id, CASE WHEN status = 'failed' AND retry_count + 1 >= 5 THEN 'dlq' WHEN status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' THEN CAST(power(2, retry_count) AS BIGINT) ELSE 0 END AS backoff_s FROM outbox_events")
register("st8_daily_cap", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY user_id, CAST(used_at AS DATE) ORDER BY used_at, id) AS rn FROM meme_usage_history) z WHERE rn <= 3")
register("st11_stale_pending", lambda d: f"SELECT count(CASE WHEN created_at < {d.ts()} - INTERVAL '30' SECOND THEN 1 END) AS stale_30s, count(CASE WHEN created_at < {d.ts()} - INTERVAL '1' HOUR THEN 1 END) AS stale_1h FROM outbox_events WHERE status = 'pending'")
# a meme's trend falls by a tenth a day from its first sighting; the day of its last change and its level are stand-ins
register("st18_declining", lambda d: f"SELECT id, CASE WHEN status = 'approved' AND level = 'declining' AND idle >= 30 THEN 'archive' WHEN status = 'approved' AND level <> 'declining' AND score < 30 AND idle >= 7 THEN 'declining' ELSE 'keep' END AS action FROM (SELECT id, status, popularity_score * exp(-0.1 * {d.days(d.ts(), 'first_seen_at')}) AS score, CASE WHEN id % 5 = 0 THEN 'declining' ELSE 'rising' END AS level, id % 60 AS idle FROM memes) z")
register("v1_entity_critic", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN confidence < 0.5 THEN 'low_confidence' WHEN entity_id % 11 = 0 THEN 'bad_type' WHEN row_number() OVER (PARTITION BY memory_id, entity_id, confidence >= 0.5 AND entity_id % 11 <> 0 ORDER BY seq, confidence, created_at) > 1 THEN 'duplicate' ELSE 'kept' END AS reason FROM memory_entities WHERE confidence IS NOT NULL) z GROUP BY reason")
register("v2_relation_critic", "SELECT CASE WHEN src = dst THEN 'self_loop' WHEN weight < 0.5 THEN 'low_confidence' WHEN rel_type NOT IN ('LIVES_IN', 'FROM', 'RELATED_TO') THEN 'bad_type' ELSE 'kept' END AS reason, count(*) AS n FROM edges GROUP BY 1")
register("v5_resolve_by_time", lambda d: f"SELECT a.id AS first_id, b.id AS second_id, CASE WHEN abs({d.days('a.created_at', 'b.created_at')}) < 1 THEN 'clarify' WHEN a.created_at > b.created_at THEN 'first' ELSE 'second' END AS verdict FROM memories a JOIN memories b ON b.id = a.id + 15")
register("c1_graph_as_of", lambda d: f"SELECT count(*) AS edges, round(sum(w), 3) AS weight FROM (SELECT weight * exp(-decay_rate * {d.days(d.ts('2024-01-15 00:00:00'), 'updated_at')}) AS w FROM edges WHERE updated_at <= {d.ts('2024-01-15 00:00:00')}) z WHERE w > 0.1")
register("c4_demo_state", "SELECT id, CASE WHEN emotion_valence < 0 THEN 'distant' WHEN emotion_valence < 0.3 THEN 'acquaintance' WHEN emotion_valence < 0.5 THEN 'friend' WHEN emotion_valence < 0.7 THEN 'close' ELSE 'intimate' END AS state FROM affinity_history")
register("c9_top_memories", lambda d: "SELECT user_id, id, rn FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY valence DESC, id DESC) AS rn FROM memories WHERE status = 'committed') z WHERE rn <= 5")
register("c10_history_lines", lambda d: f"SELECT session_id, {d.joined('line', 'turn', '; ')} AS history FROM (SELECT session_id, turn, concat(CASE WHEN role = 'user' THEN 'U' ELSE 'A' END, ': ', left(content, 100)) AS line, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM conversation_turns) z WHERE rn <= 5 GROUP BY session_id")
register("c15_edge_histogram", "SELECT rel_type, count(*) AS n FROM edges GROUP BY rel_type ORDER BY rel_type")

# ---- composites ----------------------------------------------------------------------------------
register("r9_recommend_score", lambda d: f"SELECT id, round(greatest(0, least(1, (0.5 * 0.5 + 0.3 * exp(-0.05 * {d.seconds(d.ts(), 'published_at')} / 3600) + 0.2 * quality_score) * CASE WHEN id % 30 = 0 THEN CAST(0.3 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END)), 6) AS score FROM content_library WHERE is_active")
