"""Rules of the chat services with their whole bodies, and the reads and writes of their stores (inventory F, J, G, DM, ST, X, IO).

Word lists, weights, patterns and thresholds under "fixed values" must equal the memory engine's.
"""

from __future__ import annotations

import re

from memloom.plans.catalog import register
from memloom.plans.memory_state import ranked
from memloom.plans.text_rules import hits, hmac

# ---- fixed values ---------------------------------------------------------------------------------
POSITIVE = ("开心", "高兴", "喜欢", "爱", "棒", "好", "谢谢", "感谢", "哈哈")
NEGATIVE = ("难过", "伤心", "讨厌", "烦", "累", "不好", "生气", "失望")
WEIGHTS_UP = {
    "开心": 0.8, "高兴": 0.7, "喜欢": 0.6, "爱": 0.9, "棒": 0.6, "好": 0.3, "谢谢": 0.5, "感谢": 0.6, "哈哈": 0.5,
    "嘻嘻": 0.4, "兴奋": 0.8, "期待": 0.6, "幸福": 0.9, "满足": 0.7, "感动": 0.8,
}
WEIGHTS_DOWN = {
    "难过": 0.7, "伤心": 0.8, "讨厌": 0.6, "烦": 0.5, "累": 0.4, "不好": 0.3, "生气": 0.7, "失望": 0.6, "郁闷": 0.6,
    "焦虑": 0.5, "害怕": 0.6, "孤独": 0.7, "绝望": 0.9, "无助": 0.8, "崩溃": 0.9,
}
EMOJI_UP, EMOJI_DOWN = "😊😄😁🎉❤️💕👍🥰😍", "😢😭😔😞💔😠😡"
TRIPLES = (
    (r"(.+?)(住在|住|在)(.+)", 3, "LIVES_IN"),
    (r"(.+?)(来自|来源于|是)(.+?)(人|的)", 4, "FROM"),
    (r"(.+?)(工作在|上班在)(.+)", 3, "WORKS_AT"),
    (r"(.+?)(喜欢|爱|热爱|喜爱)(.+)", 3, "LIKES"),
    (r"(.+?)(不喜欢|讨厌|不爱|厌恶)(.+)", 3, "DISLIKES"),
    (r"(.+?)(是|叫)(.+?)(的)?(妈妈|母亲|爸爸|父亲)", 5, "PARENT_OF"),
    (r"(.+?)(的)?(妈妈|母亲|爸爸|父亲)(是|叫)(.+)", 5, "CHILD_OF"),
    (r"(.+?)(是|叫)(.+?)(的)?(哥哥|弟弟|姐姐|妹妹)", 5, "SIBLING_OF"),
    (r"(.+?)(的)?(哥哥|弟弟|姐姐|妹妹)(是|叫)(.+)", 5, "SIBLING_OF"),
    (r"(.+?)(是|叫)(.+?)(的)?(朋友|好友)", 5, "FRIEND_OF"),
    (r"(.+?)(的)?(朋友|好友)(是|叫)(.+)", 5, "FRIEND_OF"),
    (r"(.+?)(是|叫)(.+?)(的)?(同事)", 5, "COLLEAGUE_OF"),
)
NO_ANSWER = ("unknown", "不确定", "无法确定", "我不确定", "我不知道")
DATE_WORDS = ("year", "month", "date", "when", "时间", "日期", "哪年", "哪天", "什么时候")

#: The four safety checks and the status a match gives. Their blocklists are a parameter of a deployment
#: (some hundred words); these few stand in for them over the test tables.
CHECKS = (("content_safety", "failed", ("kill", "血腥", "色情")), ("cultural_sensitivity", "failed", ("genocide", "jihad")), ("legal_compliance", "uncertain", ("copyright", "license", "盗版")), ("ethical_boundaries", "failed", ("password", "secret")))


def weighted(col: str, words: dict[str, float], emoji: str) -> str:
    """Sum of the weights of the words a text contains, and 0.3 for each of the emoji characters in it."""
    parts = [f"CASE WHEN contains({col}, '{w}') THEN {v}e0 ELSE 0e0 END" for w, v in words.items()]
    return "(" + " + ".join(parts) + f" + 0.3e0 * (length({col}) - length(translate({col}, '{emoji}', ''))))"


def any_of(col: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def verdict(col: str, checks=CHECKS) -> str:
    """rejected if a check fails, flagged if one is uncertain, else approved."""
    by = {s: [any_of(col, words) for _, status, words in checks if status == s] for s in ("failed", "uncertain")}
    return f"CASE WHEN {' OR '.join(by['failed'])} THEN 'rejected' WHEN {' OR '.join(by['uncertain'])} THEN 'flagged' ELSE 'approved' END"


# ---- text rules -----------------------------------------------------------------------------------
register("f1_lexicon_count", f"""SELECT session_id, turn, p AS positive, n AS negative, round(CASE WHEN p > n THEN least(0.8e0, 0.3e0 + p * 0.1e0) WHEN n > p THEN greatest(-0.8e0, -0.3e0 - n * 0.1e0) ELSE 0e0 END, 6) AS valence,
 CASE WHEN p > n THEN 'happy' WHEN n > p THEN 'sad' ELSE 'neutral' END AS emotion
 FROM (SELECT session_id, turn, {hits('lower(content)', POSITIVE)} AS p, {hits('lower(content)', NEGATIVE)} AS n FROM conversation_turns) z""")
register("f2_lexicon_valence", f"""SELECT session_id, turn, round(CASE WHEN p > n THEN least(1e0, p / 3) WHEN n > p THEN greatest(-1e0, -n / 3) ELSE 0e0 END, 6) AS valence, round(least(1e0, (p + n) / 2), 6) AS confidence
 FROM (SELECT session_id, turn, {weighted('content', WEIGHTS_UP, EMOJI_UP)} AS p, {weighted('content', WEIGHTS_DOWN, EMOJI_DOWN)} AS n FROM conversation_turns) z""")
register("f11_safety_verdict", f"SELECT id, {verdict('lower(content)')} AS verdict FROM memories")


def supported(d, answer: str, evidence: str, question: str) -> str:
    """The answer, or Unknown where the evidence does not hold it."""
    flat = lambda x: f"trim({d.sub(f'lower({x})', chr(92) + 's+', ' ')})"
    if d.spark:
        digits = rf"exists(regexp_extract_all({answer}, r'\d{{2,4}}', 0), x -> NOT contains({evidence}, x))"
    else:
        digits = rf"len(list_filter(regexp_extract_all({answer}, '\d{{2,4}}'), lambda x: NOT contains({evidence}, x))) > 0"
    return f"""CASE WHEN trim({answer}) = '' OR {any_of(f'lower({answer})', NO_ANSWER)} OR trim({evidence}) = '' THEN trim({answer})
 WHEN {any_of(f'lower({question})', DATE_WORDS)} AND {digits} THEN 'Unknown'
 WHEN length({flat(answer)}) >= 4 AND NOT contains({flat(evidence)}, {flat(answer)}) THEN 'Unknown' ELSE trim({answer}) END"""


register("f22_support_check", lambda d: f"""SELECT session_id, turn, {supported(d, 'a', 'e', 'q')} AS answer FROM (SELECT session_id, turn, coalesce(content, '') AS a,
 coalesce(lead(content) OVER (PARTITION BY session_id ORDER BY turn), '') AS e, coalesce(lag(content) OVER (PARTITION BY session_id ORDER BY turn), '') AS q FROM conversation_turns) z""")


def needed(col: str, pattern: str) -> str:
    """A text can only match if it has a word of each group of the pattern; without them the search would backtrack."""
    groups = re.findall(r"\(([^.()]+)\)(?!\?)", pattern)
    return " AND ".join(any_of(col, tuple(g.split("|"))) for g in groups)


def triples(d, source: str, key: str, col: str) -> str:
    """One row for each relation pattern that a text matches: first and last group, where neither is empty."""
    same_dot = "(?d)" if d.spark else ""  # a dot stops at line feeds alone
    if d.spark:
        grab = lambda pat, g: f"CASE WHEN {needed(col, pat)} THEN trim({d.grab(col, same_dot + pat, g)}) ELSE '' END"
        each = ", ".join(f"named_struct('rule', {n}, 'subject', {grab(pat, 1)}, 'rel', '{rel}', 'object', {grab(pat, last)})" for n, (pat, last, rel) in enumerate(TRIPLES, 1))
        return f"SELECT {key}, t.* FROM (SELECT {key}, explode(array({each})) AS t FROM {source}) z WHERE t.subject <> '' AND t.object <> ''"
    each = [f"SELECT {key}, {n} AS rule, trim({d.grab(col, same_dot + pat, 1)}) AS subject, '{rel}' AS rel, trim({d.grab(col, same_dot + pat, last)}) AS object FROM {source} WHERE {d.like(col, same_dot + pat)}" for n, (pat, last, rel) in enumerate(TRIPLES, 1)]
    return f"SELECT * FROM ({' UNION ALL '.join(each)}) z WHERE subject <> '' AND object <> ''"


#: The turns, and one made sentence for each nation, as the test tables hold no Chinese.
_SAID = "(SELECT session_id * 10 + turn AS id, content FROM conversation_turns UNION ALL SELECT -n_nationkey - 1, concat(n_name, CASE n_regionkey WHEN 0 THEN '住在' WHEN 1 THEN '不喜欢' WHEN 2 THEN '的妈妈叫' WHEN 3 THEN '是我的朋友' ELSE '来自中国的' END, 'x') FROM nation)"

# ---- joins, graph, deletion, state ----------------------------------------------------------------
_USERS = "(SELECT user_id AS id, min(created_at) AS created_at FROM affinity_history GROUP BY user_id)"
register("j10_join_group", f"SELECT m.user_id, u.created_at AS user_created, count(*) AS n, max(m.created_at) AS last_at FROM memories m JOIN {_USERS} u ON m.user_id = u.id GROUP BY m.user_id, u.created_at")
register("g5_weak_important", "SELECT src, dst, rel_type, round(current_weight, 6) AS w, row_number() OVER (PARTITION BY src ORDER BY current_weight, dst, rel_type) AS weakest FROM decayed_edges WHERE current_weight > 0.1 AND current_weight < 0.3")
register("dm10_verify_deletion", lambda d: f"SELECT m.id, CASE WHEN e.vec_id IS NULL AND o.memory_id IS NULL THEN 'clean' ELSE 'left over' END AS verdict, {hmac(d, 'concat(CAST(m.id AS VARCHAR(20)), chr(58), m.status)')} AS audit_hash FROM memories m LEFT JOIN embeddings e ON e.vec_id = m.id LEFT JOIN (SELECT DISTINCT memory_id FROM memory_entities) o ON o.memory_id = m.id WHERE m.status = 'deleted'")
register("st19_consistency", """WITH m AS (SELECT id FROM memories WHERE status = 'committed'),
 no_graph AS (SELECT count(*) AS n FROM m WHERE NOT EXISTS (SELECT 1 FROM memory_entities e WHERE e.memory_id = m.id)),
 no_vector AS (SELECT count(*) AS n FROM m WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = m.id)),
 orphans AS (SELECT count(*) AS n FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.vec_id)),
 total AS (SELECT count(*) AS n FROM m)
 SELECT t.n AS checked, g.n AS missing_graph, v.n AS missing_vector, o.n AS orphan_vectors, round(CAST(g.n + v.n AS DOUBLE) / greatest(2 * t.n, 1), 6) AS mismatch_rate,
 CASE WHEN CAST(g.n + v.n AS DOUBLE) / greatest(2 * t.n, 1) <= 0.01 THEN 'pass' ELSE 'breach' END AS verdict FROM total t CROSS JOIN no_graph g CROSS JOIN no_vector v CROSS JOIN orphans o""")
register("st10_hourly_slo", lambda d: f"""WITH lag_rows AS (SELECT date_trunc('hour', processed_at) AS hour, {d.seconds('processed_at', 'created_at')} * 1000 AS lag_ms FROM outbox_events WHERE status = 'done' AND processed_at IS NOT NULL),
 each_value AS (SELECT hour, lag_ms, count(*) AS n FROM lag_rows GROUP BY hour, lag_ms),
 run AS (SELECT hour, lag_ms, sum(n) OVER (PARTITION BY hour ORDER BY lag_ms) AS upto, sum(n) OVER (PARTITION BY hour) AS total FROM each_value),
 pct AS (SELECT hour, CAST(max(total) AS BIGINT) AS n, min(CASE WHEN upto > floor(total / 2) THEN lag_ms END) AS p50, min(CASE WHEN upto >= least(floor(total * 0.95e0) + 1, total) THEN lag_ms END) AS p95 FROM run GROUP BY hour)
 SELECT hour, n, p50, p95, CASE WHEN p50 < 2000 AND p95 < 30000 THEN 'pass' ELSE 'breach' END AS verdict FROM pct""")
register("st14_greeting_enabled", lambda d: f"SELECT DISTINCT h.user_id FROM affinity_history h JOIN latest_affinity l ON l.user_id = h.user_id WHERE h.created_at > {d.ts()} - INTERVAL '30' DAY AND l.new_score > 20")
_PREFERRED = "(SELECT id, first_id, second_id, CASE WHEN id % 2 = 0 THEN first_id ELSE second_id END AS preferred FROM conflicts WHERE status = 'pending')"
register("x2_resolve_conflict", f"""SELECT 'conflict' AS kind, id, 'resolved' AS status, preferred AS preferred_id, 'time' AS method FROM {_PREFERRED} a
 UNION ALL SELECT 'memory', CASE WHEN preferred = first_id THEN second_id ELSE first_id END, 'deprecated', -1, '' FROM {_PREFERRED} b""")
register("x1_evict_context", lambda d: f"SELECT user_id, count(*) AS evicted FROM ({ranked('SELECT user_id, id, valence, created_at FROM memories', 'user_id, id, rn', 'user_id', 'valence DESC, created_at DESC, id', 1 << 40)}) z WHERE rn > 20 GROUP BY user_id")
register("x3_cleanup_cache", lambda d: f"SELECT count(*) AS removed FROM content_library WHERE published_at < {d.ts()} - INTERVAL '1' DAY")

# ---- store reads and writes -----------------------------------------------------------------------
register("io5_id_list", "SELECT e.memory_id, e.entity_id FROM memory_entities e WHERE e.memory_id IN (SELECT id FROM memories WHERE status = 'pending')")
register("io11_vector_metadata", "SELECT vec_id AS memory_id, label FROM embeddings WHERE label IN (1, 3, 5)")
register("io17_session_recency", ranked("SELECT user_id, entity_id, max(created_at) AS seen FROM memory_entities GROUP BY user_id, entity_id", "user_id, entity_id, rn", "user_id", "seen DESC, entity_id", 10))
register("io12_vector_rows", lambda d: f"SELECT m.id AS memory_id, m.user_id, left(m.content, 4096) AS content, m.valence, {'size(v)' if d.spark else 'len(v)'} AS dims, round(CAST(v[{0 if d.spark else 1}] AS DOUBLE), 5) AS first, CAST(v[{1023 if d.spark else 1024}] AS DOUBLE) AS last FROM (SELECT id, user_id, content, valence, "
         + ("slice(concat(embedding, array_repeat(CAST(0 AS FLOAT), 1024)), 1, 1024)" if d.spark else "list_resize(CAST(embedding AS FLOAT[]), 1024, CAST(0 AS FLOAT))") + " AS v FROM memories WHERE embedding IS NOT NULL) m")
register("io31_batch_embed", lambda d: "SELECT doc_id, cached, " + ("size(v)" if d.spark else "len(v)") + f" AS dims, round(CAST(v[{0 if d.spark else 1}] AS DOUBLE), 5) AS first FROM (SELECT t.doc_id, c.vec_id IS NOT NULL AS cached, coalesce("
         + ("c.embedding, array_repeat(CAST(0 AS FLOAT), 1024)" if d.spark else "CAST(c.embedding AS FLOAT[]), list_resize(CAST([] AS FLOAT[]), 1024, CAST(0 AS FLOAT))") + ") AS v FROM documents t LEFT JOIN embeddings c ON c.vec_id = t.doc_id) z")
