"""Scalar rules over texts, dates, arrays and JSON (inventory F, D, AR, JS). Word lists are fixed values."""

from __future__ import annotations

from memloom.plans.catalog import register

POSITIVE = ("happy", "good", "great", "love", "thanks", "开心", "喜欢")
NEGATIVE = ("sad", "bad", "hate", "angry", "tired", "难过", "讨厌")


def hits(col: str, words: tuple[str, ...]) -> str:
    """How many of the words a text contains."""
    return "(" + " + ".join(f"CASE WHEN contains({col}, '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


def hmac(d, text: str, key: bytes = b"audit") -> str:
    """HMAC-SHA256 in lower-case hex, from two plain hashes over the padded key."""
    pads = [bytes(b ^ x for b in key.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]
    if d.spark:
        return f"sha2(concat(X'{pads[1]}', unhex(sha2(concat(X'{pads[0]}', encode({text}, 'UTF-8')), 256))), 256)"
    return f"sha256(unhex('{pads[1]}') || unhex(sha256(unhex('{pads[0]}') || encode({text}))))"


_POS, _NEG = hits("lower(content)", POSITIVE), hits("lower(content)", NEGATIVE)
register("f5_strip_truncate", lambda d: f"SELECT page_id, md5(left({d.sub('html', '<[^>]*>', '')}, 500)) AS h FROM pages")
register("f9_audit_hmac", lambda d: f"SELECT event_id, {hmac(d, 'concat(CAST(event_id AS VARCHAR(20)), chr(58), status)')} AS audit_hash FROM outbox_events")
register("f10_keyword_matches", lambda d: "SELECT id, array_join(array_sort(array_distinct(regexp_extract_all(lower(content), r'(license|copyright|password|secret)', 1))), ',') AS found FROM memories" if d.spark else "SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(content), '(license|copyright|password|secret)', 1))), ',') AS found FROM memories")
register("f12_meme_type", lambda d: f"SELECT id, CASE WHEN {d.like('lower(text_description)', '(red|pink)')} THEN 'humor' WHEN {d.like('lower(text_description)', '(blue|green)')} THEN 'emotion' ELSE 'phrase' END AS kind FROM memes")
_KIND = lambda d: f"CASE WHEN length(trim(content)) > 20 THEN 'none' WHEN {d.like('lower(trim(content))', '^(hi|hello|你好[啊呀吗]?|早上好|晚上好)[!！]?$')} THEN 'greeting' WHEN {d.like('lower(trim(content))', '^(ok|thanks|好的|谢谢你?|明白了)[!！]?$')} THEN 'acknowledgment' WHEN {d.like('lower(trim(content))', '^(bye|再见|拜拜|回头见)[!！]?$')} THEN 'farewell' ELSE 'none' END"
register("f14_greeting_type", lambda d: f"SELECT session_id, turn, {_KIND(d)} AS kind FROM conversation_turns")
_STATE = "CASE WHEN session_id % 100 <= 20 THEN 'stranger' WHEN session_id % 100 <= 50 THEN 'acquaintance' WHEN session_id % 100 <= 80 THEN 'friend' ELSE 'close_friend' END"
register("f15_tier_route", lambda d: f"""SELECT session_id, turn, CASE WHEN kind <> 'none' AND len < 20 THEN 3
 WHEN state IN ('stranger', 'acquaintance') AND valence > 0.6 THEN 1 WHEN state IN ('stranger', 'acquaintance') AND len < 30 THEN 3 WHEN state IN ('stranger', 'acquaintance') THEN 2
 WHEN valence > 0.6 THEN 1 WHEN state = 'close_friend' AND len > 50 THEN 1 WHEN state = 'friend' OR len > 30 THEN 2 ELSE 3 END AS tier
 FROM (SELECT session_id, turn, length(trim(content)) AS len, {_KIND(d)} AS kind, CAST(turn AS DOUBLE) / 8 AS valence, {_STATE} AS state FROM conversation_turns) z""")
_MONTH = "(January|February|March|April|May|June|July|August|September|October|November|December)"
register("f19_date_phrase", lambda d: f"SELECT id, {d.grab('phrase', '([0-9]{1,2} ' + _MONTH + ' [0-9]{4})', 1)} AS day FROM (SELECT id, concat('On ', CAST(1 + id % 28 AS VARCHAR(2)), ' ', CASE id % 3 WHEN 0 THEN 'May' WHEN 1 THEN 'June' ELSE 'Nomonth' END, ' 2023, what happened?') AS phrase FROM memories) z")
register("f20_relative_date", "SELECT session_id, turn, CASE WHEN turn % 4 = 0 THEN CAST(CAST(created_at - INTERVAL '1' DAY AS DATE) AS VARCHAR(10)) WHEN turn % 4 = 1 THEN CAST(CAST(created_at + INTERVAL '1' DAY AS DATE) AS VARCHAR(10)) WHEN turn % 4 = 2 THEN CAST(year(created_at) - 1 AS VARCHAR(10)) ELSE content END AS answer FROM conversation_turns")
register("f21_question_split", lambda d: f"SELECT session_id, turn, trim({d.grab('message', '^.*Question: (.*)$', 1)}) AS question FROM (SELECT session_id, turn, concat('Evidence: Question: no. Question: ', {d.sub('content', '[^a-zA-Z0-9 ]', ' ')}) AS message FROM conversation_turns) z")
register("f26_complex", lambda d: f"SELECT session_id, turn, CASE WHEN length(content) > 50 OR {d.count('content', '[，。,.]')} > 2 OR {d.like('content', '(而且|但是|不过|然而|虽然|尽管|不是|并且)')} THEN 1 ELSE 0 END AS complex FROM conversation_turns")
register("f29_pronoun_type", "SELECT session_id, turn, CASE WHEN contains(content, '那个人') OR contains(content, '他') OR contains(lower(content), ' he ') THEN 'person' WHEN contains(content, '那个地方') OR contains(lower(content), ' there ') THEN 'place' WHEN contains(content, '那件事') OR contains(lower(content), ' that ') THEN 'event' WHEN contains(content, '它') OR contains(lower(content), ' it ') THEN 'thing' END AS expected FROM conversation_turns")
register("f30_lookback_days", "SELECT session_id, turn, CASE WHEN contains(content, '昨天') OR contains(lower(content), 'yesterday') THEN 1 WHEN contains(content, '前天') THEN 2 WHEN contains(content, '上周') OR contains(lower(content), 'last week') THEN 7 WHEN contains(content, '上个月') THEN 30 WHEN contains(content, '去年') OR contains(lower(content), 'last year') THEN 365 ELSE 30 END AS days FROM conversation_turns")
register("f31_user_choice", lambda d: f"SELECT session_id, turn, CASE WHEN {d.like('lower(content)', '(第一|a|1|前者)')} THEN 'first' WHEN {d.like('lower(content)', '(第二|b|2|后者)')} THEN 'second' END AS choice FROM conversation_turns")
register("f32_relation_label", "SELECT src, dst, CASE rel_type WHEN 'LIVES_IN' THEN 'lives in' WHEN 'FROM' THEN 'comes from' ELSE rel_type END AS label FROM edges")
# `a -[r]-> m -[r2]-> b` with its marks put together from plain parts
register("f34_path_text", "SELECT concat_ws(' ', a.src, concat('-', chr(91), a.rel_type, chr(93), '-', chr(62)), a.dst, concat('-', chr(91), b.rel_type, chr(93), '-', chr(62)), b.dst) AS path FROM edges a JOIN edges b ON a.dst = b.src")
register("f35_left_truncate", "SELECT id, md5(left(content, 4096)) AS stored, left(content, 20) AS label FROM memories")

register("d2_duration_days", lambda d: f"SELECT src, dst, {d.days(d.ts(), 'updated_at')} AS days FROM edges")
register("d5_date", "SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM affinity_history GROUP BY CAST(created_at AS DATE)")
register("d7_epoch", lambda d: f"SELECT event_id, CAST(floor({d.seconds('created_at', d.ts('1970-01-01 00:00:00'))}) AS BIGINT) AS epoch_s FROM outbox_events")
register("d9_intervals", lambda d: f"SELECT event_id, CASE WHEN created_at + INTERVAL '72' HOUR < {d.ts()} THEN 1 ELSE 0 END AS past_sla, CASE WHEN created_at > {d.ts()} - INTERVAL '24' HOUR THEN 1 ELSE 0 END AS last_day FROM outbox_events")
register("d10_stale", lambda d: f"SELECT src, dst FROM edges WHERE {d.days(d.ts(), 'updated_at')} > 30")

register("ar1_slices", lambda d: "SELECT vec_id, round(CAST(element_at(embedding, 1) AS DOUBLE), 5) AS head, size(slice(embedding, 1, 3)) AS n, array_contains(array(1, 2, 3), CAST(label AS INT)) AS known FROM embeddings" if d.spark else "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 5) AS head, len(embedding[1:3]) AS n, list_contains([1, 2, 3], CAST(label AS INT)) AS known FROM embeddings")
register("ar2_append", lambda d: "SELECT conv_id, array_join(array_append(array_sort(collect_set(role)), 'new'), ',') AS roles FROM conversations GROUP BY conv_id" if d.spark else "SELECT conv_id, array_to_string(list_append(list_sort(list(DISTINCT role)), 'new'), ',') AS roles FROM conversations GROUP BY conv_id")
register("ar3_pad", lambda d: "SELECT vec_id, size(v) AS n, round(CAST(v[1] AS DOUBLE), 5) AS second, CAST(v[1023] AS DOUBLE) AS last FROM (SELECT vec_id, slice(concat(embedding, array_repeat(CAST(0 AS FLOAT), 1024)), 1, 1024) AS v FROM embeddings) z" if d.spark else "SELECT vec_id, len(v) AS n, round(CAST(v[2] AS DOUBLE), 5) AS second, CAST(v[1024] AS DOUBLE) AS last FROM (SELECT vec_id, list_resize(CAST(embedding AS FLOAT[]), 1024, CAST(0 AS FLOAT)) AS v FROM embeddings) z")
register("ar4_reduce", lambda d: "SELECT vec_id, round(aggregate(embedding, 0.0D, (s, x) -> s + CAST(x AS DOUBLE)), 4) AS total FROM embeddings" if d.spark else "SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
register("ar5_labels", "SELECT left(src, 1) AS label, rel_type, left(dst, 1) AS end_label, count(*) AS n FROM edges GROUP BY left(src, 1), rel_type, left(dst, 1)")
register("js1_path", lambda d: f"SELECT id, CAST({d.json('signals', 'k')} AS BIGINT) AS k, coalesce({d.json('signals', 'absent')}, 'none') AS absent FROM affinity_history")
register("js2_build", lambda d: "SELECT id, get_json_object(j, '$.a') AS a, get_json_object(j, '$.b') AS b FROM (SELECT id, to_json(named_struct('a', trigger_event, 'b', CAST(user_id AS STRING))) AS j FROM affinity_history) z" if d.spark else "SELECT id, json_extract_string(j, '$.a') AS a, json_extract_string(j, '$.b') AS b FROM (SELECT id, to_json({'a': trigger_event, 'b': CAST(user_id AS VARCHAR)}) AS j FROM affinity_history) z")
register("js3_parse_defaults", lambda d: "SELECT id, coalesce(from_json(signals, 'k BIGINT, w DOUBLE').k, 0) AS k, coalesce(from_json(signals, 'k BIGINT, w DOUBLE').w, 0.5D) AS w FROM affinity_history" if d.spark else "SELECT id, coalesce(TRY_CAST(json_extract_string(signals, '$.k') AS BIGINT), 0) AS k, coalesce(TRY_CAST(json_extract_string(signals, '$.w') AS DOUBLE), 0.5::DOUBLE) AS w FROM affinity_history")
register("js4_topic_increment", "SELECT user_id, trigger_event AS topic, round(least(1, CAST(0.1 AS DOUBLE) * count(*)), 6) AS preference FROM affinity_history GROUP BY user_id, trigger_event")
register("js5_fenced_array", lambda d: f"SELECT p_partkey, {'array_join(from_json(' + d.grab('fenced', '```json(.*)```', 1) + ', ' + chr(39) + 'array<string>' + chr(39) + '), chr(44))' if d.spark else 'array_to_string(from_json(' + d.grab('fenced', '```json(.*)```', 1) + ', ' + chr(39) + '[' + chr(34) + 'VARCHAR' + chr(34) + ']' + chr(39) + '), chr(44))'} AS names FROM (SELECT p_partkey, concat('```json[\"', p_name, '\",\"x\"]```') AS fenced FROM part) z")
