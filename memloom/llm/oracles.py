"""SQL of the training-data operators whose results SQL can express whole (operator 12 has its own beside its code)."""

#: op4: every 400-byte window by its 64-bit hash, over the hex form of the bytes (two letters a byte), block by block.
SUFFIX_DEDUP = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
 block AS (SELECT r, o, substring(h, CAST(2 * o + 1 AS BIGINT), 1310) AS t FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 399, 256)) AS o FROM d WHERE len(h) >= 800) x),
 w AS (SELECT r, o, t, unnest(range(0, CAST(least(256, len(t) // 2 - 399) AS BIGINT))) AS j FROM block),
 k AS (SELECT r, o + j AS i, hash(substring(t, CAST(2 * j + 1 AS BIGINT), 800)) AS k FROM w),
 more AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
 s AS (SELECT k.r, k.i FROM k JOIN more USING (k)),
 marked AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM s),
 grouped AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM marked),
 spans AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM grouped GROUP BY r, g),
 cuts AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
 per AS (SELECT c.r, sum(c.b - c.a) AS n_removed, count(*) AS n_spans, max(c.b) AS last, string_agg(substring(d.h, CAST(2 * c.before + 1 AS BIGINT), CAST(2 * (c.a - c.before) AS BIGINT)), '' ORDER BY c.a) AS kept FROM cuts c JOIN d ON d.r = c.r GROUP BY c.r)
 SELECT d.doc_id, len(d.h) // 2 AS n_bytes, CAST(coalesce(p.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(p.n_spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN p.r IS NULL THEN d.h ELSE concat(p.kept, substring(d.h, CAST(2 * p.last + 1 AS BIGINT))) END)) AS kept_sha256 FROM d LEFT JOIN per p ON p.r = d.r"""

#: op9: shingles as 64-bit hashes of joined words (no word holds the separator), all pairs that share one, components by the smallest neighbour.
JACCARD_JOIN = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
 sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [hash(array_to_string(w, chr(10)))] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: hash(array_to_string(w[i : i + 3], chr(10))))) END AS s FROM d),
 classes AS (SELECT min(doc_id) AS c, list_sort(s) AS s, any_value(len(s)) AS n, list(doc_id) AS members FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
 sh AS (SELECT c, n, unnest(s) AS g FROM classes),
 rare AS (SELECT g FROM sh GROUP BY g HAVING count(*) > 1),
 inside AS (SELECT sh.* FROM sh JOIN rare USING (g)),
 pairs AS (SELECT a.c AS x, b.c AS y, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM inside a JOIN inside b ON a.g = b.g AND a.c < b.c AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85 GROUP BY a.c, b.c),
 links AS (SELECT x, y FROM pairs WHERE 100 * common >= 85 * (na + nb - common)),
 sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
 reach AS (SELECT c AS x, c AS y FROM classes UNION SELECT r.x, s.y FROM reach r JOIN sides s ON s.x = r.y),
 named AS (SELECT x AS c, min(y) AS component_id FROM reach GROUP BY x),
 member AS (SELECT unnest(k.members) AS doc_id, n.component_id FROM classes k JOIN named n ON n.c = k.c)
 SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id FROM sets s LEFT JOIN member m ON m.doc_id = s.doc_id"""
