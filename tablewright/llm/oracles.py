"""The results of queries as plain SQL over the same tables, where SQL can say them."""

from __future__ import annotations

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SUBSTRINGS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS p, w FROM d WHERE len(w) >= 35),
g AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 34], ' ')) AS h FROM x),
r AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM r),
k AS (SELECT d.doc_id, len(w) AS n, i, w[i] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d) d),
left_over AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.i) AS kept, count(*) AS n FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.i = k.i WHERE c.i IS NULL GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (doc_id)"""

LINES = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, line_no) AS k FROM l WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')),
d AS (SELECT line, min(k) AS k FROM p GROUP BY line),
t AS (SELECT k, unnest(list_distinct(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+'))) AS w FROM d),
n AS (SELECT k, count(*) AS n FROM t GROUP BY 1), f AS (SELECT w, count(*) AS df FROM t GROUP BY 1),
o AS (SELECT k, w, n, row_number() OVER (PARTITION BY k ORDER BY df, w) AS r FROM t JOIN f USING (w) JOIN n USING (k)),
x AS (SELECT * FROM o WHERE r <= n - (80 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.k AS ka, a.n AS na, b.k AS kb, b.n AS nb FROM x a JOIN x b ON a.w = b.w AND a.k < b.k AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
v AS (SELECT DISTINCT kb FROM (SELECT ka, kb, na, nb, count(*) AS m FROM c JOIN t a ON a.k = ka JOIN t b ON b.k = kb AND a.w = b.w GROUP BY ALL) WHERE 100 * m >= 80 * (na + nb - m)),
s AS (SELECT p.doc_id, p.line_no, p.k <> d.k OR v.kb IS NOT NULL AS gone FROM p JOIN d USING (line) LEFT JOIN v ON v.kb = d.k),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, string_agg(CASE WHEN gone THEN CAST(line_no AS VARCHAR) END, ',' ORDER BY line_no) AS removed_lines FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed_lines, '') AS removed_lines FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN g USING (doc_id)"""

CONTAMINATION = f"""WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents), b AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
i AS (SELECT item_id, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM i),
ks AS (SELECT DISTINCT k FROM win),
x AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k),
h AS (SELECT doc_id, p, x.k, item_id FROM (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM x) x JOIN win ON win.k = x.k AND win.g = x.g),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
r AS (SELECT s.* FROM s JOIN (SELECT g FROM s GROUP BY 1 HAVING count(*) > 1) USING (g)),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM r x JOIN r y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= 80 * (p.n + q.n - m)),
reach AS (SELECT DISTINCT a AS v, a AS c FROM e UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.v),
m AS (SELECT v, min(c) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, d.doc_id = coalesce(m.c, d.doc_id) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.v = d.doc_id"""

IMPORTANCE = f"""WITH z AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(b))),
d AS (SELECT row_number() OVER () AS k, doc_id, {_PLAIN} AS w FROM documents), b AS (SELECT {_PLAIN} AS w FROM benchmark),
u AS (SELECT DISTINCT unnest(w) AS x FROM (SELECT w FROM d UNION ALL SELECT w FROM b)),
c AS (SELECT x, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(x)), lambda i: CAST('0x' || substr(hex(encode(x)), 2 * i + 1, 2) AS BIGINT))), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS v FROM u, z),
f AS (SELECT k, v FROM (SELECT k, unnest(w) AS x FROM d) JOIN c USING (x)), e AS (SELECT v FROM (SELECT unnest(w) AS x FROM b) JOIN c USING (x)),
s AS (SELECT v, count(*) AS s FROM f GROUP BY 1), t AS (SELECT v, count(*) AS t FROM e GROUP BY 1),
g AS (SELECT v, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM f) + 10000) / (CAST(s + 1 AS DOUBLE) * ((SELECT count(*) FROM e) + 10000)))) AS g FROM s LEFT JOIN t USING (v)),
m AS (SELECT k, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM f JOIN g USING (v) GROUP BY 1),
h AS (SELECT k, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d),
r AS (SELECT k, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d JOIN h USING (k) LEFT JOIN m USING (k)),
o AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS p, count(*) OVER () AS n FROM r WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= 10 * n // 100 THEN p END AS rank FROM r LEFT JOIN o USING (k)"""

MIDDLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT *, len(u) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b FROM x),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

ARCHIVES = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r"""

ORACLES = {"op1_substring_dedup": SUBSTRINGS, "op2_line_dedup": LINES, "op5_benchmark_decontamination": CONTAMINATION, "op7_minhash_near_dedup": NEAR, "op11_importance_resampling": IMPORTANCE, "op12_fill_in_middle": MIDDLE, "op13_warc_archives": ARCHIVES}
