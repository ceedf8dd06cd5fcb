"""DuckDB SQL for the queries of this package that SQL can express on whole tables."""

from __future__ import annotations

NEAR_DUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

DECONTAMINATE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
i AS (SELECT item_id, ws, least(len(ws), 13) AS l, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS k FROM b WHERE len(ws) > 0),
win AS (SELECT item_id, l, array_to_string(ws[k:k + l - 1], ' ') AS g FROM i),
t AS (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS k FROM d, (SELECT DISTINCT l FROM win)),
hit AS (SELECT doc_id, k, l, item_id FROM (SELECT doc_id, l, k, array_to_string(ws[k:k + l - 1], ' ') AS g FROM t) JOIN win USING (l, g)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + l)) AS q FROM hit) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)
"""

CHAT = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS ord, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 3 AS tokens,
  12 + len(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) + 1 + len(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) + 10 + 1 AS size FROM given),
b AS (SELECT *, ord = 1 AND role = 'system' AS sys FROM a),
c AS (SELECT *, max(CASE WHEN sys THEN tokens END) OVER (PARTITION BY conv_id) AS head, max(CASE WHEN sys THEN size END) OVER (PARTITION BY conv_id) AS head_size,
  coalesce(sum(CASE WHEN NOT sys THEN tokens END) OVER (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_ FROM b),
d AS (SELECT *, greatest(1024 - 128 - coalesce(head, 0), 256) // 2 AS half FROM c),
e AS (SELECT *, (NOT sys AND tokens > half)::INT AS large FROM d),
f AS (SELECT *, CASE WHEN NOT sys THEN (before_ // half) || ':' || coalesce(sum(large) OVER (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) || ':' || large END AS cell FROM e),
g AS (SELECT *, NOT sys AND lag(cell) OVER (PARTITION BY conv_id ORDER BY ord) IS DISTINCT FROM cell AS opens FROM f),
h AS (SELECT *, greatest(sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY ord ROWS UNBOUNDED PRECEDING), 1) AS win,
  coalesce(sum(CASE WHEN NOT sys THEN size END) OVER (PARTITION BY conv_id ORDER BY before_ RANGE BETWEEN 128 PRECEDING AND 1 PRECEDING), 0) AS past FROM g)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY ord) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(size) + coalesce(sum(past + coalesce(head_size, 0)) FILTER (WHERE opens AND win > 1), 0))::BIGINT AS formatted_chars
FROM h GROUP BY 1
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
g AS (
  SELECT lang, m AS words, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM p, (SELECT unnest([1, 2, 3]) AS m) WHERE len(ws) >= m),
f AS (SELECT lang, words, phrase, count(*)::HUGEINT AS n FROM g GROUP BY 1, 2, 3),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE words = 1 GROUP BY 1),
cand AS (SELECT lang, words, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND n >= 10),
cuts AS (SELECT lang, phrase, words, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM cand, (SELECT unnest([1, 2]) AS k) WHERE k < words),
sc AS (SELECT c.*, x.n AS l, y.n AS r, 1000000 * a * a // (x.n * y.n) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM sc),
longer AS (SELECT lang, sub, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS sub FROM cand WHERE words = 3) GROUP BY 1, 2),
kept AS (SELECT low.* FROM low LEFT JOIN longer ON longer.lang = low.lang AND longer.sub = low.phrase WHERE o = 1 AND (most IS NULL OR 100 * most < 50 * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, total.n AS n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

#: The remainders of the CRC come from its polynomial, a bit at a time.
RESAMPLING = r"""
WITH tab AS (SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
d AS (
  SELECT doc_id, 0 AS side, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
  UNION ALL
  SELECT -1, 1, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
w AS (SELECT doc_id, side, w, count(*) AS n FROM (SELECT doc_id, side, unnest(ws) AS w FROM d) GROUP BY ALL),
b AS (
  SELECT w, list_reduce(list_transform(range(1, len(hex(encode(w))) // 2 + 1), lambda k: ('0x' || substr(hex(encode(w)), (2 * k - 1)::BIGINT, 2))::BIGINT),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT) AS c FROM (SELECT DISTINCT w FROM w), tab),
f AS (SELECT doc_id, side, xor(c, 4294967295) % 10000 AS bucket, sum(n)::BIGINT AS n FROM w JOIN b USING (w) GROUP BY ALL),
st AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0)::BIGINT AS t FROM f GROUP BY 1),
al AS (SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM st),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain FROM st, al),
x AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM f JOIN gain USING (bucket) WHERE side = 0 GROUP BY 1),
y AS (
  SELECT d.doc_id, len(ws) >= 20 AS drawable, coalesce(n_features, 0)::BIGINT AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN x USING (doc_id) WHERE side = 0),
z AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::BIGINT AS score FROM y),
r AS (SELECT *, row_number() OVER (ORDER BY drawable DESC, score DESC, doc_id) AS place, count(*) FILTER (WHERE drawable) OVER () * 10 // 100 AS k FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= k THEN place END::BIGINT AS rank FROM r
"""
