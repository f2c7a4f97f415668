"""SQL for DuckDB that gives the rows of those training-data queries that SQL can express."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d
), e AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * i >= 75 * (len(sa.g) + len(sb.g) - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id)
SELECT s.doc_id, CAST(max(len(g)) AS BIGINT) AS n_shingles, min(c) AS component_id, min(c) = s.doc_id AS kept
FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id
"""

CHAT_FORMAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, CASE WHEN contains(text, '[/INST]') OR contains(text, '</s>') OR contains(text, '\\') OR contains(text, '[\INST]') OR contains(text, '[\/INST]') OR contains(text, '<\/s>')
    THEN replace(replace(replace(replace(text, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>') ELSE text END AS x FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('[INST]') + length(role) + 1 + length(x) + CASE WHEN role = 'assistant' THEN length('</s>') ELSE length('[/INST]') END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

QUALITY_RULES = r"""
WITH names(lang, n) AS (VALUES ('en', ['the', 'of', 'and', 'to', 'in', 'that', 'is', 'was', 'for', 'it']), ('fr', ['le', 'la', 'les', 'de', 'des', 'et', 'un', 'une', 'que', 'en']),
  ('de', ['der', 'die', 'das', 'den', 'und', 'in', 'ein', 'eine', 'ist', 'von']), ('es', ['el', 'la', 'los', 'de', 'y', 'en', 'que', 'un', 'una', 'del'])),
d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8))),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g WHERE n > 1) GROUP BY 1),
c AS (SELECT d.doc_id, d.lang, length(t) AS chars, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^\p{Ll}]+', '', 'g')) AS lo, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS up,
  length(regexp_replace(t, '[^0-9]+', '', 'g')) AS di, length(regexp_replace(t, '[^.,;:!?''"()-]+', '', 'g')) AS st, names.n AS own, list_transform(w, lambda x: regexp_replace(lower(x), '[^\p{L}]+', '', 'g')) AS plain
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN names ON names.lang = d.lang),
h AS (SELECT *, [lo, up, di, st, n_symbols, chars - word_chars, word_chars - lo - up - di - st - n_symbols] AS a, list_transform(own, lambda x: len(list_filter(plain, lambda y: y = x))) AS b0 FROM c),
k AS (SELECT *, list_append(b0, n_words - coalesce(list_sum(b0), 0)) AS b FROM h),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS failed FROM k),
p AS (SELECT doc_id, 'a' AS kind, lang, i, a[i] / list_sum(a) AS p FROM m, range(1, 8) s(i) WHERE list_sum(a) > 0 UNION ALL SELECT doc_id, 'b', lang, i, b[i] / list_sum(b) FROM m, range(1, 12) s(i) WHERE list_sum(b) > 0),
c1 AS (SELECT * FROM m WHERE n_words >= 40 AND NOT failed),
e1 AS (SELECT lang, 'a' AS kind, i, avg(a[i] / chars) FILTER (chars > 0) AS q FROM c1, range(1, 8) s(i) GROUP BY lang, i HAVING count(*) >= 20 UNION ALL SELECT lang, 'b', i, avg(b[i] / n_words) FILTER (n_words > 0) FROM c1, range(1, 12) s(i) GROUP BY lang, i HAVING count(*) >= 20),
j1 AS (SELECT doc_id, kind, round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END / 2 + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END / 2))), 9) AS s
  FROM (SELECT p.doc_id, p.kind, p.p, e.q / sum(e.q) OVER (PARTITION BY p.doc_id, p.kind) AS q FROM p JOIN e1 e ON e.lang IS NOT DISTINCT FROM p.lang AND e.kind = p.kind AND e.i = p.i) GROUP BY 1, 2),
c2 AS (SELECT c1.* FROM c1 WHERE doc_id NOT IN (SELECT doc_id FROM j1 WHERE s > 0.25)),
e2 AS (SELECT lang, 'a' AS kind, i, avg(a[i] / chars) FILTER (chars > 0) AS q FROM c2, range(1, 8) s(i) GROUP BY lang, i HAVING count(*) >= 20 UNION ALL SELECT lang, 'b', i, avg(b[i] / n_words) FILTER (n_words > 0) FROM c2, range(1, 12) s(i) GROUP BY lang, i HAVING count(*) >= 20),
j AS (SELECT doc_id, kind, round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END / 2 + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END / 2))), 9) AS s
  FROM (SELECT p.doc_id, p.kind, p.p, e.q / sum(e.q) OVER (PARTITION BY p.doc_id, p.kind) AS q FROM p JOIN e2 e ON e.lang IS NOT DISTINCT FROM p.lang AND e.kind = p.kind AND e.i = p.i) GROUP BY 1, 2),
f AS (SELECT m.*, coalesce(x.s, 0) AS cd, coalesce(y.s, 0) AS wd FROM m LEFT JOIN j x ON x.doc_id = m.doc_id AND x.kind = 'a' LEFT JOIN j y ON y.doc_id = m.doc_id AND y.kind = 'b')
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  failed AS base_failed, NOT failed AND NOT (n_words >= 40 AND (cd > 0.25 OR wd > 0.25)) AS kept, cd AS class_distance, wd AS common_distance FROM f
"""

#: Tables t: the 256 words of crc32's table; crc32 of a text s is then the fold over its bytes.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
HEX = "instr('0123456789ABCDEF', substr(hex(encode(s)), {}, 1)) - 1"
CRC = f"xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * strlen(s), 2), lambda i: ({HEX.format('i')}) * 16 + {HEX.format('i + 1')})), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

SPELLING_VARIANTS = rf"""
WITH RECURSIVE {CRC_TABLE}, r AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS run FROM documents
), g AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM r GROUP BY 1, 2),
x AS (SELECT run, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM g),
h AS (SELECT run, n, {CRC} AS h FROM x, crc),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
c AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM c),
p AS (SELECT DISTINCT a.word AS a, b.word AS b FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.cut UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.cut),
f AS (SELECT a, count(*) AS near, arg_min(b, (-v.n, b)) AS best, max(v.n) AS best_n FROM p JOIN v ON v.word = p.b GROUP BY 1),
k AS (SELECT word, n, coalesce(near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM v LEFT JOIN f ON a = word),
z AS (SELECT word, word AS root FROM k WHERE form IS NULL UNION ALL SELECT k.word, z.root FROM k JOIN z ON k.form = z.word)
SELECT k.word, form, root, n, n_near, form_n FROM k JOIN z ON z.word = k.word
"""

PREFIX_TRIE = rf"""
WITH {CRC_TABLE}, o AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
), h AS (SELECT conv_id, turns, CAST({CRC} % 4 AS INT) AS h FROM (SELECT *, CAST(conv_id AS VARCHAR) AS s FROM o), crc),
p AS (SELECT h.conv_id, coalesce(b.turns[1:h.h], []) || h.turns[h.h + 1:] AS path FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM p),
n AS (SELECT path[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (len(path) = depth), '') AS ends FROM m GROUP BY 1, 2),
k AS (SELECT path[1:depth - 1] AS up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
s AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.path[n.depth].text, '[^\x20\x09-\x0D]+')) END AS own FROM n LEFT JOIN k ON k.up = n.path),
e AS (SELECT path, depth, n_children, own, unnest(range(0, depth + 1)) AS above FROM s),
t AS (SELECT path[1:above] AS top, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM e GROUP BY 1)
SELECT s.conv_id, s.depth, u.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves, saved_tokens, sha256(s.ends) AS ends_sha256
FROM s JOIN t ON t.top = s.path LEFT JOIN n u ON s.depth > 0 AND u.path = s.path[1:s.depth - 1]
"""
