"""DuckDB SQL for the queries that SQL can express."""

OP3 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)
), b AS (
  SELECT item_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))
), h AS (
  SELECT DISTINCT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP4 = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source
), num AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM src
), w AS (
  SELECT *, CAST([3, 1, 2][no % 3 + 1] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap FROM num
), lev AS (
  SELECT *, cap / w AS level, (SELECT sum(source_size) FROM src)::DOUBLE * 1.5::DOUBLE AS total FROM w
), tries AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY level, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY level, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t FROM lev
), tgt AS (
  SELECT source, no, source_size, least(cap, w * (SELECT t FROM tries WHERE t <= level ORDER BY level, no LIMIT 1)) AS target FROM tries
), par AS (
  SELECT greatest(1, least(4096, CAST(floor(sum(target)) AS BIGINT) // 131072)) AS block, CAST(floor(sum(target)) AS BIGINT) AS words FROM tgt
), cum AS (
  SELECT no, sum(floor(target)) OVER (ORDER BY no) AS t2, sum(floor(target)) OVER (ORDER BY no) - floor(target) AS t1, (SELECT sum(floor(target)) FROM tgt) AS t FROM tgt
), pts AS (
  SELECT no, CAST(floor(t1 / t * 4294967296.0::DOUBLE) AS BIGINT) AS lo, CAST(floor(t2 / t * 4294967296.0::DOUBLE) AS BIGINT) AS hi FROM cum
), slots AS (
  SELECT no, count(*) AS n FROM (SELECT i * 2654435769 % 4294967296 AS u FROM (SELECT unnest(range((words + block - 1) // block)) AS i FROM par)) JOIN pts ON u >= lo AND u < hi GROUP BY no
), pos AS (
  SELECT s.doc_id, s.size, tgt.no, tgt.source_size, tgt.target,
    coalesce(sum(s.size) OVER (PARTITION BY tgt.no ORDER BY md5('mix:' || CAST(s.doc_id AS VARCHAR)), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM s JOIN tgt ON s.source IS NOT DISTINCT FROM tgt.source
)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, coalesce(n, 0) * block - a)) + greatest(0, least(size, coalesce(n, 0) * block - source_size - a)) AS BIGINT) AS taken
FROM pos LEFT JOIN slots USING (no), par
"""

OP10 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

OP5 = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place,
    coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n') || chr(2) AS line FROM t
), c AS (
  SELECT *, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM p
), w AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n, max_by(prefix, place) AS whole FROM c GROUP BY conv_id
), f AS (
  SELECT n, whole, min(conv_id) AS conv_id, count(*) AS snapshots FROM w GROUP BY n, whole
), k AS (
  SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM c JOIN w USING (conv_id) WHERE c.place + 1 = f.n AND c.place + 1 < w.n AND c.prefix = f.whole)
)
SELECT conv_id, CAST(place // 256 AS BIGINT) AS part, any_value(k.n) AS n_turns, any_value(k.snapshots) AS snapshots,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
FROM p JOIN k USING (conv_id) GROUP BY conv_id, place // 256
"""

OP1 = r"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text <> ''
), l AS (
  SELECT doc_id, text, pos, regexp_extract_all(lines[pos + 1], '[^\x20\x09-\x0D]+') AS raw FROM (SELECT *, unnest(range(len(lines))) AS pos FROM d)
), k AS (
  SELECT doc_id, text, pos, len(raw) AS n, len(raw) // 5 AS w,
    CASE WHEN len(raw) >= 5 THEN list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) ELSE raw END AS tok
  FROM l WHERE len(raw) > 0
), f AS (
  SELECT doc_id, text, pos, n, w, tok,
    unnest(CASE WHEN n >= 5 THEN list_distinct(list_concat(range(3, n - w + 1, greatest(1, w // 2)), [n - w, -1])) ELSE [-1] END) AS field
  FROM k
), t AS (
  SELECT doc_id, text, pos, field, n || ' ' || field || ' ' || CASE WHEN field < 0 THEN array_to_string(tok, ' ')
    ELSE array_to_string(tok[1 : field], ' ') || chr(10) || array_to_string(tok[field + w + 1 : n], ' ') END AS template
  FROM f
), r AS (
  SELECT template, count(*) AS lines, arg_min(text, doc_id) AS keeper FROM t GROUP BY template HAVING min(text) <> max(text)
), b AS (
  SELECT doc_id, pos, t.text <> arg_max(keeper, (lines, -field)) AS dropped FROM t JOIN r USING (template) GROUP BY doc_id, pos, t.text
), g AS (
  SELECT doc_id, count(*) AS n, list(pos) AS gone FROM b WHERE dropped GROUP BY doc_id
)
SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_dropped,
  CASE WHEN g.n IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(len(string_split(text, chr(10)))), lambda p: NOT list_contains(gone, p)), lambda p: string_split(text, chr(10))[p + 1]), chr(10)), '') END AS text
FROM documents LEFT JOIN g USING (doc_id)
"""

OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b USING (s) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach AS (
  SELECT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), c AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

ORACLES = {"op7_near_dedup": OP7, "op1_line_dedup": OP1, "op5_chat_format": OP5, "op3_decontaminate": OP3, "op4_mix_sources": OP4, "op10_exact_dedup": OP10}
