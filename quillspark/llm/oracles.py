"""DuckDB SQL for those queries of this subpackage that SQL can express; an independent reading of their contracts."""

OP8_LINES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, doc_id, t, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT rid, doc_id, t, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
many AS (SELECT key FROM (SELECT DISTINCT key, doc_id, t FROM k WHERE key <> '') GROUP BY key HAVING count(*) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(many.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE many.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN many ON k.key = many.key GROUP BY k.rid, k.doc_id
"""

OP7_CHAT = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
n AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM r),
o AS (SELECT conv_id, alone, role, text, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) AS i FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(13 + length(role) + 2 * len(regexp_extract_all(role, '[%|<>\n]')) + length(text) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars
FROM o GROUP BY conv_id, alone
"""

#: All pairs; below one cell's size the operator compares all pairs too.
OP9_CELLS = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e,
         coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, FALSE) AS fine
  FROM embeddings),
n AS (SELECT rid, e, sqrt(list_dot_product(e, e)) AS l FROM v WHERE fine),
link AS (SELECT a.rid AS r, b.rid AS s FROM n a JOIN n b ON a.rid <> b.rid WHERE list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.9),
reach AS (SELECT rid AS r, rid AS s FROM v UNION SELECT reach.r, link.s FROM reach JOIN link ON reach.s = link.r),
least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.s GROUP BY reach.r),
many AS (SELECT r, count(*) AS n_links FROM link GROUP BY r)
SELECT v.vec_id, coalesce(many.n_links, 0)::BIGINT AS n_links, least.component_id, coalesce(v.vec_id = least.component_id, FALSE) AS kept
FROM v JOIN least ON least.r = v.rid LEFT JOIN many ON many.r = v.rid
"""
