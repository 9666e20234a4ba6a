"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from pixelloom.llm.quality import STOP_WORDS

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_FORMS = ", ".join(f"'{f}'" for w in sorted(set(STOP_WORDS)) for f in sorted({w, w.capitalize()}))

_COUNTED = rf"""
w AS (SELECT doc_id, coalesce(text, '') AS body, {_WORDS} AS ws FROM documents),
l AS (SELECT *, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
grams AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 4)),
starts AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
cover AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
          FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM starts) GROUP BY doc_id),
m AS (SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(list_filter(ws, lambda x: x IN ({_FORMS}))) AS BIGINT) AS n_stop_words,
  CAST(len(ls) AS BIGINT) AS n_lines
  FROM l LEFT JOIN cover USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
"""

OP1 = rf"""
WITH {_COUNTED}
SELECT *, NOT base_failed AND word_chars >= n_words * 2.0 AND word_chars <= n_words * 16.0
  AND n_symbols <= n_words * 0.25 AND (n_words < 20 OR n_stop_words >= n_words * CAST(0.01 AS DOUBLE))
  AND n_dup_lines <= n_lines * 0.5 AS kept
FROM judged
"""

OP2 = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
  [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight FROM d GROUP BY source),
v AS (SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / weight AS level, 1.5 * CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
x AS (SELECT *, (total - CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
  / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS water FROM v WINDOW o AS (ORDER BY level, source NULLS LAST)),
y AS (SELECT *, (SELECT arg_min(water, level) FROM x WHERE water <= level) AS w FROM x),
r AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(w, 0.0) * weight) AS target FROM y),
z AS (SELECT d.doc_id, d.size, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0.0 END AS rate,
  CAST('0x' || substr(md5('17:' || d.doc_id), 1, 8) AS BIGINT) / 4294967296.0 AS coin
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM z
"""

OP10 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS erole, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS etext,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c),
f AS (SELECT *, CASE WHEN before IS NULL THEN '<|role|>' || erole || '<|text|>' WHEN before = role THEN '<|more|>'
  ELSE '<|end|><|role|>' || erole || '<|text|>' END || etext AS piece FROM e)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(length(string_agg(piece, '' ORDER BY turn, role, text) || '<|end|>') AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

ORACLE = {
    "op1_quality_rules": OP1,
    "op2_exact_dedup": OP2,
    "op3_source_mixing": OP3,
    "op10_chat_formatting": OP10,
}
