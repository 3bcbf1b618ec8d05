"""Checking SQL (DuckDB) of the corpus queries whose contracts are plain SQL."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP10 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_UPPER.lower()}') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT k.*, r.last IS NOT NULL AND r.last <> doc_id AS gone FROM k LEFT JOIN r ON r.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""


def _escaped(column: str) -> str:
    out = f"replace({column}, '&', '&amp;')"
    for control, name in (("<|", "&lt;|"), ("<s>", "&lt;s>"), ("</s>", "&lt;/s>"), ("[INST]", "&lbrack;INST]"), ("[/INST]", "&lbrack;/INST]"), ("<<SYS>>", "&lt;<SYS>>"), ("<</SYS>>", "&lt;</SYS>>")):
        out = f"replace({out}, '{control}', '{name}')"
    return out


OP3 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS said,
  coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss, list(role ORDER BY turn) AS roles,
  sum(length('<|turn ') + length(replace({_escaped('role')}, '|', '&vert;')) + length('|>' || chr(10)) + length({_escaped('text')}) + length('<|end|>' || chr(10))) AS n
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars,
  CASE WHEN roles = ['user', 'assistant'] THEN 'prompt'
    WHEN roles[1] = 'system' AND len(roles) > 1 AND len(list_filter(roles[2:], lambda r: r NOT IN ('user', 'assistant'))) = 0 THEN 'conversations' ELSE 'messages' END AS layout
FROM g
"""
