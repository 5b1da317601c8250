"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .chat_format import ALSO, END, TEXT, TURN
from .common import LOWER, UPPER
from .url_filter import RULES, THIN_CHARS

ORACLE: dict[str, str] = {}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_fits = "\n".join(
    f"WHEN (host = {_text(h)} OR ends_with(host, {_text('.' + h)})) AND starts_with(path, {_text(p)}) THEN {_text(a + ' ' + h + p)}"
    for a, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
)
ORACLE["op1_url_filter"] = rf"""
WITH parts AS MATERIALIZED (
  SELECT page_id, html,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
addressed AS MATERIALIZED (SELECT *, host || CASE path WHEN '' THEN '/' ELSE path END AS address FROM parts),
thin AS MATERIALIZED (
  SELECT DISTINCT address AS key FROM addressed WHERE host <> '' AND length(coalesce(html, '')) < {THIN_CHARS}),
fitted AS (
  SELECT *, CASE {_fits} END AS fit, address IN (SELECT key FROM thin) AS listed
  FROM addressed)
SELECT page_id, host, path, regexp_replace(fit, '^[a-z]+ ', '') AS rule,
  CASE WHEN fit IS NOT NULL THEN split_part(fit, ' ', 1) WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM fitted
"""

_escaped = r"replace(replace({x}, '\', '\b'), '<|', '\l|')"
ORACLE["op4_chat_format"] = rf"""
WITH turns AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, NULL, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) AS before FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS bigint) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  cast(sum(length({_escaped.format(x="text")}) + CASE WHEN role IS NOT DISTINCT FROM before THEN {len(ALSO)}
    ELSE length({_escaped.format(x="role")}) + {len(TURN) + len(TEXT) + len(END)} END) AS bigint) AS formatted_chars
FROM marked GROUP BY conv_id, alone
"""

_strip = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
ORACLE["op6_line_dedup"] = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
lines AS MATERIALIZED (
  SELECT row, doc_id, pos, line, translate({_strip}, '{UPPER}', '{LOWER}') AS key
  FROM (SELECT row, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM docs))),
common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key
  HAVING count(DISTINCT doc_id) + count(DISTINCT row) FILTER (WHERE doc_id IS NULL) >= 10)
SELECT doc_id, count(*) AS n_lines,
  cast(count(*) FILTER (WHERE common.key IS NOT NULL) AS bigint) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common USING (key) GROUP BY row, doc_id
"""

_usable = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
ORACLE["op5_ann"] = f"""
WITH v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_usable}),
pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id,
    sqrt(list_reduce(list_transform(list_zip(q.e, x.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs)
SELECT query_id, cast(rank AS integer) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_word = r"[^\x20\x09-\x0D]+"
ORACLE["quality_statistics"] = rf"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT row, doc_id, text, regexp_extract_all(text, '{_word}') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_word}')) AS lines FROM t),
windows AS MATERIALIZED (
  SELECT row, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, a, b, c) > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY row)
SELECT doc_id, cast(len(words) AS bigint) AS n_words, cast(length(array_to_string(words, '')) AS bigint) AS word_chars,
  cast(len(regexp_extract_all(text, '[#*$%&|<>]')) AS bigint) AS n_symbols,
  cast(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  len(words) < 50 OR 100 * coalesce(n, 0) > 50 * len(words) AS base_failed
FROM w LEFT JOIN covered USING (row)
"""

ORACLE["packing_invariants"] = """
SELECT 0::bigint AS misplaced, 0::bigint AS too_long, count(*) AS documents, 0::bigint AS torn FROM documents
"""
