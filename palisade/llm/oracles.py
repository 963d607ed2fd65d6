"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from palisade.llm import divergence as d
from palisade.llm import line_quality as q
from palisade.llm.common import SPACE

WORDS = f"[^{SPACE}]+"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(text: str, characters: str) -> str:
    return f"(length({text}) - length(translate({text}, {_quoted(characters)}, '')))"


OP5 = f"""
WITH docs AS (
  SELECT doc_id, t, regexp_extract_all(t, '{WORDS}') AS words FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs
), windows AS (
  SELECT doc_id, pos, CASE WHEN lead(word, 2) OVER o IS NOT NULL
    THEN word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o END AS win
  FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), found AS (
  SELECT doc_id, pos, win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 AS twice FROM windows
), covered AS (
  SELECT doc_id, max(twice::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM found
), repeated AS (
  SELECT doc_id, sum(c)::BIGINT AS n FROM covered GROUP BY doc_id
), lines AS (
  SELECT doc_id, line, regexp_extract_all(line, '{WORDS}') AS words
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^{SPACE}]')
), judged AS (
  SELECT doc_id, line, len(words) AS n,
    {_count("line", q.MARKS)} <= {q.MAX_MARKS} * length(translate(line, {_BLANKS}, ''))
    AND len(list_filter(words, lambda w: regexp_matches(w, '[!?]{{2,}}$'))) <= {q.MAX_SHOUTS} * len(words)
    AND ({_count("line", q.SEPARATORS)} < {q.MIN_SEPARATORS} OR {_count("line", q.SEPARATORS)} <= {q.MAX_SEPARATORS} * len(words))
    AND (len(words) > {q.BOILERPLATE_WORDS} OR NOT regexp_matches(line, {_quoted(q.BOILERPLATE)})) AS passes
  FROM lines
), by_doc AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup, sum(CASE WHEN passes THEN n ELSE 0 END)::BIGINT AS n_kept
  FROM judged GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(translate(t, {_BLANKS}, ''))::BIGINT AS word_chars,
    {_count("t", q.SYMBOLS)}::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_kept, 0)::BIGINT AS n_kept_words
  FROM docs LEFT JOIN repeated USING (doc_id) LEFT JOIN by_doc USING (doc_id)
)
SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND n_kept_words >= {1 - q.MAX_LOST} * n_words AS kept
FROM counts
"""

OP9 = """
WITH keyed AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM keyed
"""

_SHARE = f"1 + {d.UNIT}::HUGEINT * (%s + {d.ADDED}) // (%s + {d.ADDED} * v)"

OP12 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), vocabulary AS (
  SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT id) >= {d.LEAST_DOCS}
), sizes AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM vocabulary GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), grid AS (
  SELECT g.lang, g.source, v.term, v.lang_n, (SELECT any_value(s.v) FROM sizes s WHERE s.lang = g.lang) AS v FROM groups g JOIN vocabulary v USING (lang)
), found AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN vocabulary USING (lang, term) GROUP BY ALL
), counts AS (
  SELECT g.*, s.lang_total, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM grid g LEFT JOIN found USING (lang, source, term) JOIN sizes s ON s.lang = g.lang
), shares AS (
  SELECT *, {_SHARE % ("n", "total")} AS p, {_SHARE % ("lang_n", "lang_total")} AS q FROM counts
), distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
), both_parts AS (
  SELECT * FROM pairs UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {d.TOP_TERMS}
"""

ORACLES = {"op5_line_quality": OP5, "op9_exact_dedup": OP9, "op12_count_trees": OP12}
