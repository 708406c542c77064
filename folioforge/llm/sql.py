"""DuckDB SQL equal to the queries that SQL can express."""

from __future__ import annotations

from .rules import BASE_FAILED, STOP_WORDS, THRESHOLDS

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')"
_EDGE = ".,;:!?\"''()#*$%&|<>"
_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_RULES = " AND ".join(f"NOT (n_words >= {least} AND ({rule}))" for _, rule, least in THRESHOLDS)

#: Common table expressions that give the measures m(doc_id, ...) of the rows of @source.
MEASURES_CTE = rf"""
numbered AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text, {_WORDS} AS w FROM @source),
windows AS (
    SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g
    FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM numbered WHERE len(w) >= 5)),
repeated AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(*) AS n_repeat_words
    FROM (SELECT DISTINCT rid, unnest(range(i, i + 5)) AS place FROM repeated) GROUP BY rid),
lined AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM numbered),
m AS (
    SELECT rid, doc_id, len(w)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(ls)::BIGINT AS n_lines,
        (length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g')))::BIGINT AS n_letters,
        (length(text) - length(replace(text, '!', '')))::BIGINT AS n_bangs,
        len(list_intersect(list_transform(w, lambda x: lower(trim(x, '{_EDGE}'))), {_STOPS}))::BIGINT AS n_stop_words
    FROM lined LEFT JOIN covered USING (rid))"""

KEPT_BY_RULES = f"NOT ({BASE_FAILED}) AND {_RULES}"

OP8_SQL = f"""
WITH {MEASURES_CTE.replace("@source", "documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed, ({KEPT_BY_RULES}) AS kept
FROM m"""
