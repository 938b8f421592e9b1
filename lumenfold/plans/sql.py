"""Pieces of DuckDB SQL that the oracles share. They are written from the definitions, apart from the Spark expressions."""

from __future__ import annotations

from ..functions.arabic import FOLDED, FOLDS_TO
from ..functions.text import AUDIT_STOP_WORDS, SPELLINGS, STOP_WORDS, SUFFIXES


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(items: list[str]) -> str:
    return "[" + ", ".join(map(text, items)) + "]"


TOKENS = "regexp_extract_all(lower({0}), '[a-z'']+')"
STOP = words(STOP_WORDS)


def stems(source: str, name: str = "stemmed") -> str:
    """CTEs that end with ``name`` (word, stem) for the distinct words of ``source`` (word)."""
    strip = "^(.{3,}?)(?:" + "|".join(SUFFIXES) + ")$"
    return f"""
        {name}_0 AS (SELECT DISTINCT word, word AS w FROM {source}),
        {name}_1 AS (SELECT word, CASE WHEN length(w) > 5 AND ends_with(w, 'ly') THEN left(w, length(w) - 2) ELSE w END AS w FROM {name}_0),
        {name}_2 AS (SELECT word, CASE WHEN length(w) > 3 AND ends_with(w, 'y') AND NOT regexp_matches(w, '[aeiou]y$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM {name}_1),
        {name}_3 AS (SELECT word, regexp_replace(w, '{strip}', '\\1') AS w FROM {name}_2),
        {name}_4 AS (SELECT word, regexp_replace(w, '{strip}', '\\1') AS w FROM {name}_3),
        {name}_5 AS (SELECT word, CASE WHEN length(w) > 3 AND ends_with(w, 'e') THEN left(w, length(w) - 1) ELSE w END AS w FROM {name}_4),
        {name} AS (SELECT word, CASE WHEN length(w) > 3 AND right(w, 1) = left(right(w, 2), 1) AND NOT contains('lszaeiou', right(w, 1)) THEN left(w, length(w) - 1) ELSE w END AS stem FROM {name}_5)"""


def spelling_keys(source: str, name: str = "keyed") -> str:
    """CTEs that end with ``name`` (word, key) for the words of ``source`` (word)."""
    w = "replace(lower(word), '''', '')"
    for a, b in SPELLINGS:
        w = f"replace({w}, '{a}', '{b}')"
    return f"""
        {name}_0 AS (SELECT DISTINCT word, {w} AS w FROM {source}),
        {name}_1 AS (SELECT word, list_aggregate(list_transform(range(1, length(w) + 1), lambda i: CASE WHEN i > 1 AND w[i:i] = w[i - 1:i - 1] THEN '' ELSE w[i:i] END), 'string_agg', '') AS w FROM {name}_0),
        {name}_2 AS (SELECT word, CASE WHEN length(w) > 2 AND ends_with(w, 'h') THEN left(w, length(w) - 1) ELSE w END AS w FROM {name}_1),
        {name}_3 AS (SELECT word, CASE WHEN length(w) > 3 THEN left(w, 1) || regexp_replace(substr(w, 2), '[aeiou]', '', 'g') ELSE w END AS w FROM {name}_2),
        {name} AS (SELECT word, CASE WHEN coalesce(w, '') = '' THEN lower(word) ELSE w END AS key FROM {name}_3)"""


def vector_terms(source: str, name: str = "terms") -> str:
    """CTEs that end with ``name`` (id, term): words and pairs of ``source`` (id, text), one row for each."""
    return f"""
        {name}_w AS (SELECT id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: NOT list_contains({STOP}, t)) AS w FROM {source}),
        {name} AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {name}_w)"""


def tfidf() -> str:
    """CTEs passage (id, text), idf (term, idf) and weight (id, term, w) of documents."""
    return f"""
        passage AS (SELECT doc_id AS id, text FROM documents),
        {vector_terms('passage')},
        tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY ALL),
        idf AS (SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM passage)) / (1.0 + count(*))) + 1.0 AS idf FROM tf GROUP BY term),
        raw AS (SELECT id, term, (1.0 + ln(tf)) * idf AS raw FROM tf JOIN idf USING (term)),
        norm AS (SELECT id, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY id),
        weight AS (SELECT id, term, raw / norm AS w FROM raw JOIN norm USING (id))"""


def query_scores(query: str) -> str:
    """CTEs tfidf_score (id, tfidf) and keyword (id, kw) of a literal query; they need those of :func:`tfidf`."""
    return f"""
        asked AS (SELECT 0 AS id, {text(query)} AS text),
        {vector_terms('asked', 'qterms')},
        qraw AS (SELECT term, (1.0 + ln(count(*))) * any_value(idf) AS raw FROM qterms JOIN idf USING (term) GROUP BY term),
        qweight AS (SELECT term, raw / sqrt((SELECT sum(raw * raw) FROM qraw)) AS w FROM qraw),
        tfidf_score AS (SELECT id, sum(weight.w * qweight.w) AS tfidf FROM weight JOIN qweight USING (term) GROUP BY id),
        {keyword(query)}"""


def keyword(query: str) -> str:
    """CTEs that end with keyword (id, kw) of a literal query; they need passage (id, text)."""
    return f"""
        qwords AS (SELECT unnest(list_filter({TOKENS.format(text(query))}, lambda t: length(t) >= 3 AND NOT list_contains({STOP}, t))) AS word),
        qnumbered AS (SELECT word, row_number() OVER () AS pos FROM qwords),
        pwords AS (SELECT DISTINCT id, unnest({TOKENS.format('text')}) AS word FROM passage),
        every AS (SELECT word FROM qwords UNION SELECT word FROM pwords),
        {stems('every')},
        qstems AS (SELECT pos, stem FROM qnumbered JOIN stemmed USING (word)),
        pstems AS (SELECT DISTINCT id, stem FROM pwords JOIN stemmed USING (word)),
        keyword AS (SELECT id, count(DISTINCT pos) / (SELECT CAST(count(*) AS DOUBLE) FROM qstems) AS kw FROM pstems JOIN qstems USING (stem) GROUP BY id)"""


def bag(column: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({column}), '[a-z]+'), lambda w: length(w) > 2 AND NOT list_contains({words(AUDIT_STOP_WORDS)}, w)))"


def arabic(column: str, dagger: str) -> str:
    marks = "[ً-ٟـۖ-ࣰۭ-ࣿ]"
    return f"translate(regexp_replace(replace({column}, 'ٰ', '{dagger}'), '{marks}', '', 'g'), '{FOLDED}', '{FOLDS_TO}')"
