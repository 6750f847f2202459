"""Metrics, types and scores of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import page_quality as quality
from .registry import add


def _re(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _n(text: str, *patterns: str) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({text}, {_re(p)}))" for p in patterns) + ")"


def _left(text: str, drop: str) -> str:
    return f"CASE WHEN n8 > 0 THEN strlen(regexp_replace({text}, {_re(drop)}, '', 'g')) / n8::DOUBLE ELSE 0 END"


_SUMS = {c: "(" + " + ".join(f"regexp_matches(low, '{p}')::INT" for p in ps) + f") * {w}::DOUBLE" for c, (w, ps) in quality.CATEGORIES.items()}
_BEST = f"greatest({', '.join(_SUMS.values())})"
_SQL = f"""WITH t AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g') AS text FROM pages),
u AS (SELECT *, lower(text) AS low, strlen(text) AS n8, regexp_extract_all(text, {_re(quality.WORDS)}) AS words, regexp_replace(text, '[^a-zA-Z]', '', 'g') AS letters, len(regexp_split_to_array(text, '[.!?]+')) AS sentences FROM t),
v AS (SELECT *, CASE WHEN length(letters) > 0 THEN length(regexp_replace(letters, '[^A-Z]', '', 'g')) / length(letters)::DOUBLE ELSE 0 END AS up, CASE WHEN length(letters) > 0 THEN length(regexp_replace(letters, '[^a-z]', '', 'g')) / length(letters)::DOUBLE ELSE 0 END AS down,
    {_left('text', '[^.!?,:;]')} AS marks, {_left('text', r'[a-zA-Z0-9\s.!?,:;]')} AS odd,
    CASE WHEN strlen(html) > 0 THEN strlen(regexp_replace(text, '^[ \\t\\n\\r\\x00\\x0B]+|[ \\t\\n\\r\\x00\\x0B]+$', '', 'g')) / strlen(html)::DOUBLE ELSE 0 END AS text_ratio,
    CASE WHEN len(words) = 0 THEN 0 ELSE round(least(1.0::DOUBLE, len(list_distinct(words)) / len(words)::DOUBLE * 2 + least(len(words) / sentences::DOUBLE / 20, 0.5::DOUBLE)), 3) END AS density,
    least(1.0::DOUBLE, {' + '.join(f"least({_n('text', p)} * 0.1::DOUBLE, 0.3::DOUBLE)" for p in quality.ENTITIES)}) AS richness,
    {' + '.join(f"CASE WHEN regexp_matches(low, '{'|'.join(p)}') THEN 0.25::DOUBLE ELSE 0 END" for p in quality.BUSINESS)} AS relevance,
    {' + '.join(f"regexp_matches(html, {_re(p)})::INT" for p in quality.STRUCTURED)} >= 2 AS structured,
    {_n('html', '<table')} > 0 AND ({_n('html', '<td', '<th')} > 15 OR {_n('html', 'hidden-xs', 'visible-xs')} > 5) AS complex_tables, {_n('html', '<form')} > 0 AS has_forms,
    regexp_matches(lower(html), '<nav|menu|breadcrumb|sidebar') AS has_navigation, {_n('html', '<img', '<video', '<audio')} > 2 AS has_media FROM u),
w AS (SELECT *, CASE WHEN len(words) < 10 THEN 0.1 ELSE greatest(0.0, least(1.0, 0.5 - CASE WHEN up > 0.8 OR down > 0.9 THEN 0.3 ELSE 0 END + CASE WHEN marks > 0.02 AND marks < 0.15 THEN 0.2 ELSE 0 END - CASE WHEN odd > 0.1 THEN 0.2 ELSE 0 END)) END::DOUBLE AS language_quality,
    CASE WHEN {_n('html', '<img', '<video', '<iframe')} > 5 AND n8 < 500 THEN 'media_rich' WHEN complex_tables THEN 'data_table' WHEN {_n('html', '<form')} > 0 AND {_n('html', '<input', '<select', '<textarea')} > 3 THEN 'interactive_form'
      WHEN {_n('html', '<a ')} > 20 AND n8 < 1000 THEN 'navigation_directory' WHEN n8 > 500 AND {_n('html', '<p')} > 3 THEN 'article_content' WHEN structured THEN 'structured_info' ELSE 'generic_page' END AS page_type,
    CASE WHEN {_BEST} = 0 THEN 'general' {' '.join(f"WHEN {s} = {_BEST} THEN '{c}'" for c, s in _SUMS.items())} END AS category FROM v),
x AS (SELECT *, round(least(1.0::DOUBLE, (text_ratio * 0.2::DOUBLE + density * 0.25::DOUBLE + richness * 0.2::DOUBLE + language_quality * 0.15::DOUBLE + relevance * 0.2::DOUBLE
    + CASE WHEN structured AND relevance > 0.5 THEN 0.1 ELSE 0 END::DOUBLE) * CASE WHEN page_type = 'navigation_directory' THEN 0.7 ELSE 1 END::DOUBLE), 3) AS quality FROM w)
"""
_METRICS = ["text_ratio", "density", "richness", "language_quality", "relevance"]
add("X61_page_metrics", "pages", lambda p: quality.metrics(p).select("page_id", *(quality.rounded(F.col(c), 6).alias(c) for c in _METRICS)), _SQL + "SELECT page_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _METRICS) + " FROM x")
_FLAGS = ["structured", "complex_tables", "has_forms", "has_navigation", "has_media"]
add("X62_page_predicates", "pages", lambda p: quality.metrics(p).select("page_id", *_FLAGS), _SQL + f"SELECT page_id, {', '.join(_FLAGS)} FROM x")
add("X63_page_type", "pages", lambda p: quality.metrics(p).select("page_id", "page_type", "category", "priority"), _SQL + "SELECT page_id, page_type, category, CASE WHEN quality >= 0.7 OR relevance > 0.7 THEN 'high' WHEN quality < 0.3 THEN 'low' ELSE 'normal' END AS priority FROM x")
add("X64_page_quality", "pages", lambda p: quality.metrics(p).select("page_id", "quality"), _SQL + "SELECT page_id, quality FROM x")
