"""Contexts of citations that are put together from given conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context
from .registry import add_derived

_T = "'| Nome | Tel |' || chr(10) || '|---|---|' || chr(10) || '| Ada ' || turn || ' | 06 |' || chr(10) || '| | 07 |'"
_CITED = f"""SELECT conv_id, turn, CASE WHEN turn % 4 > 0 THEN 'T' || turn END AS title, CASE turn % 5 WHEN 1 THEN 'Sopra' || chr(10) || {_T} WHEN 2 THEN 'Stesso testo' WHEN 3 THEN '' ELSE substr(coalesce(text, ''), 1, 150) END AS text,
    CASE WHEN turn % 2 = 0 THEN 'https://a.example/x' END AS url, CASE WHEN turn % 3 = 0 THEN '06 ' || turn END AS phone, CASE WHEN turn % 5 = 3 AND conv_id % 2 = 0 THEN 'a@b.it' END AS email, CAST(NULL AS STRING) AS address, '' AS schedule FROM conversations"""
_LINES = "list_filter(string_split(shown, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2 AND NOT regexp_matches(x, '^[\\s|:-]+$'))"
_CELLS = lambda x: rf"list_transform(string_split(regexp_replace({x}, '^\s*\||\|\s*$', '', 'g'), '|'), lambda c: trim(c))"
add_derived("QS5_tables_first", {"c": _CITED}, lambda c: context.build(c, "conv_id", ["turn"], 900).select("conv_id", "parts", F.md5("context").alias("digest")), rf""",
u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, lower(trim(text || '|' || coalesce(url, ''))) ORDER BY turn) = 1),
s AS (SELECT *, len(list_filter(string_split(text, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2)) >= 2 AS tab, CASE WHEN starts_with(trim(text), '|') THEN trim(text) ELSE regexp_replace(trim(text), '(\S)\n(\|)', '\1' || chr(10) || chr(10) || '\2', 'g') END AS shown FROM u),
r AS (SELECT *, {_LINES} AS l FROM s),
f AS (SELECT *, array_to_string(list_transform(l[2:], lambda x: array_to_string(list_filter(list_transform(range(1, len({_CELLS('x')}) + 1), lambda i: CASE WHEN length({_CELLS('x')}[i]) > 0 THEN coalesce({_CELLS('l[1]')}[i] || ': ', '') || {_CELLS('x')}[i] END), lambda y: y IS NOT NULL), '; ')), chr(10)) AS flat FROM r),
x AS (SELECT *, CASE WHEN coalesce(phone, '') <> '' THEN chr(10) || 'Telefono: ' || phone ELSE '' END || CASE WHEN coalesce(email, '') <> '' THEN chr(10) || 'Email: ' || email ELSE '' END AS extra, CASE WHEN url IS NOT NULL THEN chr(10) || chr(10) || '[Fonte](' || url || ')' ELSE '' END AS src,
    CASE WHEN tab THEN '**Table (alta priorità)**' || chr(10) || chr(10) || shown || chr(10) || chr(10) || 'Tabella (testo lineare di supporto):' || chr(10) || flat ELSE text END AS body FROM f),
p AS (SELECT conv_id, turn, tab, CASE WHEN body <> '' THEN '[' || coalesce(title, 'Unknown') || ']' || chr(10) || body || extra || src WHEN extra <> '' THEN '[' || coalesce(title, 'Unknown') || ']' || extra || src ELSE '' END AS part FROM x),
b AS (SELECT *, length(part) + 5 + coalesce(sum(length(part)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 7 * greatest(0, row_number() OVER w - 2) <= 900 AS fits FROM p WHERE part <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY NOT tab, turn))
SELECT conv_id, count(*) AS parts, md5(string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY NOT tab, turn)) AS digest FROM (SELECT *, bool_and(fits) OVER (PARTITION BY conv_id ORDER BY NOT tab, turn) AS keep FROM b) WHERE keep GROUP BY 1""")
