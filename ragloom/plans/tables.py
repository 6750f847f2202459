"""Pipe tables and directories in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables
from .registry import add

_STRIP = r"regexp_replace({}, '^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$', '', 'g')".format
_LINES = """l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, lines, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM l)"""
_TABLES = f"""WITH {_LINES}, t AS (SELECT doc_id, any_value(lines) AS lines, min(i) AS s, max(i) AS e, count(*) AS n FROM
    (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM x WHERE length(line) - length(replace(line, '|', '')) >= 2) GROUP BY doc_id, g HAVING count(*) > 1),
f AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS "table", s::INT AS start_line, n::INT AS rows, (length(lines[s + 1]) - length(replace(lines[s + 1], '|', '')) - 1)::INT AS cols,
    array_to_string(lines[s + 1:e + 1], chr(10)) AS content, {_STRIP("array_to_string(lines[greatest(s - 2, 0) + 1:s], chr(10))")} AS context_before, {_STRIP("array_to_string(lines[e + 2:e + 3], chr(10))")} AS context_after FROM t)"""
add("E15_tables", "documents", lambda d: tables.find_tables(d, "doc_id", "text").select("doc_id", "table", "start_line", "rows", "cols", F.md5("content").alias("content"), F.md5("context_before").alias("before"), F.md5("context_after").alias("after")),
    _TABLES + ' SELECT doc_id, "table", start_line, rows, cols, md5(content) AS content, md5(context_before) AS before, md5(context_after) AS after FROM f')
add("C6_table_chunks", "documents", lambda d: tables.chunk_tables(d, "doc_id", "text").select("doc_id", "table", "part", "kind", F.md5("content").alias("digest")), None)
_PHONE = tables.PHONE.replace("'", "''")
_DIRECTORY = f"""n AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, count(*) OVER (PARTITION BY doc_id) AS lines, regexp_matches(line, '{_PHONE}') AS p FROM (SELECT doc_id, i, {_STRIP("line")} AS line FROM x) WHERE line <> ''),
w AS (SELECT *, lag(line) OVER o AS l1, lag(p) OVER o AS p1, lag(line, 2) OVER o AS l2, lag(p, 2) OVER o AS p2, lead(line) OVER o AS l3, lead(p) OVER o AS p3 FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT DISTINCT doc_id, coalesce(CASE WHEN NOT p1 THEN l1 END, CASE WHEN NOT p2 THEN l2 END, '') AS name, array_to_string(list_transform(regexp_extract_all(line, '{_PHONE}'), lambda m: trim(m)), ' / ') AS phones, coalesce(CASE WHEN NOT p3 THEN l3 END, '') AS address FROM w WHERE p AND lines >= 3),
g AS (SELECT *, concat_ws(chr(10), CASE WHEN name <> '' THEN 'Nome: ' || name END, CASE WHEN phones <> '' THEN 'Telefono: ' || phones END, CASE WHEN address <> '' THEN 'Indirizzo: ' || address END) AS content FROM e),
h AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS entries FROM g WHERE length(content) >= 15)
SELECT doc_id, phones, md5(content) AS digest FROM h WHERE entries >= 2"""
add("E16_directory", "documents", lambda d: d.select("doc_id", F.explode(tables.directory_entries(F.col("text"))).alias("e")).select("doc_id", "e.phones", F.md5("e.content").alias("digest")), f"WITH {_LINES}, {_DIRECTORY}")
add("X22_boilerplate", "documents", lambda d: d.select("doc_id", F.md5(tables.without_boilerplate(F.coalesce("text", F.lit("")))).alias("digest")),
    "SELECT doc_id, md5(" + _STRIP(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?m)^#\s+[a-z0-9\-.]+\s*$', '', 'g'), '(?m)^\*\*URL:\*\*.*$', '', 'g'), '(?m)^\*\*Scraped on:\*\*.*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + ") AS digest FROM documents")
add("C7_chunks_by_source", "documents", lambda d: tables.chunk_by_source(d, "doc_id", "text", F.col("source") == "web", 1_500, 200).select("doc_id", "kind", "part", F.md5("content").alias("digest")), None)
