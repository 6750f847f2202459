"""Titles, Markdown, schedules, phones and form fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup
from ..operators import page_quality
from .page_quality import _SQL
from .registry import PARTS, add, add_derived, spread


def _decoded(c: str) -> str:
    for a, b in markup.ENTITIES.items():
        c = "replace({}, '{}', '{}')".format(c, a, b.replace("'", "''"))
    return c


add("X18_sentence_safe", "documents", lambda d: d.select("doc_id", F.md5(markup.sentence_safe(F.coalesce("text", F.lit("")))).alias("digest")), r"""SELECT doc_id, md5(CASE WHEN length(t) <= 800 THEN t WHEN contains(h, '.') AND length(h) - instr(reverse(h), '.') > 500 THEN substr(t, 1, length(h) - instr(reverse(h), '.') + 1) ELSE h || '...' END) AS digest
    FROM (SELECT doc_id, t, substr(t, 1, 750) AS h FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents))""")
_TITLES = "SELECT * FROM (VALUES (1, 'Orari &amp; <b>contatti</b>  (Scraped)'), (2, '  &lt;i&gt; &quot;x&quot; '), (3, NULL), (4, '(scraped)'), (5, 'Caff&#39;è  due')) AS t(id, title)"
add_derived("X19_clean_title", {"c": spread(_TITLES, 5, "title", "(SELECT page_id AS k, regexp_extract(html, '<title>([^<]*)</title>', 1) AS text FROM pages)", "k", "title")}, lambda c: c.select("id", markup.clean_title(F.col("title")).alias("title")),
    rf"SELECT id, nullif(trim(regexp_replace(regexp_replace(regexp_replace({_decoded('title')}, '<[^>]*>', '', 'g'), '(?i)\s*\(Scraped\)$', '', 'g'), '[\s ]+', ' ', 'g')), '') AS title FROM c")
_INNER = lambda p, g: rf"list_filter(list_transform(regexp_extract_all(html, '{p}', {g}), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'))), lambda x: x <> '')"
_TITLE = _INNER(r"(?is)<title\b[^>]*>(.*?)</title>", 1) + "[1]"
_CLEAN = lambda raw: rf"nullif(trim(substr(regexp_replace(regexp_replace({_decoded(raw)}, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'), 1, 512)), '')"
add("X44_titles_by_strategy", "pages", lambda p: p.select("page_id", *(markup.page_title(F.col("html"), s).alias(s) for s in ("title", "h1", "h1_h2"))),
    f"SELECT page_id, {_CLEAN(_TITLE)} AS title, {_CLEAN('coalesce(' + _INNER(r'(?is)<h1[^>]*>(.*?)</h1>', 1) + '[1], ' + _TITLE + ')')} AS h1, {_CLEAN('coalesce(nullif(array_to_string(' + _INNER('(?is)<h1[^>]*>.*?</h1>|<h2[^>]*>.*?</h2>', 0) + chr(44) + chr(39) + ' ' + chr(39) + ')' + chr(44) + chr(39) * 2 + '), ' + _TITLE + ')')} AS h1_h2 FROM pages")
_ESCAPE = "text"
for _mark in markup.ESCAPED:
    _ESCAPE = f"replace({_ESCAPE}, '{_mark}', '\\{_mark}')"
add_derived("X31_escaped", {"c": "SELECT doc_id AS id, coalesce(text, '') || ' a*b_c [x](y) #1.5 - 2! Tel. 06.123' AS text FROM documents"}, lambda c: c.select("id", F.md5(markup.escape_markdown(F.col("text"))).alias("full"), F.md5(markup.escape_link_text(F.col("text"))).alias("link")),
    rf"SELECT id, md5(regexp_replace(replace({_ESCAPE}, '.', '\.'), '\\\.([0-9])', '.\1', 'g')) AS full, md5(replace(replace(replace(text, '\', '\\'), '[', '\['), ']', '\]')) AS link FROM c")
add("X36_clean_markdown", "documents", lambda d: d.select("doc_id", F.md5(markup.clean_markdown(F.coalesce("text", F.lit("")))).alias("digest")), r"""SELECT doc_id, md5(regexp_replace(coalesce(array_to_string(list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\[\s*\]\([^)]*\)', '', 'g'), '\[([^\]]+)\]\(\s*\)', '\1', 'g'), chr(10)),
    lambda x: strlen(trim(x)) > 3 AND regexp_matches(x, '\w')), chr(10)), ''), '^\s+|\s+$', '', 'g')) AS digest FROM documents""")
_EXTRACTED = """SELECT * FROM (VALUES (1, '| a | b |  [x](y) 06 1234 5678', '<table><tr><td>a</td></tr></table><a href="y">x</a> 06 1234 5678'), (2, '', '<a href="y">x</a><a href="z">w</a> 06 1234 5678'), (3, 'only words here', '<p>only words here and more</p>'), (4, '', '')) AS t(id, markdown, html)"""
_N = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
add_derived("X41_extraction_quality", {"c": spread(_EXTRACTED, 4, "markdown html", "(SELECT page_id AS k, html AS text FROM pages)", "k", "markdown html")}, lambda c: c.select("id", F.round(markup.extraction_quality(F.col("markdown"), F.col("html")), 6).alias("quality")), rf"""SELECT id, round(least(1.0::DOUBLE, CASE WHEN contains(html, '<table') AND contains(markdown, '|') THEN 0.3 ELSE 0 END::DOUBLE
    + CASE WHEN {_N('html', markup.PHONES)} > 0 THEN {_N('markdown', markup.PHONES)} / {_N('html', markup.PHONES)}::DOUBLE ELSE 1 END * 0.4::DOUBLE + CASE WHEN {_N('html', '<a ')} > 0 THEN {_N('markdown', r'\]\(')} / {_N('html', '<a ')}::DOUBLE ELSE 1 END * 0.2::DOUBLE
    + CASE WHEN n > 0 AND strlen(markdown) / n::DOUBLE > 0.3 AND strlen(markdown) / n::DOUBLE < 0.8 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN strlen(markdown) > 200 THEN 0.15 ELSE 0 END::DOUBLE), 6) AS quality FROM (SELECT *, strlen(regexp_replace(html, '<[^>]*>', '', 'g')) AS n FROM c)""")
add("X42_strategy", "pages", lambda p: page_quality.metrics(p).select("page_id", markup.extraction_strategy(F.col("complex_tables"), F.col("page_type"), F.col("quality"), F.col("structured"), F.col("relevance")).alias("strategy")),
    _SQL + "SELECT page_id, CASE WHEN complex_tables THEN 'manual_dom_primary' WHEN page_type = 'article_content' AND quality > 0.5 THEN 'readability_primary' WHEN structured AND relevance > 0.6 THEN 'hybrid_structured' WHEN quality < 0.3 THEN 'skip_low_quality' ELSE 'hybrid_default' END AS strategy FROM x")
add("E7_term_positions", "documents", lambda d: d.select("doc_id", F.array_join(markup.term_positions(F.lower(F.coalesce("text", F.lit(""))), ["the", "que ", "der", "of"], ("der",)), ",").alias("positions")),
    """SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_concat(a, b))), ','), '') AS positions FROM (SELECT doc_id, """ + ", ".join(
        f"list_transform(range(1, len(string_split(t, '{w}'))), lambda i: list_sum(list_transform(string_split(t, '{w}')[:i], lambda x: length(x)))::BIGINT + (i - 1) * {len(w)}) AS {n}" for w, n in (("the", "a"), ("que", "b"))) + " FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents))")
_HOURS = "SELECT p_partkey AS id, CASE WHEN p_size % 11 = 0 THEN 'x' ELSE CAST(p_size % 24 AS STRING) || ':00' END AS a, CAST((p_size * 7 + p_partkey) % 24 AS STRING) || CASE WHEN p_size % 2 = 0 THEN '.30' ELSE '' END AS b FROM part"
add_derived("X55_valid_hours", {"c": _HOURS}, lambda c: c.select("id", markup.valid_hours(F.col("a"), F.col("b")).alias("valid")),
    "SELECT id, x BETWEEN 7 AND 20 AND y BETWEEN 7 AND 20 AND x < y AS valid FROM (SELECT id, coalesce(try_cast(string_split(replace(a, '.', ':'), ':')[1] AS INT), 0) AS x, coalesce(try_cast(string_split(replace(b, '.', ':'), ':')[1] AS INT), 0) AS y FROM c)")
_DAYS = """SELECT p_partkey AS id, concat_ws(',', CASE WHEN p_size % 2 = 0 THEN 'martedì' WHEN p_size % 9 = 0 THEN 'Martedì' END, CASE WHEN p_size % 3 = 0 THEN 'venerdì' END, CASE WHEN p_size % 5 = 0 THEN 'giovedì' END, CASE WHEN p_partkey % 7 = 0 THEN 'lunedì' END) AS days FROM part"""
add_derived("X56_inferred_schedule", {"c": _DAYS}, lambda c: c.select("id", F.array_join(markup.inferred_schedule(F.split("days", ",")), "; ").alias("schedule")), """SELECT id, concat_ws('; ', CASE WHEN len(d) <= 3 AND (contains(lower(days), 'martedì') OR contains(days, 'venerdì')) THEN 'Martedì e Venerdì: 9:00-12:00 (orario inferito)' END, CASE WHEN len(d) <= 3 AND contains(days, 'giovedì') THEN 'Giovedì: 15:00-17:00 (orario inferito)' END,
    CASE WHEN list_contains(d, 'martedì') AND list_contains(d, 'venerdì') THEN 'Apertura: Martedì e Venerdì mattina, Giovedì pomeriggio' END) AS schedule FROM (SELECT id, days, string_split(days, ',') AS d FROM c)""")
_FORMS = """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '{"nome": "' || c_name || '", "email": "c' || c_custkey || '@example.org", "testo": "URGENTE"}' WHEN 1 THEN '{"Contact_email": "c' || c_custkey || '@example.org", "email": "no", "nickname": " ' || c_name || ' "}'
    WHEN 2 THEN '{"testo": "' || c_mktsegment || ' ho un problema"}' ELSE '{}' END AS data, CASE WHEN c_nationkey % 2 = 0 THEN 'auto' ELSE 'keyword' END AS trigger_type FROM customer"""
_MAP = lambda c: F.from_json(c, "map<string,string>")
_HOLDS = lambda words: "(" + " OR ".join(f"contains(lower(data), '{w}')" for w in words) + ")"
add_derived("X67_form_priority", {"c": _FORMS}, lambda c: c.select("id", markup.form_priority(F.col("data"), F.col("trigger_type")).alias("priority")), f"SELECT id, CASE WHEN {_HOLDS(markup.URGENT)} THEN 'urgent' WHEN {_HOLDS(markup.HIGH)} OR trigger_type = 'auto' THEN 'high' ELSE 'normal' END AS priority FROM c")
_MAIL = "regexp_matches({}, '" + markup.MAIL + "')"
add_derived("X68_form_fields", {"c": _FORMS}, lambda c: c.select("id", markup.user_mail(_MAP("data")).alias("mail"), markup.user_name(_MAP("data")).alias("name")), f"""SELECT id, coalesce(CASE WHEN {_MAIL.format("json_extract_string(data, '$.email')")} THEN json_extract_string(data, '$.email') END, CASE WHEN {_MAIL.format("json_extract_string(data, '$.Contact_email')")} THEN json_extract_string(data, '$.Contact_email') END) AS mail,
    trim(coalesce(json_extract_string(data, '$.nome'), json_extract_string(data, '$.nickname'))) AS name FROM c""")
_FIELDS = "SELECT * FROM (VALUES (1, 'email', 'a@b.co', TRUE, NULL, TRUE), (2, 'email', 'a@', TRUE, NULL, FALSE), (3, 'phone', '+39 06 (1) 2', FALSE, NULL, TRUE), (4, 'phone', '06a', FALSE, NULL, FALSE), (5, 'date', '2024-02-30', FALSE, NULL, FALSE), (6, 'number', '1.5', TRUE, NULL, TRUE), (7, 'select', 'b', TRUE, 'a,b', TRUE), (8, 'select', 'c', TRUE, 'a,b', FALSE), (9, 'text', '', TRUE, NULL, FALSE), (10, 'text', NULL, FALSE, NULL, TRUE)) AS t(id, kind, value, required, options, valid)"
add_derived("X69_valid_fields", {"c": spread(_FIELDS, 10, "kind value required options valid", "part", "p_partkey")}, lambda c: c.select("id", markup.valid_field(*(F.col(x) for x in ("kind", "value", "required", "options"))).alias("valid")), r"""SELECT id, CASE WHEN coalesce(trim(value), '') = '' THEN NOT required WHEN kind = 'email' THEN regexp_matches(value, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+$')
    WHEN kind = 'phone' THEN regexp_matches(value, '^[+]?[-0-9 ()]+$') WHEN kind = 'date' THEN try_cast(value AS DATE) IS NOT NULL WHEN kind = 'number' THEN try_cast(value AS DOUBLE) IS NOT NULL
    WHEN kind = 'select' AND coalesce(options, '') <> '' THEN list_contains(string_split(options, ','), value) ELSE TRUE END AS valid FROM c""")
_NUMBERS = "SELECT * FROM (VALUES (1, '06 1234567', 'tel. 06 1234567', FALSE), (2, '118', 'chiama il 118', FALSE), (3, '01234567890', 'P.IVA 01234567890', TRUE), (4, '12/03/2024', 'il 12/03/2024', TRUE), (5, '10.30', 'ore 10.30', TRUE), (6, '00100', 'CAP 00100 Roma', TRUE), (7, '331234567', '€ 331234567', TRUE), (8, '12345', 'codice 12345', TRUE), (9, '+39 333 1234567', 'cell. +39 333 1234567', FALSE), (10, '555 123 456', 'chiama 555 123 456', TRUE)) AS t(id, match, around, unlikely)"
add_derived("X54_unlikely_phones", {"c": spread(_NUMBERS, 10, "match around unlikely", PARTS, "k", "around")}, lambda c: c.select("id", markup.unlikely_phone(F.col("match"), F.col("around")).alias("unlikely")), "SELECT id, unlikely FROM c")
_SYNONYMS = {"tel": "telefono, cellulare", "orario apertura": "sportello orari", "orario": "orari"}
_EXPANDED = "SELECT * FROM (VALUES (1, 'tel ufficio', 'tel ufficio telefono cellulare'), (2, 'Orario apertura', 'Orario apertura sportello orari'), (3, 'hotel', 'hotel'), (4, 'tel telefono', 'tel telefono cellulare')) AS t(id, query, expanded)"
_ENDED = f"SELECT id, query, substr(expanded, length(query) + 1) AS more FROM ({_EXPANDED})"
_EXPANDED_BY = f"SELECT id, query, query || more AS expanded FROM ({spread(_ENDED, 4, 'query more', PARTS, 'k', 'query')})"
add_derived("X4_synonyms", {"c": _EXPANDED_BY}, lambda c: c.select("id", markup.with_synonyms(F.col("query"), _SYNONYMS).alias("expanded")), "SELECT id, expanded FROM c")
