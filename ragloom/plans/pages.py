"""Pages: Markdown, main content, density extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..operators import page_markdown, page_tree
from .registry import add


def _markdown(pages: DataFrame) -> DataFrame:
    text = page_markdown.to_markdown(F.col("html"), F.col("url"))
    return pages.select("page_id", text.alias("markdown")).select("page_id", F.length("markdown").alias("length"), F.md5("markdown").alias("digest"))


def _main_content(pages: DataFrame) -> DataFrame:
    return page_tree.cleaned(pages.select("page_id", "html")).select("page_id", "selector", "tag", "pre", F.md5("content").alias("digest"))


def _extracted(pages: DataFrame) -> DataFrame:
    return page_markdown.extracted(pages).select("page_id", "selector", F.octet_length("markdown").alias("bytes"), F.md5("markdown").alias("digest"))


def _by_density(pages: DataFrame) -> DataFrame:
    found = page_markdown.by_density(pages)
    return found.select("page_id", "pre", "tag", F.round("points", 6).alias("points"), F.round("link_share", 6).alias("link_share"), F.md5("markdown").alias("digest"), "passed")


add("X29_markdown", "pages", _markdown, None)
add("X37_main_content", "pages", _main_content, None)
add("X35_extracted", "pages", _extracted, None)
add("X40_density", "pages", _by_density, None)

_HOISTED = "html"
for _name in page_tree.COMPONENTS:
    _HOISTED = f"""replace(replace({_HOISTED}, '<app-{_name}>', '<div class="{"app-switcher" if _name == "switcher" else _name}">'), '</app-{_name}>', '</div>')"""
add("X39_hoisted", "pages", lambda p: p.select("page_id", F.md5(page_tree.hoisted(F.col("html"))).alias("digest")), rf"""
SELECT page_id, md5(CASE WHEN found NOT IN ('', '0') THEN '<div class="main-content">' || found || '</div>' ELSE '' END || plain) AS digest
FROM (SELECT page_id, regexp_extract(html, '(?s)<div class="testolungo[^"]*"[^>]*>(.*?)</div>', 1) AS found, {_HOISTED} AS plain FROM pages)""")

_BLANK = r"[ \t\n\x0B\f\r]"
_TRIM = r"'^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$', '', 'g'"
add("X35_lines", "documents", lambda d: d.select("doc_id", F.md5(markup.filtered_lines(F.col("text"))).alias("digest")), rf"""
WITH lines AS (SELECT doc_id, list_transform(string_split(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{_BLANK}*\n{_BLANK}*\n+', chr(10) || chr(10), 'g'), chr(10)),
    lambda x: {{'raw': x, 'cut': regexp_replace(x, {_TRIM})}}) AS l FROM documents)
SELECT doc_id, md5(regexp_replace(array_to_string(list_transform(list_filter(l, lambda x: x.cut = '' OR regexp_matches(x.cut, '^(#{{1,6}}{_BLANK}|[-*+]{_BLANK}|>{_BLANK}|```)')
    OR regexp_matches(x.cut, '(?i)(^|{_BLANK})tel[:.]?{_BLANK}*\+?[0-9]') OR regexp_matches(x.cut, '(^|[^0-9])(\+39{_BLANK}*)?(0[0-9]{{1,3}}|3[0-9]{{2}})[-. \t\n\x0B\f\r]?[0-9]{{2,4}}[-. \t\n\x0B\f\r]?[0-9]{{3,4}}($|[^0-9])')
    OR regexp_matches(x.cut, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') OR strlen(x.cut) >= 10), lambda x: x.raw), chr(10)), {_TRIM})) AS digest FROM lines""")
