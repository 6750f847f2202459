"""Links in Markdown that is put together from given pages, and names with synonyms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import links
from .registry import PARTS, add_derived

_TEXT = """SELECT page_id AS id, CASE WHEN page_id % 7 > 0 THEN url END AS source, 'Comune [' || (page_id % 9) || '](https://x.org/?page=' || page_id || ') [pagina](' || url || ') [Home](/) [clicca qui](https://m.example.org/' || (page_id % 5) || ')'
    || CASE page_id % 6 WHEN 0 THEN ' [legge](https://www.normattiva.it/a) [x y](http://a b)' WHEN 1 THEN ' [[doppio](http://a.org)](http://b.org) [#](x)' WHEN 2 THEN ' [altro testo](https://altro.example/...) [t](http://a.org "titolo")'
    WHEN 3 THEN ' [script](javascript:go()) [sezione](#top)' WHEN 4 THEN ' [orari](' || url || ' ) [vai](http:' || chr(92) || '/' || chr(92) || '/c.org)' ELSE '' END AS text FROM pages"""
# the same in the other engine; back references are \1 there
_CLEAN = "text"
for _p in links.NAVIGATION:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '', 'g')"
_EACH = rf"list_transform(range(1, len(regexp_extract_all({{c}}, '{links.LINK}')) + 1), lambda i: {{{{'w': regexp_extract_all({{c}}, '{links.LINK}')[i], 't': regexp_extract_all({{c}}, '{links.LINK}', 1)[i], 'u': regexp_extract_all({{c}}, '{links.LINK}', 2)[i]}}}})"
_AT = lambda u: f"nullif(regexp_extract({u}, '{links._HOST}', 1), '')"
_LISTED = " OR ".join(f"contains({_AT('x.u')}, '{d}')" for d in links.ALLOWED)
_GENERIC = " OR ".join(f"contains(lower(x.t), '{g}')" for g in links.GENERIC)
_DROP = "list_reduce(list_prepend({c}, list_transform(list_filter({each}, lambda x: {goes}), lambda x: x.w || chr(0) || x.t)), lambda a, b: replace(a, split_part(b, chr(0), 1), split_part(b, chr(0), 2)))"
_FOREIGN = _DROP.format(c="a", each=_EACH.format(c="a"), goes=f"coalesce({_AT('x.u')} <> own AND NOT ({_LISTED}), FALSE)")
_IRRELEVANT = _DROP.format(c="c", each=_EACH.format(c="c"), goes=f"(({_GENERIC}) OR strlen(trim(x.t)) < 5) AND NOT (contains(lower(x.t), 'orari') OR contains(lower(x.u), 'orari') OR contains(lower(x.t), 'legge') OR contains(lower(x.u), 'legge'))")
_MALFORMED = r"""regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(b, '\[\[([^\]]+)\]\([^)]+\)\]\([^)]+\)', '[\1]', 'g'), '\/', '/'), '\[([^\]]+)\]\(([^")]+)"[^)]*"\)', '[\1](\2)', 'g'),
    '\[([^\]]+)\]\(([^)]+)\]\([^)]+\)', '[\1](\2)', 'g'), '\[([^\]]+)\]\([^)]*\s[^)]*\)', '\1', 'g')"""


def _filtered(p):
    text = links.without_malformed(links.without_foreign(links.without_navigation(F.col("text")), F.col("source")))
    # step by step, so that each is computed once
    kept = p.withColumn("text", text).withColumn("text", links.without_irrelevant(F.col("text"), F.array(F.lit("orari"), F.lit("legge"))))
    return kept.select("id", links.with_source(F.col("text"), F.col("source")).alias("text"))


add_derived("X52_filtered_links", {"p": _TEXT}, _filtered, rf"""SELECT id, d || CASE WHEN source IS NOT NULL AND regexp_matches(d, '\[[^\]]+\]\([^)]+\)') THEN chr(10) || chr(10) || '💡 Fonte: ' || source ELSE '' END AS text
FROM (SELECT *, {_IRRELEVANT} AS d FROM (SELECT *, {_MALFORMED} AS c FROM (SELECT *, CASE WHEN own IS NULL THEN a ELSE {_FOREIGN} END AS b FROM (SELECT *, {_CLEAN} AS a, {_AT('source')} AS own FROM p))))""")

_RELATED = lambda c: "(" + " OR ".join(f"contains({c}, '{k}')" for k in links.RELEVANT) + ")"
add_derived("X81_link_issues", {"p": _TEXT.replace("'Comune [", "CASE WHEN page_id % 2 = 0 THEN 'Comune [' ELSE 'Pagina [' END || '[")}, lambda p: p.select("id", F.array_join(links.issues(F.col("text"), F.col("source")), ",").alias("issues")), rf"""
SELECT id, concat_ws(',', CASE WHEN coalesce(source, '') = '' THEN 'no_source' END, CASE WHEN len(list_filter(l, lambda x: {_AT('x.u')} <> {_AT('source')})) > 0 THEN 'cross_domain' END,
    CASE WHEN len(list_filter(l, lambda x: NOT {_RELATED('lower(x.t)')} AND NOT {_RELATED('lower(text)')} AND strlen(x.t) > 5)) > 0 THEN 'unrelated' END,
    CASE WHEN len(list_filter(l, lambda x: NOT regexp_matches(x.u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/?#]+\S*$') AND NOT regexp_matches(x.u, '^mailto:.+@.+$'))) > 0 THEN 'malformed' END,
    CASE WHEN len(list_filter(l, lambda x: contains(x.u, '...') OR ends_with(x.u, '.'))) > 0 THEN 'truncated' END) AS issues FROM (SELECT *, {_EACH.format(c="text")} AS l FROM p)""")

_VALID = r"(regexp_matches(x.u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/?#]+\S*$') OR regexp_matches(x.u, '^mailto:.+@.+$'))"
_TURNS = " OR ".join(f"contains(lower(x.t), '{t}')" for t in links.TURNING)
add_derived("A27_link_totals", {"p": f"SELECT id % 20 AS tenant, source, text FROM ({_TEXT})"}, lambda p: links.quality(p, "text", "source", "tenant"), rf"""
SELECT tenant, count(*) AS citations, sum(links)::BIGINT AS links, sum(a)::BIGINT AS cross_domain, sum(b)::BIGINT AS navigation, sum(c)::BIGINT AS malformed, sum(d)::BIGINT AS relevant, round(CASE WHEN sum(links) > 0 THEN sum(d) / sum(links)::DOUBLE * 100 ELSE 0 END, 1) AS score
FROM (SELECT tenant, len(l) AS links, len(list_filter(l, lambda x: {_AT('x.u')} <> {_AT('source')})) AS a, len(list_filter(l, lambda x: {_TURNS} OR regexp_matches(trim(x.t), '^\d+$') OR contains(x.u, 'pag=') OR contains(x.u, 'page='))) AS b,
    len(list_filter(l, lambda x: NOT {_VALID} OR contains(x.u, ' '))) AS c, len(list_filter(l, lambda x: NOT (({_GENERIC}) OR strlen(trim(x.t)) < 5) AND {_VALID})) AS d FROM (SELECT *, {_EACH.format(c="text")} AS l FROM p)) GROUP BY 1""")

_SYNONYMS = {"ring": "anello, cerchio", "blue bolt": "vite blu", "bolt": "vite", "gear": ""}
add_derived("X5_expanded_names", {"p": PARTS[1:-1]}, lambda p: p.select("k", links.expanded_name(F.col("text"), _SYNONYMS).alias("name")), """SELECT k, CASE WHEN contains(text, 'blue bolt') THEN text || ' vite blu vite blu' WHEN contains(text, 'ring') THEN text || ' anello cerchio anello, cerchio'
    WHEN contains(text, 'bolt') THEN text || ' vite' ELSE text END AS name FROM p""")
