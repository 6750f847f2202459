"""Routing with skills, settings over layers, pages to fetch again, required terms, keys of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hours
from ..operators import crawl, routing, settings, text
from .registry import add, add_derived

#: Pending orders ask for the segment of their customer and, every other one, for a language; suppliers have two segments each.
_SEGMENTS = "'AUTOMOBILE,BUILDING,FURNITURE,MACHINERY,HOUSEHOLD'"
_REQUESTS = """SELECT o_orderkey AS request_id, c_nationkey AS tenant, c_mktsegment AS wanted, CASE WHEN o_orderkey % 2 = 0 THEN 'it' END AS liked,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' ELSE 'normal' END AS priority, o_orderpriority AS level, o_orderdate AS requested_at FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'"""
_OPERATORS = f"""SELECT s_suppkey AS operator_id, s_nationkey AS tenant, split_part({_SEGMENTS}, ',', CAST(s_suppkey % 5 AS INT) + 1) AS a, split_part({_SEGMENTS}, ',', CAST(s_suppkey % 3 AS INT) + 3) AS b, CASE WHEN s_suppkey % 4 = 0 THEN 'it' ELSE 'en' END AS c,
    CAST(s_suppkey % 3 AS INT) AS load, CAST(s_suppkey % 7 AS INT) AS most, CAST(s_suppkey % 14 AS DOUBLE) AS minutes, CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_suppkey % 9 AS DOUBLE) / 2 + 1 END AS rating, s_suppkey % 80 AS handled FROM supplier"""


def _sides(r: DataFrame, o: DataFrame) -> tuple[DataFrame, DataFrame]:
    asked = r.withColumns({"required": F.array("wanted"), "preferred": F.when(F.col("liked").isNotNull(), F.array("liked"))})
    return asked, o.withColumn("skills", F.array("a", "b", "c"))


_BEST = """SELECT request_id, operator_id, round(skill + free + response + satisfaction + bonus, 6) AS score FROM (SELECT request_id, operator_id,
    least(30.0::DOUBLE, CASE WHEN list_contains([a, b, c], wanted) THEN 20.0::DOUBLE ELSE 0 END + CASE WHEN list_contains([a, b, c], liked) THEN 10.0::DOUBLE ELSE 0 END) AS skill, (1 - load / most::DOUBLE) * 25 AS free,
    CASE WHEN minutes <= 2 THEN 20.0::DOUBLE WHEN minutes <= 10 THEN 20 - (minutes - 2) / 8 * 20 ELSE 0 END AS response,
    CASE WHEN coalesce(rating, 3.5) >= 4.5 THEN 15 WHEN coalesce(rating, 3.5) >= 4 THEN 12 WHEN coalesce(rating, 3.5) >= 3.5 THEN 8 WHEN coalesce(rating, 3.5) >= 3 THEN 5 ELSE 0 END AS satisfaction,
    CASE WHEN priority = 'urgent' AND handled > 50 THEN 10 WHEN priority = 'high' AND handled > 20 THEN 5 ELSE 0 END AS bonus FROM r JOIN o USING (tenant) WHERE load < most)"""
add_derived("J16_suited_operator", {"r": _REQUESTS, "o": _OPERATORS}, lambda r, o: routing.best_operator(*_sides(r, o)), f"SELECT request_id, operator_id, score FROM ({_BEST}) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, operator_id) = 1")
add_derived("J17_assigned_by_rounds", {"r": _REQUESTS, "o": _OPERATORS}, lambda r, o: routing.assign(*_sides(r, o), ["level", "requested_at"]), None)

_DEFAULTS = {"hybrid": {"vector_top_k": 40, "bm25_top_k": 80, "mmr_lambda": 0.25}, "answer": {"min_citations": 1, "fallback": "none"}, "features": {"hyde": False}}
_TENANTS = """SELECT c_custkey AS tenant, CASE c_nationkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'shop' END AS profile, CASE c_custkey % 4 WHEN 0 THEN '{"hybrid": {"vector_top_k": ' || (c_custkey % 90) || '}, "answer": {"fallback": "' || c_mktsegment || '"}}'
    WHEN 1 THEN '{"features": {"hyde": true}, "extra": {"a": {"b": ' || c_custkey || '}}}' WHEN 2 THEN 'no json' END AS settings FROM customer"""
_PROFILES = """SELECT 'public' AS profile, '{"hybrid.vector_top_k": 60, "answer.min_citations": 2}' AS overrides UNION ALL SELECT 'shop', '{"hybrid.mmr_lambda": 0.5, "features.hyde": true}'"""
_PATHS = ("hybrid.vector_top_k", "hybrid.bm25_top_k", "hybrid.mmr_lambda", "answer.min_citations", "answer.fallback", "features.hyde", "extra.a.b")


def _settings(t: DataFrame, p: DataFrame) -> DataFrame:
    found = settings.resolved(t, p, _DEFAULTS)
    return found.select("tenant", *(settings.value(F.col("resolved"), x).alias(x.replace(".", "_")) for x in _PATHS))


def _layered(path: str) -> str:
    section, _, key = path.partition(".")
    default = str(_DEFAULTS.get(section, {}).get(key, "")).lower()
    own = f"json_extract_string(own, '$.{path}')"
    profile = f"""json_extract_string(overrides, '$."{path}"')"""
    return f"coalesce({own}, {profile}, nullif('{default}', '')) AS {path.replace('.', '_')}"


add_derived("J20_settings", {"t": _TENANTS, "p": _PROFILES}, _settings, f"SELECT tenant, {', '.join(map(_layered, _PATHS))} FROM (SELECT tenant, overrides, CASE WHEN json_valid(settings) THEN settings END AS own FROM t LEFT JOIN p USING (profile))")

_KNOWN = "SELECT CASE WHEN page_id % 5 > 0 THEN url ELSE url || '/old' END AS url, CASE WHEN page_id % 11 > 0 THEN TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' HOUR * (page_id * 7 % 1000) END AS scraped_at FROM pages UNION ALL SELECT url, TIMESTAMP '2023-12-01 00:00:00' FROM pages"
add_derived("F15_to_fetch", {"c": "SELECT page_id, url FROM pages", "k": _KNOWN}, lambda c, k: crawl.to_fetch(c, k, F.lit("2024-01-31 00:00:00").cast("timestamp"), 14).select("page_id", "url"),
    "SELECT page_id, url FROM c WHERE url NOT IN (SELECT url FROM k GROUP BY url HAVING max(scraped_at) > TIMESTAMP '2024-01-17 00:00:00')")
add("F16_required_any", "documents", lambda d: d.filter(text.holds_required(F.col("text"), ["les", "Ufficio", "of", "que"], hours.GENERIC)).select("doc_id"), "SELECT doc_id FROM documents WHERE contains(lower(text), 'les') OR contains(lower(text), 'que')")
add("X48_dedup_keys", "pages", lambda p: p.select("page_id", text.dedup_key(F.col("html"), F.col("url")).alias("dedup_key")), "SELECT page_id, sha1(lower(trim(html || '|' || url))) AS dedup_key FROM pages")
