"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import chunking, crawl, ranking, retrieval
from .registry import add, add_derived, add_many

add("X15_excerpt", "documents", lambda d: d.select("doc_id", scalars.excerpt(F.col("text"), F.lit(300), 120).alias("excerpt")), """SELECT doc_id, CASE WHEN n <= 120 THEN text ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || substr(text, s + 1, 120) || CASE WHEN s + 120 < n THEN '…' ELSE '' END END AS excerpt
    FROM (SELECT *, length(text) AS n, greatest(0, least(240, length(text) - 120)) AS s FROM documents)""")
add("X17_word_safe", "documents", lambda d: d.select("doc_id", scalars.word_safe(F.col("text"), 200).alias("cut")), """SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN p > 0 AND 200 - p > 160 THEN substr(c, 1, (200 - p)::BIGINT) || '...' ELSE c || '...' END AS cut
    FROM (SELECT *, substr(text, 1, 200) AS c, instr(reverse(substr(text, 1, 200)), ' ') AS p FROM documents)""")
add("X21_noise", "documents", lambda d: d.select("doc_id", F.md5(scalars.without_noise(F.col("text"))).alias("digest")), r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'Pagina\s+\d+(\s+di\s+\d+)?', '', 'gi'),
    'Page\s+\d+(\s+of\s+\d+)?', '', 'gi'), '[-_]{5,}', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[ \t\x{00A0}]{5,}', ' ', 'g'), '(?m)^[.\-=\s]+$', '', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""")
add("X38_scripted", "pages", lambda p: p.select("page_id", scalars.is_scripted(F.col("html")).alias("scripted")), "SELECT page_id, " + " OR ".join(f"contains(lower(html), '{m}')" for m in scalars.SCRIPTED) + " AS scripted FROM pages")
add("X46_slug", "pages", lambda p: p.select("page_id", scalars.slug(F.col("url")).alias("slug")), r"""SELECT page_id, CASE WHEN len(p) = 0 THEN 'index' ELSE substr(array_to_string(list_transform(CASE WHEN len(p) > 3 THEN p[len(p) - 2:] ELSE p END, lambda x: substr(regexp_replace(x, '[^a-z0-9]+', '-', 'g'), 1, 15)), '-'), 1, 60) END AS slug
    FROM (SELECT page_id, list_filter(string_split(lower(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', ''), '[?#].*$', '')), '/'), lambda x: length(x) > 0) AS p FROM pages)""")
add("X50_blend", "embeddings", lambda v: v.select("vec_id", F.round(F.aggregate(F.zip_with("embedding", F.reverse("embedding"), lambda a, b: 0.6 * a.cast("double") + 0.4 * b.cast("double")), F.lit(0.0), lambda s, x: s + x * x), 6).alias("energy")),
    "SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda x: (0.6::DOUBLE * x[1]::DOUBLE + 0.4::DOUBLE * x[2]::DOUBLE) * (0.6::DOUBLE * x[1]::DOUBLE + 0.4::DOUBLE * x[2]::DOUBLE))), 6) AS energy FROM embeddings")
add("X65_italian", "documents", lambda d: d.select("doc_id", scalars.is_italian(F.col("text")).alias("italian")), "SELECT doc_id, " + " + ".join(rf"regexp_matches(lower(text), '\b{w}\b')::INT" for w in scalars.ITALIAN) + " >= 3 AS italian FROM documents")
add("X72_answer_key", "conversations", lambda c: c.select("conv_id", "turn", F.concat(F.lit("t1:"), "role", F.lit(":"), F.substring(F.sha2("text", 256), 1, 16)).alias("key")), "SELECT conv_id, turn, 't1:' || role || ':' || substr(sha256(text), 1, 16) AS key FROM conversations")
add("X73_duration", "part", lambda p: p.select("p_partkey", scalars.duration((F.col("p_partkey") * 7 % 200).cast("long")).alias("took")), "SELECT p_partkey, CASE WHEN m = 0 THEN 'N/A' WHEN m >= 60 THEN (m // 60) || 'h ' || (m % 60) || 'm' ELSE m || 'm' END AS took FROM (SELECT p_partkey, p_partkey * 7 % 200 AS m FROM part)")
add("X74_overdue", "orders", lambda o: o.select("o_orderkey", ((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.lit("2001-07-01").cast("timestamp_ntz"))).alias("overdue")), "SELECT o_orderkey, o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '2001-07-01' AS overdue FROM orders")
add("X77_similar_words", "part", lambda p: p.select("p_partkey", scalars.similar_words(F.split("p_name", " ")[0], F.element_at(F.split("p_name", " "), -1)).alias("similar")), """SELECT p_partkey, length(a) >= 4 AND length(b) >= 4 AND (a[:4] = b[:4] OR a[-4:] = b[-4:] OR (length(a) <= 8 AND length(b) <= 8 AND levenshtein(a, b) <= 2)) AS similar
    FROM (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[-1] AS b FROM part)""")
add("X78_scores", "pages", lambda p: p.select("page_id", F.array_join(scalars.scores(F.col("url"), 3), ",").alias("scores")), r"""SELECT page_id, array_to_string(list_transform([0, 1, 2], lambda i: CASE WHEN i < len(f) THEN least(100, f[i + 1]::HUGEINT) ELSE 50 END), ',') AS scores FROM (SELECT page_id, regexp_extract_all(url, '\d+') AS f FROM pages)""")
add("E10_emails", "documents", lambda d: d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"), 0))).alias("email")), r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}')) AS email FROM documents")
add("E14_bare_urls", "documents", lambda d: d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"https?://[A-Za-z0-9./_-]+"), 0))).alias("url")), "SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, 'https?://[A-Za-z0-9./_-]+')) AS url FROM documents")
add("E8_label_line", "documents", lambda d: d.select("doc_id", F.get(F.filter(F.split("text", "\n"), lambda x: F.contains(F.lower(x), F.lit("les"))), 0).alias("line")).filter("line is not null"), "SELECT doc_id, line FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'les'))[1] AS line FROM documents) WHERE line IS NOT NULL")
# the address of a link: absolute, with the page's scheme, below its host or below its folder; no other schemes
_ORIGIN = "regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)"
_FOLDER = f"coalesce(nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([a-zA-Z]+://[^/]+.*/)[^/]*$', 1), ''), {_ORIGIN} || '/')"
TARGET = f"""CASE WHEN regexp_matches(bare, '^https?://') THEN bare WHEN starts_with(bare, '//') THEN regexp_extract(url, '^([a-zA-Z]+):', 1) || ':' || bare WHEN regexp_matches(bare, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL
    WHEN starts_with(bare, '/') THEN {_ORIGIN} || bare WHEN length(bare) > 0 THEN {_FOLDER} || bare END"""
LINKS = f"""hrefs AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, 'href="([^"]+)"', 1)))) AS position FROM pages),
links AS (SELECT page_id, url, href, position, {TARGET} AS target FROM (SELECT *, regexp_replace(href, '#.*$', '') AS bare FROM hrefs))"""
add("X45_resolve", "pages", lambda p: p.select("page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1))).alias("href")).select("page_id", "href", scalars.resolve(F.col("href"), F.col("url")).alias("target")), f"WITH {LINKS} SELECT DISTINCT page_id, href, target FROM links")
add("C2_paragraph_chunks", "documents", lambda d: chunking.chunks(d.select("doc_id", "text"), "text", 1_500, 200).select("doc_id", "chunk_index", F.md5("content").alias("digest")), None)
add("C3_sentence_chunks", "documents", lambda d: chunking.chunks(d.select("doc_id", "text"), "text", 1_500, 200, "sentence").select("doc_id", "chunk_index", F.md5("content").alias("digest")), None)
add("C9_without_tables", "documents", lambda d: d.select("doc_id", F.md5(chunking.without_tables(F.col("text"))).alias("digest")), "SELECT doc_id, md5(coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) < 2 AND length(trim(x)) > 0), chr(10)), '')) AS digest FROM documents")
# the same over texts with tables of three kinds
_TABLES = r"""'before' || chr(10) || '| Name | Phone |' || chr(10) || '|---|:--:|' || chr(10) || '| Ada ' || doc_id || ' | 06 1 |' || chr(10) || '| | only |' || chr(10) || 'between | one' || chr(10) || 'a|b|c' || chr(10) || '1|2|3|4' || chr(10) || '|x|'
    || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'a lone | row | here' || chr(10) || substr(text, 1, 300) ELSE '' END"""
_CELLS = lambda c: rf"list_transform(string_split(regexp_replace({c}, '^\s*\||\|\s*$', '', 'g'), '|'), lambda x: trim(x))"
_FLAT = rf"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, unnest(range(len(string_split(text, chr(10))))) AS at_line FROM t),
r AS (SELECT *, at_line - row_number() OVER (PARTITION BY doc_id ORDER BY at_line) AS run FROM l WHERE length(c) - length(replace(c, '|', '')) >= 2),
n AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n FROM r) WHERE n > 1 AND NOT regexp_matches(c, '^[\s|:-]+$')),
k AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY run)::INT AS "table", row_number() OVER (PARTITION BY doc_id, run ORDER BY at_line)::INT AS line, {_CELLS('trim(c)')} AS v FROM n)
SELECT b.doc_id, b."table", b.line, coalesce(array_to_string(list_filter(list_transform(range(1, greatest(len(h.v), len(b.v)) + 1), lambda i: CASE WHEN length(b.v[i]) > 0 THEN coalesce(h.v[i] || ': ', '') || b.v[i] END), lambda x: x IS NOT NULL), '; '), '') AS flat
FROM k b JOIN k h ON h.doc_id = b.doc_id AND h."table" = b."table" AND h.line = 1 WHERE b.line > 1"""
add("X26_flat_tables", "documents", lambda d: chunking.flat_tables(d, "doc_id", "text"), f"WITH t AS (SELECT doc_id, text FROM documents), {_FLAT}")
add_derived("X26_flat_contacts", {"t": f"SELECT doc_id, {_TABLES} AS text FROM documents"}, lambda t: chunking.flat_tables(t, "doc_id", "text"), "," + _FLAT)
add("G1_reach", "pages", lambda p: crawl.reach(crawl.links(p), p.filter(F.contains("url", F.lit("utm_source=feed"))).select("url"), 2), f"""WITH {LINKS}, seeds AS (SELECT DISTINCT url FROM pages WHERE contains(url, 'utm_source=feed')),
    one AS (SELECT DISTINCT target AS url FROM links WHERE target <> url AND url IN (SELECT url FROM seeds) AND target NOT IN (SELECT url FROM seeds)),
    two AS (SELECT DISTINCT target AS url FROM links WHERE target <> url AND url IN (SELECT url FROM one) AND target NOT IN (SELECT url FROM seeds UNION ALL SELECT url FROM one))
    SELECT url, 0 AS depth FROM seeds UNION ALL SELECT url, 1 FROM one UNION ALL SELECT url, 2 FROM two""")


def _reranked(b: DataFrame, d: DataFrame) -> DataFrame:
    """The lexical ten of every query in the order of the lexical score."""
    found = retrieval.lexical_top_k(b.select(F.col("item_id").alias("query_id"), "text"), d, 10)
    texts = found.join(d.select("doc_id", "text"), "doc_id").join(b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    total = F.count("*").over(Window.partitionBy("query_id"))
    scored = texts.withColumn("points", F.round(ranking.lexical_score(F.col("query"), F.col("text"), F.col("rank") - 1, total), 6))
    return ranking.rerank(scored.select("query_id", "doc_id", "points"), "query_id", F.desc("points"), F.col("doc_id"))


add_many("R8_lexical_rerank", ["benchmark", "documents"], _reranked, None)
