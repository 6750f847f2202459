"""Named queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, ranking, retrieval, text
from ..session import TABLES, load
from ..streaming import counters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, table: str, build: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    """A query over one table, with its SQL where there is one."""
    QUERIES[name] = lambda spark, sf_dir: build(load(spark, sf_dir, table))
    if sql:
        ORACLE[name] = sql


def add_derived(name: str, tables: dict[str, str], build: Callable[..., DataFrame], sql: str | None) -> None:
    """A query over tables in the shape of settings and requests, which SQL text (the same for Spark and DuckDB) makes of the given ones."""
    given = [t for t in TABLES if re.search(rf"\b{t}\b", " ".join(tables.values()))]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in given:
            load(spark, sf_dir, t).createOrReplaceTempView(t)
        return build(*(spark.sql(t) for t in tables.values()))

    QUERIES[name] = query
    if sql:
        ORACLE[name] = "WITH " + ", ".join(f"{k} AS ({t})" for k, t in tables.items()) + f" {sql}"


def spread(cases: str, n: int, columns: str, given: str, key: str, into: str = "", text: str = "text") -> str:
    """SQL: every row of ``given`` with one of the ``n`` cases (numbered by id), in turn; in every other round the row's own text follows in the columns ``into``."""
    own = f"' ' || replace(substr(g.{text}, 1, 60), chr(10), ' ')"
    cols = (f"CASE WHEN ((g.{key} - g.{key} % {n}) / {n}) % 2 = 0 THEN v.{c} ELSE v.{c} || {own} END AS {c}" if c in into.split() else f"v.{c}" for c in columns.split())
    return f"SELECT g.{key} AS id, {', '.join(cols)} FROM {given} g JOIN ({cases}) v ON v.id = g.{key} % {n} + 1"


#: Turns with a key of their own; parts with names in ASCII.
TURNS = "(SELECT conv_id * 1000 + turn AS k, coalesce(text, '') AS text FROM conversations)"
PARTS = "(SELECT p_partkey AS k, p_name AS text FROM part)"


def add_many(name: str, tables: list[str], build: Callable[..., DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(*(load(spark, sf_dir, t) for t in tables))
    if sql:
        ORACLE[name] = sql


def _error_rate(n: str) -> str:
    return f"round(CASE WHEN count(*) > 0 THEN 100.0::DOUBLE * count(*) FILTER (WHERE {n}) / count(*) ELSE 0 END, 2)"


add("A2_daily_trend", "events", analytics.daily_trend, """SELECT CAST(ts AS DATE) AS day, count(*) AS events, count(DISTINCT user_id) AS sessions,
    sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS messages, round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS avg_response FROM events GROUP BY 1""")
add("A1_usage", "events", analytics.usage, f"""SELECT count(*) AS events, count(DISTINCT user_id) AS sessions, count(*) FILTER (WHERE event_type = 'signup') AS opened,
    count(*) FILTER (WHERE event_type = 'click') AS messages, round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS avg_response, round(sum(value), 4) AS total, {_error_rate("event_type = 'error'")} AS error_rate FROM events""")
add("A3_event_histogram", "events", lambda e: analytics.histogram(e, "event_type"), "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
add("A5_error_rate", "events", lambda e: e.groupBy(F.to_date("ts").alias("day")).agg(analytics.percent(F.count_if(F.col("event_type") == "error"), F.count("*"), 2).alias("error_rate")),
    f"""SELECT CAST(ts AS DATE) AS day, {_error_rate("event_type = 'error'")} AS error_rate FROM events GROUP BY 1""")
add("A6_session_stats", "events", analytics.sessions, """SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS kinds, count(*) FILTER (WHERE event_type = 'error') AS errors,
    epoch_us(max(ts)) - epoch_us(min(ts)) AS micros FROM events GROUP BY 1""")
add("A7_last_day", "events", lambda e: e.agg(F.count_if((F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-30").cast("timestamp_ntz"))).alias("n")),
    "SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-29' AND ts < TIMESTAMP '2024-01-30') AS n FROM events")
add("A8_feedback", "labels", lambda x: analytics.ratings(x, "quality", {1: "positive", 0: "negative", 2: "neutral"}),
    "SELECT count(quality) AS total, " + ", ".join(f"count(*) FILTER (WHERE quality = {v}) AS {n}, round(100.0::DOUBLE * count(*) FILTER (WHERE quality = {v}) / count(quality), 1) AS {n}_percent" for v, n in ((1, "positive"), (0, "negative"), (2, "neutral"))) + " FROM labels")
add("A19_json_field", "events", lambda e: e.groupBy(F.get(F.json_object_keys("props"), 0).alias("key")).agg(F.count("*").alias("n")), "SELECT json_keys(props)[1] AS key, count(*) AS n FROM events GROUP BY 1")
add("A22_duplicate_groups", "documents", lambda d: analytics.duplicates(d.select(F.sha2("text", 256).alias("content_hash")), ["content_hash"]), "SELECT sha256(text) AS content_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
add("A30_gaps", "events", lambda e: analytics.gaps(e, "user_id", ["ts", "event_id"]), """SELECT user_id, round(avg(gap), 6) AS avg_gap, count(gap) AS gaps FROM (SELECT user_id,
    floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 60000000)::BIGINT AS gap FROM events) GROUP BY 1""")
add("A34_storage_audit", "documents", lambda d: d.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.ceil(F.length("text") / 1000)).cast("long").alias("chunks")),
    "SELECT source, count(*) AS docs, sum(ceil(length(text) / 1000))::BIGINT AS chunks FROM documents GROUP BY 1")
add("F1_event_type", "events", lambda e: e.filter("event_type = 'purchase'").select("event_id", "user_id"), "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
add("F2_closed_range", "events", lambda e: e.filter("ts between timestamp_ntz'2024-01-05 00:00:00' and timestamp_ntz'2024-01-07 00:00:00'").select("event_id"), "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07'")
add("F3_from_day", "events", lambda e: e.filter("ts >= timestamp_ntz'2024-01-20 00:00:00'").select("event_id"), "SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-20'")
add("F4_substring_any", "customer", lambda c: c.filter(F.col("c_name").ilike("%00001%") | F.col("c_mktsegment").ilike("%auto%")).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_name ILIKE '%00001%' OR c_mktsegment ILIKE '%auto%'")
add("F5_score_bucket", "events", lambda e: e.groupBy(F.when(F.col("value") >= 70, "high").when(F.col("value") >= 40, "medium").when(F.col("value").isNotNull(), "low").otherwise("none").alias("bucket")).agg(F.count("*").alias("n")),
    "SELECT CASE WHEN value >= 70 THEN 'high' WHEN value >= 40 THEN 'medium' WHEN value IS NOT NULL THEN 'low' ELSE 'none' END AS bucket, count(*) AS n FROM events GROUP BY 1")
add("F7_in_list", "orders", lambda o: o.filter(F.col("o_orderstatus").isin("O", "P") & F.col("o_custkey").isNotNull()).groupBy("o_orderstatus").agg(F.count("*").alias("n")), "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_custkey IS NOT NULL GROUP BY 1")
add("F8_columns", "lineitem", lambda x: x.filter(F.col("l_suppkey") < F.col("l_quantity")).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey < l_quantity")
add("F11_calendar", "events", lambda e: e.filter(F.date_trunc("week", "ts") == F.date_trunc("week", F.lit("2024-01-17").cast("timestamp_ntz"))).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM events WHERE date_trunc('week', ts) = date_trunc('week', TIMESTAMP '2024-01-17')")
add("F12_url_admission", "pages", lambda p: p.filter(F.col("url").startswith("https://") & ~F.col("url").rlike(r"\.(pdf|zip|png)$")).select("page_id", "url"), r"SELECT page_id, url FROM pages WHERE starts_with(url, 'https://') AND NOT regexp_matches(url, '\.(pdf|zip|png)$')")
add_many("J1_tenant_join", ["orders", "customer"], lambda o, c: o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")),
    "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
add_many("J11_orphans", ["embeddings", "documents"], lambda v, d: v.join(d, v["vec_id"] == d["doc_id"], "left_anti").select("vec_id"), "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
add_many("J12_exists", ["customer", "orders"], lambda c, o: c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
add("J14_latest", "orders", lambda o: o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x")).select("o_custkey", F.col("x.o_orderkey").alias("o_orderkey")),
    "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
add_many("J15_counts", ["customer", "orders"], lambda c, o: c.join(o.groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "P").alias("pending")), c["c_custkey"] == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("pending", F.lit(0)).alias("pending")),
    "SELECT c_custkey, count(o_orderkey) AS total, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
add("W2_oldest", "documents", lambda d: analytics.oldest(d.select("doc_id", F.sha2("text", 256).alias("content_hash")), ["content_hash"], ["doc_id"]), "SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY text")
add("W6_history", "conversations", lambda c: c.select("conv_id", "turn", F.expr("concat_ws('|', collect_list(role) over (partition by conv_id order by turn, text rows between 10 preceding and 1 preceding))").alias("before")),
    "SELECT conv_id, turn, coalesce(string_agg(role, '|') OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), '') AS before FROM conversations")
add("W7_last_user", "conversations", lambda c: c.filter("role = 'user'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("x")).select("conv_id", F.col("x.text").alias("text")),
    "SELECT conv_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS r FROM conversations WHERE role = 'user') WHERE r = 1")
PRIORITY = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}
add("T4_priority_page", "orders", lambda o: analytics.priority_page(o, "o_orderpriority", PRIORITY, ["o_orderdate", "o_orderkey"], 20, 20).select("o_orderkey", "rank"),
    "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END AS rank FROM orders ORDER BY rank, o_orderdate, o_orderkey LIMIT 20 OFFSET 20")
add("T8_recent", "events", lambda e: e.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id"), "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
add_many("U3_difference", ["embeddings", "documents"], lambda v, d: v.select(F.col("vec_id").alias("id")).subtract(d.select(F.col("doc_id").alias("id"))), "SELECT vec_id AS id FROM embeddings EXCEPT SELECT doc_id FROM documents")
add("X3_terms", "benchmark", lambda b: b.select("item_id", F.concat_ws(" ", text.terms(F.col("text"))).alias("terms")), """SELECT item_id, coalesce(array_to_string((SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM
    (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT string_split(trim(regexp_replace(lower(b.text), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws)) WHERE length(w) >= 2 GROUP BY w ORDER BY i LIMIT 60)), ' '), '') AS terms FROM benchmark b""")
add("X12_trigrams", "nation", lambda n: n.alias("a").join(n.alias("b"), F.col("a.n_regionkey") == F.col("b.n_regionkey")).select(F.col("a.n_name").alias("x"), F.col("b.n_name").alias("y"), F.round(text.trigram_similarity(F.col("a.n_name"), F.col("b.n_name")), 6).alias("similarity")), """WITH t AS (SELECT n_name, n_regionkey,
    list_distinct(list_transform(range(1, greatest(1, length(n_name) - 2) + 1), lambda i: substr(lower(n_name), i, 3))) AS g FROM nation)
    SELECT a.n_name AS x, b.n_name AS y, round(len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity FROM t a JOIN t b USING (n_regionkey)""")
add("X16_snippet", "documents", lambda d: d.select("doc_id", text.snippet(F.col("text"), 200).alias("snippet")), "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 199) || '…' ELSE text END AS snippet FROM documents")
add("X20_normalise", "documents", lambda d: d.select("doc_id", F.md5(text.normalise(F.col("text"))).alias("digest")), r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents")
add("X27_has_table", "documents", lambda d: d.select("doc_id", text.has_table(F.col("text")).alias("has_table")), "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2)) >= 2 AS has_table FROM documents")
add("X44_title", "pages", lambda p: p.select("page_id", F.substring(F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)), 1, 512).alias("title")), "SELECT page_id, substr(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), 1, 512) AS title FROM pages")
add("X47_digests", "documents", lambda d: text.digests(d.select("doc_id", "text"), "text").drop("text"), "SELECT doc_id, sha256(text) AS content_hash, sha1(lower(trim(text))) AS dedup_key, substr(sha256(text), 1, 16) AS cache_key FROM documents")
add("X49_norm", "embeddings", lambda v: v.select("vec_id", F.round(retrieval.norm("embedding"), 6).alias("norm")), "SELECT vec_id, round(greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12), 6) AS norm FROM embeddings")
add("X51_keys", "lineitem", lambda x: x.select(F.expr("l_orderkey * 100000 + l_linenumber").alias("id")).select("id", F.expr("id div 100000").alias("document_id"), F.expr("id % 100000").alias("chunk_index")),
    "SELECT l_orderkey * 100000 + l_linenumber AS id, l_orderkey AS document_id, l_linenumber::BIGINT AS chunk_index FROM lineitem")
add("X70_tokens", "documents", lambda d: d.select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), text.chunk_size(F.length("text")).cast("long").alias("chunk_size")),
    "SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens, CASE WHEN length(text) < 1000 THEN length(text) WHEN length(text) <= 20000 THEN 2200 ELSE 3000 END AS chunk_size FROM documents")
add("C4_hard_chunks", "documents", lambda d: text.hard_chunks(d.select("doc_id", "text"), "text", 1_000, 100).select("doc_id", "chunk_index", F.md5("content").alias("digest")),
    "SELECT doc_id, i AS chunk_index, md5(substr(text, i * 900 + 1, 1000)) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 100) / 900)::INT))) AS i FROM documents WHERE length(text) > 0)")
add("E13_links", "pages", lambda p: p.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1))).alias("href")), """SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages""")
_LEX = """WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 2))) AS term FROM benchmark),
    m AS (SELECT query_id, count(*) AS m FROM q GROUP BY 1),
    p AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS term FROM documents) WHERE length(term) >= 2 GROUP BY 1, 2),
    s AS (SELECT query_id, doc_id, round(sum(list_sum(list_transform(range(1, n + 1), lambda j: 1.0::DOUBLE / (j * j)))) * 0.1::DOUBLE / 1.64493406685::DOUBLE / max(m), 6) AS score FROM p JOIN q USING (term) JOIN m USING (query_id) GROUP BY 1, 2),
    lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10)"""


def _lexical(b: DataFrame, d: DataFrame) -> DataFrame:
    return retrieval.lexical_top_k(b.select(F.col("item_id").alias("query_id"), "text"), d, 10)


add_many("R1_lexical_top_k", ["benchmark", "documents"], _lexical, _LEX + " SELECT query_id, doc_id, score, rank FROM lex")
add_many("A25_confidence", ["benchmark", "documents"], lambda b, d: retrieval.confidence(_lexical(b, d)), _LEX + " SELECT query_id, round(least(1.0, greatest(0.0, 10 * sum(score))), 6) AS confidence FROM lex WHERE rank <= 3 GROUP BY 1")
add("R2_vector_top_k", "embeddings", lambda v: retrieval.vector_top_k(v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10),
    """SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id,
    round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS score
    FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)) WHERE rank <= 10""")


def _two_lists(b: DataFrame, d: DataFrame) -> DataFrame:
    lexical = _lexical(b, d).select("query_id", "doc_id", "rank")
    return retrieval.fuse(lexical.unionByName(ranking.rerank(lexical, "query_id", F.col("doc_id"))))


_TWO = "(SELECT query_id, doc_id, rank FROM lex UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) FROM lex)"
add_many("R3_fusion", ["benchmark", "documents"], _two_lists, _LEX + f" SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM {_TWO} GROUP BY 1, 2")
add_many("W8_position_scores", ["benchmark", "documents"], lambda b, d: ranking.position_scores(_lexical(b, d), "query_id").select("query_id", "doc_id", "bias", "linear"),
    _LEX + """ SELECT query_id, doc_id, round(1 - (rank - 1)::DOUBLE / count(*) OVER (PARTITION BY query_id) * 0.1::DOUBLE, 6) AS bias,
    round(1 - (rank - 1)::DOUBLE / greatest(1, count(*) OVER (PARTITION BY query_id) - 1), 6) AS linear FROM lex""")
add_many("T10_citation_cap", ["benchmark", "documents"], lambda b, d: _lexical(b, d).filter("rank <= 5").select("query_id", "doc_id"), _LEX + " SELECT query_id, doc_id FROM lex WHERE rank <= 5")
add("R13_diversity", "embeddings", lambda v: ranking.mmr(
    retrieval.vector_top_k(v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), ranking.MMR_CANDIDATES)
    .join(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id").join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id"), 5, 0.7), None)
add("QS5_context", "conversations", lambda c: ranking.pack(c, "conv_id", "text", ["turn", "text"], 1_200).select("conv_id", "parts", F.md5("context").alias("digest")),
    """WITH p AS (SELECT *, length(text) + 5 + coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 7 * greatest(0, row_number() OVER w - 2) <= 1200 AS fits
    FROM conversations WHERE length(text) > 0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text))
    SELECT conv_id, count(*) AS parts, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn, text)) AS digest
    FROM (SELECT *, bool_and(fits) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS keep FROM p) WHERE keep GROUP BY 1""")
add("QS4_operator_score", "supplier", lambda s: s.select("s_suppkey", F.round(ranking.operator_score(
    F.when(F.col("s_nationkey") % 2 == 0, F.array(F.lit("billing"), F.lit("refunds"))).otherwise(F.array(F.lit("billing"))), F.array(F.lit("billing"), F.lit("refunds")), F.array(F.lit("refunds")),
    F.col("s_suppkey") % 6, F.lit(6), F.col("s_suppkey") % 12, 3 + F.col("s_suppkey") % 4 * 0.5, F.col("s_suppkey"), F.lit("high")), 6).alias("score")),
    """SELECT s_suppkey, round(CASE WHEN s_nationkey % 2 = 0 THEN 30 ELSE 10 END + (1 - (s_suppkey % 6) / 6.0::DOUBLE) * 25 + CASE WHEN s_suppkey % 12 <= 2 THEN 20 WHEN s_suppkey % 12 <= 10 THEN 20 - (s_suppkey % 12 - 2) / 8.0::DOUBLE * 20 ELSE 0 END
    + CASE s_suppkey % 4 WHEN 3 THEN 15 WHEN 2 THEN 12 WHEN 1 THEN 8 ELSE 5 END + CASE WHEN s_suppkey > 20 THEN 5 ELSE 0 END, 6) AS score FROM supplier""")
add("T5_alphabetical_priority", "orders", lambda o: o.orderBy("o_orderpriority", "o_orderkey").limit(20).select("o_orderkey", "o_orderpriority"), "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 20")
add("T6_page_and_total", "orders", lambda o: o.orderBy("o_orderkey").offset(40).limit(20).select("o_orderkey", o.select(F.count("*")).scalar().alias("total")), "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
add("T7_relevance_order", "customer", lambda c: c.select("c_custkey", F.when(F.col("c_mktsegment").startswith("AUTO"), 0).when(F.col("c_name").contains("1"), 1).otherwise(2).alias("grade")).orderBy("grade", F.desc("c_custkey")).limit(10),
    "SELECT c_custkey, CASE WHEN c_mktsegment LIKE 'AUTO%' THEN 0 WHEN c_name LIKE '%1%' THEN 1 ELSE 2 END AS grade FROM customer ORDER BY grade, c_custkey DESC LIMIT 10")
add_many("G3_changes", ["documents", "benchmark"], lambda d, b: ranking.changes(d.select(F.col("doc_id").alias("id"), "text"), b.select(F.col("item_id").alias("id"), "text"), "id", "text"),
    "SELECT coalesce(doc_id, item_id) AS id, CASE WHEN item_id IS NULL THEN 'new' WHEN doc_id IS NULL THEN 'removed' WHEN d.text IS NOT DISTINCT FROM b.text THEN 'unchanged' ELSE 'updated' END AS state FROM documents d FULL JOIN benchmark b ON doc_id = item_id")
add_many("G7_mismatch", ["embeddings", "documents"], lambda v, d: v.select(F.col("vec_id").alias("id"), F.lit(1).alias("x")).join(d.select(F.col("doc_id").alias("id"), F.lit(1).alias("y")), "id", "full").filter("x is null or y is null").select("id", F.when(F.col("x").isNull(), "no vector").otherwise("no document").alias("problem")),
    "SELECT coalesce(vec_id, doc_id) AS id, CASE WHEN vec_id IS NULL THEN 'no vector' ELSE 'no document' END AS problem FROM embeddings FULL JOIN documents ON vec_id = doc_id WHERE vec_id IS NULL OR doc_id IS NULL")
add("ST1_daily_counts", "events", lambda e: counters.daily_counts(e, ["event_type"]), "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
add("ST4_alerts", "events", lambda e: counters.alerts(e, F.col("value"), 90.0).select("event_id"), "SELECT event_id FROM events WHERE value > 90")
add("ST5_rate_limit", "events", lambda e: counters.over_limit(e, ["user_id", "event_type"], 1), "SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour_start, user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1")
