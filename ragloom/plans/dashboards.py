"""Dashboard and queue aggregates; orders stand for tickets, suppliers for operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.analytics import percent
from ..operators.retrieval import top_k
from .registry import add, add_many

AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-30 00:00:00"


def _status() -> Column:
    return F.col("o_orderstatus")



def _sql_percent(part: str, whole: str, digits: int) -> str:
    return f"round(CASE WHEN {whole} > 0 THEN 100.0::DOUBLE * {part} / {whole} ELSE 0 END, {digits})"


add("A4_confidence_citations", "events", lambda e: e.agg(F.round(F.avg(F.when(F.col("event_type") == "view", F.col("value"))), 6).alias("avg_value"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("citations")),
    "SELECT round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS avg_value, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS citations FROM events")
add("A9_toxic_percent", "labels", lambda x: x.agg(F.count("toxic").alias("total"), percent(F.count_if(F.col("toxic") == 1), F.count("toxic"), 1).alias("toxic_percent")),
    f"SELECT count(toxic) AS total, {_sql_percent('count(*) FILTER (WHERE toxic = 1)', 'count(toxic)', 1)} AS toxic_percent FROM labels")
add("A10_ticket_metrics", "orders", lambda o: o.agg(F.count("*").alias("total"), percent(F.count_if(_status() == "F"), F.count("*"), 2).alias("resolved_rate"), percent(F.count_if(_status() == "P"), F.count("*"), 2).alias("pending_rate"), F.round(F.avg(F.when(_status() == "F", F.col("o_totalprice"))), 4).alias("avg_resolved")),
    f"SELECT count(*) AS total, {_sql_percent('count(*) FILTER (WHERE o_orderstatus = ' + repr('F') + ')', 'count(*)', 2)} AS resolved_rate, {_sql_percent('count(*) FILTER (WHERE o_orderstatus = ' + repr('P') + ')', 'count(*)', 2)} AS pending_rate, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS avg_resolved FROM orders")
add("A11_routing_stats", "supplier", lambda s: s.groupBy("s_nationkey").agg(F.count("*").alias("operators"), F.count_if(F.col("s_suppkey") % 6 < 5).alias("available"), F.round(F.avg((F.col("s_suppkey") % 6) / 5.0), 6).alias("utilisation")),
    "SELECT s_nationkey, count(*) AS operators, count(*) FILTER (WHERE s_suppkey % 6 < 5) AS available, round(avg((s_suppkey % 6) / 5.0::DOUBLE), 6) AS utilisation FROM supplier GROUP BY 1")
add_many("A12_tenant_metrics", ["customer", "orders"], lambda c, o: c.join(o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t")), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.round(F.coalesce(F.sum("t"), F.lit(0.0)), 2).alias("total")),
    "SELECT c_nationkey, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
add("A13_trigger_stats", "events", lambda e: e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), percent(F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "click"), 2).alias("conversion")),
    "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, " + _sql_percent("count(*) FILTER (WHERE event_type = 'purchase')", "count(*) FILTER (WHERE event_type = 'click')", 2) + " AS conversion FROM events GROUP BY 1")
add("A14_status_by_month", "orders", lambda o: o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("total"), *(F.count_if(_status() == s).alias(n) for s, n in (("O", "open"), ("P", "pending"), ("F", "finished")))),
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM orders GROUP BY 1")
add("A15_response_rate", "orders", lambda o: o.filter("o_orderdate >= timestamp_ntz'1998-01-01 00:00:00' and o_orderdate < timestamp_ntz'1999-01-01 00:00:00'").agg(F.count("*").alias("total"), percent(F.count_if(_status() != "O"), F.count("*"), 1).alias("response_rate")),
    "SELECT count(*) AS total, " + _sql_percent("count(*) FILTER (WHERE o_orderstatus <> 'O')", "count(*)", 1) + " AS response_rate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
add_many("A16_mean_duration", ["orders", "lineitem"], lambda o, x: x.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.round(F.avg(F.when(F.col("l_linestatus") == "F", F.datediff("l_shipdate", "o_orderdate"))), 6).alias("days")),
    "SELECT o_orderpriority, round(avg(CASE WHEN l_linestatus = 'F' THEN date_diff('day', o_orderdate::DATE, l_shipdate::DATE) END), 6) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
add("A17_progress", "lineitem", lambda x: x.groupBy("l_orderkey").agg(F.round(F.least(F.lit(100.0), 100.0 * F.count_if(F.col("l_linestatus") == "F") / F.greatest(F.count("*"), F.lit(1))), 2).alias("progress")),
    "SELECT l_orderkey, round(least(100.0::DOUBLE, 100.0::DOUBLE * count(*) FILTER (WHERE l_linestatus = 'F') / greatest(count(*), 1)), 2) AS progress FROM lineitem GROUP BY 1")
add("A18_queue_summary", "orders", lambda o: o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("oldest"), F.max("o_orderdate").alias("newest")),
    "SELECT o_orderpriority, count(*) AS n, min(o_orderdate) AS oldest, max(o_orderdate) AS newest FROM orders GROUP BY 1")
add("A20_queue_lag", "orders", lambda o: o.filter(_status() == "P").groupBy("o_orderpriority").agg(F.count("*").alias("pending"), F.datediff(F.lit(AS_OF).cast("timestamp_ntz"), F.min("o_orderdate")).cast("long").alias("lag_days")),
    f"SELECT o_orderpriority, count(*) AS pending, date_diff('day', min(o_orderdate)::DATE, DATE '{AS_OF[:10]}') AS lag_days FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")


def _kind() -> Column:
    return F.when(F.col("value") < 5, "timeout").when(F.col("value") < 20, "network").otherwise("other")


add("A21_failure_categories", "events", lambda e: e.filter("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).groupBy(_kind().alias("category")).agg(F.count("*").alias("n")),
    "SELECT CASE WHEN value < 5 THEN 'timeout' WHEN value < 20 THEN 'network' ELSE 'other' END AS category, count(*) AS n FROM (SELECT * FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 10) GROUP BY 1")


def _boost() -> Column:
    return F.when(F.col("lang") == "en", 1.2).when(F.col("lang") == "de", 1.1).otherwise(1.0)


add("A23_best_base", "documents", lambda d: top_k(d.groupBy("source", "lang").agg(F.round(F.sum(_boost() * F.length("text")), 3).alias("score")), "source", 1, F.desc("score"), F.col("lang")).drop("rank"),
    "SELECT source, lang, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, lang NULLS FIRST) AS r FROM (SELECT source, lang, round(sum((CASE lang WHEN 'en' THEN 1.2::DOUBLE WHEN 'de' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END) * length(text)), 3) AS score FROM documents GROUP BY 1, 2)) WHERE r = 1")
add("A26_merge", "orders", lambda o: o.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("priorities"), F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("statuses"), F.floor(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.count("*")).alias("mean_cents")),
    "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses, floor(sum(round(o_totalprice * 100)::BIGINT) / count(*))::BIGINT AS mean_cents FROM orders GROUP BY 1")
add("A27_link_quality", "pages", lambda p: p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href")).groupBy("page_id").agg(F.count("*").alias("links"), percent(F.count_if(F.col("href").startswith("/")), F.count("*"), 1).alias("own_percent")),
    "SELECT page_id, count(*) AS links, " + _sql_percent("count(*) FILTER (WHERE starts_with(href, '/'))", "count(*)", 1) + """ AS own_percent FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1""")


def _cost(docs: DataFrame) -> DataFrame:
    """Prices are whole cents a million tokens, so rounding to six digits is exact."""
    prices = docs.sparkSession.createDataFrame([("en", 15, 60), ("de", 250, 1000)], "lang string, price_in long, price_out long")
    tokens = F.ceil(F.length("text") / 4)
    cents = tokens * F.coalesce("price_in", F.lit(0)) + F.floor(tokens / 4) * F.coalesce("price_out", F.lit(0))
    return docs.join(F.broadcast(prices), "lang", "left").select("doc_id", (F.floor((cents + 50) / 100) / 1e6).alias("cost"))  # a price list of stated rows


add("A29_cost", "documents", _cost, """SELECT doc_id, floor((t * coalesce(price_in, 0) + floor(t / 4) * coalesce(price_out, 0) + 50) / 100) / 1e6 AS cost FROM (SELECT doc_id, lang, ceil(length(text) / 4) AS t FROM documents)
    LEFT JOIN (VALUES ('en', 15, 60), ('de', 250, 1000)) p(lang, price_in, price_out) USING (lang)""")
add("A31_utilisation", "supplier", lambda s: s.select("s_suppkey", percent(F.col("s_suppkey") % 5, F.col("s_nationkey") % 4, 2).alias("utilisation")),
    f"SELECT s_suppkey, {_sql_percent('(s_suppkey % 5)', '(s_nationkey % 4)', 2)} AS utilisation FROM supplier")
add("A32_tiles", "orders", lambda o: o.agg(F.count_if(_status() == "P").alias("pending"), F.count_if(_status() == "O").alias("active"), F.countDistinct(F.when(_status() == "O", F.col("o_custkey"))).alias("waiting"), F.count_if(F.to_date("o_orderdate") == F.lit("2001-08-01").cast("date")).alias("today")),
    "SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, count(*) FILTER (WHERE o_orderstatus = 'O') AS active, count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_custkey END) AS waiting, count(*) FILTER (WHERE o_orderdate::DATE = DATE '2001-08-01') AS today FROM orders")
add("A33_payload_like", "events", lambda e: e.agg(F.count_if(F.col("props").like('%"k": 6%')).alias("matching"), F.count_if(F.col("event_type").like("%err%")).alias("failed")),
    """SELECT count(*) FILTER (WHERE props LIKE '%"k": 6%') AS matching, count(*) FILTER (WHERE event_type LIKE '%err%') AS failed FROM events""")
add("A35_vector_counts", "embeddings", lambda v: v.groupBy("label").agg(F.count("*").alias("n")), "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")


def _recent(e: DataFrame) -> DataFrame:
    rows = e.filter(f"ts > timestamp_ntz'{EVENTS_AS_OF}' - interval 1 day and ts <= timestamp_ntz'{EVENTS_AS_OF}'")
    return rows.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("everyone", rows.select(F.count("*")).scalar())


add("A36_recent_by_user", "events", _recent,
    f"SELECT user_id, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS everyone FROM events WHERE ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 1 DAY AND ts <= TIMESTAMP '{EVENTS_AS_OF}' GROUP BY 1")
