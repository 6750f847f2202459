"""Filters, joins, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import retrieval
from .registry import add, add_many

AS_OF = "2001-08-02 00:00:00"


def _low() -> Column:
    return F.lower(F.coalesce(F.col("text"), F.lit("")))


def has(*words: str) -> list[Column]:
    return [F.contains(_low(), F.lit(w)) for w in words]


def any_pair(words: list[str]) -> Column:
    """At least two of the words stand in the text; the same as any unordered pair of them."""
    return F.aggregate(F.array(*(x.cast("int") for x in has(*words))), F.lit(0), lambda s, x: s + x) >= 2


_WORDS = ["der", "les", "the", "que"]
_HAS = " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in _WORDS)
add("F6_json_contains", "events", lambda e: e.filter(F.array_contains(F.map_values(F.from_json("props", "map<string,int>")), 69)).select("event_id"), "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '69'")
add_many("F9_within_interval", ["lineitem", "orders"], lambda x, o: x.join(o, F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate <= o_orderdate + interval 30 days").groupBy("o_orderpriority").agg(F.count("*").alias("n")),
    "SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= o_orderdate + INTERVAL 30 DAY GROUP BY 1")
add("F10_overdue", "orders", lambda o: o.filter(f"o_orderstatus = 'P' and o_orderdate < timestamp_ntz'{AS_OF}' - interval 180 days").select("o_orderkey"), f"SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY")
add("F13_link_only", "pages", lambda p: p.filter(F.col("url").rlike(r"[?&]page=\d+")).select("page_id"), r"SELECT page_id FROM pages WHERE regexp_matches(url, '[?&]page=\d+')")
add_many("F15_known_and_fresh", ["pages", "benchmark"], lambda p, b: p.join(b.filter(F.length("text") < 250), F.col("page_id") == F.col("item_id"), "left_anti").select("page_id"), "SELECT page_id FROM pages WHERE page_id NOT IN (SELECT item_id FROM benchmark WHERE length(text) < 250)")
add("F16_required_terms", "documents", lambda d: d.filter(has("les")[0] & has("que")[0]).select("doc_id"), "SELECT doc_id FROM documents WHERE contains(lower(text), 'les') AND contains(lower(text), 'que')")
add("F17_any_pair", "documents", lambda d: d.filter(any_pair(_WORDS)).select("doc_id"), f"SELECT doc_id FROM documents WHERE {_HAS} >= 2")
add("F18_any_keyword", "documents", lambda d: d.filter(_low().rlike("der|les")).select("doc_id"), "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'der|les')")
add("F19_document_pattern", "part", lambda p: p.filter(F.lower("p_name").contains("green") | F.lower("p_brand").contains("#1") | F.lower("p_type").contains("brass")).select("p_partkey"), "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'green') OR contains(lower(p_brand), '#1') OR contains(lower(p_type), 'brass')")
add_many("F20_due", ["customer", "orders"], lambda c, o: c.join(o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last")), F.col("c_custkey") == F.col("o_custkey"), "left").filter(f"last is null or last <= timestamp_ntz'{AS_OF}' - interval 90 days").select("c_custkey"),
    f"SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1 HAVING max(o_orderdate) IS NULL OR max(o_orderdate) <= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY")

add("J2_one_row_cte", "part", lambda p: p.filter(F.col("p_retailprice") > p.select(F.avg("p_retailprice")).scalar()).select("p_partkey"), "WITH a AS (SELECT avg(p_retailprice) AS m FROM part) SELECT p_partkey FROM part, a WHERE p_retailprice > m")
add_many("J3_hits_in_base", ["embeddings", "documents"], lambda v, d: v.join(d.select("doc_id", "lang"), F.col("vec_id") == F.col("doc_id")).filter("lang = 'en'").select("vec_id"), "SELECT vec_id FROM embeddings JOIN documents ON vec_id = doc_id WHERE lang = 'en'")
add_many("J5_enrich", ["labels", "documents"], lambda x, d: x.join(d.select("doc_id", "source", "lang"), "doc_id", "left").filter("source is not null").select("doc_id", "source", "lang"), "SELECT l.doc_id, source, lang FROM labels l LEFT JOIN documents d USING (doc_id) WHERE source IS NOT NULL")
add_many("J6_title_refresh", ["embeddings", "pages"], lambda v, p: v.join(p.select("page_id", "url"), F.col("vec_id") == F.col("page_id"), "left").select("vec_id", F.coalesce("url", F.concat(F.lit("vector "), "vec_id")).alias("title")), "SELECT vec_id, coalesce(url, 'vector ' || vec_id) AS title FROM embeddings LEFT JOIN pages ON vec_id = page_id")


def _neighbours(x: DataFrame) -> DataFrame:
    """Lines beside each line, by three exploded positions and an equi-join."""
    around = x.select("l_orderkey", F.col("l_linenumber").alias("center"), F.explode(F.array(*(F.col("l_linenumber") + i for i in (-1, 0, 1)))).alias("at"))
    there = x.select("l_orderkey", F.col("l_linenumber").alias("at"), "l_partkey")
    return around.join(there, ["l_orderkey", "at"]).groupBy("l_orderkey", "center").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


add("J7_neighbours", "lineitem", _neighbours, "SELECT a.l_orderkey, a.l_linenumber AS center, count(*) AS n, sum(b.l_partkey)::BIGINT AS parts FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber BETWEEN a.l_linenumber - 1 AND a.l_linenumber + 1 GROUP BY 1, 2")
add_many("J8_lookup", ["conversations", "labels"], lambda c, x: c.join(x.select(F.col("doc_id").alias("conv_id"), (F.col("quality") + 1).alias("turn")), ["conv_id", "turn"]).select("conv_id", "turn", F.substring("text", 1, 80).alias("text")),
    "SELECT conv_id, turn, substr(c.text, 1, 80) AS text FROM conversations c JOIN labels l ON conv_id = doc_id AND turn = quality + 1")
add_many("J9_distinct_bases", ["nation", "customer"], lambda n, c: n.join(c.filter(F.col("c_mktsegment").like("%A%")), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select("n_nationkey", "n_name"), "SELECT DISTINCT n_nationkey, n_name FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_mktsegment LIKE '%A%'")
add_many("J10_document_list", ["lineitem", "orders"], lambda x, o: x.join(o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
add_many("J13_bridge_or_type", ["customer", "orders"], lambda c, o: c.join(o.filter("o_orderpriority = '1-URGENT'").select("o_custkey").distinct(), F.col("c_custkey") == F.col("o_custkey"), "left").filter("o_custkey is not null or c_mktsegment = 'BUILDING'").select("c_custkey"), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') OR c_mktsegment = 'BUILDING'")
add_many("J19_key_sets", ["lineitem", "orders"], lambda x, o: o.select((F.col("o_orderkey") * 100_000 + 1).alias("id")).join(x.select((F.col("l_orderkey") * 100_000 + F.col("l_linenumber")).alias("id")), "id", "left_anti"), "SELECT o_orderkey * 100000 + 1 AS id FROM orders WHERE o_orderkey * 100000 + 1 NOT IN (SELECT l_orderkey * 100000 + l_linenumber FROM lineitem)")
add_many("J20_config", ["customer", "nation", "region"], lambda c, n, r: c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n")), "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")


def assign(requests: DataFrame, operators: DataFrame, by: str, order: list[Column], operator_order: list[Column]) -> DataFrame:
    """Requests in order to the free slots of their tenant's operators; those beyond the last slot wait (null operator).

    ``operators`` has the column ``free``. Operators with room take in their
    order, each up to its slots; slot numbers are an interval of the tenant's
    running total, so no group is collected.
    """
    w = Window.partitionBy(by)
    queue = requests.withColumn("_n", F.row_number().over(w.orderBy(*order)))
    upto = F.sum("free").over(w.orderBy(*operator_order).rowsBetween(Window.unboundedPreceding, 0))
    slots = operators.filter("free > 0").withColumn("_to", upto).withColumn("_n", F.explode(F.sequence(F.col("_to") - F.col("free") + 1, "_to"))).drop("_to", "free")
    return queue.join(slots, [by, "_n"], "left").drop("_n")


def _handed(o: DataFrame, c: DataFrame, s: DataFrame) -> DataFrame:
    asked = o.filter("o_orderstatus = 'P'").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority", "o_orderdate", F.col("c_nationkey").alias("nation"))
    able = s.select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 4).alias("free"))
    return assign(asked, able, "nation", [F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")], [F.col("s_suppkey")]).select("o_orderkey", "s_suppkey")


add_many("J17_assignment", ["orders", "customer", "supplier"], _handed, """WITH q AS (SELECT o_orderkey, c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'),
    s AS (SELECT s_suppkey, s_nationkey AS nation, s_suppkey % 4 AS free, sum(s_suppkey % 4) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS upto FROM supplier)
    SELECT o_orderkey, s_suppkey FROM q LEFT JOIN s ON q.nation = s.nation AND n > upto - free AND n <= upto""")


def _best_operator(c: DataFrame, s: DataFrame) -> DataFrame:
    """Each request's best operator of its tenant: the score does not depend on the request, so one per tenant is found first."""
    score = F.round((1 - F.col("s_suppkey") % 6 / 6) * 25 + F.least(F.lit(10.0), F.col("s_acctbal") / 1000), 6)
    best = s.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max(F.struct(score.alias("score"), (-F.col("s_suppkey")).alias("k"))).alias("x"))
    return c.join(best, "c_nationkey").select("c_custkey", (-F.col("x.k")).alias("s_suppkey"), F.col("x.score").alias("score"))


add_many("J16_best_operator", ["customer", "supplier"], _best_operator, """SELECT c_custkey, s_suppkey, score FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY score DESC, s_suppkey) AS r FROM
    (SELECT s_suppkey, s_nationkey, round((1 - (s_suppkey % 6) / 6.0::DOUBLE) * 25 + least(10.0::DOUBLE, s_acctbal / 1000), 6) AS score FROM supplier)) ON s_nationkey = c_nationkey WHERE r = 1""")

add("W1_rank", "orders", lambda o: retrieval.top_k(o, "o_custkey", 3, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank")), "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
add("W3_first_by_hash", "documents", lambda d: d.groupBy(F.sha1(F.lower(F.trim(F.col("text")))).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "SELECT sha1(lower(trim(text))) AS key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
add("W4_running_budget", "lineitem", lambda x: x.withColumn("s", F.sum("l_quantity").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))).filter("s <= 60").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("s").alias("held")), "SELECT l_orderkey, count(*) AS n, max(s) AS held FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS s FROM lineitem) WHERE s <= 60 GROUP BY 1")
add("W5_previous", "events", lambda e: e.select("event_id", F.round(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), 6).alias("change")), "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS change FROM events")
add("W10_versions", "orders", lambda o: o.withColumn("version", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")).withColumn("back", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))).filter("back <= 5").select("o_custkey", "o_orderkey", "version"),
    "SELECT o_custkey, o_orderkey, version FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders) WHERE back <= 5")
add("T1_score_limit", "part", lambda p: p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "p_retailprice"), "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
add("T3_candidate_cap", "customer", lambda c: retrieval.top_k(c, "c_mktsegment", 200, F.desc("c_acctbal"), F.col("c_custkey")).select("c_mktsegment", "c_custkey"), "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 200")
_BY_LENGTH = lambda x: F.array_join(F.transform(F.array_sort(F.transform(x, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"]), " ")
add("T9_longest_first", "part", lambda p: p.select("p_partkey", _BY_LENGTH(F.split("p_name", " ")).alias("words")), "SELECT p_partkey, array_to_string((SELECT list(w ORDER BY length(w) DESC, w) FROM (SELECT unnest(string_split(p_name, ' ')) AS w)), ' ') AS words FROM part p")
add_many("U1_concatenate", ["benchmark", "conversations"], lambda b, c: b.select(F.col("item_id").alias("id"), F.lit(0).cast("long").alias("list"), F.md5("text").alias("digest")).unionByName(c.select(F.col("conv_id").alias("id"), F.lit(1).cast("long").alias("list"), F.md5("text").alias("digest"))), "SELECT item_id AS id, 0::BIGINT AS list, md5(text) AS digest FROM benchmark UNION ALL SELECT conv_id, 1, md5(text) FROM conversations")
add("U4_overlap", "part", lambda p: p.select("p_partkey", F.size(F.array_intersect(F.split("p_name", " "), F.split(F.lower("p_type"), " "))).cast("long").alias("shared")), "SELECT p_partkey, len(list_distinct(list_intersect(string_split(p_name, ' '), string_split(lower(p_type), ' '))))::BIGINT AS shared FROM part")
add("U5_ordered_distinct", "part", lambda p: p.select("p_partkey", F.array_join(F.array_distinct(F.split(F.lower("p_name"), " ")), " ").alias("words")), "SELECT p_partkey, array_to_string((SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w, generate_subscripts(string_split(lower(p_name), ' '), 1) AS i) GROUP BY w)), ' ') AS words FROM part p")
add("G5_duplicate_rows", "documents", lambda d: d.join(d.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), F.sha2("text", 256) == F.col("h")).filter("doc_id <> first").select("doc_id", "first"), "SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE text IS NOT NULL) WHERE doc_id <> first")
add_many("G9_delete_by_key", ["embeddings", "labels"], lambda v, x: v.join(x.filter("toxic = 1"), F.col("vec_id") == F.col("doc_id"), "left_anti").select("vec_id"), "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
add("G10_requeue", "orders", lambda o: o.filter(f"o_orderstatus = 'P' and o_orderdate < timestamp_ntz'{AS_OF}' - interval 30 days").select("o_orderkey", F.lit("O").alias("o_orderstatus")), f"SELECT o_orderkey, 'O' AS o_orderstatus FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY")
