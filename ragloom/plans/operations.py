"""Figures of the desk and the crawler, over small tables in their own shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import operations
from .registry import TURNS, add, add_derived, spread

add("F5_json_bucket", "events", lambda e: e.groupBy(operations.score_bucket(F.replace("props", F.lit('"k": '), F.lit('"k": 0.')), "$.k").alias("bucket")).agg(F.count("*").alias("n")),
    """SELECT CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.4 THEN 'medium' WHEN s IS NOT NULL THEN 'low' ELSE 'none' END AS bucket, count(*) AS n FROM (SELECT try_cast(json_extract_string(replace(props, '"k": ', '"k": 0.'), '$.k') AS DOUBLE) AS s FROM events) GROUP BY 1""")
_HANDOFFS = """SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'resolved' WHEN 'error' THEN 'timeout' ELSE 'assigned' END AS status, CASE WHEN user_id % 3 > 0 THEN CAST(floor(value) AS INT) END AS wait_seconds,
    CASE WHEN event_type = 'view' THEN CAST(floor(value * 10) AS INT) END AS resolution_seconds, CASE WHEN user_id % 3 > 0 THEN user_id END AS operator_id, CAST(ts AS TIMESTAMP) AS requested_at, CASE WHEN user_id % 3 > 0 THEN CAST(ts AS TIMESTAMP) + INTERVAL '1' MINUTE * (event_id % 10) END AS assigned_at FROM events"""
_OPERATORS = "SELECT s_suppkey AS id, CAST(s_suppkey % 5 AS INT) AS current, CAST(s_suppkey % 4 AS INT) AS most FROM supplier"
add_derived("A10_handoff_metrics", {"h": _HANDOFFS}, operations.handoff_metrics, """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'resolved') AS resolved, count(*) FILTER (WHERE status = 'timeout') AS timed_out, count(*) FILTER (WHERE status = 'resolved') / count(*)::DOUBLE * 100 AS resolution_rate,
    count(*) FILTER (WHERE status = 'timeout') / count(*)::DOUBLE * 100 AS timeout_rate, round(avg(wait_seconds) / 60, 2) AS wait_minutes, round(avg(resolution_seconds) / 60, 2) AS resolution_minutes FROM h""")
add_derived("A11_routing", {"h": _HANDOFFS, "o": _OPERATORS}, operations.routing_stats, """SELECT count(*) AS total, count(*) FILTER (WHERE operator_id IS NOT NULL AND assigned_at <= requested_at + INTERVAL 5 MINUTE) AS auto, round(avg(wait_seconds) / 60, 2) AS wait_minutes,
    (SELECT round(avg(current / most::DOUBLE * 100), 2) FROM o WHERE most > 0) AS utilisation, count(*) FILTER (WHERE operator_id IS NOT NULL AND assigned_at <= requested_at + INTERVAL 5 MINUTE) / count(*)::DOUBLE * 100 AS auto_rate FROM h""")
add_derived("A31_operator_utilisation", {"o": _OPERATORS}, lambda o: o.select("id", operations.utilisation(F.col("current"), F.col("most")).alias("percent")), "SELECT id, CASE WHEN most > 0 THEN current / most::DOUBLE * 100 ELSE 0 END AS percent FROM o")
_FAILED = "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'timeout after MaxAttemptsExceeded' WHEN event_type = 'view' THEN 'cURL timeout' ELSE props END AS message FROM events"
add_derived("A21_failure_messages", {"f": _FAILED}, lambda f: operations.failure_categories(f, "message", F.desc("id")), """SELECT category, count(*) AS n FROM (SELECT CASE WHEN contains(message, 'MaxAttemptsExceeded') THEN 'max_attempts' WHEN contains(message, 'timeout') THEN 'timeout' ELSE 'other' END AS category FROM (SELECT * FROM f ORDER BY id DESC LIMIT 10)) GROUP BY 1""")
_CONTACTS = "SELECT 'n' || (c_custkey % 100) AS name, CASE WHEN c_custkey % 3 > 0 THEN '06 ' || (c_custkey % 7) END AS phone, CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'x' || (c_custkey % 11) || '@y.z' END AS email, CAST(c_custkey % 9 AS DOUBLE) / 8 AS confidence FROM customer"
add_derived("A26_contacts", {"c": _CONTACTS}, lambda c: operations.merged_contacts(c, "name", ["phone", "email"]), "SELECT name, coalesce(string_agg(DISTINCT nullif(trim(phone), ''), ',' ORDER BY nullif(trim(phone), '')), '') AS phone, coalesce(string_agg(DISTINCT nullif(trim(email), ''), ',' ORDER BY nullif(trim(email), '')), '') AS email, round(avg(confidence), 4)::DOUBLE AS confidence FROM c GROUP BY 1")
_DOCS = "SELECT c_nationkey AS tenant, c_custkey AS doc FROM customer"
_CHUNKS = "SELECT c_nationkey AS tenant, o_custkey AS doc, CAST(o_orderkey % 1000 AS INT) AS part FROM orders JOIN customer ON o_custkey = c_custkey"
_VECTORS = "SELECT c_nationkey AS tenant, o_custkey * 100000 + o_orderkey % 1000 AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'"
add_derived("A34_audit", {"d": _DOCS, "c": _CHUNKS, "v": _VECTORS}, lambda d, c, v: operations.storage_audit(d, c, v, "tenant"), """SELECT tenant, sum(d)::BIGINT AS docs, sum(c)::BIGINT AS chunks, sum(v)::BIGINT AS vectors, (sum(c) - sum(v))::BIGINT AS missing FROM (SELECT tenant, 1 AS d, 0 AS c, 0 AS v FROM d UNION ALL SELECT tenant, 0, 1, 0 FROM c UNION ALL SELECT tenant, 0, 0, 1 FROM v) GROUP BY 1""")
_FETCHED = "SELECT url || ' ' || page_id AS url, 'T ' || page_id AS title, md5(html) AS hash FROM pages"
_SNAPSHOT = """SELECT page_id AS id, CASE WHEN page_id % 3 > 0 THEN url || ' ' || page_id END AS url, CASE WHEN page_id % 4 = 0 THEN 'gone' ELSE 'T ' || page_id END AS title, CASE WHEN page_id % 2 = 0 THEN md5(html) ELSE 'old' END AS hash FROM pages"""
add_derived("G3_page_changes", {"f": _FETCHED, "s": _SNAPSHOT}, operations.changes, """SELECT f.url, CASE WHEN coalesce(a.hash, b.hash) IS NULL THEN 'new' WHEN coalesce(a.hash, b.hash) = f.hash THEN 'unchanged' ELSE 'updated' END AS state
    FROM f LEFT JOIN s a ON f.url = a.url LEFT JOIN s b ON b.url IS NULL AND f.title = b.title""")
add("F12_admission_rules", "pages", lambda p: p.filter(operations.admitted(F.col("url"), hosts=["example"], include=["/en/", "/de/"], exclude=["utm_", r"\.pdf$"])).select("page_id"),
    r"SELECT page_id FROM pages WHERE starts_with(lower(url), 'https://') AND contains(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1), 'example') AND regexp_matches(url, '/en/|/de/') AND NOT regexp_matches(url, 'utm_|\.pdf$')")
_TEXTS = "SELECT * FROM (VALUES (1, 'See [a](https://x.org/1) and https://y.org/2, or [b](https://x.org/1) https://x.org/1'), (2, 'none'), (3, '<https://z.org/q?a=1>')) AS t(id, text)"
add_derived("E14_links", {"t": spread(_TEXTS, 3, "text", TURNS, "k", "text")}, lambda t: t.select("id", F.explode(operations.links_of(F.col("text"))).alias("url")), r"""SELECT DISTINCT id, url FROM (SELECT id, unnest(regexp_extract_all(text, '\[[^\]]*\]\((https?://[^)\s]+)\)', 1)) AS url FROM t
    UNION ALL SELECT id, unnest(regexp_extract_all(regexp_replace(text, '\[[^\]]*\]\((https?://[^)\s]+)\)', ' ', 'g'), 'https?://[^\s)\]<>"'']+')) FROM t)""")
_PAIR = "SELECT p_partkey AS id, CAST(p_size AS STRING) || ',' || CAST(p_partkey % 100 AS STRING) AS a, CASE WHEN p_partkey % 9 = 0 THEN '1' ELSE '0.5,' || CAST(p_size % 10 AS STRING) END AS b FROM part"
add_derived("X50_weighted_blend", {"p": _PAIR}, lambda p: p.withColumns({c: F.split(c, ",").cast("array<double>") for c in "ab"}).select("id", F.array_join(F.transform(operations.blended("a", "b"), lambda x: F.format_number(x, 4)), ",").alias("v")), """
    SELECT id, CASE WHEN len(x) = len(y) THEN array_to_string(list_transform(list_zip(x, y), lambda p: printf('%.4f', 0.6 * p[1] + 0.4 * p[2])), ',') END AS v FROM (SELECT id, CAST(string_split(a, ',') AS DOUBLE[]) AS x, CAST(string_split(b, ',') AS DOUBLE[]) AS y FROM p)""")
_REQUESTS = "SELECT conv_id * 1000 + turn AS id, conv_id % 5 AS tenant, CASE WHEN conv_id % 3 > 0 THEN 'gpt-4o' END AS model, coalesce(text, '') AS question FROM conversations WHERE role = 'user'"
add_derived("X72_cache_keys", {"r": _REQUESTS}, lambda r: r.select("id", F.concat_ws(":", F.col("tenant").cast("string"), F.coalesce("model", F.lit("")), F.substring(F.sha2("question", 256), 1, 16)).alias("key")), "SELECT id, tenant || ':' || coalesce(model, '') || ':' || substr(sha256(question), 1, 16) AS key FROM r")
add("A19_json_top", "events", lambda e: e.groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(10), "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, k LIMIT 10")
