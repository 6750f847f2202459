"""Neighbours, candidate texts, embedding scores, base selection, trigrams; scopes and console rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import assembly, scopes
from .registry import _LEX, _lexical, add, add_derived, add_many, spread

_CUT = lambda c, n: f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n - 1}) || '…' ELSE {c} END"
add("R7_candidate_text", "conversations", lambda c: assembly.with_neighbours(c, "conv_id", "turn", "text", 1, own=300, other=200).select("conv_id", "turn", F.md5("context").alias("digest")), f"""
    SELECT a.conv_id, a.turn, md5(concat_ws(chr(10), {_CUT('a.text', 300)}, nullif({_CUT('b.text', 200)}, ''), nullif({_CUT('c.text', 200)}, ''))) AS digest
    FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations) a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 LEFT JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn + 1""")
add("R14_cited_context", "conversations", lambda c: assembly.with_neighbours(c, "conv_id", "turn", "text", 2).select("conv_id", "turn", F.md5("context").alias("digest")), """
    SELECT a.conv_id, a.turn, md5(concat_ws(chr(10), coalesce(any_value(a.text), ''), string_agg(nullif(b.text, ''), chr(10) ORDER BY b.turn))) AS digest
    FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn + 2 AND b.turn <> a.turn GROUP BY a.conv_id, a.turn""")
_PAIRS = """SELECT * FROM (VALUES (1, 1, 'orario ufficio anagrafe', 'L''ufficio anagrafe osserva il seguente orario: lunedì e mercoledì mattina, chiuso il venerdì.', '1,0,1', '1,0.5,1', 0.4, 'Punteggio: 85'),
    (1, 2, 'orario ufficio anagrafe', 'Orari uffici', '1,0,1', '0,1,0', 0.9, 'nessuno'), (1, 3, 'orario ufficio anagrafe', 'Telefono della polizia municipale e dei vigili urbani del comune', '1,0,1', '0.2,0,0.1', NULL, '140'),
    (2, 4, 'il la di', 'testo senza parole della domanda', '0,1,0', '0,2,0', 0.1, NULL), (2, 5, 'il la di', 'altro testo', '0,1,0', NULL, 0.3, '7 su 10')) AS t(query_id, id, query, text, q, v, score, answer)"""
_CASES = spread(_PAIRS.replace("t(query_id, id,", "t(query_id, id,"), 5, "query text q v score answer", "documents", "doc_id", "text")
_PAIRS = f"SELECT id % 97 AS query_id, id, query, text, q, v, score, answer FROM ({_CASES})"
_STOP = ", ".join(f"'{w}'" for w in assembly.STOP_WORDS)
_WEIGHTY = ", ".join(f"'{w}'" for w in assembly.WEIGHTY)
_EMBEDDED = f""", w AS (SELECT *, list_filter(regexp_split_to_array(lower(query), '\\W+'), lambda x: length(x) >= 3 AND x NOT IN ({_STOP})) AS qw, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\W+'), lambda x: length(x) >= 3 AND x NOT IN ({_STOP}))) AS tw,
    CAST(string_split(q, ',') AS DOUBLE[]) AS qv, CAST(string_split(v, ',') AS DOUBLE[]) AS vv FROM c),
k AS (SELECT query_id, id, x, tw, count(*) * (1 + CASE WHEN length(x) >= 6 THEN 0.3 ELSE 0 END + CASE WHEN x IN ({_WEIGHTY}) THEN 0.5 ELSE 0 END)::DOUBLE AS wt FROM (SELECT query_id, id, tw, unnest(qw) AS x FROM w) GROUP BY query_id, id, x, tw),
f AS (SELECT query_id, id, sum(CASE WHEN list_contains(tw, x) THEN wt WHEN len(list_filter(tw, lambda t: length(x) >= 4 AND length(t) >= 4 AND (x[:4] = t[:4] OR x[-4:] = t[-4:] OR (length(x) <= 8 AND length(t) <= 8 AND levenshtein(x, t) <= 2)))) > 0 THEN wt * 0.7 ELSE 0 END) / sum(wt) AS cov FROM k GROUP BY 1, 2),
s AS (SELECT w.query_id, w.id, CASE WHEN vv IS NULL THEN 0 ELSE list_sum(list_transform(list_zip(qv, vv), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(qv, lambda p: p * p))) * sqrt(list_sum(list_transform(vv, lambda p: p * p)))) * 0.7::DOUBLE
    + coalesce(cov, 0.5)::DOUBLE * 0.2::DOUBLE + (CASE WHEN length(text) < 50 THEN 0.7 WHEN length(text) <= 100 THEN 0.9 WHEN length(text) <= 500 THEN 1.0 WHEN length(text) <= 800 THEN 0.95 ELSE 0.8 END)::DOUBLE * 0.1::DOUBLE END * 0.8::DOUBLE + coalesce(score, 0)::DOUBLE * 0.2::DOUBLE AS score FROM w LEFT JOIN f USING (query_id, id))"""
_VECTORS = lambda c: c.withColumns({x: F.split(x, ",").cast("array<double>") for x in ("q", "v")}).withColumn("score", F.col("score").cast("double"))
_RANKED = "SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS \"rank\" FROM "
_SCORERS = {"embedding": assembly.by_embedding, "judged": assembly.by_judgement("answer")}
_OUT = ("query_id", "id", "round(score, 6) as score", "rank")
add_derived("R9_embedding_rerank", {"c": _PAIRS}, lambda c: assembly.rerank_with("embedding", _VECTORS(c), _SCORERS, 9).selectExpr(*_OUT), _EMBEDDED + 'SELECT * FROM (' + _RANKED + 's) WHERE "rank" <= 9')
add_derived("R10_judged_rerank", {"c": _PAIRS}, lambda c: assembly.rerank_with("judged", _VECTORS(c), _SCORERS, 9).selectExpr(*_OUT),
    r", s AS (SELECT query_id, id, CASE WHEN n IS NULL THEN 50 ELSE least(100, n) END / 100 AS score FROM (SELECT *, try_cast(nullif(regexp_extract(coalesce(answer, ''), '\d+'), '') AS INT) AS n FROM c)) SELECT * FROM (" + _RANKED + 's) WHERE "rank" <= 9')
add_derived("R12_driver_choice", {"c": _PAIRS}, lambda c: assembly.rerank_with("none", _VECTORS(c).fillna(0.0, ["score"]), _SCORERS, 1).selectExpr(*_OUT), "SELECT * FROM (" + _RANKED + '(SELECT query_id, id, coalesce(score, 0)::DOUBLE AS score FROM c)) WHERE "rank" <= 1')
add_many("R6_best_base", ["benchmark", "documents"], lambda b, d: assembly.best_base(_lexical(b, d).join(d.select("doc_id", "source"), "doc_id"), "source", F.when(F.col("source") == "web", 0.5).otherwise(1.0), b.select(F.col("item_id").alias("query_id")), "default").select("query_id", "base", F.round("score", 6).alias("score")),
    _LEX + """, g AS (SELECT query_id, source AS base, sum(score * CASE WHEN source = 'web' THEN 0.5::DOUBLE ELSE 1 END) AS score FROM lex JOIN documents USING (doc_id) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base) AS n FROM g)
    SELECT item_id AS query_id, coalesce(base, 'default') AS base, round(coalesce(score, 0), 6) AS score FROM benchmark LEFT JOIN (SELECT * FROM r WHERE n = 1) ON item_id = query_id""")
add_many("J4_fused_in_base", ["benchmark", "documents"], lambda b, d: _lexical(b, d).join(d.filter("source = 'web'").select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id"), _LEX + " SELECT query_id, doc_id FROM lex JOIN documents USING (doc_id) WHERE source = 'web'")
add_many("R16_complete", ["conversations", "labels"], lambda c, x: c.join(x.filter("quality = 0").select(F.col("doc_id").alias("conv_id")), "conv_id", "left_semi").select("conv_id", "turn").orderBy("conv_id", "turn"), "SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
_TRI = lambda c: f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
add("X13_trigrams", "part", lambda p: p.select("p_partkey", F.round(assembly.trigram_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity")),
    f"SELECT p_partkey, round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE ELSE 0 END, 6) AS similarity FROM (SELECT p_partkey, {_TRI('p_name')} AS a, {_TRI('p_type')} AS b FROM part)")
add("J18_candidates", "part", lambda p: p.filter((assembly.trigram_similarity(F.col("p_name"), F.lit("green steel")) >= 0.3) | F.contains("p_name", F.lit("green"))).select("p_partkey"),
    f"SELECT p_partkey FROM (SELECT p_partkey, p_name, {_TRI('p_name')} AS a, {_TRI(chr(39) + 'green steel' + chr(39))} AS b FROM part) WHERE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE >= 0.3 OR contains(p_name, 'green')")



def _as_of() -> Column:
    return F.lit("2024-01-02 12:00:00").cast("timestamp")


_NOW = "TIMESTAMP '2024-01-02 12:00:00'"
_FORMS = """SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'responded' ELSE 'closed' END AS status, CASE WHEN user_id % 3 > 0 THEN user_id % 3 = 1 END AS has_active_conversation,
    CASE WHEN event_id % 5 = 0 THEN 'urgent' ELSE 'normal' END AS conversation_priority, CASE WHEN event_type <> 'signup' THEN CAST(ts AS TIMESTAMP) END AS last_response_at FROM events"""
add_derived("F21_form_scopes", {"f": _FORMS}, lambda f: f.select("id", *(scopes.is_(s, scopes.FORMS).alias(s) for s in scopes.FORMS), F.coalesce(scopes.recent_activity(_as_of()), F.lit(False)).alias("recent")),
    f"SELECT id, status = 'pending' AS pending, status = 'responded' AS responded, status = 'closed' AS closed, coalesce(has_active_conversation, FALSE) AS active, conversation_priority = 'urgent' AS urgent, coalesce(last_response_at >= {_NOW} - INTERVAL 24 HOUR, FALSE) AS recent FROM f")
_RESPONSES = """SELECT conv_id * 1000 + turn AS id, CASE WHEN role = 'user' THEN 'email' ELSE 'web' END AS response_type, conv_id % 2 = 0 AS email_sent, CASE WHEN conv_id % 5 = 0 THEN 'urgent' ELSE 'low' END AS priority,
    turn = 0 AS is_thread_starter, turn % 2 = 1 AS admin_notified, conv_id % 3 = 0 AS user_read FROM conversations"""
add_derived("F22_response_scopes", {"r": _RESPONSES}, lambda r: r.select("id", *(scopes.is_(s, scopes.RESPONSES).alias(s) for s in scopes.RESPONSES), scopes.mail_pending().alias("mail_pending")),
    "SELECT id, response_type = 'email' AS email, response_type = 'web' AS web, email_sent AS sent, priority = 'urgent' AS urgent, is_thread_starter AS starters, NOT admin_notified AS unnotified, NOT user_read AS unread, response_type = 'email' AND NOT email_sent AS mail_pending FROM r")
_USERS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'Joanna ' ELSE '' END || c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN 'x@ANNEX.org' ELSE 'x@example.org' END AS email, c_custkey % 4 > 0 AS is_operator,
    CASE c_custkey % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'busy' ELSE 'offline' END AS operator_status, TIMESTAMP '2024-01-02 12:00:00' - INTERVAL '1' MINUTE * (c_custkey % 20) AS last_seen_at, TIMESTAMP '2023-01-01 00:00:00' + INTERVAL '1' MINUTE * c_custkey AS created_at FROM customer"""
add_derived("F23_online_operators", {"u": _USERS}, lambda u: u.filter(scopes.online(_as_of())).select("id"), f"SELECT id FROM u WHERE is_operator AND operator_status IN ('available', 'busy') AND last_seen_at >= {_NOW} - INTERVAL 5 MINUTE")
add_derived("F24_users", {"u": _USERS, "r": "SELECT o_custkey AS user_id, o_orderkey % 9 AS tenant_id, CASE o_orderstatus WHEN 'P' THEN 'agent' ELSE 'customer' END AS role FROM orders"}, lambda u, r: scopes.users(u, r, search="ANN", role="agent", page=1, size=2).select("id"),
    "SELECT id FROM u WHERE (contains(lower(name), 'ann') OR contains(lower(email), 'ann')) AND EXISTS (SELECT 1 FROM r WHERE user_id = id AND role = 'agent') ORDER BY created_at DESC, id DESC LIMIT 2")
_CRAWLS = "SELECT page_id AS id, CAST(length(html) % 5 AS INT) AS pages_found, TIMESTAMP '2024-01-02 12:00:00' - INTERVAL '1' MINUTE * (page_id * 7) AS created_at FROM pages"
add_derived("F25_stale_crawls", {"c": _CRAWLS}, lambda c: c.select("id", scopes.stale(_as_of()).alias("old"), scopes.stale(_as_of(), ghosts=True).alias("ghost")), f"SELECT id, created_at < {_NOW} - INTERVAL 24 HOUR AS old, pages_found = 0 AS ghost FROM c")
_SCHEDULES = "SELECT p_partkey AS id, p_size AS interval_minutes, CASE WHEN p_partkey % 9 > 0 THEN TIMESTAMP '2024-01-02 12:00:00' - INTERVAL '1' MINUTE * (p_partkey % 60) END AS last_run_at FROM part"
add_derived("G11_due_schedules", {"s": _SCHEDULES}, lambda s: s.filter(scopes.due(_as_of())).select("id"), f"SELECT id FROM s WHERE last_run_at IS NULL OR last_run_at <= {_NOW} - to_minutes(interval_minutes)")
add("T11_polling", "events", lambda e: scopes.polled(e, "ts", "event_id", F.lit("2024-01-10").cast("timestamp_ntz"), 20, 50).select("event_id"), "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' ORDER BY ts, event_id LIMIT 50 OFFSET 20")
add("T12_chunk_preview", "conversations", lambda c: c.orderBy("conv_id", "turn").select("conv_id", "turn", F.substring("text", 1, 60).alias("preview")), "SELECT conv_id, turn, substr(text, 1, 60) AS preview FROM conversations")
add("X79_source_url", "pages", lambda p: p.select("page_id", scopes.source_url(F.col("html")).alias("source")), r"SELECT page_id, coalesce(nullif(regexp_extract(html, '(?i)\*\*URL:\*\*\s+(https?://[^\s]+)', 1), ''), nullif(regexp_extract(html, '(?i)(https?://[^\s)]+)', 1), '')) AS source FROM pages")
_PLANS = "SELECT p_partkey AS id, p_size AS seeds, CAST(p_partkey % 50 AS INT) AS sitemap, CAST(p_partkey % 4 AS INT) AS depth, p_partkey % 2 = 0 AS scripted, CAST(p_partkey % 3 AS DOUBLE) / 64 AS per_second FROM part"
add_derived("X80_crawl_plan", {"p": _PLANS}, lambda p: p.select("id", scopes.crawl_plan(*(F.col(c) for c in ("seeds", "sitemap", "depth", "scripted", "per_second"))).alias("e")).select("id", F.round("e.urls", 4).alias("urls"), F.round("e.seconds", 4).alias("seconds")),
    "SELECT id, round(urls, 4) AS urls, round(urls * greatest(CASE WHEN scripted THEN 45 ELSE 5 END, CASE WHEN per_second > 0 THEN 1 / per_second::DOUBLE ELSE 0 END), 4) AS seconds FROM (SELECT *, (seeds * ((pow(10, greatest(1, depth)) - 1) / 9) + sitemap) * 0.3 AS urls FROM p)")
add_many("G8_zombies", ["embeddings", "documents"], lambda v, d: v.join(d, F.col("vec_id") == F.col("doc_id"), "left_anti").select("vec_id"), "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
add_many("G16_reindex", ["orders", "lineitem"], lambda o, x: o.join(x.groupBy("l_orderkey").agg(F.count("*").alias("chunks")), F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("chunks", F.lit(0)).alias("chunks")), "SELECT o_orderkey, count(l_orderkey) AS chunks FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
add_many("G15_bulk_delete", ["lineitem", "orders"], lambda x, o: x.join(o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select((F.col("l_orderkey") * 100_000 + F.col("l_linenumber")).alias("key")), "SELECT l_orderkey * 100000 + l_linenumber AS key FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
add("A28_daily_usage", "events", lambda e: e.groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("requests"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean")), "SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS requests, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2")
