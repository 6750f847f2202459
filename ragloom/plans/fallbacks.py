"""Answers in stages, similar questions, crawls with a budget, appended metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cascade, crawl, filtered_search, similarity
from ..session import ensure_checkpoints, load
from ..streaming import metrics
from .registry import _LEX, ORACLE, QUERIES, add, add_many
from .texts import LINKS

_TERMS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 2))"
_COSINE, _RANK, _PATTERNS = 0.3, 0.032, ("the that", "de la", "und")


def _cascade(b: DataFrame, d: DataFrame, v: DataFrame) -> DataFrame:
    queries = b.select(F.col("item_id").alias("query_id"), "text").join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id", "left")
    # every third query has no vector, as where the embedding service failed
    queries = queries.withColumn("q", F.when(F.col("query_id") % 3 > 0, F.col("q")))
    vectors = v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return cascade.execute_intent(queries, d, vectors, least_cosine=_COSINE, least_rank=_RANK, patterns=_PATTERNS)


add_many("R17_cascade", ["benchmark", "documents", "embeddings"], _cascade, _LEX.replace("WITH ", f"""WITH asked AS (SELECT item_id AS query_id, unnest({_TERMS}) AS term, len({_TERMS}) AS m FROM benchmark),
held AS (SELECT doc_id, unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 2)) AS term FROM documents),
cnt AS (SELECT doc_id, term, count(*) AS n FROM held WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
al AS (SELECT query_id, doc_id, sum(n)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY sum(n) DESC, doc_id) AS r FROM asked JOIN cnt USING (term) GROUP BY query_id, doc_id, m HAVING count(*) = m),
s1 AS (SELECT query_id, doc_id, score, 'specific' AS stage, 1 AS stage_no FROM al WHERE r <= 5),
vec0 AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc_id,
    round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS score
    FROM embeddings q JOIN benchmark ON q.vec_id = item_id JOIN embeddings v ON q.vec_id <> v.vec_id WHERE item_id % 3 > 0)),
s2 AS (SELECT query_id, doc_id, score, 'semantic', 2 FROM vec0 WHERE r <= 5 AND score >= {_COSINE} AND query_id NOT IN (SELECT query_id FROM s1)), """, 1) + f""",
s3 AS (SELECT query_id, doc_id, score, 'text', 3 FROM lex WHERE rank <= 5 AND score >= {_RANK} AND query_id NOT IN (SELECT query_id FROM s1 UNION ALL SELECT query_id FROM s2)),
db AS (SELECT doc_id FROM (SELECT doc_id, CASE {' '.join(f"WHEN contains(lower(text), '{p}') THEN {i}" for i, p in enumerate(_PATTERNS))} END AS place FROM documents) WHERE place IS NOT NULL ORDER BY place, doc_id DESC LIMIT 10),
s4 AS (SELECT item_id, doc_id, 0.8::DOUBLE, 'database', 4 FROM benchmark, db WHERE item_id NOT IN (SELECT query_id FROM s1 UNION ALL SELECT query_id FROM s2 UNION ALL SELECT query_id FROM s3))
SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4""")


def _questions(benchmark: DataFrame) -> DataFrame:
    """Items of ``benchmark`` as messages, and the first three quarters of each as questions."""
    asked = [(r.item_id, r.start) for r in benchmark.select("item_id", F.expr("substr(text, 1, cast(ceil(length(text) * 0.75) as int)) as start")).collect()]
    found = similarity.matching_questions(benchmark, ["item_id"], "text", asked)
    return found.withColumns({c: F.round(c, 6) for c in ("percent", "word_percent")})


# the beginning of a text is in common with it as a whole; that no other pair is as similar, the tests show by the definition
add("X66_similar_questions", "benchmark", _questions, """WITH q AS (SELECT item_id AS question_id, lower(trim(substr(text, 1, ceil(length(text) * 0.75)::BIGINT))) AS q FROM benchmark),
w AS (SELECT *, list_filter(string_split(q, ' '), lambda x: length(x) > 3) AS words FROM q),
p AS (SELECT item_id, question_id, CASE WHEN contains(lower(text), q) THEN 200.0::DOUBLE * strlen(q) / (strlen(q) + strlen(text)) END AS percent,
    CASE WHEN len(words) > 0 THEN 100.0::DOUBLE * len(list_filter(words, lambda x: contains(lower(text), x))) / len(words) ELSE 0 END AS word_percent FROM benchmark, w)
SELECT item_id, question_id, round(percent, 6) AS percent, round(word_percent, 6) AS word_percent FROM p WHERE percent >= 70 OR word_percent >= 60""")

def _filtered(v: DataFrame) -> DataFrame:
    """Every row whose id is divisible by 100 against all vectors of its label."""
    rows = v.select(F.col("vec_id").alias("id"), F.col("label").alias("tenant"), F.col("embedding").alias("v"))
    queries = rows.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "tenant", F.col("v").alias("q"))
    return filtered_search.search(queries, rows, 10)


add("T2_tenant_top_k", "embeddings", _filtered, None)

_DEPTH, _PAGES = 2, 400


def _crawl(pages: DataFrame) -> DataFrame:
    seeds = pages.select("url", F.col("page_id").alias("position")).filter(F.contains("url", F.lit("utm_source=feed")))
    return crawl.crawl(crawl.ordered_links(pages), seeds, max_depth=_DEPTH, max_pages=_PAGES, allowed=~F.col("url").rlike(r"\.(pdf|zip)$"))


# level by level: the first page that links to an address, then the place of the link
_LEVEL = "SELECT url, row_number() OVER (ORDER BY b.page, b.position) AS r FROM (SELECT target AS url, min({{'page': l.rank, 'position': position}}) AS b FROM links JOIN {last} l USING (url) WHERE target <> links.url AND NOT regexp_matches(target, '[.](pdf|zip)$') AND target NOT IN ({seen}) GROUP BY target)"
add("G2_capped_crawl", "pages", _crawl, f"""WITH {LINKS},
zero AS (SELECT url, row_number() OVER (ORDER BY min(page_id), url) AS rank FROM pages WHERE contains(url, 'utm_source=feed') AND NOT regexp_matches(url, '[.](pdf|zip)$') GROUP BY url QUALIFY rank <= {_PAGES}),
one AS (SELECT url, r + (SELECT count(*) FROM zero) AS rank FROM ({_LEVEL.format(last="zero", seen="SELECT url FROM zero")}) WHERE r + (SELECT count(*) FROM zero) <= {_PAGES}),
two AS (SELECT url, r + (SELECT count(*) FROM zero) + (SELECT count(*) FROM one) AS rank FROM ({_LEVEL.format(last="one", seen="SELECT url FROM zero UNION ALL SELECT url FROM one")}) WHERE r + (SELECT count(*) FROM zero) + (SELECT count(*) FROM one) <= {_PAGES})
SELECT url, 0 AS depth, rank, TRUE AS expanded FROM zero UNION ALL SELECT url, 1, rank, TRUE FROM one UNION ALL SELECT url, 2, rank, FALSE FROM two""")


def _collected(pages: DataFrame) -> DataFrame:
    seeds = pages.select("url", F.col("page_id").alias("position")).filter(F.contains("url", F.lit("utm_source=feed")))
    return crawl.collected([seeds, pages.select("url", F.col("page_id").alias("position"))], 100, F.col("url").startswith("https://"))


add("G14_collected", "pages", _collected, """SELECT url, row_number() OVER (ORDER BY list, position, url) AS rank FROM (SELECT url, b.list AS list, b.position AS position FROM (SELECT url, min({'list': list, 'position': position}) AS b FROM (
    SELECT url, page_id AS position, 0 AS list FROM pages WHERE contains(url, 'utm_source=feed') UNION ALL SELECT url, page_id, 1 FROM pages WHERE starts_with(url, 'https://')) GROUP BY url)) QUALIFY row_number() OVER (ORDER BY list, position, url) <= 100""")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as step metrics through the appending sink, then counted."""
    ensure_checkpoints(spark)
    schema = load(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    steps = stream.select(F.col("event_type").alias("step"), (F.col("value") * 100).alias("duration_ms"), F.col("user_id").cast("string").alias("correlation_id"), "ts")
    base = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/ragloom/metrics-{uuid.uuid4().hex}"
    metrics.append_metrics(steps, f"{base}/table", f"{base}/state").awaitTermination()
    return metrics.read_metrics(spark, f"{base}/table").groupBy("step").agg(F.count("*").alias("n"), F.count_distinct("metric_id").alias("ids"), F.round(F.sum("duration_ms"), 2).alias("total"))


QUERIES["ST3_step_metrics"] = _metrics
ORACLE["ST3_step_metrics"] = "SELECT event_type AS step, count(*) AS n, count(*) AS ids, round(sum(value * 100), 2) AS total FROM events GROUP BY 1"
