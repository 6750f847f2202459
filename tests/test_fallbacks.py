"""Stages of answers, similar questions, crawls with a budget, appended metrics."""

from __future__ import annotations

import os
import random
from collections import deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragloom.operators import cascade, crawl, retrieval, similarity
from ragloom.streaming import metrics

# --- lexical search ---


def test_scores_in_place_as_by_a_join(spark, monkeypatch):
    rnd = random.Random(4)
    words = ["alpha", "beta", "gamma", "x1", "zeta", "È", "a"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs = spark.createDataFrame([(i, text(rnd.randrange(0, 12))) for i in range(60)] + [(70, None), (None, "alpha"), (71, ""), (72, "Alpha-ALPHA")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "Zeta? x1."), (3, "nothing here"), (4, None), (5, "a"), (None, "gamma")], "query_id long, text string")
    monkeypatch.setattr(retrieval, "SCORE_CELLS", 30)
    here = sorted(map(tuple, retrieval.lexical_top_k(queries.filter("query_id is not null"), docs, 4).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 0)
    joined = sorted(map(tuple, retrieval.lexical_top_k(queries.filter("query_id is not null"), docs, 4).collect()))
    assert here == joined and {r[0] for r in here} == {1, 2}
    assert retrieval.lexical_top_k(queries, docs.limit(0), 4).collect() == []


# --- similar questions ---


def by_definition(a: bytes, b: bytes) -> int:
    """The longest common substring, then both sides again."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    n, i, j = best
    return n + by_definition(a[:i], b[:j]) + by_definition(a[i + n :], b[j + n :]) if n else 0


@settings(max_examples=400, deadline=None)
@given(st.text("abc é", max_size=14), st.text("abc é", max_size=14))
def test_similar_text_by_definition(a, b):
    a, b = a.encode(), b.encode()
    exact = by_definition(a, b)
    assert similarity.similar(a, b) == exact and min(len(a), len(b)) >= similarity.common_length(a, b) >= exact
    whole = 200.0 * exact / (len(a) + len(b)) if a or b else 0.0
    assert similarity.percent(a, b) == whole
    assert similarity.percent(a, b, 70.0) == (whole if whole >= 70 else None)


def test_pairs_of_benchmark_texts(spark):
    path = "/root/testdata/sf0.001/benchmark.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    texts = [r.text.lower().encode()[:120] for r in spark.read.parquet(path).collect()][:12]
    for a in texts:
        for b in texts:
            assert similarity.similar(a, b) == by_definition(a, b)


def test_questions_of_forms(spark):
    rows = [(1, "Quando apre lo sportello?"), (2, "quando apre sportello"), (3, "lo sportello dove quando si apre mai"), (4, "altro"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("percent", F.lit(0))
    got = similarity.matching_questions(df, ["id"], "text", [(9, " Quando apre lo sportello? "), (8, ""), (7, None), (6, "altro")]).collect()
    assert {(r.id, r.question_id) for r in got} == {(1, 9), (2, 9), (3, 9), (4, 6)}
    assert {r.id: r.percent for r in got}[1] == 100.0
    assert similarity.matching_questions(df, ["id"], "text", []).collect() == []


# --- stages ---


def test_later_stages_get_open_queries_only(spark):
    asked: list[set] = []

    def stage(answers):
        def run(left):
            asked.append({r.query_id for r in left.collect()})
            return left.filter(F.col("query_id").isin(*answers)).select("query_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("doc_id"))

        return run

    queries = spark.range(5).withColumnRenamed("id", "query_id")
    got = cascade.cascade(queries, [("a", stage([0, 1])), ("b", stage([1, 3])), ("c", stage([99])), ("d", stage([2, 4]))]).collect()
    assert asked == [{0, 1, 2, 3, 4}, {2, 3, 4}, {2, 4}, {2, 4}]
    assert {(r.query_id, r.stage, r.stage_no) for r in got} == {(0, "a", 1), (1, "a", 1), (3, "b", 2), (2, "d", 4), (4, "d", 4)} and len(got) == 10
    asked.clear()
    cascade.cascade(queries, [("a", stage(range(5))), ("b", stage([1]))]).collect()
    assert asked == [{0, 1, 2, 3, 4}]  # nothing is open, nobody is asked
    assert cascade.cascade(queries.limit(0), [("a", stage([1])), ("b", stage([1]))]).collect() == []


def test_intent_by_stages(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha delta"), (3, "polizia locale"), (4, "comando polizia"), (5, None)], "doc_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    queries = spark.createDataFrame([(10, "Alpha beta", None), (11, "zzz", [0.9, 0.1]), (12, "delta zzz", None), (13, "zzz", None), (14, None, None)], "query_id long, text string, q array<double>")
    got = cascade.execute_intent(queries, docs, vectors, least_cosine=0.5, patterns=("comando polizia", "polizia")).collect()
    assert {(r.query_id, r.doc_id, r.stage) for r in got} == {(10, 1, "specific"), (11, 1, "semantic"), (12, 2, "text"), (13, 4, "database"), (13, 3, "database"), (14, 4, "database"), (14, 3, "database")}


def test_entity_name(spark):
    df = spark.createDataFrame([("Qual è il telefono dell'Anagrafe centrale?",), ("telefono",), (None,), ("Telefonomania: orari di apertura",), ("  numero di telefono del Sindaco  ",)], "q string")
    got = [tuple(r) for r in df.select(*(cascade.entity_name(F.col("q"), i) for i in ("phone", "schedule"))).collect()]
    assert got == [("dell anagrafe centrale",) * 2, ("", ""), (None, None), ("telefonomania orari apertura", "telefonomania"), ("sindaco", "sindaco")]
    assert df.select(cascade.entity_name(F.col("q"), "", ())).collect()[1][0] == "telefono"


# --- crawls ---


def by_queue(links, seeds, max_depth, max_pages, allowed):
    queue, out = deque(), {}

    def visit(url, depth):
        if allowed(url) and url not in out and len(out) < max_pages:
            out[url] = (depth, len(out) + 1)
            queue.append(url)

    for s in seeds:
        visit(s, 0)
    while queue:
        url = queue.popleft()
        if out[url][0] < max_depth:
            for target in links.get(url, []):
                visit(target, out[url][0] + 1)
    return {(u, d, r, d < max_depth) for u, (d, r) in out.items()}


@pytest.mark.parametrize("seed", range(4))
def test_crawl_as_a_queue(spark, seed):
    rnd = random.Random(seed)
    urls = [f"u{i}" for i in range(60)]
    links = {u: rnd.sample(urls, rnd.randrange(0, 8)) for u in urls}
    seeds = rnd.sample(urls, 5)
    edges = spark.createDataFrame([(u, t, i) for u, ts in links.items() for i, t in enumerate(ts)], "source string, target string, position int").repartition(rnd.randrange(1, 6))
    start = spark.createDataFrame([(s, i) for i, s in enumerate(seeds)] + [(None, 9), (seeds[0], 10)], "url string, position int")
    depth, pages = rnd.randrange(0, 5), rnd.choice([3, 12, 25, 1000])
    got = crawl.crawl(edges, start, max_depth=depth, max_pages=pages, allowed=F.col("url") != "u7")
    assert set(map(tuple, got.collect())) == by_queue(links, seeds, depth, pages, lambda u: u != "u7")


def test_chain_with_a_depth_limit(spark):
    edges = spark.createDataFrame([(f"p{i}", f"p{i + 1}", 0) for i in range(20)], "source string, target string, position int")
    got = crawl.crawl(edges, spark.createDataFrame([("p0", 0)], "url string, position int"), max_depth=11, max_pages=1000).collect()
    assert len(got) == 12 and sum(r.expanded for r in got) == 11


def test_collected(spark):
    make = lambda urls: spark.createDataFrame(list(enumerate(urls)), "position int, url string")
    got = crawl.collected([make(["b", "x", None]), make(["c", "b", "no", "a"]), make(["d"])], 4, F.col("url") != "no").collect()
    assert {(r.url, r.rank) for r in got} == {("b", 1), ("x", 2), ("c", 3), ("a", 4)}


# --- metrics ---


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    source, table, state = (f"{tmp_path}/{x}" for x in ("in", "table", "state"))
    spark.range(10).selectExpr("'retrieval' as step", "id * 1D as duration_ms").write.parquet(source)
    stream = lambda: spark.readStream.schema("step string, duration_ms double").parquet(source)
    metrics.append_metrics(stream(), table, state).awaitTermination()
    first = sorted(map(str, metrics.read_metrics(spark, table).collect()))
    assert len(first) == 10
    # the batch was written, but not recorded as done: it comes again after a restart
    commits = f"{state}/commits"
    for name in os.listdir(commits):
        if name.strip(".").split(".")[0] == "0":
            os.remove(f"{commits}/{name}")
    metrics.append_metrics(stream(), table, state).awaitTermination()
    assert sorted(map(str, metrics.read_metrics(spark, table).collect())) == first
    spark.range(3).selectExpr("'rerank' as step", "id * 1D as duration_ms").write.mode("append").parquet(source)
    metrics.append_metrics(stream(), table, state).awaitTermination()
    rows = metrics.read_metrics(spark, table)
    assert rows.count() == 13 and rows.select("metric_id").distinct().count() == 13


def test_questions_lose_blanks_only(spark):
    """A line break at the end of a question belongs to it, as in SQL."""
    rows = spark.createDataFrame([(1, "when do they open\nand close")], "k long, t string")
    got = similarity.matching_questions(rows, ["k"], "t", [(7, " when do they open\n")]).collect()
    assert [(r.question_id, r.percent) for r in got] == [(7, 200.0 * 18 / (18 + 27))]
