"""What the findings of round 3 on memory and time ask for."""

import os
import random
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from ragloom.functions import encodings
from ragloom.operators import cascade, chunking, page_markdown, page_quality, page_tree, retrieval, tables


def test_chunks_leave_a_worker_as_they_are_made(spark, monkeypatch):
    def cut(text, size, overlap):
        with open("/proc/self/statm") as f:
            pages = int(f.read().split()[1])
        return [str(pages), *(f"{text}{k}" * 1_000 for k in range(20))]

    monkeypatch.setitem(chunking.STRATEGIES, "probe", cut)
    rows = spark.range(0, 4_000, 1, 1).select(F.col("id").alias("k"), F.array(F.col("id")).alias("also"), F.lpad(F.col("id").cast("string"), 5, "t").alias("text"))
    got = chunking.chunks(rows, "text", 100, 10, "probe")
    assert got.columns == ["k", "also", "chunk_index", "content"]
    held = got.filter("chunk_index = 0").agg(F.min(F.col("content").cast("long")).alias("low"), F.max(F.col("content").cast("long")).alias("high")).first()
    assert (held.high - held.low) * os.sysconf("SC_PAGE_SIZE") < 250e6  # all chunks of the rows are 480 MB
    assert got.filter("also[0] <> k or chunk_index > 20").isEmpty()


def test_chunks_of_null_and_blank_texts(spark):
    df = spark.createDataFrame([(1, None), (2, " \n "), (3, "One. Two.")], "k long, text string")
    assert [tuple(r) for r in chunking.chunks(df, "text", 6, 0, "sentence").collect()] == [(3, 0, "One."), (3, 1, "Two.")]


def test_directories_take_time_in_proportion_to_their_lines(spark):
    text = "\n".join(f"Office {k}\n+39 055 {k:07d}\nStreet {k}" for k in range(3_000))
    df = spark.createDataFrame([(1, text)], "k long, text string")
    began = time.time()
    got = df.select(F.explode(tables.directory_entries(F.col("text"))).alias("e")).select("e.*").collect()
    assert time.time() - began < 20
    assert len(got) == 3_000
    assert tuple(got[7]) == ("Office 7", "+39 055 0000007", "Street 7", "Nome: Office 7\nTelefono: +39 055 0000007\nIndirizzo: Street 7")


def test_only_blanks_at_the_very_end_are_stripped(spark):
    df = spark.createDataFrame([(1, " a  "), (2, "\t\x0b\x00b\n ")], "k long, text string")
    assert [r[0] for r in df.orderBy("k").select(tables._strip(F.col("text"))).collect()] == ["a  ", "b"]


def test_page_metrics_name_each_costly_step_once(spark):
    pages = spark.createDataFrame([(1, "<p>Hello, world. 06 1234</p>")], "page_id long, html string")
    plan = page_quality.metrics(pages).select("page_id", "quality", "category")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-zA-Z]") == 1 and plan.count("telefono") == 2  # a category and a group of business words


def test_encodings_are_mended_few_texts_at_a_time():
    texts = pa.array(["cittÃ", "è", None] * 100)
    assert [len(x) for x in encodings._repaired.func(iter([texts]))] == [128, 128, 44]
    pieces = list(encodings._fetched.func(iter([(pa.array([b"\xe8", None] * 150), pa.array(["windows-1252", "utf-8"] * 150))])))
    assert [len(x) for x in pieces] == [128, 128, 44] and pieces[0].to_pylist()[:2] == ["è", None]


def test_nearest_vectors_with_ties_and_without_a_number(spark):
    vectors = [(i, [1.0, float(i % 3)]) for i in range(30)] + [(30 + i, [float("nan"), 1.0]) for i in range(5)]
    v = spark.createDataFrame(vectors, "id long, v array<double>")
    got = retrieval.vector_top_k(v.filter("id in (3, 31)").select(F.col("id").alias("query_id"), F.col("v").alias("q")), v, 12)
    found = {(r.query_id, r["rank"]): r.id for r in got.filter("query_id = 3").collect()}
    assert [found[3, k] for k in range(1, 13)] == [0, 6, 9, 12, 15, 18, 21, 24, 27, 1, 4, 7]


def test_all_terms_are_met_within_a_document(spark):
    said = ["red blue", "blue", "red red blue green", None, "", "green red", "blue x red", "BLUE! red", "green"]
    texts = [(i, t) for i, t in enumerate(said)] + [(20, "red"), (20, "blue red"), (None, "red"), (None, "blue")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    asked = [(1, "Red, blue"), (2, "green"), (3, "red blue red"), (4, "purple red"), (5, "a -"), (6, None)]
    queries = spark.createDataFrame(asked, "query_id int, text string")
    words = {}
    for i, t in texts:  # rows of one id, or of none, are one document
        words.setdefault(i, []).extend(re.findall("[a-z0-9]{2,}", (t or "").lower()))
    for k in (2, 20):
        want = set()
        for q, t in asked:
            terms = set(re.findall("[a-z0-9]{2,}", (t or "").lower()))
            held = [(-sum(w.count(x) for x in terms), -1 if i is None else i, q, i) for i, w in words.items() if terms and terms <= set(w)]
            want |= {(q, i, float(-n)) for n, _, q, i in sorted(held)[:k]}
        got = cascade.holding_all(queries, docs, k)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    # pairs of documents and queries are neither grouped nor joined
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_all_terms_in_blocks_and_by_a_join(spark, monkeypatch):
    docs = spark.range(0, 3_000, 1, 3).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two "), F.repeat(F.lit("one "), (F.col("id") % 7).cast("int"))).alias("text"))
    queries = spark.createDataFrame([(1, "one two"), (2, "two"), (3, "one three")], "query_id long, text string")
    want = {(1, i, 8.0) for i in (6, 13, 20)} | {(2, i, 1.0) for i in (0, 1, 2)}
    assert {tuple(r) for r in cascade.holding_all(queries, docs, 3).collect()} == want
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 2)
    assert {tuple(r) for r in cascade.holding_all(queries, docs, 3).collect()} == want


def _page(rnd):
    words = lambda n: ", ".join("word" * rnd.randrange(1, 9) for _ in range(n))
    text = lambda: f"<p>{words(rnd.randrange(0, 12))} <a href=x>{words(rnd.randrange(0, 3))}، </a></p>"
    block = lambda: f"<div class='{rnd.choice(('x', 'y menu', 'header'))}'>{''.join(text() for _ in range(rnd.randrange(0, 4)))}</div>"
    return f"{rnd.choice(('', '<body>'))}{block()}<section>{block()}{text()}<pre>{words(5)}</pre>{block()}</section><{rnd.choice(('nav', 'td'))}>{block()}<table><tr><td>{words(9)}<td>b</table>{text()}"


def test_density_page_by_page_as_by_node_tables(spark):
    rnd = random.Random(5)
    texts = [*(_page(rnd) for _ in range(300)), "<p>short</p>", "", None, "no element at all but text that is long enough", f"<p>{'x' * 30}</p>"]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")
    one = df.select(F.col("page_id").alias("id"), page_tree.densest_element(F.col("html")).alias("m")).filter("m is not null").select("id", "m.pre", "m.tag", "m.start", "m.stop", "m.points", "m.link_share")
    other = page_tree.densest(page_tree.node_table(df))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect())) and one.count() > 200


def test_density_reads_each_page_where_it_is(spark):
    long = "<p>" + "Running text, with commas. " * 3 + "</p>"
    # pages with one id, and without any, are pages of their own
    pages = [(1, f"<div>{long}</div>", "u"), (1, f"<body><section>{long}{long}</section></body>", "u"), (None, f"<main>{long}</main>", "u")]
    df = spark.createDataFrame(pages, "page_id long, html string, url string")
    got = page_markdown.by_density(df)
    assert sorted((r.page_id or 0, r.pre, r.tag, r.passed) for r in got.collect()) == [(0, 1, "main", True), (1, 1, "div", True), (1, 2, "section", True)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Aggregate" not in plan
