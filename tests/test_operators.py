"""Registered queries against their SQL, and small cases."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from ragloom.operators import contacts, ranking, retrieval, text
from ragloom.plans import registry
from ragloom.session import TABLES
from ragloom.streaming import counters

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cols = ", ".join(f'"{c}"' for c in df.columns)
    want = con.sql(f"SELECT {cols} FROM ({registry.ORACLE[name]})").fetchall()
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
    assert key(df.collect()) == key(want)


def test_hard_chunks_need_a_step(spark):
    with pytest.raises(ValueError):
        text.hard_chunks(spark.range(1).withColumn("text", F.lit("x")), "text", 10, 10)


def test_hard_chunks_cover_the_text(spark):
    df = spark.createDataFrame([(1, "abcdefghij" * 3), (2, ""), (3, "short")], "doc_id long, text string")
    got = text.hard_chunks(df, "text", 12, 2).orderBy("doc_id", "chunk_index").collect()
    assert [r.content for r in got if r.doc_id == 1] == ["abcdefghijab", "abcdefghijab", "abcdefghij"]
    assert [r.content for r in got if r.doc_id != 1] == ["short"]


def test_rank_of_one_term(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha")], "doc_id long, text string")
    q = spark.createDataFrame([(9, "Alpha?")], "query_id long, text string")
    got = {r.doc_id: (r.rank, r.score) for r in retrieval.lexical_top_k(q, docs, 5).collect()}
    assert got == {2: (1, 0.075991), 1: (2, 0.060793)}


def test_fusion_adds_reciprocal_ranks(spark):
    rows = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 6, 1)], "query_id long, doc_id long, rank int")
    got = {r.doc_id: r.score for r in retrieval.fuse(rows).collect()}
    assert got[5] == round(1 / 61 + 1 / 62, 9) and got[6] == round(1 / 61, 9)


def test_diversity_prefers_what_differs(spark):
    q = [1.0, 0.0]
    rows = [(1, 1, q, [1.0, 0.0], 1), (1, 2, q, [1.0, 0.01], 2), (1, 3, q, [0.7, 0.7], 3)]
    df = spark.createDataFrame(rows, "query_id long, id long, q array<double>, v array<double>, rank int")
    order = lambda out: [r.id for r in out.orderBy("position").collect()]
    assert order(ranking.mmr(df, 3, 0.3)) == [1, 3, 2]
    assert order(ranking.mmr(df, 2, 1.0)) == [1, 2]


def test_packing_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 0, "a" * 10), (1, 1, "b" * 50), (1, 2, "c"), (2, 0, "x" * 99), (3, 0, None)], "k long, turn int, text string")
    got = ranking.pack(df, "k", "text", ["turn"], 40).collect()
    assert [(r.k, r.parts, r.context) for r in got] == [(1, 1, "a" * 10)]


def test_stream_counts_as_the_table_does(spark, tmp_path):
    rows = spark.range(200).selectExpr("id", "timestamp_seconds(1700000000 + id * 1800) AS ts", "id % 3 AS k")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = counters.daily_counts(stream, ["k"]).writeStream.format("memory").queryName("counted").outputMode("complete")
    out.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(60)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("counted")) == key(counters.daily_counts(rows, ["k"]))


def test_a_price_elsewhere_leaves_a_phone(spark):
    rows = spark.createDataFrame([(1, "Mario Rossi: 0612345678. A$$$ 000 b"), (2, "Mario Rossi: € 0612345678"), (3, "Mario Rossi: 0612345678 euro")], "doc long, t string")
    got = contacts.near_name(rows, ["doc"], "t", "Mario Rossi", "phone", None)
    assert [(r.doc, r.value) for r in got.collect()] == [(1, "0612345678")]
