"""Lexical and vector top-k, fusion and rank arithmetic over whole tables."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import dealt, slices
from .text import terms


def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)")


def norm(a: str) -> Column:
    """The L2 norm, at least 1e-12."""
    return F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12))


def top_k(scored: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Most queries and vectors, on average, of a pair of blocks; queries that one task compares with them at once.
QUERY_BLOCK, VECTOR_BLOCK, AT_ONCE = 1_024, 16_384, 64


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k of a stated query set (query_id, q) against all other (id, v): with score and rank.

    Both sides are dealt to blocks by a hash of their ids; each pair of blocks
    is one small matrix product whose k best go on, so nothing is broadcast
    and no task grows with the input. Null vectors and vectors with null
    components take no part. Scores have six digits; ties go to the smaller id.
    """

    def side(rows: DataFrame, key: str, vector: str, size: int) -> tuple[DataFrame, int]:
        rows = rows.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector))
        rows = rows.filter(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
        return rows, max(1, math.ceil(rows.count() / size))

    (q, q_blocks), (v, v_blocks) = side(queries, "query_id", "q", QUERY_BLOCK), side(vectors, "id", "v", VECTOR_BLOCK)
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("_q", block("query_id", q_blocks)).withColumn("_v", every(v_blocks))
    right = v.withColumn("_v", block("id", v_blocks)).withColumn("_q", every(q_blocks))

    def unit(rows: pa.ChunkedArray) -> np.ndarray:
        rows = rows.combine_chunks()
        if len(set(rows.value_lengths().unique().to_pylist())) > 1:
            raise ValueError("vectors of different sizes")
        x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        return x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asked.num_rows and held.num_rows:
            ids, own = held["id"].to_numpy(), asked["query_id"].to_numpy()
            near_to, far = unit(asked["q"]), unit(held["v"]).T
            for at in range(0, len(own), AT_ONCE):
                for query, away in zip(own[at : at + AT_ONCE], -np.round(near_to[at : at + AT_ONCE] @ far, 6), strict=True):
                    # one more than k, since the query itself may be among them, with all that are as near as the last
                    few = np.flatnonzero(~(away > np.partition(away, k)[k])) if len(away) > k else np.arange(len(away))
                    few = few[ids[few] != query]
                    few = few[np.lexsort((ids[few], away[few]))][:k]
                    found.append((np.full(len(few), query), ids[few], -away[few]))
        return pa.table(dict(zip(("query_id", "id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    near = left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInArrow(best, "query_id long, id long, score double")
    return top_k(near, "query_id", k, F.desc("score"), F.col("id"))


def postings(docs: DataFrame, key: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """(key, term, n): occurrences of every term, or of those in ``only`` (term).

    Terms that nobody asks for go before anything is counted or shuffled; a
    small ``only`` is broadcast by Spark's own check of its size.
    """
    words = F.explode(F.split(F.trim(F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]+", " ")), " "))
    rows = docs.select(key, words.alias("term")).filter("length(term) >= 2")
    if only is not None:
        rows = rows.join(only.select("term").distinct(), "term", "left_semi")
    return rows.groupBy(key, "term").agg(F.count("*").alias("n"))


#: Terms of all queries that go to every task (some 20 MB); beyond that queries meet documents by a join. Cells of a block of scores.
BROADCAST_TERMS, SCORE_CELLS = 1 << 20, 1 << 21
_SCALE = 0.1 / 1.64493406685
_WORD = re.compile("[a-z0-9]{2,}")


def lexical_top_k(queries: DataFrame, docs: DataFrame, k: int, *, most_terms: int | None = None) -> DataFrame:
    """OR query rank: the mean over the query's terms of 0.1 * H2(n) / 1.64493406685.

    H2(n) is the sum of 1/j^2 for j up to n, the occurrences of the term. A
    query has its first ``most_terms`` distinct terms, or all. Up to
    BROADCAST_TERMS terms of queries go to the documents, which are scored where
    they are, block by block: only ``k`` rows of each block and query go on.
    More terms meet the documents by a join. ``doc_id`` tells texts apart;
    texts without one are left out.
    """
    asked = queries.select("query_id", terms(F.col("text"), most_terms).alias("terms"))
    asked = asked.select(F.col("query_id").cast("long").alias("query_id"), F.size("terms").cast("long").alias("m"), F.explode("terms").alias("term"))
    if asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        scored = _scored_in_place(asked, docs, k)
    else:
        h2 = F.expr("aggregate(sequence(1, int(n)), 0D, (s, j) -> s + 1D / (j * j))")
        hits = postings(docs.filter("doc_id is not null"), "doc_id", "text", asked).join(asked, "term").select("query_id", "doc_id", "m", "term", h2.alias("h"))
        scored = hits.groupBy("query_id", "doc_id").agg((F.sum("h") * _SCALE / F.max("m")).alias("score"))
    scored = scored.withColumn("score", F.round("score", 6))
    return top_k(scored, "query_id", k, F.desc("score"), F.col("doc_id"))


def _scored_in_place(asked: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score): the best ``k`` documents of each block for every query that they share a term with."""
    table = asked.toArrow()
    query, m = (np.asarray(table.column(c).combine_chunks(), np.int64) for c in ("query_id", "m"))
    ids, of = np.unique(query, return_inverse=True)
    sizes = np.ones(len(ids))
    sizes[of] = m
    order = np.argsort(of, kind="stable")
    words = table.column("term").to_pylist()
    by_term: dict[str, list[int]] = {}
    for i in order.tolist():
        by_term.setdefault(words[i], []).append(int(of[i]))
    sent = docs.sparkSession.sparkContext.broadcast((ids, sizes, {t: np.array(q, np.int64) for t, q in by_term.items()}))

    def best(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        ids, sizes, _ = sent.value
        found.sort(key=lambda x: x[0])  # of equal scores the smaller id is first
        scores = np.stack([s for _, s in found])
        # the same order as after rounding to six digits
        place = np.argsort(-np.floor(scores * (_SCALE / sizes) * 1e6 + 0.5), axis=0, kind="stable")[:k]
        which = np.broadcast_to(np.arange(len(ids)), place.shape)
        hit = scores[place, which] > 0
        own = np.array([i for i, _ in found], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[which[hit]]), pa.array(own[place[hit]]), pa.array(scores[place, which][hit] * (_SCALE / sizes[which[hit]]))], names=["query_id", "doc_id", "score"])

    def run(batches):
        ids, _, queries_of = sent.value
        if not len(ids):
            return
        most, found, h2 = max(1, SCORE_CELLS // len(ids)), [], np.zeros(1)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = Counter(_WORD.findall(text.lower()))
                shared = [t for t in held if t in queries_of]
                if not shared:
                    continue
                counts = np.array([held[t] for t in shared])
                if counts.max() >= len(h2):
                    h2 = np.r_[0.0, np.cumsum(1.0 / np.arange(1, 2 * counts.max() + 1) ** 2)]
                lists = [queries_of[t] for t in shared]
                found.append((doc, np.bincount(np.concatenate(lists), weights=np.repeat(h2[counts], [len(x) for x in lists]), minlength=len(ids))))
                if len(found) >= most:
                    yield best(found)
                    found = []
        if found:
            yield best(found)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    return dealt(rows, "doc_id").mapInArrow(run, "query_id long, doc_id long, score double")


#: Matches of a task that are cut to the best of each query at once.
MATCHES = 1 << 16


def held_top_k(asked: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score): of the documents with all ``m`` terms of a query, the best ``k`` of each block by the terms' occurrences.

    ``asked``: query_id, m and each term of a query, up to BROADCAST_TERMS rows,
    which go to the texts. A text becomes one row with its counts of these
    terms. Texts are sorted by ``doc_id``, those of one id (or none) are one
    document, and each document meets the queries by itself, so pairs of
    documents and queries are never held at once.
    """
    table = asked.toArrow()
    words, which = np.unique(np.array(table.column("term").to_pylist(), object), return_inverse=True)
    both = list(zip(table.column("query_id").to_pylist(), table.column("m").to_pylist(), strict=True))
    pairs = dict.fromkeys(both)
    number = {pair: i for i, pair in enumerate(pairs)}
    order = np.argsort(which, kind="stable")
    queries_of = np.split(np.array([number[x] for x in both], np.int64)[order], np.cumsum(np.bincount(which, minlength=len(words)))[:-1]) if both else []
    asking = pa.array([q for q, _ in pairs], table.schema.field("query_id").type)
    sent = docs.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(words)}, queries_of, np.array([m for _, m in pairs], np.int64), asking))

    def counts(batches):
        place = sent.value[0]
        for batch in slices(batches):
            found = [Counter(place[w] for w in _WORD.findall(x.lower()) if w in place) for x in batch.column(1).to_pylist()]
            some = pa.array([i for i, each in enumerate(found) if each], pa.int32())
            found = [each for each in found if each]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), pa.array([list(x) for x in found], pa.list_(pa.int32())), pa.array([list(x.values()) for x in found], pa.list_(pa.int64()))], names=["doc_id", "terms", "counts"])

    def documents(batches):
        """(doc_id, terms, counts) of each document."""
        last = None
        for batch in batches:
            for own, term, n in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                row = own, term.values.to_numpy(), n.values.to_numpy()
                if last is not None and last[0].as_py() == own.as_py():
                    term, of = np.unique(np.r_[last[1], row[1]], return_inverse=True)
                    row = own, term, np.bincount(of, np.r_[last[2], row[2]]).astype(np.int64)
                elif last is not None:
                    yield last
                last = row
        if last is not None:
            yield last

    def best(found: list[tuple]) -> pa.RecordBatch:
        ids, query, score = zip(*found, strict=True)
        at = np.repeat(np.arange(len(ids)), [len(q) for q in query])
        query, score = np.concatenate(query), np.concatenate(score)
        order = np.lexsort((at, -score, query))  # of equal scores the smaller id, which came first
        order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < k]
        own = pa.array([x.as_py() for x in ids], ids[0].type)
        return pa.RecordBatch.from_arrays([sent.value[3].take(pa.array(query[order])), own.take(pa.array(at[order])), pa.array(score[order])], names=["query_id", "doc_id", "score"])

    def match(batches):
        _, queries_of, m, _ = sent.value
        found, size = [], 0
        for own, term, n in documents(batches):
            lists = [queries_of[t] for t in term]
            of = np.concatenate(lists)
            whole = np.flatnonzero(np.bincount(of, minlength=len(m)) == m)
            if len(whole):
                score = np.bincount(of, np.repeat(n, [len(x) for x in lists]), len(m))[whole]
                found.append((own, whole, score.astype(np.int64)))
                size += len(whole)
            if size >= MATCHES:
                yield best(found)
                found, size = [], 0
        if found:
            yield best(found)

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    held = dealt(docs.select("doc_id", "text").filter("text is not null"), "doc_id").mapInArrow(counts, schema)
    out = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())])
    return held.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(match, out)


def fuse(ranked: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, rank) rows of several lists."""
    score = F.round(F.sum(1.0 / (k + F.col("rank"))), 9)
    return ranked.groupBy("query_id", "doc_id").agg(score.alias("score"))


def confidence(ranked: DataFrame) -> DataFrame:
    """Ten times the sum of the three best scores, between 0 and 1."""
    return ranked.filter("rank <= 3").groupBy("query_id").agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 10 * F.sum("score"))), 6).alias("confidence"))
