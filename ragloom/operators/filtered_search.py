"""Vector search within a tenant: an inverted file whose probes widen until the filter leaves enough."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval

#: Cells, and vectors that they are fitted on at most: those with the smallest hashes of their ids.
CELLS, SAMPLE = 256, 16_384
#: A query looks at cells, nearest first, until they hold this share of its tenant's vectors, and ``effort`` of them.
SHARE = 0.75


def effort(k: int) -> int:
    """Vectors that a search for ``k`` looks at in any case."""
    return max(96, k + 10)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return _unit(np.asarray(column.flatten(), np.float64).reshape(-1, dim))


def _usable(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    return rows.filter(F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False)))


def fit(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Centres of cells by spherical k-means over a bounded sample; fewer vectors than cells are their own centres."""
    dim = vectors.filter("v is not null and size(v) > 0").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if dim is None:
        return np.zeros((0, 0))
    rows = _usable(vectors.select("id", F.col("v").cast("array<double>").alias("v")), "v", dim.n).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    x = _matrix(rows.column("v").combine_chunks(), dim.n)
    centres = x[:cells].copy()
    for _ in range(rounds if len(x) > cells else 0):
        of = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        held = np.bincount(of, minlength=len(centres)) > 0
        centres[held] = _unit(sums[held])
    return centres


def search(queries: DataFrame, vectors: DataFrame, k: int, *, cells: int = CELLS, sample: int = SAMPLE, share: float = SHARE) -> DataFrame:
    """(query_id, id, score, rank, scanned): the ``k`` nearest found for each query among the vectors of its tenant, itself left out.

    ``queries``: query_id, tenant, q; ``vectors``: id, tenant, v. Nearness is
    cosine, in six digits, ties go to the smaller id. ``scanned`` counts the
    vectors in the cells that the query looked at. A tenant with fewer vectors than
    ``effort`` is searched in full. Vectors of other than the most frequent
    size, or with null or NaN components, take no part, nor do queries or
    vectors without a tenant. Cells are fitted on the sample; all vectors are in
    them. Queries meet the vectors of (tenant, cell) by a join.
    """
    spark = vectors.sparkSession
    centres = fit(vectors, cells, sample)
    dim = centres.shape[1] if len(centres) else 0
    sent = spark.sparkContext.broadcast(centres)  # ``cells`` x size numbers

    def cell_of(batches):
        for batch in batches:
            x = _matrix(batch.column(2), dim)
            of = (x @ sent.value.T).argmax(axis=1).astype(np.int32) if len(x) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(of), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "tenant", "cell", "v"])

    def order_of(batches):
        for batch in batches:
            x = _matrix(batch.column(2), dim)
            order = np.argsort(-(x @ sent.value.T), axis=1, kind="stable").astype(np.int32) if len(x) else np.zeros((0, 0), np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(order), pa.list_(pa.int32()))], names=["query_id", "tenant", "q", "cells"])

    side = lambda rows, key, v: _usable(rows.filter("tenant is not null").select(F.col(key).cast("long").alias(key), F.col("tenant").cast("string").alias("tenant"), F.col(v).cast("array<double>").alias(v)), v, dim)
    held = side(vectors, "id", "v").mapInArrow(cell_of, "id long, tenant string, cell int, v array<double>")
    asked = side(queries, "query_id", "q").mapInArrow(order_of, "query_id long, tenant string, q array<double>, cells array<int>")
    counts = held.groupBy("tenant", "cell").agg(F.count("*").alias("n"))
    totals = counts.groupBy("tenant").agg(F.sum("n").alias("total"))
    probes = asked.select("query_id", "tenant", F.posexplode("cells").alias("place", "cell")).join(counts, ["tenant", "cell"]).join(totals, "tenant")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    probes = probes.withColumn("before", before).filter(F.col("before") < F.greatest(F.lit(effort(k)), F.col("total") * share)).select("query_id", "tenant", "cell", "n")
    pairs = probes.join(asked.select("query_id", "q"), "query_id").join(held, ["tenant", "cell"]).filter("id <> query_id")
    scored = pairs.select("query_id", "id", F.round(retrieval.dot("q", "v"), 6).alias("score"))
    # how much was read is known from the cells, the query's own row included
    work = probes.groupBy("query_id").agg(F.sum("n").alias("scanned"))
    return retrieval.top_k(scored, "query_id", k, F.desc("score"), F.col("id")).join(work, "query_id").select("query_id", "id", "score", "rank", "scanned")
