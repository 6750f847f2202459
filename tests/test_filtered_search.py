"""Search within a tenant against brute force."""

from __future__ import annotations

import os

import numpy as np
import pytest

from ragloom.operators import filtered_search

VECTORS = "id long, tenant string, v array<double>"


def brute(rows, query, k):
    ids = [(i, np.array(v)) for i, t, v in rows if t == query[1] and i != query[0]]
    cosine = lambda x: round(float(x @ query[2] / np.linalg.norm(x) / np.linalg.norm(query[2])), 6)
    return [i for i, _ in sorted(((i, cosine(v)) for i, v in ids), key=lambda x: (-x[1], x[0]))[:k]]


def test_small_tenants_are_searched_in_full(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"t{i % 4}", rng.normal(size=6).tolist()) for i in range(300)]
    odd = [(900, "t0", None), (901, "t0", [1.0]), (902, "t0", [float("nan")] * 6), (903, None, [1.0] * 6)]
    vectors = spark.createDataFrame(rows + odd, VECTORS)
    queries = spark.createDataFrame([(i, t, v) for i, t, v in rows[:8]] + [(950, "nobody", [1.0] * 6), (951, None, [1.0] * 6), (952, "t1", None)], "query_id long, tenant string, q array<double>")
    got = filtered_search.search(queries, vectors, 5, cells=16).collect()
    for i, t, v in rows[:8]:
        assert [r.id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == brute(rows, (i, t, np.array(v)), 5)
    assert {r.query_id for r in got} == set(range(8))
    assert filtered_search.search(queries, vectors.limit(0), 5).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_recall_and_work_by_tenant(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    rows = [(r.vec_id, str(r.label), list(map(float, r.embedding))) for r in table if r.embedding is not None and r.label is not None]
    vectors = spark.createDataFrame(rows, VECTORS)
    asked = [r for r in rows if r[0] % 10 == 0]
    queries = spark.createDataFrame(asked, "query_id long, tenant string, q array<double>")
    got: dict = {}
    for r in filtered_search.search(queries, vectors, 10).collect():
        got.setdefault(r.query_id, []).append(r)
    recall: dict = {}
    for q in asked:
        want = brute(rows, (q[0], q[1], np.array(q[2])), 10)
        recall.setdefault(q[1], []).append(len(set(want) & {r.id for r in got[q[0]]}) / len(want))
    assert {t: np.mean(x) >= 0.9 for t, x in recall.items()} == dict.fromkeys(recall, True), {t: float(np.mean(x)) for t, x in recall.items()}
    assert max(r.scanned for x in got.values() for r in x) < 0.11 * len(rows) and np.mean([x[0].scanned for x in got.values()]) < 0.1 * len(rows)
