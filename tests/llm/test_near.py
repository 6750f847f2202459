"""Vectors against all pairs: links, components, nearest neighbours and their recall."""

from __future__ import annotations

import numpy as np

from ragloom.llm import ann, near_vectors

rng = np.random.default_rng(8)


def clustered(n: int, dim: int, spread: float) -> np.ndarray:
    centres = rng.normal(size=(n // 12, dim))
    return centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * spread


def test_links_as_all_pairs(spark):
    x = np.round(clustered(600, 24, 0.17), 3)
    x[300:320] = x[300]  # equal vectors
    labels = rng.integers(0, 3, 600)
    labels[300:320] = 1
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels, strict=True))]
    other = [(1_000 + i, [1.0, float(i == 3)], 1) for i in range(6)]  # another size: five alike
    got = {r.vec_id: (r.n_links, r.component) for r in near_vectors.link(spark.createDataFrame(rows + other, "vec_id long, embedding array<double>, label int")).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    comp = np.arange(600)
    while True:
        new = np.minimum(comp, np.where(linked, comp[None, :], 600).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    assert linked.sum() > 500
    assert {i: got[i] for i in range(600)} == {i: (int(linked[i].sum()), int(comp[i])) for i in range(600)}
    assert [got[1_000 + i] for i in range(6)] == [(4, 1_000)] * 3 + [(0, 1_003)] + [(4, 1_000)] * 2


def test_recall_with_a_short_list(spark):
    x = clustered(4_000, 32, 0.6)
    x[7] = x[200]  # a tie at distance 0
    x[9] = x[200]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found: dict[int, list[tuple[int, int, float]]] = {}
    for r in ann.search(df.union(df.filter("vec_id < 50")), "vec_id % 100 = 0", short=64).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 4_000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = set(np.lexsort((np.arange(4_000), d))[:10].tolist())
        rows = sorted(found[q])
        assert [r for r, *_ in rows] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-9 for _, v, s in rows)
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        hits += len(best & {v for _, v, _ in rows})
    assert hits >= 0.9 * 400
    assert [v for _, v, _ in sorted(found[200])][:2] == [7, 9]


def test_nearest_are_exact_on_any_rows(spark):
    """Vectors far from the origin, and of very different sizes, which estimates alone don't tell apart."""
    rng = np.random.default_rng(5)
    n = 1_500
    for x in (1e4 + rng.normal(size=(n, 16)), rng.normal(size=(n, 16)) * 10.0 ** rng.uniform(-6, 6, size=(n, 1))):
        x = x.astype(np.float32).astype(float)
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
        got = {}
        for r in ann.search(df, "vec_id % 100 = 0").collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
        for q in range(0, n, 100):
            d = ((x - x[q]) ** 2).sum(axis=1)
            d[q] = np.inf
            assert [got[q][i + 1] for i in range(10)] == np.lexsort((np.arange(n), d))[:10].tolist()
