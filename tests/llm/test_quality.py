"""The factorisation machine against explicit pairs, and on odd rows."""

from __future__ import annotations

import numpy as np

from ragloom.llm import quality

rng = np.random.default_rng(12)


def test_interactions_as_explicit_pairs():
    machine = quality.FactorisationMachine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)))
    rows = [quality.features(t, n) for t, n in ((None, None), ("", 0), ("one word", 8), ("a b c a b | 12 A-Z\n" * 9, 10**9))]
    got = machine.logits(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), np.cumsum([0, *(len(i) for i, _ in rows[:-1])]))
    for z, (idx, val) in zip(got, rows, strict=True):
        pairs = sum(machine.factors[i] @ machine.factors[j] * x * y for k, (i, x) in enumerate(zip(idx, val, strict=True)) for j, y in list(zip(idx, val, strict=True))[:k])
        assert abs(z - (0.3 + machine.linear[idx] @ val + pairs)) < 1e-6


def test_odd_rows_are_scored(spark):
    rows = [(i, "good words here" if i % 2 else "BAD !!! 12", 10) for i in range(40)] + [(50, None, None), (51, "", -3), (1, "good words here", 10), (None, "x " * 200_000, 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "0 AS id", "'q' AS y", "1.0D AS score")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, None), (3, 0), (None, 1)], "doc_id long, quality int")
    got = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in got if r.doc_id == 1] == [got[1].score] * 2
    assert quality.score(docs.filter("doc_id < 0"), quality.learn(docs.filter("doc_id < 0"), labels)).count() == 0
