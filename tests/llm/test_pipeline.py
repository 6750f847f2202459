"""The pipeline's stages and the mix on small cases."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.llm import mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _copy int, key string, row string"
rnd = random.Random(11)
words = lambda n: " ".join(f"w{rnd.randrange(500)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, words(rnd.randrange(5, 60)), "xx", f"s{i % 3}", 0, 1, "k", "r") for i in range(60)]
    rows[20] = (20, rows[3][1], "xx", "s1", 0, 1, "k", "r")  # a copy
    rows[21] = (21, rows[3][1] + " tail", "xx", None, 0, 1, "k", "r")
    rows += [(None, "a text without an id", "xx", "s0", 0, 1, "k", "r")] * 2
    rows += [rows[5], (5, words(30), "xx", "s2", 0, 1, "k", "r")]  # a repeated row, and another text with its id
    rows += [(90, None, "xx", "s0", 0, 1, "k", "r"), (91, "", None, None, 0, 1, "k", "r"), (92, "12 34", "xx", "s1", 0, 1, "k", "r"), (93, "write to jo@example.org now", "xx", "s1", 0, 1, "k", "r")]
    return spark.createDataFrame(rows, COLUMNS)


def plain(df):
    return Counter(tuple(r) for r in df.collect())


def reference_mix(rows: list[tuple]) -> dict:
    """Words taken of every (id, size): the queue, one item after the other."""
    import hashlib

    place = lambda i: int(hashlib.md5(f"mix{'' if i is None else i}".encode()).hexdigest()[:10], 16)
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    left, open_, target = 1.5 * sum(size.values()), set(sources), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    items = []
    for k, s in enumerate(sources):
        upto = 0
        for i, n in sorted(((i, n) for i, x, n in rows if x == s), key=lambda x: (place(x[0]), x[0] is not None, x[0] or 0, x[1])):
            upto += n
            if n and target[s] > 0:
                items += [((p * size[s] + upto) / target[s], k, i is not None, i or 0, p, n, i) for p in (0, 1)]
    taken, total = Counter(), 0
    for *_, n, i in sorted(items):
        total += n
        if total > 1.5 * sum(size.values()):
            break
        taken[i] += n
    return taken


def test_mix_with_null_and_repeated_ids(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.times <= 2 for r in got)
    rows = [(r.doc_id, r.source, len((r.text or "").split())) for r in docs.collect()]
    taken = Counter()
    for r in got:
        taken[r.doc_id] += r.times * r.size
    assert {k: v for k, v in taken.items() if v} == dict(reference_mix(rows))


def test_rows_are_taken_as_often_as_the_mix_says(docs):
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    seen, before = plain(out), plain(docs)
    assert set(seen) <= set(before) and all(n <= 2 * before[r] for r, n in seen.items())
    per = Counter()
    for row, n in seen.items():
        per[row[3]] += n * len((row[1] or "").split())
    size = Counter()
    for row, n in before.items():
        size[row[3]] += n * len((row[1] or "").split())
    assert sum(per.values()) <= 1.5 * sum(size.values()) < sum(per.values()) + 60
    assert mixing.apply_mix(docs.filter("doc_id < 0")).count() == 0


def test_stages(spark, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    known = corpus_pipeline.identify(spark, docs, "")
    assert known.columns == docs.columns
    assert plain(known) == plain(docs.filter("doc_id is null or doc_id not in (90, 91, 92)"))
    kept = corpus_pipeline.deduplicate(spark, known, "")
    assert kept.columns == docs.columns
    want = plain(known.filter("doc_id is null or doc_id not in (5, 20, 21)")) + Counter({r: 1 for r in plain(known.filter("doc_id = 5"))})
    assert plain(kept) == want
    masked = {r.doc_id: r.text for r in corpus_pipeline.mask(spark, kept, "").filter("doc_id is not null").collect()}
    assert masked[93] == "write to <EMAIL> now"
    mixed = corpus_pipeline.mix(spark, kept, "")
    assert mixed.columns == docs.columns
    ids = corpus_pipeline.encode(spark, mixed.filter("doc_id is not null"), "").collect()
    texts = {r.doc_id: r.text for r in mixed.filter("doc_id <> 5").collect()}
    assert len(ids) == mixed.filter("doc_id is not null").count() and all(r.n_tokens == len(r.ids) // 4 for r in ids)
    import hashlib

    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in ids if r.doc_id != 5)
    assert np.all([r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() for r in ids])


def test_empty_tables(spark, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    none = docs.filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
