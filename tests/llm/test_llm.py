"""Small cases of the numbered operators: nulls, empty and long texts, ties, repeats, extra columns."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.llm import ann, bpe, jaccard, language_id, mixing, near_vectors, pii, quality, suffixes, toxicity
from ragloom.llm.toxicity import segments
from ragloom.llm.util import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, h string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    word = lambda letters: "".join(rng.choice(list(letters), 4))
    rows = []
    for i in range(120):
        lang = "xx" if i % 2 else "yy"
        t = " ".join(word("abcdef" if lang == "xx" else "uvwxyz") for _ in range(60))
        rows.append((i, t, lang, f"s{i % 3}", len(t), 0, "z"))
    rows[10] = (10, rows[8][1], "yy", "s1", 1, 0, "z")  # a copy
    rows[12] = (12, rows[8][1] + " tail", "yy", None, 1, 0, "z")  # a near copy
    rows += [(200, None, None, None, None, 0, "z"), (201, "", "xx", "s0", 0, 0, "z"), (202, "12 34 !!", "xx", "s0", 8, 0, "z"), (203, "é" * 9_000, "xx", "s0", 9_000, 0, "z")]
    return spark.createDataFrame(rows, DOCS)


def test_language(docs):
    got = {r.doc_id: r for r in language_id.detect(docs, language_id.learn(docs)).collect()}
    assert len(got) == docs.count()
    assert all(got[i].lang_pred == ("xx" if i % 2 else "yy") for i in range(120))
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3
    empty = docs.filter("doc_id < 0")
    assert language_id.detect(empty, language_id.learn(empty)).count() == 0
    assert language_id.keep_known(docs, language_id.learn(docs)).columns == docs.columns


def test_bpe_as_the_library(spark, docs):
    public_tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    long = spark.createDataFrame([(300, "word  two\n\n" * 1_000, "", "", 0, 0, ""), (301, "a" * 9_000, "", "", 0, 0, ""), (302, " " * 9_000 + "x", "", "", 0, 0, "")], DOCS)
    every = docs.union(long).union(long.filter("doc_id = 300"))
    ids = bpe.encode(every, path, public_tokenizers.PATTERN, chunk=4_096)
    got = bpe.decode(ids.withColumn("raw", F.col("ids")), path, ids_col="raw").collect()
    texts = {r.doc_id: r.text or "" for r in every.collect()}
    assert len(got) == every.count()
    for r in got:
        want = enc.encode_ordinary(texts[r.doc_id])
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded) == texts[r.doc_id].encode()


def test_segments_are_maximal():
    s = np.array([-1.0, 2, -1, 3, -5, 4, -1, -1, 1])
    assert segments(s) == [(1, 4, 4.0), (5, 6, 4.0), (8, 9, 1.0)]
    assert segments(np.array([-1.0])) == [] and segments(np.zeros(0)) == []


def test_toxicity_and_quality_learn(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{k}" for k in rng.integers(0, 50, 30)]
        if i % 4 == 0:
            words[5:8] = ["vile", "vile", "vile"]
        t = " ".join(words) if i % 3 else " ".join(["same"] * 40)
        rows.append((i, t, "xx", "s", len(t), 0, ""))
        labels.append((i, int(bool(i % 3)), int("vile" in t)))
    docs = spark.createDataFrame([*rows, (900, None, None, None, None, 0, "")], DOCS)
    marks = spark.createDataFrame([*labels, (1, None, None)], "doc_id long, quality int, toxic int")
    tox = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, toxicity.learn(docs, marks)).collect()}
    assert all(tox[i] == bool(t) for i, _, t in labels) and not tox[900]
    good = {r.doc_id: r.score >= 0.5 for r in quality.score(docs, quality.learn(docs, marks)).collect()}
    assert all(good[i] == bool(q) for i, q, _ in labels)
    none = marks.filter("doc_id < 0")
    assert quality.score(docs, quality.learn(docs, none)).count() == toxicity.score(docs, toxicity.learn(docs, none)).count() == 401


def test_pii_spans(spark):
    rows = [(1, "a@b.c_d@e.fg 1.2.3.4.5.6.7.8 300.1.1.1"), (2, None), (3, ""), (4, "4111 1111 1111 1111 é 4111111111111112 +1 (988) 555-2485"), (5, "1" * 50_000), (6, "DE89 3704 0044 0532 0130 00")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(0))
    got = {r.doc_id: r for r in pii.digest(pii.find(df)).collect()}
    assert got[1].spans == "email:0:5,email:5:12,ip:13:20,ip:21:28"
    assert (got[4].n_card, got[4].n_phone, got[4].spans) == (1, 1, "card:0:19,phone:39:56")
    assert [got[i].spans for i in (2, 3, 5)] == [""] * 3 and got[6].spans == "iban:0:27"
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    text = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert text[4] == "<CARD> é 4111111111111112 <PHONE>" and text[2] is None and text[5] == "1" * 50_000


def test_mix_meets_targets(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.times <= 2 for r in got)
    per = {}
    for r in got:
        per[r.source_size, r.target] = per.get((r.source_size, r.target), 0) + r.size * r.times
    assert all(abs(taken - target) <= 180 for (_, target), taken in per.items())
    assert mixing.mix(docs.filter("doc_id < 0")).count() == 0
    assert {r.times for r in mixing.mix(docs.filter("doc_id in (200, 201)")).collect()} == {0}


def test_jaccard_components(docs):
    got = {r.doc_id: r for r in jaccard.link(docs).collect()}
    assert got[10].component == got[12].component == got[8].component == 8
    assert (got[200].n_shingles, got[201].n_shingles, got[202].n_shingles, got[8].n_shingles) == (0, 0, 1, 56)
    assert all(got[i].component == i for i in got if i not in (10, 12))


def test_suffixes_remove_repeats(spark):
    rng = np.random.default_rng(3)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared, edge = text(500), text(399)
    rows = [(1, text(300) + shared + text(200)), (2, text(90) + shared), (3, edge), (4, edge), (5, None), (6, ""), (7, "ab" * 400), (8, text(5_000))]
    got = {r.doc_id: r for r in suffixes.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    removed = {k: r.n_bytes - len(r.kept) for k, r in got.items()}
    assert removed[1] >= 500 and removed[2] >= 500 and removed[1] == removed[2]
    assert [removed[i] for i in (3, 4, 5, 6, 7, 8)] == [0, 0, 0, 0, 800, 0]


def test_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    x[50:60] = x[49] + rng.normal(size=(10, 16)) * 0.01
    x[61] = x[60]
    rows = [(i, v.tolist(), 1, 0) for i, v in enumerate(x)]
    rows += [(900, None, 1, 0), (901, [0.0] * 16, 1, 0), (902, [float("nan")] * 16, 1, 0), (903, x[49].tolist(), None, 0), (904, [1.0], 1, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id int")
    found = ann.search(df, "vec_id % 100 = 0").collect()
    for q in (0, 100, 200):
        d = [(float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in range(300) if i != q]
        d.append((float(np.sqrt(((x[49] - x[q]) ** 2).sum())), 903))
        assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == [i for _, i in sorted(d)[:10]]
    got = {r.vec_id: r for r in near_vectors.link(df).collect()}
    assert len(got) == 305 and all(got[i].component == 49 and got[i].n_links == 10 for i in range(49, 60))
    assert got[61].component == 60 and got[61].n_links == got[60].n_links == 1
    assert all(got[i].n_links == 0 and got[i].component == i for i in (900, 901, 902, 903, 904))
    assert ann.search(df.filter("vec_id < 0"), "true").count() == near_vectors.link(df.filter("vec_id < 0")).count() == 0


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in connected_components(e, "a", "b").collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100
