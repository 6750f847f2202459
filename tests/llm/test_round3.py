"""Quality rules by divergence, the conversation trie and whitening on small cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.llm import divergence, trie, whitening

SF = "/root/testdata/sf0.001"


# --- quality rules ---


def plain_counts(text: str | None) -> tuple:
    """Base counts by the definition."""
    text = text or ""
    words, now = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [now] if now else []
            now = ""
        else:
            now += c
    seen, twice = set(), 0
    for line in text.split("\n"):
        if any(c not in " \t\n\x0b\x0c\r" for c in line):
            twice += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    held = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(held)


def test_base_counts():
    rnd = random.Random(5)
    texts = [None, "", " \n\t", "a", "a a a a", "a b c a b c", "x\x0by z w", "é" * 5, "l\nl\n l\nl\n\n\n", "#*$%&|<> ok"]
    texts += ["".join(rnd.choice(["a", "b", " ", "\n", "é", "#", "😀", "\t"]) for _ in range(rnd.randrange(200))) for _ in range(200)]
    texts += [" ".join(rnd.choice("ab") * rnd.randrange(1, 3) for _ in range(80)) for _ in range(20)]
    got = divergence.measure(texts)
    columns = got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words
    for i, t in enumerate(texts):
        assert tuple(int(c[i]) for c in columns) == plain_counts(t) and got.classes[i].sum() == len(t or "")
    assert len(divergence.measure([]).n_words) == 0


def test_vocabulary():
    """Words lose marks at their end and are told apart from all others; those without a letter are none."""
    texts = ["The the, the. THE?! .the", "... 12 |", "", "é é. a-b a.b x..,;y", "x y"]
    hashes, counts = divergence.vocabulary(texts)
    assert counts.tolist() == [5, 0, 0, 5, 2]
    assert len(set(hashes[:4])) == 1 and hashes[4] != hashes[0] and hashes[5] == hashes[6] and len(set(hashes)) == 8


def test_distance():
    p, q = np.array([0.5, 0.5, 0]), np.array([0, 0, 1.0])
    assert divergence.jensen_shannon(p, p) == 0 and divergence.jensen_shannon(p, q) == 1
    h = lambda x: -sum(v * math.log2(v) for v in x if v > 0)
    q = np.array([0.2, 0.3, 0.5])
    assert divergence.jensen_shannon(p, q) == pytest.approx(math.sqrt(h((p + q) / 2) - (h(p) + h(q)) / 2))
    assert divergence.jensen_shannon(np.array([p, q]), q).tolist() == [divergence.jensen_shannon(p, q), 0]


def prose(rnd, common, n):
    return " ".join(rnd.choice(common) if rnd.random() < 0.5 else "".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_verdicts(spark):
    rnd = random.Random(3)
    la, lb = ["the", "of", "and", "to"], ["der", "die", "und", "zu"]
    rows = [(i, prose(rnd, (la, lb)[i % 2], 200), ("a", "b")[i % 2]) for i in range(60)]
    rows += [(100, prose(rnd, la, 300), None), (101, " ".join(w + "%%%&&&" for w in prose(rnd, la, 300).split()), "a"), (102, prose(rnd, ["zzz"], 300), "b"), (103, prose(rnd, la, 20), "a")]
    rows += [(104, None, "a"), (105, "", None), (106, "one two three four " * 30, "a"), (107, prose(rnd, ["xx", "yy"], 60), "c"), (100, rows[60][1], None), (None, prose(rnd, lb, 100), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("id", "n", "kept", "word")})
    refs = divergence.learn(docs)
    assert refs.langs == ["a", "b"]  # c has too few words
    got = divergence.judge(docs, refs).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(60)) and kept[100] and kept[107] and kept[None]
    assert not any(kept[i] for i in (101, 102, 103, 104, 105, 106))
    by = {r.doc_id: r for r in got}
    assert by[101].char_distance > 0.3 and not by[101].base_failed and by[102].word_distance > 0.36
    assert by[107].word_distance is None and by[103].word_distance is None and by[106].base_failed
    none = docs.filter("doc_id > 900")
    assert divergence.judge(none, divergence.learn(none)).collect() == []
    alone = docs.filter("doc_id = 107")
    assert [r.kept for r in divergence.judge(alone, divergence.learn(alone)).collect()] == [True]


def test_a_very_long_text(spark):
    text = "w%d x y\n" * 1
    text = "".join(f"w{i} and more\n" for i in range(120_000))
    docs = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, lang string")
    got = divergence.judge(docs, divergence.learn(docs)).first()
    assert (got.n_words, got.n_dup_lines, got.n_repeat_words) == (360_000, 0, 0) and got.kept


# --- the trie ---


def brute_trie(rows, rebuilt=True):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in convs.items()}
    seqs = own
    if rebuilt:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        seqs = {c: own.get(c - int(math.fmod(c, 20)), [])[: h[c]] + own[c][h[c] :] for c in own}
    nodes = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    name = {k: min(v) for k, v in nodes.items()}
    out = set()
    for k, members in nodes.items():
        under = [x for x in nodes if x[: len(k)] == k]
        parents = {x[:-1] for x in nodes if x}
        ends = ",".join(map(str, sorted(c for c in members if len(seqs[c]) == len(k))))
        out.add((
            name[k], len(k), name[k[:-1]] if k else None, len(members), sum(len(x) == len(k) + 1 for x in under), sum(x not in parents for x in under),
            sum((len(nodes[x]) - 1) * len(x[-1][1].split()) for x in under if x), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


CONV = "conv_id long, turn long, role string, text string, node long, d int, child string"


def conversations(seed):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-45, 130), 60):
        for turn in range(rnd.randrange(0, 9)):
            rows.append((rnd.choice([c, c, c, c, 40]), rnd.choice([turn, turn, turn, None, 2]), rnd.choice(["user", "user", None]), rnd.choice(["a b", "a b", "c", None, "", " d  e f\n"]), 7, 1, "x"))
    return [*rows, *rows[:5], (None, 1, "user", "lost", 7, 1, "x")]


@pytest.mark.parametrize(("seed", "rebuilt"), [(0, True), (1, True), (2, False)])
def test_trie(spark, seed, rebuilt):
    rows = conversations(seed)
    got = trie.build(spark.createDataFrame(rows, CONV), rebuilt=rebuilt).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute_trie(rows, rebuilt)


def test_copies_and_long_chains(spark, monkeypatch):
    """Many equal conversations, one that goes on alone for long, and pieces that are cut often."""
    monkeypatch.setattr(trie, "PIECE", 4)
    rows = [(c, t, "user", f"turn {t}", 7, 1, "x") for c in range(25) for t in range(3)] + [(30, t, "user", f"turn {t}", 7, 1, "x") for t in range(40)]
    got = trie.build(spark.createDataFrame(rows, CONV), rebuilt=False).collect()
    assert set(map(tuple, got)) == brute_trie(rows, False) and len(got) == 41


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], CONV)
    assert trie.build(empty).collect() == []
    one = [(7, 0, "user", "a b c", 7, 1, "x")]
    assert set(map(tuple, trie.build(spark.createDataFrame(one, CONV)).collect())) == brute_trie(one)


@pytest.mark.parametrize("name", ["op11_divergence_rules", "op12_prefix_trie"])
def test_as_sql(spark, name):
    from ragloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE[name]})").fetchall()
    key = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert key(got.collect()) == key(want)


# --- whitening ---


def plain_whitening(vectors: np.ndarray, k: int):
    x = np.floor(64 * vectors.astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(axis=1), c @ q / np.sqrt(e), e / np.trace(c.T @ c / n)


def test_whitening(spark):
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) + 3).astype(np.float32)
    bad = [(900, None), (901, [1.0] * 39 + [None]), (902, [1.0] * 39 + [float("nan")]), (903, [float("inf")] * 40), (904, [])]
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)] + bad
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("x", "w", "n", "k", "label")})
    got = whitening.whiten(table).orderBy("vec_id", "component").collect()
    assert len(got) == 300 * 32 and {r.n for r in got} == {300}
    deviation, white, share = plain_whitening(v, 32)
    w = np.array([r.whitened for r in got]).reshape(300, 32)
    signs = np.sign((w * white).sum(axis=0))
    assert np.abs(w - white * signs).max() < 1e-8
    assert [r.deviation for r in got[::32]] == deviation.tolist()
    assert np.allclose([r.explained for r in got[:32]], share, rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    assert np.abs(w.T @ w / 300 - np.eye(32)).max() < 1e-9


def test_whitening_of_little(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([])).collect() == []
    assert whitening.whiten(make([(1, [1.0, 2.0])])).collect() == []  # no variance, no component
    assert whitening.whiten(make([(1, [1.0, 2.0])] * 3)).collect() == []
    # rank 1: one component; repeated rows and null ids stay; another size is whitened apart
    got = whitening.whiten(make([(1, [0.0, 0.0]), (1, [0.0, 0.0]), (None, [1.0, 1.0]), (4, [5.0]), (5, [7.0])])).collect()
    assert sorted(((r.vec_id or -1, r.component, r.n, round(abs(r.whitened), 6)) for r in got)) == [(-1, 1, 3, 1.414214), (1, 1, 3, 0.707107), (1, 1, 3, 0.707107), (4, 1, 2, 1.0), (5, 1, 2, 1.0)]
    assert all(abs(r.explained - 1) < 1e-12 for r in got)
