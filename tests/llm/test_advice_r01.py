from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np

from ragloom.llm import quality, suffixes, toxicity

rnd = random.Random(5)


def letters(n: int) -> str:
    return "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=n))


def test_words_without_a_clean_context_score_high():
    # 156 of 111,200 toxic contexts and none of 802,310 others
    odds = toxicity.log_odds({"the": (4_000, 28_000), "idiot": (156, 0), "rare": (1, 0), "clean": (0, 200), "x": (107_043, 774_110)})
    assert odds.of("idiot") > 4 > 1 > odds.of("rare") > 0 > odds.of("clean") and abs(odds.of("the")) < 0.1
    assert odds.of("unseen") == 0 and toxicity.log_odds({"a": (5, 0)}).of("a") == 0
    # a word that was never seen leans on its beginning
    odds = toxicity.log_odds({f"bomente{k}": (2, 0) for k in "abcdefgh"} | {"x": (900, 9_000)})
    assert odds.of("bomentexyz") > 1.5 and odds.of("bo") == 0


def test_segments_against_all_stretches():
    """Maximal segments by their definition: proper prefixes and suffixes score above zero, and no longer stretch does so."""
    for _ in range(200):
        s = [rnd.choice([-3, -2, -1, 1, 2, 3]) + rnd.random() / 8 for _ in range(rnd.randrange(0, 14))]
        n = len(s)
        good = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if all(sum(s[i:k]) > 0 for k in range(i + 1, j + 1)) and all(sum(s[k:j]) > 0 for k in range(i, j))]
        want = [(i, j) for i, j in good if not any(a <= i and j <= b and (a, b) != (i, j) for a, b in good)]
        got = toxicity.segments(np.array(s))
        assert [(a, b) for a, b, _ in got] == sorted(want)
        assert all(abs(x - sum(s[a:b])) < 1e-9 for a, b, x in got)


def test_held_out_labels_are_never_read(spark):
    texts = [" ".join(rnd.choices(["ab", "cd", "ef", "gh", "vile"] if i % 4 == 0 else ["ab", "cd", "ef", "gh"], k=40)) for i in range(200)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    labels = [(i, int("vile" in t)) for i, t in enumerate(texts)]
    for learn, score, n, rest in ((toxicity.learn, toxicity.score, 5, 0), (quality.learn, quality.score, 3, 1)):
        turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % n == rest else y) for i, y in labels]
        got = [sorted((r.doc_id, r.score) for r in score(docs, learn(docs, spark.createDataFrame([(i, y, y) for i, y in x], "doc_id long, toxic int, quality int"))).collect()) for x in (labels, turned)]
        assert turned != labels and got[0] == got[1]


def test_pieces_own_the_anchors_of_the_undivided_text(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 20_000)
    for n in (24_096, 24_097, 61_000):
        body = letters(n).encode()
        whole = suffixes.anchors(*suffixes._laid_out([body]), 400, 24)[1].tolist()
        got = []
        for _, off, low, high, parts in suffixes._blocks([1], [body], 400):
            flat, starts, lens = suffixes._laid_out(parts)
            who, at, _ = suffixes.anchors(flat, starts, lens, 400, 24)
            ok = suffixes._owned(who, at, starts, low, high)
            got += (at - starts[who] + np.array(off)[who])[ok].tolist()
        assert got == whole


def test_pieces_of_a_long_text_are_no_repeats(spark):
    again = letters(700)
    long = letters(2 * suffixes.PIECE + suffixes.OVERLAP + 10_000)
    over = letters(suffixes.PIECE - 300) + again + letters(25_000)
    rows = [(1, long), (2, over), (3, "#" * 300 + again + "." * 300)]
    got = {r.doc_id: r for r in suffixes.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].spans == [] and bytes(got[1].kept) == long.encode()
    assert [(s.start, s.end) for s in got[2].spans] == [(suffixes.PIECE - 300, suffixes.PIECE + 400)]
    assert [(s.start, s.end) for s in got[3].spans] == [(300, 1_000)]


def test_crowded_leads_are_dealt_with_the_same_result(spark):
    line, line2 = letters(380), letters(399)
    texts = [letters(500) + line + letters(500) for _ in range(30)] + [letters(500) + line2 + letters(500) for _ in range(30)]
    tail, both = letters(90), letters(1_200)
    # some share 24 bytes more on a side, some a long stretch
    texts += [letters(450) + line + tail + letters(450) for _ in range(5)] + [letters(450) + tail + line2 + letters(450) for _ in range(5)]
    texts += [letters(i) + both[: 900 + 20 * i] + letters(300) for i in range(1, 12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = Counter(t[p : p + 400] for t in texts for p in range(len(t) - 399))
    want = {}
    for k, t in enumerate(texts):
        if at := {q for p in range(len(t) - 399) if seen[t[p : p + 400]] > 1 for q in range(p, p + 400)}:
            want[k] = at
    assert set(range(60, 81)) <= set(want) and len(want) < 80
    for crowd in (3, suffixes.BUCKET):
        got = {r.doc_id: {q for s in r.spans for q in range(s.start, s.end)} for r in suffixes.repeated(docs, crowd=crowd).collect()}
        assert got == want


def test_suffixes_leave_null_ids_out(spark):
    text = letters(900)
    docs = spark.createDataFrame([(None, text), (1, text + "a"), (2, "b" + text)], "doc_id long, text string")
    assert {r.doc_id: len(r.spans) for r in suffixes.remove(docs).collect()} == {1: 1, 2: 1}
