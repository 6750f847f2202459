"""Cross-parsing against a parse by search."""

from __future__ import annotations

import random

from ragloom.llm import language_id


def phrases(text: str, sample: str) -> int:
    """Greedy parse into the longest stretches that stand in the sample; a letter that it never has closes its phrase."""
    n, current = 1, ""
    for c in text:
        if current + c in sample:
            current += c
        else:
            n, current = n + 1, c if c in sample else ""
    return n


def test_phrases_as_by_search():
    rnd = random.Random(3)
    draw = lambda letters, n: "".join(rnd.choices(letters, k=n))
    samples = {"aa": draw("abc de", 300), "bb": draw("xyz abé", 500), "cc": draw("日本語テ ", 200), "dd": "a"}
    samples = {k: language_id.normalise(v) for k, v in samples.items()}
    model = language_id.build_model(samples)
    texts = [draw("abc dexyzé日本!", rnd.randrange(1, 200)) for _ in range(40)] + ["q", "Q q 1", "日本", "abc 😀 def", "ab\ue000cd", "𝐚𝐛 xyz"]
    got, lens = language_id.phrase_counts(texts, model)
    for k, text in enumerate(texts):
        low = language_id.normalise(text)
        assert lens[k] == len(low)
        assert got[:, k].tolist() == [phrases(low, samples[lang]) for lang in model.langs], text


def test_ties_and_repeats(spark):
    docs = spark.createDataFrame([(i, "abc abd acd " * 9, x) for i, x in enumerate(["aa", "bb"] * 30)], "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    got = language_id.detect(docs.union(docs), model).collect()
    # both languages parse alike, whatever the row; their samples may differ in length
    assert len(got) == 120 and len({(r.lang_pred, r.score) for r in got}) == 1 and got[0].score < 0.1
    same = language_id.build_model({"bb": "abc abd", "aa": "abc abd"})
    assert language_id._decide(["abc abd", "abd"], same)[0] == ["aa", "aa"]
