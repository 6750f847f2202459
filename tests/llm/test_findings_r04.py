"""Faults of the fourth round of findings, on small cases."""

from __future__ import annotations

import random

import duckdb
import pytest
from ragloom.llm import jaccard, suffixes
from ragloom.plans import registry


def _near_copies(n: int, copies: int) -> list[tuple[int, str]]:
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.randint(30, 90))) for _ in range(n)]
    return [(k * n + i, f"{t} copy number {k}." if k else t) for k in range(copies) for i, t in enumerate(texts)]


def _brute(rows: list[tuple[int, str]]) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_by_rounds(spark, monkeypatch):
    """Keys and pairs come in rounds, so that tables of near copies don't fill the disks; all links are found."""
    sizes: dict[str, list[int]] = {}
    write = jaccard.materialize

    def counted(df, name):
        out = write(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    rows = _near_copies(12, 8)
    limits = jaccard.Limits(keys=500, cell=2, texts=1_000, rounds=3)
    got = {r[0]: (r[1], r[2]) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), limits=limits).collect()}
    assert got == _brute(rows)
    for name in ("jaccard-met", "jaccard-across", "jaccard-links"):
        assert len(sizes[name]) == 3 and max(sizes[name]) < 0.7 * sum(sizes[name]), name


PIECES = "132 4116106959541135|12:30|01/02/2024|8:15 - 9:45|é|É|ß|\u0301|\x0b|\x85|\xa0|İ|ı|ſ|\u212a| |\n|, |. |! |: |via |VIA |cor\u017fo |\u017ftrada |piazza \x0b|Roma centrale|a@b.it|12,50 €|9 eur|7%|http://x|http\u017f://y|contatti|CONTATTİ|SERVİZİ|orari|\u212aa|menu|MENU|SİDEBAR|<p>|<td>|<nav>|<form>|the|word|Word|_|0039|+39 055 123456".split("|")


@pytest.mark.parametrize("name", ["X61_page_metrics", "X62_page_predicates", "X63_page_type", "X64_page_quality", "X42_strategy"])
def test_page_metrics_as_sql(spark, tmp_path, name):
    """Letters beyond ASCII next to numbers, other blanks, letters that fold to ASCII ones, and sums that end in 5."""
    rng = random.Random(6)
    pages = [(0, "x 27.204.213.132 4116106959541135Éré"), (1, None)] + [(i, "".join(rng.choices(PIECES, k=rng.randint(1, 60)))) for i in range(2, 3_000)]
    # 2 words of 2 over 1 / 20 and the like: round() by decimals and by binary differ
    pages += [(3_000 + i, "w " * rng.randint(1, 40) + "v! " * rng.randint(0, 25) + "u" * rng.randint(0, 9)) for i in range(1_000)]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    expected = {r[0]: r for r in con.execute(registry.ORACLE[name]).fetchall()}
    got = {r[0]: tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert {i: (got[i], expected[i]) for i in expected if got[i] != expected[i]} == {} and len(got) == len(expected)


def test_suffixes_of_copies_are_not_sorted(spark, monkeypatch):
    """Where all contexts are copies of one another no bytes go on; where they differ, all of them are compared."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared = text(450)
    copied = [text(2_000) for _ in range(5)]
    rows = [(i, copied[i % 5]) for i in range(15)] + [(100, text(300) + shared + text(300)), (101, text(500) + shared), (102, copied[0][:1_000] + text(900)), (103, text(399))]
    tables = []
    monkeypatch.setattr(suffixes, "keep", lambda df, keep=suffixes.keep: tables.append(out := keep(df)) or out)
    got = {r[0]: bytes(r[1]) for r in suffixes.remove(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "kept").collect()}
    starts: dict[str, int] = {}
    for _, t in rows:
        for k in range(len(t) - 399):
            starts[t[k : k + 400]] = starts.get(t[k : k + 400], 0) + 1
    for i, t in rows:
        gone = {k + j for k in range(len(t) - 399) if starts[t[k : k + 400]] > 1 for j in range(400)}
        assert got[i].decode() == "".join(x for k, x in enumerate(t) if k not in gone), i
    found = next(t for t in tables if "context" in t.columns)
    ids = {r[0] for r in found.filter("context is not null").select("id").distinct().collect()}
    assert ids and ids <= {100, 101, 102, *range(0, 15, 5)}
