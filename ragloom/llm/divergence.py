"""Quality rules: base counts, and distances of a text's histograms to those of languages.

Each language's reference is its share of character classes and of its most
common words, counted over all its documents that pass the base rules. A
document is as far away as the nearest reference, by Jensen-Shannon distance
(base 2, from 0 to 1). Short texts scatter more, so the bound on words widens
by a stated slack, and texts below a length aren't judged at all.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shingles import BLOCK, mix, word_hashes
from .util import keep, slices

SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?'\"()-"
#: Character classes: general categories by their letters, except for the two sets above, the space and the line break.
CLASSES = ("Ll", "Lu", "LM", "N", " ", "\n", "ZC", "marks", "symbols", "rest")
#: What words lose at their end before they are looked up.
ENDS = ".,;:!?"
_BLANK, _END, _LETTER = (np.zeros(256, bool) for _ in range(3))
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_END[[ord(c) for c in ENDS]] = True
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Rules:
    """Bounds of the verdict.

    ``common``: words of a language's histogram. ``chars``, ``words``: largest
    distances. A text of n words may be ``slack`` / n further off in words.
    ``least_words``: shorter texts are not judged by distances. ``reference``:
    languages with fewer words have no reference.
    """

    common: int = 64
    chars: float = 0.3
    words: float = 0.31
    slack: float = 10.0
    least_words: int = 50
    reference: int = 1_000


@dataclass(frozen=True)
class References:
    """Languages in order, their shares of classes, the hashes of their common words and the shares of these (the last: of all others)."""

    langs: list[str]
    chars: np.ndarray
    words: list[np.ndarray]
    shares: list[np.ndarray]


@dataclass(frozen=True)
class Measured:
    """Counts of many texts: a row each."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    classes: np.ndarray

    def base_failed(self) -> np.ndarray:
        return (self.n_words < 50) | (100 * self.n_repeat_words > 50 * self.n_words)


@functools.cache
def _class_table() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, CLASSES.index("rest"), np.uint8)
    of = {"Ll": 0, "Lu": 1, "L": 2, "M": 2, "N": 3, "Z": 6, "C": 6}
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))
        table[i] = of.get(kind, of.get(kind[0], 9))
    for chars, k in ((" ", 4), ("\n", 5), (MARKS, 7), (SYMBOLS, 8)):
        table[[ord(c) for c in chars]] = k
    return table


def _repeated(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text in windows of three that occur twice or more in it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(words) < 3:
        return np.zeros(len(counts), np.int64)
    with np.errstate(over="ignore"):
        h = mix(mix(mix(words[:-2]) + words[1:-1]) + words[2:]) ^ mix(owner[:-2].astype(np.uint64) + np.uint64(1))
    at = np.flatnonzero(owner[:-2] == owner[2:])
    _, which, count = np.unique(h[at], return_inverse=True, return_counts=True)
    again = at[count[which] > 1]
    held = np.zeros(len(words), bool)
    for k in range(3):
        held[again + k] = True
    return np.bincount(owner[held], minlength=len(counts))


def measure(texts: list[str | None]) -> Measured:
    """Words, their code points, symbols, repeated lines, repeated words, and counts of character classes, of every text."""
    texts = [t or "" for t in texts]
    raw = [t.encode() for t in texts]
    words, n_words = word_hashes(raw) if raw else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    k = len(CLASSES)
    classes = np.bincount(owner * k + _class_table()[points], minlength=len(texts) * k).reshape(-1, k)
    blanks = (points == 0x20) | (points - np.uint32(9) < 5)
    dups = []
    for x in raw:
        lines = [y for y in x.split(b"\n") if y.strip()]
        dups.append(len(lines) - len(set(lines)))
    return Measured(n_words, sizes - np.bincount(owner[blanks], minlength=len(texts)), classes[:, CLASSES.index("symbols")], np.array(dups, np.int64), _repeated(words, n_words), classes)


def vocabulary(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in lower case, without marks at their ends, and how many each text has.

    Words without a letter (of ASCII or beyond it any character) are left out.
    """
    lowered = [t.lower().encode() for t in texts]
    flat = np.frombuffer(b" ".join(lowered) + b" ", np.uint8).copy()
    mark = _END[flat]
    following = np.minimum.accumulate(np.where(mark, len(flat) - 1, np.arange(len(flat)))[::-1])[::-1]
    flat[mark & _BLANK[flat[following]]] = 0x20
    blank = _BLANK[flat]
    edge = np.flatnonzero(np.diff(np.r_[True, blank].astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    letters = np.r_[0, np.cumsum(_LETTER[flat])]
    without = letters[end] == letters[start]
    cover = np.zeros(len(flat) + 1, np.int64)
    cover[start[without]] += 1
    cover[end[without]] -= 1
    flat[np.cumsum(cover[:-1]) > 0] = 0x20
    data, ends = flat.tobytes(), np.cumsum([len(x) + 1 for x in lowered])
    return word_hashes([data[e - len(x) - 1 : e - 1] for e, x in zip(ends.tolist(), lowered, strict=True)])


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows of a batch (texts are its second column), in blocks of about a megabyte of text."""
    texts, at, size = batch.column(1).to_pylist(), 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BLOCK or i + 1 == len(texts):
            yield batch.slice(at, i + 1 - at), texts[at : i + 1]
            at, size = i + 1, 0


COUNTS = "lang string, kind int, h long, n long"


class _Held:
    """Counts of hashes by language; told whenever many are held."""

    def __init__(self) -> None:
        self.parts: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, lang: str, kind: int, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.parts.setdefault((lang, kind), []).append((hashes, counts))
        self.size += len(hashes)

    def told(self) -> Iterator[pa.RecordBatch]:
        for (lang, kind), parts in self.parts.items():
            h, place = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([c for _, c in parts]), minlength=len(h)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], names=["lang", "kind", "h", "n"])
        self.parts, self.size = {}, 0


def _count(batches):
    """Counts of classes (0), words (1) and of all words (2) of each language's documents that pass the base rules."""
    held = _Held()
    for batch in slices(batches):
        for block, texts in _blocks(batch):
            got = measure(texts)
            fine = np.flatnonzero(~got.base_failed())
            if not len(fine):
                continue
            langs = np.array(block.column(0).to_pylist(), object)[fine]
            words, counts = vocabulary([texts[i] for i in fine])
            owner = np.repeat(np.arange(len(fine)), counts)
            for lang in dict.fromkeys(langs):
                mine = langs == lang
                held.add(lang, 0, np.arange(len(CLASSES), dtype=np.uint64), got.classes[fine[mine]].sum(axis=0))
                held.add(lang, 1, *np.unique(words[mine[owner]], return_counts=True))
                held.add(lang, 2, np.zeros(1, np.uint64), got.n_words[fine[mine]].sum(keepdims=True))
        if held.size > 2_000_000:
            yield from held.told()
    yield from held.told()


def learn(docs: DataFrame, rules: Rules = Rules(), *, text_col: str = "text", lang_col: str = "lang") -> References:
    """References of all languages, from all documents with a language.

    A language's common words are the most frequent ones, at most ``common``;
    those as frequent as the first that has no place are none either. What
    reaches the driver are these and the classes of each language that the
    table names.
    """
    counts = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    counts = counts.mapInArrow(_count, COUNTS).groupBy("lang", "kind", "h").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "h")
    top = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= max(rules.common + 1, len(CLASSES))).orderBy("lang", "kind", "r").collect()
    total = {r.lang: r.n for r in top if r.kind == 2}
    langs = sorted(x for x, n in total.items() if n >= rules.reference)
    chars, words, shares = np.zeros((len(langs), len(CLASSES))), [], []
    for i, lang in enumerate(langs):
        mine = [r for r in top if r.lang == lang]
        for r in mine:
            if r.kind == 0:
                chars[i, r.h] = r.n
        ranked = [r for r in mine if r.kind == 1]
        least = ranked[rules.common].n if len(ranked) > rules.common else 0
        common = sorted((r.h % (1 << 64), r.n) for r in ranked[: rules.common] if r.n > least)  # unsigned, in order
        words.append(np.array([h for h, _ in common], np.uint64))
        share = np.array([n for _, n in common], np.float64)
        shares.append(np.r_[share, total[lang] - share.sum()] / total[lang])
    return References(langs, chars / chars.sum(axis=1, keepdims=True), words, shares)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The distances of the rows of ``p`` from ``q``: 0 for equal distributions, 1 for disjoint ones."""
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = (np.where(x > 0, x * np.log2(2 * x / (p + q)), 0.0).sum(axis=-1) for x in (p, q + np.zeros_like(p)))
    return np.sqrt(np.maximum(0.0, (a + b) / 2))


def _distances(texts: list[str], got: Measured, rows: np.ndarray, refs: References) -> tuple[np.ndarray, np.ndarray]:
    """Distances of these rows from the nearest reference, in classes and in common words."""
    classes = got.classes[rows] / got.classes[rows].sum(axis=1, keepdims=True)
    chars = np.min([jensen_shannon(classes, r) for r in refs.chars], axis=0)
    hashes, counts = vocabulary([texts[i] for i in rows])
    owner = np.repeat(np.arange(len(rows)), counts)
    words = np.ones(len(rows))
    for common, share in zip(refs.words, refs.shares, strict=True):
        at = np.minimum(np.searchsorted(common, hashes), max(0, len(common) - 1))
        hit = np.flatnonzero(common[at] == hashes) if len(common) else np.zeros(0, np.int64)
        here = np.bincount(owner[hit] * len(share) + at[hit], minlength=len(rows) * len(share)).reshape(len(rows), -1)
        here[:, -1] = got.n_words[rows] - here[:, :-1].sum(axis=1)
        words = np.minimum(words, jensen_shannon(here / got.n_words[rows][:, None], share))
    return chars, words


OUT = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judge(docs: DataFrame, refs: References, rules: Rules = Rules(), *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The base counts of every row, whether the base rules fail, whether the row is kept, and its distances.

    Null and empty texts have no words and fail the base rules. Distances are
    null where they aren't looked at: below ``least_words``, without any
    reference, and for documents of a named language that has none (they are
    kept, if the base rules hold). Rows that repeat repeat in the result; a
    null id stays null; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches):
        known = sent.value
        for batch in slices(batches):
            for block, texts in _blocks(batch):
                got = measure(texts)
                failed = got.base_failed()
                judged = np.array([x is None or x in known.langs for x in block.column(2).to_pylist()]) & (got.n_words >= max(1, rules.least_words)) & bool(known.langs)
                chars, words = np.zeros(len(texts)), np.zeros(len(texts))
                rows = np.flatnonzero(judged)
                if len(rows):
                    chars[rows], words[rows] = _distances(texts, got, rows, known)
                near = ~judged | ((chars <= rules.chars) & (words <= rules.words + rules.slack / np.maximum(got.n_words, 1)))
                counts = [pa.array(np.asarray(c, np.int64)) for c in (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words)]
                far = [pa.array(x, mask=~judged) for x in (chars, words)]
                yield pa.RecordBatch.from_arrays([block.column(0), *counts, pa.array(failed), pa.array(near & ~failed), *far], names=[x.split()[0] for x in OUT.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return rows.mapInArrow(run, OUT).withColumnRenamed("id", id_col)


def _sql() -> str:
    r = Rules()
    classes = {0: r"\p{Ll}", 1: r"\p{Lu}", 2: r"\p{Lt}\p{Lm}\p{Lo}\p{M}", 3: r"\p{N}", 4: " ", 5: r"\n", 7: r".,;:!?''\"()\-", 8: r"#*$%&|<>"}
    number = ", ".join(f"length(regexp_replace(text, '[^{c}]', '', 'g')) AS c{k}" for k, c in classes.items())
    number += r", length(regexp_replace(text, '[^\p{Z}\p{C}]', '', 'g')) - c4 - c5 AS c6"
    all_k = [*classes, 6]
    rest = "length(text) - " + " - ".join(f"c{k}" for k in all_k)
    js = lambda p, q: f"sqrt(greatest(0, sum(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END) / 2))"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS v FROM d),
pos AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 1)) AS i, w FROM w),
win AS (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM pos),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, range(3) t(k) WHERE c > 1 GROUP BY 1),
b AS (SELECT w.doc_id, lang, text, v, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
c AS (SELECT doc_id, lang, base_failed, n_words, {number}, {rest} AS c9 FROM f),
ch AS (SELECT doc_id, lang, base_failed, n_words, k, n::DOUBLE / sum(n) OVER (PARTITION BY doc_id) AS p, n FROM (
    {" UNION ALL ".join(f"SELECT doc_id, lang, base_failed, n_words, {k} AS k, c{k} AS n FROM c" for k in range(10))})),
words AS (SELECT doc_id, lang, base_failed, n_words, rtrim(x, '.,;:!?') AS x, count(*) AS n FROM (SELECT doc_id, lang, base_failed, n_words, unnest(v) AS x FROM f) GROUP BY ALL),
ref_all AS (SELECT lang, sum(n) AS total FROM words WHERE lang IS NOT NULL AND NOT base_failed GROUP BY 1 HAVING sum(n) >= {r.reference}),
ref_c AS (SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM ch JOIN ref_all USING (lang) WHERE NOT base_failed GROUP BY 1, 2),
ref_w AS (SELECT lang, x, n / total AS q FROM (SELECT lang, x, sum(n) AS n, any_value(total) AS total, count(*) OVER (PARTITION BY lang ORDER BY sum(n) DESC RANGE UNBOUNDED PRECEDING) AS r
    FROM words JOIN ref_all USING (lang) WHERE NOT base_failed AND regexp_matches(x, '[a-z]|[^\x00-\x7F]') GROUP BY 1, 2) WHERE r <= {r.common}),
ref AS (SELECT lang, x, q FROM ref_w UNION ALL SELECT lang, NULL, 1 - sum(q) FROM ref_w GROUP BY 1),
dc AS (SELECT doc_id, min(j) AS char_distance FROM (SELECT doc_id, r.lang, {js("p", "q")} AS j FROM ch JOIN ref_c r USING (k) GROUP BY 1, 2) GROUP BY 1),
hit AS (SELECT d.doc_id, r.lang, r.x, r.q, coalesce(h.n, 0) / d.n_words::DOUBLE AS p FROM f d CROSS JOIN ref_w r LEFT JOIN words h ON h.doc_id = d.doc_id AND h.x = r.x WHERE d.n_words >= {r.least_words}),
hits AS (SELECT doc_id, lang, p, q FROM hit UNION ALL SELECT doc_id, lang, 1 - sum(p), 1 - sum(q) FROM hit GROUP BY 1, 2),
dw AS (SELECT doc_id, min(j) AS word_distance FROM (SELECT doc_id, lang, {js("p", "q")} AS j FROM hits GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT f.*, n_words >= {r.least_words} AND EXISTS (SELECT 1 FROM ref_all) AND (lang IS NULL OR lang IN (SELECT lang FROM ref_all)) AS judged, char_distance, word_distance
    FROM f LEFT JOIN dc USING (doc_id) LEFT JOIN dw USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (NOT judged OR (char_distance <= {r.chars} AND word_distance <= {r.words} + {r.slack} / n_words)) AS kept,
    CASE WHEN judged THEN round(char_distance, 6) END AS char_distance, CASE WHEN judged THEN round(word_distance, 6) END AS word_distance FROM j
"""


ORACLE_SQL = _sql()
