"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over labelled text. A document
is parsed greedily into the longest phrases that occur in that text; the
language that needs the fewest phrases, normalised by the length of its
labelled text (``phrases * log2(n) / characters``), wins.

The automata are dense transition tables, so a task steps thousands of text
segments at once, one array operation per character position.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import crc_mod, slices

#: A table entry: the next state, and this bit where a phrase ended.
PHRASE_END = 1 << 30
STATE = PHRASE_END - 1
#: Texts are parsed in segments of so many characters; a phrase ends with its segment.
SEGMENT = 1024
#: So many characters are stepped together.
BLOCK = 600_000
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageModel:
    """Automata of all languages, one after the other in one table.

    ``classes``: code point to letter; ``columns``: letter to column, by
    language; ``widths``, ``bases``: columns and first entry of a language.
    """

    langs: list[str]
    classes: np.ndarray
    columns: np.ndarray
    widths: np.ndarray
    bases: np.ndarray
    table: np.ndarray
    bits: np.ndarray


def normalise(text: str) -> str:
    """Lower case; every run of other characters than letters is one space."""
    return regex.sub(r"\P{L}+", " ", text.lower())


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is the root."""
    nxt: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for ch in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in nxt[p]:
            nxt[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][ch]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(ch) == q:
                    nxt[p][ch] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


def build_model(samples: dict[str, str]) -> LanguageModel:
    """Automata over normalised text per language (may be empty: nothing is learned)."""
    langs = sorted(samples)
    letters = sorted({c for s in samples.values() for c in s} - {" "})
    width = len(letters) + 2  # column 0: space; the last: any other letter
    classes = np.zeros(0x110000, np.uint8 if width < 256 else np.uint16)
    classes[np.fromiter((chr(c).isalpha() for c in range(len(classes))), bool, len(classes))] = width - 1
    for k, c in enumerate(letters, 1):
        classes[ord(c)] = k
    column = {c: k for k, c in enumerate(letters, 1)} | {" ": 0}
    tables, columns, widths, bases, base = [], [], [], [], 0
    for lang in langs:
        # letters that the sample does not have share the last column
        own = {c: k for k, c in enumerate(sorted(set(samples[lang]) | {" "}))}
        w = len(own) + 1
        columns.append(np.full(width, w - 1, np.int32))
        for c, k in own.items():
            columns[-1][column[c]] = k
        states = suffix_automaton(samples[lang])
        root = np.full(w, PHRASE_END, np.int32)
        for c, to in states[0].items():
            root[own[c]] = to | PHRASE_END
        table = np.tile(root, (len(states), 1))
        for s, out in enumerate(states):
            for c, to in out.items():
                table[s, own[c]] = to
        tables.append(table.ravel())
        widths.append(w)
        bases.append(base)
        base += table.size
    bits = np.array([np.log2(max(len(samples[x]), 2)) for x in langs])
    none = np.zeros(0, np.int32)
    return LanguageModel(langs, classes, np.stack(columns) if columns else none, np.array(widths, np.int64), np.array(bases, np.int64), np.concatenate(tables) if tables else none, bits)


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 64, sample_chars: int = 12_288) -> LanguageModel:
    """Learn from rows with a language whose crc32(id as text) mod 3 is not 1.

    Bound: per language at most ``sample_docs`` documents, those with the lowest
    hash of their id, and ``sample_chars`` normalised characters of them, dealt
    evenly. The hash threshold comes from a count per language, so that no task
    sees more than a few times that many rows of one language.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("id", 3) != 1)
    )
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(1 << 20)
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    few = rows.select("id", "lang", share.alias("u")).join(F.broadcast(counts), "lang").filter(F.col("u") * F.col("n") <= 3 * sample_docs)
    order = Window.partitionBy("lang").orderBy("u", "id")
    chosen = few.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample_docs).select("id", "lang", "r")
    got = rows.join(F.broadcast(chosen), ["id", "lang"]).select("lang", "r", "id", F.substring("text", 1, 4 * sample_chars).alias("text"))
    texts: dict[str, list[str]] = {}
    for row in sorted(got.collect(), key=lambda x: (x.lang, x.r, x.id)):
        texts.setdefault(row.lang, []).append(normalise(row.text))
    samples = {}
    for lang, parts in texts.items():
        each = max(1, sample_chars // len(parts))
        whole = " ".join(p[:each] for p in parts)
        rest = " ".join(p[each:] for p in parts)
        whole = (whole + " " + rest)[:sample_chars]
        if LETTER.search(whole):
            samples[lang] = whole
    return build_model(samples)


def phrase_counts(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Phrases per language and text, and the normalised lengths."""
    low = [t.lower() for t in texts]
    lens = np.fromiter(map(len, low), np.int64, len(low))
    code = model.classes[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(len(low)), lens)
    keep = code != 0
    keep[1:] |= (code[:-1] != 0) | (doc[1:] != doc[:-1])
    code, doc = code[keep], doc[keep]
    lens = np.bincount(doc, minlength=len(low))
    first = np.cumsum(lens) - lens
    parts = -(-lens // SEGMENT)
    owner = np.repeat(np.arange(len(low)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = first[owner] + nth * SEGMENT
    size = np.minimum(lens[owner] - nth * SEGMENT, SEGMENT)
    order = np.argsort(-size, kind="stable")
    owner, start, size = owner[order], start[order], size[order]
    phrases = np.zeros((len(model.langs), len(low)), np.int64)
    if not len(owner) or not model.langs:
        return phrases, lens
    state = np.zeros((len(model.langs), len(owner)), np.int32)
    ended = np.ones(state.shape, np.int32)
    widths, bases = model.widths[:, None], model.bases[:, None]
    active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
    for t, n in enumerate(active.tolist()):
        step = model.table[bases + state[:, :n] * widths + model.columns[:, code[start[:n] + t]]]
        ended[:, :n] += step >> 30
        state[:, :n] = step & STATE
    for k in range(len(model.langs)):
        phrases[k] = np.bincount(owner, weights=ended[k], minlength=len(low)).astype(np.int64)
    return phrases, lens


def _decide(texts: list[str | None], m: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and score of every text."""
    lang: list[str] = ["und"] * len(texts)
    score = np.zeros(len(texts))
    block: list[int] = []
    total = 0
    known = [i for i, t in enumerate(texts) if m.langs and t and LETTER.search(t)]
    for i in [*known, None]:
        if i is not None:
            block.append(i)
            total += len(texts[i])
        if block and (i is None or total >= BLOCK):
            phrases, lens = phrase_counts([texts[j] for j in block], m)
            entropy = phrases * m.bits[:, None] / np.maximum(lens, 1)
            ranked = np.sort(entropy, axis=0)
            sure = 1 - ranked[0] / ranked[1] if len(m.langs) > 1 else np.ones(len(block))
            for j, b in zip(block, entropy.argmin(axis=0).tolist(), strict=True):
                lang[j] = m.langs[b]
            score[block] = np.clip(sure, 0, 1)
            block, total = [], 0
    return lang, score


def detect(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row of ``docs``.

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no
    letter, or where no language was learned. ``score`` is 1 minus the ratio of
    the best to the second-best entropy (1 where one language is known). Equal
    entropies go to the language that sorts first. Rows repeat as they repeat
    in the input; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, 1_024):
            lang, score = _decide(batch.column(1).to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score)], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that get a language."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches, 1_024):
            lang, _ = _decide(batch.column(at).to_pylist(), held.value)
            yield batch.filter(pa.array([x != "und" for x in lang], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
