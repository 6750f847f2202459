"""Opening hours and addresses near names: a join by nearest position inside each text.

Values and names of a text become two sorted arrays of positions; one merge
finds the nearest name for every value, so no pairs are formed. Names are a
query set that goes to every task; texts stay where they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hours
from ..session import dealt, slices

#: How far a value may stand from a name, by kind.
REACH = {"schedule": 350, "address": 450}
EXCERPT = {"schedule": 300, "address": 280}


def nearest(values: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The distance of every value to the nearest of the sorted marks; very far if there is none."""
    if not len(marks):
        return np.full(len(values), 1 << 30)
    after = np.searchsorted(marks, values)
    left, right = marks[np.maximum(after - 1, 0)], marks[np.minimum(after, len(marks) - 1)]
    return np.minimum(np.abs(values - left), np.abs(values - right))


def _trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(max(1, len(text) - 2))}


def _excerpt(text: str, at: int, size: int) -> str:
    start = max(0, min(at - size // 2, len(text) - size))
    cut = text[start : start + size]
    return text if len(text) <= size else f"{'…' if start else ''}{cut}{'…' if start + size < len(text) else ''}"


KINDS = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
OUT = "name string, value string, position int, distance int, score double, label string, excerpt string, claimed boolean"


def prepared(names: list[tuple[str, list[str]]], kind: str) -> list[tuple]:
    """What each (name, its own words) asks of a text: computed once for all texts."""
    out = []
    for name, primary in names:
        words = name.split()
        required = list(dict.fromkeys(primary + words)) if kind == "schedule" else (primary or words)
        out.append((name, primary or words, required, list(dict.fromkeys(words)), _trigrams(name)))
    return out


def _matches(text: str, names: list[tuple], kind: str) -> list[tuple]:
    """The rows of one text: every value near every name (``prepared``), and whether that name is its nearest (the first of equally near ones)."""
    low, reach = text.lower(), REACH[kind]
    generic = hours.GENERIC if kind == "schedule" else hours.GENERIC_PLACES
    # names share words: each is looked for once
    holds = {w: w in low for w in {w for _, _, required, words, _ in names for w in (*required, *words)}}
    grams = _trigrams(low) if any(holds.values()) else set()
    at_word: dict[str, list[int]] = {}
    here = []
    for name, terms, required, words, of_name in names:
        held = [t for t in required if holds[t]]
        if not held:
            continue
        for t in held:
            if t not in at_word:
                at_word[t] = hours.positions(low, [t], generic)
        marks = sorted({p for t in held for p in at_word[t]})
        if not marks:
            continue
        both = len(grams & of_name)
        either = len(grams) + len(of_name) - both
        if sum(holds[w] for w in words) >= min(2, len(words)) or both > 0.2 * either:
            here.append((name, terms, np.array(marks), hours.name_position(low, name, generic), both / either))
    if not here:
        return []
    found = hours.schedules(text) if kind == "schedule" else hours.addresses(text)
    rows = []
    at = np.array([p for _, p in found], np.int64)
    for name, terms, marks, place, similar in here:
        if kind == "schedule":
            far = nearest(at, marks)
            ok = far <= reach
        else:
            far = np.abs(at - place) if place is not None else np.full(len(at), 1 << 30)
            # a term of the name stands within 200 characters before or after
            ok = (far <= reach) & np.array([bool(hours.positions(low[max(0, p - 200) : max(0, p - 200) + 400], terms, generic)) for p in at.tolist()], bool)
        shown = hours.label(text, terms)
        for i in np.flatnonzero(ok).tolist():
            rows.append([name, found[i][0], int(at[i]), int(far[i]), similar + max(0.0, 1 - far[i] / reach), shown, _excerpt(text, int(at[i]), EXCERPT[kind]), i])
        if kind == "schedule" and not found and shown and (line := hours.appointment(text, terms)):
            p = text.find(line)
            d = abs(p - place) if p >= 0 and place is not None else 250
            rows.append([name, line, max(p, 0), d, similar + max(0.0, 1 - min(d, reach) / reach), shown, _excerpt(text, max(p, 0), EXCERPT[kind]), -1])
    best: dict = {}
    for k, r in enumerate(rows):
        if r[-1] not in best or r[3] < rows[best[r[-1]]][3]:
            best[r[-1]] = k
    return [(*r[:-1], best[r[-1]] == k) for k, r in enumerate(rows)]


def near_names(chunks: DataFrame, keys: list[str], text: str, names: list[str], kind: str, originals: list[str] | None = None) -> DataFrame:
    """(keys, name, value, position, distance, score, label, excerpt, claimed) of all hours or addresses near names.

    ``kind`` is "schedule" or "address". A text counts for a name if it holds
    two of its words (its only word) or is similar to it, and a word of three
    letters that isn't generic, of ``originals`` (names before synonyms were
    added) where given. Hours are measured from the nearest such word,
    addresses from the name. The score is the trigram similarity of text and
    name, and up to 1 for nearness. Without hours a line about appointments
    stands in. ``claimed`` marks the name that is nearest to a value. Null
    texts count as empty; repeated rows repeat.
    """
    names = [" ".join(n.lower().split()) for n in names]
    wanted = prepared([(n, o.lower().split()) for n, o in zip(names, originals or [""] * len(names), strict=True) if n], kind)
    fields = OUT.split(", ")
    schema = T.StructType([chunks.schema[k] for k in keys] + [T.StructField(f.split()[0], KINDS[f.split()[1]]) for f in fields])
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string(), pa.bool_()]

    def run(batches):
        for batch in slices(batches, 1_024):
            of, rows = [], []
            for i in range(batch.num_rows):
                got = _matches(batch.column(len(keys))[i].as_py() or "", wanted, kind)
                of += [i] * len(got)
                rows += got
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            taken = [batch.column(k).take(pa.array(of, pa.int32())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[*keys, *(f.split()[0] for f in fields)])

    return dealt(chunks.select(*keys, text), *keys).mapInArrow(run, schema)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _hours(texts):
    return texts.map(lambda t: hours.office_hours(t or ""))


def office_hours(text: Column) -> Column:
    """Hours of the offices that a text names, else all its hours; an empty array for null."""
    return _hours(text)
