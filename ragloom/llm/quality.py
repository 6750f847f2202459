"""Quality classifier: a factorisation machine over words, structure and metadata.

A document is a sparse vector: hashed words (and coarse word shapes), statistics
of its structure in bins, and its stated length. The score is the logistic of
``w0 + sum(w x) + 1/2 sum_f((sum(v_f x))^2 - sum(v_f^2 x^2))``: the second-order
interactions of all pairs, in time linear in the non-zero entries.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import crc_mod, slices

WORDS = 1 << 14
BINS = 12
#: Statistics of a text, each put in one of BINS bins.
STATS = ("upper", "digit", "mark", "odd", "line", "pipe", "long", "distinct", "top", "twice", "length", "words", "stated")
SIZE = WORDS + BINS * len(STATS)
RANK = 8


@dataclass(frozen=True)
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One value per row; rows start at ``starts`` and are not empty."""
        v = self.factors[idx] * val[:, None]
        total = np.add.reduceat(v, starts)
        square = np.add.reduceat(v * v, starts)
        return self.bias + np.add.reduceat(self.linear[idx] * val, starts) + 0.5 * (total * total - square).sum(axis=1)


def _bin(x: float) -> int:
    return min(BINS - 1, max(0, int(x * BINS)))


def features(text: str | None, stated: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values; a null text counts as empty. Never without entries."""
    text = text or ""
    words = text.split()
    n, size = len(words), len(text)
    counts = Counter(words)
    octets = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    total = max(int(octets.sum()), 1)
    upper, digit = int(octets[65:91].sum()), int(octets[48:58].sum())
    mark = int(octets[33:48].sum() + octets[58:65].sum() + octets[91:97].sum() + octets[123:127].sum())
    odd = mark - int(octets[44] + octets[46])
    repeats = sum(map(str.__eq__, words, words[1:]))
    top = max(counts.values(), default=0)
    stats = (
        (upper / total) ** 0.5,
        (digit / total) ** 0.5,
        (mark / total) ** 0.5,
        (odd / total) ** 0.5,
        (int(octets[10]) / total * 10) ** 0.5,
        (int(octets[124]) / total * 4) ** 0.5,
        (size / n - 1) / 15 if n else 0.0,
        len(counts) / n if n else 0.0,
        (top / n) ** 0.5 if n else 0.0,
        (repeats / n) ** 0.5 if n else 0.0,
        math.log10(size + 1) / 6,
        math.log10(n + 1) / 5,
        math.log10(max(stated, 0) + 1) / 6 if stated is not None else 0.0,
    )
    idx = [WORDS + k * BINS + _bin(x) for k, x in enumerate(stats)]
    hashed = Counter(crc32(w.encode("utf-8", "replace")) & (WORDS - 1) for w in counts)
    scale = 1 / math.sqrt(max(len(counts), 1))
    keys = np.fromiter(hashed.keys(), np.int32, len(hashed))
    vals = np.fromiter(hashed.values(), np.float32, len(hashed)) * scale
    return np.concatenate([np.array(idx, np.int32), keys]), np.concatenate([np.full(len(idx), 1 / math.sqrt(len(idx)), np.float32), vals.astype(np.float32)])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], *, epochs: int = 12, rate: float = 0.08, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
    """AdaGrad on the logistic loss in small batches, in a fixed order of shuffles."""
    rng = np.random.default_rng(seed)
    w = np.zeros(SIZE)
    v = rng.normal(0, 0.02, (SIZE, RANK))
    share = min(max(sum(y for *_, y in rows) / max(len(rows), 1), 1e-3), 1 - 1e-3)
    b = math.log(share / (1 - share))
    gw, gv, gb = np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6), 1e-6
    for _ in range(epochs if rows else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            part = [rows[i] for i in order[at : at + 64]]
            lens = np.array([len(r[0]) for r in part])
            starts = np.cumsum(lens) - lens
            idx = np.concatenate([r[0] for r in part])
            val = np.concatenate([r[1] for r in part]).astype(float)
            y = np.array([r[2] for r in part], float)
            xv = v[idx] * val[:, None]
            total = np.add.reduceat(xv, starts)
            z = b + np.add.reduceat(w[idx] * val, starts) + 0.5 * (total**2 - np.add.reduceat(xv * xv, starts)).sum(axis=1)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(part)
            each = np.repeat(err, lens)
            step_w = each * val
            step_v = (each * val)[:, None] * (np.repeat(total, lens, axis=0) - xv)
            seen, inverse = np.unique(idx, return_inverse=True)
            dw = np.bincount(inverse, step_w, len(seen)) + decay * w[seen]
            dv = np.stack([np.bincount(inverse, step_v[:, f], len(seen)) for f in range(RANK)], axis=1) + decay * v[seen]
            gw[seen] += dw**2
            gv[seen] += dv**2
            w[seen] -= rate * dw / np.sqrt(gw[seen])
            v[seen] -= 0.3 * rate * dv / np.sqrt(gv[seen])
            db = err.sum()
            gb += db * db
            b -= rate * db / math.sqrt(gb)
    return FactorisationMachine(b, w.astype(np.float32), v.astype(np.float32))


def _features_of(batches):
    for batch in slices(batches, 64):
        idx, val = zip(*(features(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)), strict=True) if batch.num_rows else ((), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x.tobytes() for x in idx], pa.binary()), pa.array([x.tobytes() for x in val], pa.binary())], names=["y", "idx", "val"]
        )


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", label_col: str = "quality", sample_rows: int = 8_000) -> FactorisationMachine:
    """Fit on labelled rows whose crc32(id as text) mod 3 is not 1.

    Bound: at most ``sample_rows`` labelled ids, those with the lowest hash.
    Null labels are left out; an id with several labels counts with its
    largest. Without labelled rows every score is one half.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, 3) != 1))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(size_col).cast("long").alias("stated"))
    rows = rows.join(F.broadcast(known), "id").select("y", "text", "stated").mapInArrow(_features_of, "y int, idx binary, val binary")
    got = sorted(((bytes(r.idx), bytes(r.val), r.y) for r in rows.collect()))
    return fit([(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32), y) for i, x, y in got]) if got else FactorisationMachine(0.0, np.zeros(SIZE, np.float32), np.zeros((SIZE, RANK), np.float32))


def score(docs: DataFrame, model: FactorisationMachine, *, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """(id, score) of every row: the probability of label 1.

    Null and empty texts have no words and are scored by their structure.
    Rows repeat as they repeat in the input; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in slices(batches, 256):
            out = np.zeros(batch.num_rows)
            texts, stated = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for at in range(0, len(texts), 256):
                part = [features(t, s) for t, s in zip(texts[at : at + 256], stated[at : at + 256], strict=True)]
                lens = np.array([len(i) for i, _ in part])
                z = m.logits(np.concatenate([i for i, _ in part]), np.concatenate([x for _, x in part]), np.cumsum(lens) - lens)
                out[at : at + 256] = 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(size_col).cast("long").alias("stated"))
    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
