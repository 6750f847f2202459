"""Toxicity by maximum-scoring segments.

Every token scores its log-odds between toxic and other labelled documents,
less a toll. Counts are smoothed by Dirichlet priors in a chain: a word's prior
is the share of its first seven letters, theirs that of the first four, theirs
the share of toxic contexts at large; so rare words lean on what begins alike.
One linear scan per document finds all maximal scoring segments. Extreme-value
statistics of random texts (lambda and K) turn segment scores into expected
counts; segments below a threshold are the toxic passages, and a document's
score is a calibrated logistic of their evidence.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import crc_mod, slices

WORD = regex.compile(r"\w+")
#: Lengths of the word beginnings in the chain of priors, and the strength of each prior in contexts.
STEMS = (4, 7)
STRENGTH = 10.0
#: What each token pays, so that random texts drift down.
TOLL = 1.5
#: Evidence beyond this adds nothing to a score.
MOST = 50.0


@dataclass(frozen=True)
class TokenOdds:
    """Log-odds of words seen in training, and of word beginnings for all others; 0 without either."""

    words: dict[str, float]
    stems: tuple[dict[str, float], ...]

    def of(self, word: str) -> float:
        found = self.words.get(word)
        if found is not None:
            return found
        for length, table in zip(reversed(STEMS), reversed(self.stems), strict=True):
            if len(word) > length and (found := table.get(word[:length])) is not None:
                return found
        return 0.0

    def scores(self, toks: list[str]) -> np.ndarray:
        return np.fromiter(map(self.of, toks), float, len(toks)) - TOLL


@dataclass(frozen=True)
class ToxicityModel:
    odds: TokenOdds
    lam: float
    log_k: float
    bias: float
    slope: float
    max_expect: float


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), left to right, in linear time.

    Runs of tokens that do not score above zero only lower the running total,
    so the scan goes from one positive token to the next.
    """
    total = np.cumsum(scores)
    found: list[list[float]] = []  # start, end, total before, total at its end
    for i in np.flatnonzero(scores > 0).tolist():
        before, after = (total[i - 1] if i else 0.0), total[i]
        cur = [i, i + 1, before, after]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= cur[2]:
                j = int(found[j][4])
            if j < 0 or found[j][3] >= cur[3]:
                found.append([*cur, j])
                break
            cur = [found[j][0], cur[1], found[j][2], cur[3]]
            del found[j:]
    return [(int(s), int(e), float(t - b)) for s, e, b, t, _ in found]


def tokens(text: str | None) -> list[str]:
    """Runs of word characters, in lower case."""
    return WORD.findall(text.lower()) if text else []


def log_odds(counts: dict[str, tuple[int, int]], strength: float = STRENGTH) -> TokenOdds:
    """Log-odds of all words from their contexts in toxic and in other documents.

    A count pair (a, b) with prior share r stands for the share
    (a + strength r) / (a + b + strength); the log-odds are those of this share
    against the share of all toxic contexts.
    """
    n1, n0 = sum(a for a, _ in counts.values()), sum(b for _, b in counts.values())
    if not n1 or not n0:
        return TokenOdds({}, tuple({} for _ in STEMS))
    base = n1 / (n1 + n0)
    chain: list[dict[str, float]] = []

    def prior(word: str, upto: int) -> float:
        for k in range(upto - 1, -1, -1):
            if len(word) > STEMS[k]:
                return chain[k].get(word[: STEMS[k]], base)
        return base

    for k, length in enumerate(STEMS):
        sums: dict[str, list[int]] = {}
        for word, (a, b) in counts.items():
            if len(word) > length:
                pair = sums.setdefault(word[:length], [0, 0])
                pair[0] += a
                pair[1] += b
        chain.append({s: (a + strength * prior(s, k)) / (a + b + strength) for s, (a, b) in sums.items()})
    zero = math.log(base / (1 - base))
    logit = lambda p: math.log(p / (1 - p)) - zero
    words = {w: logit((a + strength * prior(w, len(STEMS))) / (a + b + strength)) for w, (a, b) in counts.items()}
    return TokenOdds(words, tuple({s: logit(p) for s, p in table.items()} for table in chain))


def extreme_values(heights: np.ndarray, tokens_seen: int) -> tuple[float, float]:
    """Lambda and ln K of texts without passages: n tokens have K n e^(-lambda x) segments above x.

    Heights of maximal segments are exponential in random texts, so lambda is
    one over their mean and K their number per token.
    """
    if not len(heights) or not tokens_seen:
        return 1.0, -math.log(max(tokens_seen, 1))
    return 1 / max(float(heights.mean()), 1e-9), math.log(len(heights) / tokens_seen)


def _significant(found: list[tuple[int, int, float]], n: int, lam: float, log_k: float, max_expect: float) -> tuple[float, list[tuple[int, int, float]]]:
    """Sum of -ln(expected count / max_expect) over significant segments, and those with the logarithm of that count."""
    log_n, most = log_k + math.log(max(n, 1)), math.log(max_expect)
    kept = [(s, e, log_n - lam * x) for s, e, x in found if log_n - lam * x <= most]
    return sum(most - x for *_, x in kept), kept


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope by Newton steps, with a small ridge on the slope."""
    bias, slope = math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), 0.5
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(bias + slope * x, -30, 30)))
        g = np.array([(p - y).sum(), ((p - y) * x).sum() + 0.1 * slope])
        q = p * (1 - p) + 1e-9
        d = np.linalg.solve(np.array([[q.sum(), (q * x).sum()], [(q * x).sum(), (q * x * x).sum() + 0.1]]), g)
        bias, slope = bias - float(np.clip(d[0], -2, 2)), slope - float(np.clip(d[1], -2, 2))
        if abs(d).max() < 1e-9:
            break
    return bias, max(slope, 0.0)


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 12_000, max_expect: float = 0.01) -> ToxicityModel:
    """Fit on labelled rows whose crc32(id as text) mod 5 is not 0.

    Bound: at most ``sample_rows`` labelled ids, those with the lowest hash;
    all words of their whole texts count. A word counts once for each pair of
    neighbours that it has, so that copies of one text count as one. Lambda, K
    and the logistic come from halves: either half is scored with the words of
    the other. Null labels are left out; an id with several labels counts with
    its largest. Without labelled rows of both kinds every document scores the
    same.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, 5) != 0))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows).withColumn("half", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("y", "half", "text")

    def once(batches):
        for batch in slices(batches, 64):
            words, ys, halves = [], [], []
            for y, half, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                toks = tokens(text)
                own = set(zip(toks, ["", *toks], [*toks[1:], ""], strict=False))
                words += own
                ys += [y] * len(own)
                halves += [half] * len(own)
            word, before, after = zip(*words, strict=True) if words else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (word, before, after)] + [pa.array(ys, pa.int32()), pa.array(halves, pa.int64())], names=["word", "before", "after", "y", "half"])

    contexts = sample.mapInArrow(once, "word string, before string, after string, y int, half long")
    contexts = contexts.select("half", "y", "word", F.xxhash64("before", "word", "after").alias("context")).distinct()
    table = contexts.groupBy("word", "half").agg(F.sum(F.col("y").cast("long")).alias("a"), F.count("*").alias("n")).toArrow()
    halves: tuple[dict, dict] = {}, {}
    every: dict[str, tuple[int, int]] = {}
    for word, half, a, n in zip(*(table.column(k).to_pylist() for k in range(4)), strict=True):
        halves[half][word] = a, n - a
        was = every.get(word, (0, 0))
        every[word] = was[0] + a, was[1] + n - a
    odds = log_odds(every)
    held = [spark.sparkContext.broadcast(log_odds(counts)) for counts in reversed(halves)]

    def heights(batches):
        for batch in slices(batches, 64):
            ys, halves = (batch.column(k).to_pylist() for k in range(2))
            toks = [tokens(t) for t in batch.column(2).to_pylist()]
            best = [[x for *_, x in segments(held[half].value.scores(t))] for half, t in zip(halves, toks, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(list(map(len, toks)), pa.int64()), pa.array(best, pa.list_(pa.float64()))], names=["y", "n", "best"])

    seen = sample.mapInArrow(heights, "y int, n long, best array<double>").collect()
    clean = [r for r in seen if r.y == 0]
    n0 = sum(r.n for r in clean)
    if not odds.words or not n0:
        share = sum(r.y for r in seen) / len(seen) if seen else 0.5
        return ToxicityModel(odds, 1.0, 0.0, math.log(max(share, 1e-3) / max(1 - share, 1e-3)), 0.0, max_expect)
    lam, log_k = extreme_values(np.array([x for r in clean for x in r.best]), n0)
    x = np.array([min(_significant([(0, 0, s) for s in r.best], r.n, lam, log_k, max_expect)[0], MOST) for r in seen])
    bias, slope = _logistic(x, np.array([r.y for r in seen], float))
    return ToxicityModel(odds, lam, log_k, bias, slope, max_expect)


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passages) of every row.

    ``passages``: the significant segments as (start, end) in tokens with the
    natural logarithm of their expected count in a random text of that length.
    Null and empty texts have none and get the score of a text without
    evidence. Rows repeat as they repeat in the input; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("log_expect", pa.float64())]))
        for batch in slices(batches, 256):
            out, spans = [], []
            for text in batch.column(1).to_pylist():
                toks = tokens(text)
                x, kept = _significant(segments(m.odds.scores(toks)), len(toks), m.lam, m.log_k, m.max_expect)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, m.bias + m.slope * min(x, MOST))))))
                spans.append([{"start": s, "end": e, "log_expect": v} for s, e, v in kept])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array(spans, kind)], names=["id", "score", "passages"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = f"id {rows.schema[0].dataType.simpleString()}, score double, passages array<struct<start:bigint,end:bigint,log_expect:double>>"
    return rows.mapInArrow(run, kind).withColumnRenamed("id", id_col)
