"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one codeword from each of several full-dimensional
codebooks; codebooks are trained on residuals and vectors are encoded by beam
search. With the norm of the sum stored beside the codes, the squared distance
to a query needs one table look-up per codebook. What the code leaves of its
vector is stored too, so the triangle inequality bounds the true distance on
both sides: only vectors whose lower bound reaches the best found are measured
exactly, and none that is truly among the nearest is missed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import materialize
from .vectors import matrix, of_size, sizes

#: Vectors of a packed row, bytes of the vectors of a slice, queries of a block, and of these so many at once.
PACK = 2_048
SLICE = 1 << 25
QUERIES = 1_024
AT_ONCE = 128
#: What a packed row holds: ids, codes, norms of the sums, norms of what the codes leave, and the vectors.
PACKED = ("ids", "codes", "norms", "rests", "vectors")


@dataclass(frozen=True)
class Codebooks:
    """words: codebook, codeword, component."""

    words: np.ndarray

    @cached_property
    def products(self) -> np.ndarray:
        """Inner products of all codewords: computed where vectors are encoded, never sent."""
        w = self.words.astype(np.float32)
        return np.einsum("akd,bld->akbl", w, w, optimize=True)

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.words.shape

    def encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes (vector, codebook) and the squared norms of the sums they stand for."""
        m, k, _ = self.shape
        n = len(x)
        dots = np.einsum("nd,mkd->mnk", x, self.words, optimize=True)
        norms = np.einsum("mkd,mkd->mk", self.words, self.words)
        codes = np.zeros((n, 1, 0), np.int64)
        errors = np.zeros((n, 1))
        for j in range(m):
            # |x - s - c|^2 = |x - s|^2 + |c|^2 - 2 x.c + 2 s.c, and s.c is a sum of products
            cross = np.zeros((n, codes.shape[1], k))
            for i in range(j):
                cross += self.products[i, :, j][codes[:, :, i]]
            total = errors[:, :, None] + norms[j] - 2 * dots[j][:, None, :] + 2 * cross
            flat = total.reshape(n, -1)
            keep = min(beam if j + 1 < m else 1, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            errors = np.take_along_axis(flat, best, axis=1)
            codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], axis=1), (best % k)[:, :, None]], axis=2)
        codes = codes[:, 0, :]
        whole = sum(self.words[j][codes[:, j]] for j in range(m))
        return codes.astype(np.uint8 if k <= 256 else np.uint16), (whole * whole).sum(axis=1)


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """k-means: centres and assignment; an empty centre moves to a random row."""
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds + 1):
        near = ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        starts = np.cumsum(count) - count
        full = count > 0
        centres[full] = np.add.reduceat(x[order], starts[full]) / count[full, None]
        centres[~full] = x[rng.integers(0, len(x), int((~full).sum()))]
    return centres, near


def train(x: np.ndarray, *, books: int = 24, words: int = 256, rounds: int = 6, seed: int = 11) -> Codebooks:
    """Codebooks on the residuals that the earlier ones leave."""
    rng = np.random.default_rng(seed)
    rest, found = x.copy(), []
    for _ in range(books):
        centres, near = _means(rest, min(words, len(x)), rounds, rng)
        found.append(centres)
        rest = rest - centres[near]
    return Codebooks(np.stack(found))


class Nearest:
    """The ``top`` nearest vectors of each of some queries, fed with packs of codes and vectors."""

    def __init__(self, own: np.ndarray, q: np.ndarray, books: Codebooks, centre: np.ndarray, top: int):
        self.own, self.q, self.top, self.centre = own, q, top, centre
        self.near = q - centre
        self.square = (self.near * self.near).sum(axis=1)
        table = 2 * np.einsum("qd,mkd->mkq", self.near, books.words, optimize=True)
        m, self.k, _ = books.shape
        self.table = np.ascontiguousarray(table.reshape(m * self.k, len(q)).astype(np.float32))
        #: What rounding can add to an estimate, for norms up to 0 (they add their own part).
        self.unit = 2.0**-22 * (m + 8)
        self.size = np.abs(table).max(axis=1).sum(axis=0) + self.square
        self.found = np.zeros((0,), [("q", np.int64), ("score", np.float64), ("id", np.int64)])
        self.limit = np.full(len(q), np.inf)

    def _lower(self, thr: np.ndarray) -> None:
        """The bound on what can still be among the nearest never grows; an unknown one bounds nothing."""
        self.limit = np.fmin(self.limit, np.where(np.isnan(thr), np.inf, thr))

    def feed(self, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, rests: np.ndarray, vectors: np.ndarray) -> None:
        score = np.repeat(norms.astype(np.float32)[:, None], len(self.q), axis=1)
        for j in range(codes.shape[1]):
            score -= self.table[codes[:, j].astype(np.int64) + j * self.k]
        other = ids[:, None] != self.own[None, :]
        slack = self.unit * (self.size + norms.max())
        # squared distances of the sums of codewords, above and below; a vector is no further from its sum than its rest
        if np.isinf(self.limit).any() and len(ids) >= self.top:
            above = np.sqrt(np.maximum(score + (self.square + slack), 0)) + rests[:, None]
            above[~other] = np.inf
            self._lower(np.partition(above, self.top - 1, axis=0)[self.top - 1] * (1 + 1e-12))
        keep = ~(score > (self.limit + rests[:, None]) ** 2 - self.square + slack) & other
        at = np.flatnonzero(keep.any(axis=1))
        if len(at):
            self._measure(ids[at], vectors[at].astype(np.float64), keep[at])

    def _measure(self, ids: np.ndarray, x: np.ndarray, keep: np.ndarray) -> None:
        """Exact distances of what passed: a block product with a margin for its rounding, then the sum of squares, one component after the other."""
        xc = x - self.centre
        norms = (xc * xc).sum(axis=1)
        block = norms[:, None] + self.square - 2 * (xc @ self.near.T)
        margin = 2.0**-50 * (x.shape[1] + 8) * (norms[:, None] + self.square + (self.centre * self.centre).sum())
        if len(ids) >= self.top and keep.sum() > 4 * self.top * len(self.q):
            above = np.where(keep, block + margin, np.inf)
            self._lower(np.sqrt(np.maximum(np.partition(above, self.top - 1, axis=0)[self.top - 1], 0)) * (1 + 1e-12))
        v, q = np.nonzero(keep & ~(block - margin > (self.limit * (1 + 1e-12)) ** 2))
        total = np.zeros(len(v))
        for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(self.q.T), strict=True):
            d = a[v] - b[q]
            total += d * d
        got = np.zeros(len(v), self.found.dtype)
        got["q"], got["score"], got["id"] = q, np.sqrt(total), ids[v]
        both = np.concatenate([self.found, got])
        both = both[np.lexsort((both["id"], both["score"], both["q"]))]
        count = np.bincount(both["q"], minlength=len(self.q))
        rank = np.arange(len(both)) - (np.cumsum(count) - count)[both["q"]]
        self.found = both[rank < self.top]
        last = both[rank == self.top - 1]
        thr = np.full(len(self.q), np.inf)
        thr[last["q"]] = last["score"]
        self._lower(thr)


def search(rows: DataFrame, is_query: str, *, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 10, short: int | None = None, beam: int = 6, sample_rows: int = 16_384) -> DataFrame:
    """(query_id, rank, id, score): the nearest rows of every row for which ``is_query`` holds.

    Codebooks are fitted on at most ``sample_rows`` vectors, those with the
    lowest hash of their id; every vector is indexed. The codes of every vector
    bound its distance to every query; those that may be among the ``top``
    nearest are measured by the exact Euclidean distance in double precision,
    ties to the smaller id, so the result is exact on any vectors (``short``,
    once the length of a list of estimates, has no effect). A row is no
    candidate of its own query. Null, zero and non-finite vectors take no part,
    vectors of different sizes never meet, and rows that repeat an id count
    once. Other columns are not read.
    """
    every = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.expr(is_query).alias("asks")).filter("id is not null")
    found = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim in sizes(every, "vec"):
        found = found.unionByName(_search_size(of_size(every, "vec", dim), dim, top, beam, sample_rows))
    return found.withColumnRenamed("vec_id", id_col)


def _search_size(every: DataFrame, dim: int, top: int, beam: int, sample_rows: int) -> DataFrame:
    """(query_id, rank, vec_id, score) among vectors (id, vec, asks) of one size."""
    spark = every.sparkSession
    kind = np.float32 if every.schema["vec"].dataType.elementType == T.FloatType() else np.float64
    cores = spark.sparkContext.defaultParallelism
    # one row of each id, for queries and candidates alike
    every = materialize(every.repartition(max(cores, every.rdd.getNumPartitions()), "id").dropDuplicates(["id"]), "ann-rows")
    sample = every.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vec").toArrow().column(0).combine_chunks()
    sample = matrix(sample, dim)
    centre = sample.mean(axis=0)
    held = spark.sparkContext.broadcast((train(sample - centre), centre))

    def index(batches):
        books, centre = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                ids, x = np.asarray(part.column(0), np.int64), matrix(part.column(1), dim)
                done = [books.encode(x[i : i + 256] - centre, beam) for i in range(0, len(ids), 256)]
                codes = np.concatenate([c for c, _ in done])
                norms = np.concatenate([v for _, v in done])
                rest = x - centre - sum(books.words[j][codes[:, j]] for j in range(codes.shape[1]))
                # a margin for the rounding of the rest itself
                rests = np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9) + 1e-14 * np.sqrt((x * x).sum(axis=1) + (centre * centre).sum())
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[0])], pa.int64())] + [pa.array([x.tobytes()], pa.binary()) for x in (ids, codes, norms, rests, x.astype(kind))], names=["first", *PACKED])

    packed = materialize(every.select("id", "vec").mapInArrow(index, "first long, " + ", ".join(f"{c} binary" for c in PACKED)), "ann-index")
    queries = every.filter(F.coalesce("asks", F.lit(False))).select("id", "vec")
    n, n_queries = every.count(), queries.count()
    blocks = max(1, -(-n_queries // QUERIES))
    slices = max(1, -(-n * dim * kind().itemsize // SLICE), min(-(-n // PACK), -(-cores // blocks)))
    spread = lambda to: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(to - 1).cast("long")))
    asked = queries.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), spread(slices).alias("slice"))
    dealt = packed.select(*PACKED, spread(blocks).alias("block"), F.pmod(F.xxhash64("first"), F.lit(slices)).alias("slice"))

    def nearest(key, ask, has):
        books, centre = held.value
        own, q = np.asarray(ask.column("id").combine_chunks(), np.int64), matrix(ask.column("vec").combine_chunks(), dim)
        some = [Nearest(own[i : i + AT_ONCE], q[i : i + AT_ONCE], books, centre, top) for i in range(0, len(own), AT_ONCE)]
        for i in range(has.num_rows if some else 0):
            ids, codes, norms, rests, vectors = (has.column(c)[i].as_buffer() for c in PACKED)
            ids = np.frombuffer(ids, np.int64)
            pack = np.frombuffer(codes, np.uint8 if books.shape[1] <= 256 else np.uint16).reshape(len(ids), -1), np.frombuffer(norms), np.frombuffer(rests), np.frombuffer(vectors, kind).reshape(len(ids), dim)
            for part in some:
                with np.errstate(over="ignore", invalid="ignore"):  # what overflows is never ruled out
                    part.feed(ids, *pack)
        out = [(p.own[p.found["q"]], p.found["id"], p.found["score"]) for p in some]
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    scored = asked.groupBy("block", "slice").cogroup(dealt.groupBy("block", "slice")).applyInArrow(nearest, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
