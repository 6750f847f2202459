"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors of a label lexicographically by the concatenated
signs of random projections and compares every vector with a bounded window of
neighbours; verified pairs of all passes are united into components. Bounded
windows cannot see all partners of a vector in a dense group, so the links are
then counted exactly within each component, block against block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import connected_components, keep
from .vectors import matrix, of_size, sizes, usable

#: Rows of a sorted bucket that the splitters aim at; rows of a block of exact counts.
BUCKET = 16_384
BLOCK = 1_024
BITS = 62


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _keys(x: np.ndarray, passes: int, seed: int) -> np.ndarray:
    """One integer a pass and row: the signs of BITS projections, first the most significant."""
    planes = np.random.default_rng(seed).normal(size=(passes, BITS, x.shape[1]))
    bits = np.einsum("nd,pbd->pnb", x, planes, optimize=True) > 0
    return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs that connect what all pairs (a, b) connect."""
    parent: dict[int, int] = {}
    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = x, y
        while rx != (p := parent.get(rx, rx)):
            parent[rx] = rx = parent.get(p, p)
        while ry != (p := parent.get(ry, ry)):
            parent[ry] = ry = parent.get(p, p)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            left.append(x)
            right.append(y)
    return left, right


def _window_pairs(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, window: int, least: float, cut: int | None = None) -> tuple[list[int], list[int]]:
    """A forest of the verified pairs within the window; across ``cut`` only, if given."""
    a, b = [], []
    for off in range(1, min(window, len(ids) - 1) + 1):
        near = (np.einsum("nd,nd->n", x[:-off], x[off:]) >= least) & (labels[:-off] == labels[off:])
        at = np.flatnonzero(near)
        if cut is not None:
            at = at[(at < cut) & (at + off >= cut)]
        a.append(ids[at])
        b.append(ids[at + off])
    return _forest(np.concatenate(a), np.concatenate(b)) if a else ([], [])


_STEP = "a long, b long, edge long, side int, place int, id long, label long, vec binary"


def _step(edges=((), ()), kept=()) -> pa.RecordBatch:
    n, m = len(edges[0]), len(kept)
    cols = list(zip(*kept, strict=True)) if kept else [()] * 6
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    arrays = [pa.array([*e, *[None] * m], pa.int64()) for e in edges]
    arrays += [pa.array([*[None] * n, *c], t) for c, t in zip(cols, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _STEP.split(", ")])


def link(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98, passes: int | None = None, window: int = 24, sample_rows: int = 16_384, seed: int = 5) -> DataFrame:
    """(id, n_links, component) of every row.

    Rows link when their labels are equal and not null and their cosine in
    double precision is at least ``least``; a row that is null, zero or not
    finite links with nothing, and vectors of different sizes don't link. Equal vectors of
    a label are one class in all comparisons and link with each other.
    ``n_links`` counts other rows, ``component`` is the smallest id reachable;
    an unlinked row has 0 and its own id. A link is missed only if in no pass
    its two ends, or a chain of links between them, stand within the window.
    There are 8 passes, and 2 more for each doubling of the largest label's rows
    beyond 20,000, unless ``passes`` says otherwise.
    """
    every = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).cast("long").alias("label"))
    able = every.filter("label is not null and id is not null")
    alone = every.filter(~F.coalesce(F.col("label").isNotNull() & F.col("id").isNotNull() & usable("vec"), F.lit(False)))
    out = alone.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    for dim in sizes(able, "vec"):
        out = out.unionByName(_link_size(of_size(able, "vec", dim), dim, least, passes, window, sample_rows, seed).withColumnRenamed("id", id_col))
    return out


def _link_size(valid: DataFrame, dim: int, least: float, passes: int | None, window: int, sample_rows: int, seed: int) -> DataFrame:
    """(id, n_links, component) of vectors (id, vec, label) of one size."""
    spark = valid.sparkSession
    classes = keep(valid.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    n, most = classes.groupBy("label").count().agg(F.sum("count"), F.max("count")).first()
    if passes is None:
        passes = 8 + 2 * max(0, math.ceil(math.log2(most / 20_000)))
    buckets = max(1, n // BUCKET)

    # splitters of every pass, from a bounded sample of (label, key)
    sample = classes.orderBy(F.xxhash64("rep")).limit(sample_rows).select("label", "vec").toArrow().combine_chunks()
    keys = _keys(_unit(matrix(sample.column(1).combine_chunks() if sample.num_rows else sample.column(1), dim)), passes, seed)
    labels = np.asarray(sample.column(0), np.int64)
    splits = []
    for p in range(passes):
        order = np.lexsort((keys[p], labels))
        at = order[[len(order) * i // buckets for i in range(1, buckets)]] if buckets > 1 else order[:0]
        splits.append(list(zip(labels[at].tolist(), keys[p][at].tolist(), strict=True)))
    held = spark.sparkContext.broadcast(splits)

    def project(batches):
        from bisect import bisect_right

        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                x = _unit(matrix(part.column(2), dim))
                label = part.column(1).to_pylist()
                vec = pa.array([v.tobytes() for v in x], pa.binary())
                for p, key in enumerate(_keys(x, passes, seed)):
                    bucket = [p * buckets + bisect_right(held.value[p], lk) for lk in zip(label, key.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), part.column(1), pa.array(key), part.column(0), vec], names=["bucket", "label", "key", "id", "vec"])

    dealt = classes.select("rep", "label", "vec").mapInArrow(project, "bucket long, label long, key long, id long, vec binary")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "label", "key", "id")

    def compare(batches):
        """Windows slide over a bucket in pieces; its first and last rows go to its neighbours."""
        bucket, ids, lab, vec, heads = None, [], [], [], 0

        def piece(last: bool):
            nonlocal ids, lab, vec
            if ids:
                x = np.frombuffer(b"".join(vec), np.float64).reshape(-1, dim)
                yield _step(_window_pairs(np.array(ids), np.array(lab), x, window, least))
            if last and bucket is not None:
                yield _step(kept=[(bucket, 0, i - len(ids), *r) for i, r in enumerate(list(zip(ids, lab, vec, strict=True))[-window:])])
            ids, lab, vec = ([], [], []) if last else (ids[-window:], lab[-window:], vec[-window:])

        for batch in batches:
            for b, label, _, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    yield from piece(True)
                    bucket, heads = b, 0
                if heads < window:
                    yield _step(kept=[(b - 1, 1, heads, i, label, v)])
                    heads += 1
                ids.append(i)
                lab.append(label)
                vec.append(v)
                if len(ids) >= 4_096:
                    yield from piece(False)
        yield from piece(True)

    steps = keep(dealt.mapInArrow(compare, _STEP))

    def across(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["side", "place"])
        cut = int((pdf["side"] == 0).sum())
        if not 0 < cut < len(pdf):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        x = np.frombuffer(b"".join(pdf["vec"]), np.float64).reshape(-1, dim)
        a, b = _window_pairs(pdf["id"].to_numpy(), pdf["label"].to_numpy(), x, window, least, cut)
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    inner = F.pmod(F.col("edge") + 1, F.lit(buckets)) != 0  # the last bucket of a pass has no next one
    between = steps.filter(F.col("edge").isNotNull() & (F.col("edge") >= 0) & inner).groupBy("edge").applyInPandas(across, "a long, b long")
    pairs = steps.filter("a is not null").select("a", "b").unionByName(between)
    comps = keep(connected_components(pairs, "a", "b"))

    # exact counts: blocks of a component against each other
    sizes = comps.groupBy("component").agg(F.count("*").alias("size"))
    members = comps.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    members = members.join(classes, comps["id"] == classes["rep"]).select("component", "block", "blocks", "id", "copies", "vec")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with")
    cells = members.select("component", "block", "id", "copies", "vec", other)
    cells = cells.select("component", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "copies", "vec")

    def count(key, table):
        _, i, j = (k.as_py() for k in key)
        block = np.asarray(table.column("block").combine_chunks(), np.int64)
        ids = np.asarray(table.column("id").combine_chunks(), np.int64)
        copies = np.asarray(table.column("copies").combine_chunks(), np.int64)
        x = _unit(matrix(table.column("vec").combine_chunks(), dim))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = x[left] @ x[right].T >= least
        if i == j:
            np.fill_diagonal(near, False)
            return pa.table({"id": ids[left], "links": near @ copies[right]})
        return pa.table({"id": np.concatenate([ids[left], ids[right]]), "links": np.concatenate([near @ copies[right], copies[left] @ near])})

    counts = cells.groupBy("component", "i", "j").applyInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    found = classes.join(comps, classes["rep"] == comps["id"], "left").join(counts.withColumnRenamed("id", "rep"), "rep", "left")
    found = found.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    return valid.join(found, ["label", "vec"]).select("id", "n_links", "component")
