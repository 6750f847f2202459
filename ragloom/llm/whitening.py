"""Whitening of vectors: an exactly centred Gram matrix, local eigenvectors, a broadcast projection.

Entries become integers, so sums and centred entries are exact before anything
is multiplied. ``RowMatrix.computeGramianMatrix`` adds the outer products on
the executors; its d x d result is decomposed on the driver, and the projection
(d x 32 numbers at most) goes back to the rows as a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import drop, materialize

#: Entries are counted in steps of 1 / SCALE, from OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Finite entries beyond this have no exact place among 64-bit integers and count as non-finite.
LARGEST = 2.0**34


def entries(col: str) -> Column:
    """The vector in whole steps; null if it is null or holds null or non-finite entries."""
    fits = F.forall(col, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= F.lit(LARGEST)), F.lit(False)))
    return F.when(fits, F.transform(col, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET))


def _sums(rows: DataFrame, col: str, dim: int) -> tuple[int, np.ndarray]:
    """How many rows, and the exact sum of each entry: partial sums for each batch, then one row for each entry."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            total = np.stack(frame[col].to_numpy()).sum(axis=0) if len(frame) else np.zeros(dim, np.int64)
            yield pd.DataFrame({"at": np.arange(dim), "n": len(frame), "total": total})

    got = rows.select(col).mapInPandas(run, "at int, n long, total long").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total = np.zeros(dim, object)
    for r in got:
        total[r["at"]] = int(r.total)
    return (int(got[0].n) if got else 0), total


def gram(centred: DataFrame, col: str) -> np.ndarray:
    """Sum of outer products of a double array column, by MLlib."""
    vectors = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector(col).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def _centred(col: str, n: int, total: np.ndarray) -> Column:
    """n * x - S, exact, over n."""
    s = F.array(*[F.lit(int(t)) for t in total])
    return F.zip_with(col, s, lambda x, t: (F.lit(n) * x - t).cast("double") / n)


def axes(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns.

    The sign is fixed by the largest entry, the first of equals. Eigenvalues
    that are zero to the precision of the matrix have no component.
    """
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    floor = max(values[0], 0.0) * len(values) * np.finfo(np.float64).eps * 16 if len(values) else 0.0
    keep = np.flatnonzero(values > floor)[:most]
    values, vectors = values[keep], vectors[:, keep]
    big = np.argmax(np.abs(vectors), axis=0)
    return values, vectors * np.where(vectors[big, np.arange(len(keep))] < 0, -1.0, 1.0)


def _whiten(rows: DataFrame, n: int, total: np.ndarray, projection: np.ndarray, id_col: str) -> DataFrame:
    """Each row's deviation and whitened components."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((total, projection))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, matrix = sent.value
        offset = sums.astype(np.int64)
        for frame in frames:
            if not len(frame):
                continue
            off = n * np.stack(frame["x"].to_numpy()) - offset
            squares = (off.astype(np.float64) ** 2).sum(axis=1)
            deviation = pd.array((off * off).sum(axis=1), dtype="Int64")
            deviation[squares > 9.2e18] = pd.NA  # no long holds it
            yield pd.DataFrame({id_col: frame[id_col].array, "deviation": deviation, "w": list(off.astype(np.float64) / n @ matrix)})

    return rows.mapInPandas(run, f"{id_col} long, deviation long, w array<double>")


def _largest_error(white: DataFrame, n: int, k: int) -> float:
    """The largest entry of the whitened rows' covariance minus the identity; they are centred again first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"at": np.arange(k), "total": np.stack(frame["w"].to_numpy()).sum(axis=0)})

    mean = np.zeros(k)
    for r in white.select("w").mapInPandas(run, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect():
        mean[r["at"]] = r.total / n
    m = F.array(*[F.lit(float(x)) for x in mean])
    covariance = gram(white.select(F.zip_with("w", m, lambda x, y: x - y).alias("w")), "w") / n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component: (id, component, n, deviation, whitened, explained, identity_error).

    Vectors that are null or hold null or non-finite entries (or finite ones
    beyond 2^34 in size) take no part; repeated rows count as often as they
    stand; a null id stays null. Vectors of different sizes are whitened apart,
    each size by its own rows. There are as many components as the covariance
    has positive eigenvalues, ``components`` at most: none for one row, for
    equal rows or for empty vectors. ``deviation`` is null where no long holds
    it. Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias(id_col), entries(vector_col).alias("x")).filter("x is not null and size(x) > 0")
    rows = materialize(rows.withColumn("dim", F.size("x")), "whiten-entries")
    out = None
    for dim in sorted(r.dim for r in rows.select("dim").distinct().collect()):
        part = _of_size(spark, rows.filter(F.col("dim") == dim).select(id_col, "x"), dim, id_col, components)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    drop(rows)
    if out is None:
        return spark.createDataFrame([], f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out


def _of_size(spark: SparkSession, rows: DataFrame, dim: int, id_col: str, components: int) -> DataFrame | None:
    n, total = _sums(rows, "x", dim)
    covariance = gram(rows.select(_centred("x", n, total).alias("c")), "c") / n
    values, vectors = axes(covariance, components)
    if not len(values):
        return None
    white = materialize(_whiten(rows, n, total, vectors / np.sqrt(values), id_col), "whiten-rows")
    error = _largest_error(white, n, len(values))
    share = F.array(*[F.lit(float(x)) for x in values / np.trace(covariance)])
    each = white.select(id_col, "deviation", F.posexplode("w").alias("k", "whitened"))
    return each.select(
        id_col, (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(share, F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error")
    )
