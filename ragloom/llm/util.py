"""What the operators share: shared-folder tables, held-out split, components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import slices  # noqa: F401  used by the operators

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="ragloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, and is computed
    once (an eager checkpoint would run the plan twice).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ragloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    schema = df.schema
    del df
    # shuffle files of finished steps go when the driver finds them unused
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df.written_to
        _delete(spark, path)
        _written.remove((spark, path))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """At most so many rows in an Arrow batch of what runs inside; the setting goes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def keep(df: DataFrame) -> DataFrame:
    """Keep ``df`` on the executors' disks once computed, with its lineage.

    Blocks of a lost executor are computed again. For steps that several later
    ones read; iterations cut their lineage with ``materialize`` instead.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may be gone at exit
            _delete(spark, path)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the split of labelled rows."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def out_schema(**fields: pa.DataType) -> pa.Schema:
    return pa.schema(list(fields.items()))


#: Forests of up to so many edges are finished by one task (16 MB of edges); larger ones shrink by rounds first.
ONE_TASK = 1 << 20


def _root(parent: dict[int, int], x: int) -> int:
    while (p := parent.get(x, x)) != x:
        parent[x] = parent.get(p, p)
        x = p
    return x


def _unite(parent: dict[int, int], batch: pa.RecordBatch) -> None:
    """Unite the ends of all edges; roots are the smallest members."""
    for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        x, y = _root(parent, x), _root(parent, y)
        if x != y:
            parent[max(x, y)] = min(x, y)


def _stars(parent: dict[int, int]) -> pa.RecordBatch:
    """An edge from every node to its root."""
    roots = [_root(parent, x) for x in parent]
    return pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array(roots, pa.int64())], names=["u", "v"])


def _local_forest(batches):
    """A spanning forest of the edges that one task reads, block by block."""
    for batch in batches:
        parent: dict[int, int] = {}
        _unite(parent, batch)
        yield _stars(parent)


def _whole_forest(batches):
    """Every node of all edges with the smallest node it reaches."""
    parent: dict[int, int] = {}
    for batch in batches:
        _unite(parent, batch)
    yield _stars(parent)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 40, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component) of every node of the edge table; component = smallest reachable id.

    Edges are first reduced to local forests. While more than ``one_task`` are
    left, large-star and small-star rounds run until nothing changes; minima are
    pre-aggregated before each shuffle, so a node with very many links stays one
    row per map task, and each round is written to the shared folder. What is
    small enough is finished by one task. An empty edge table gives no rows.
    """
    e = (
        edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .mapInArrow(_local_forest, "u long, v long")
    )
    e = materialize(e.distinct(), "cc")
    before, left = None, e.count()
    for _ in range(max_rounds):
        if left <= one_task:
            done = materialize(e.coalesce(1).mapInArrow(_whole_forest, "u long, v long"), "cc")
            drop(e)
            e = done
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        )
        # small star: every edge now points from the larger to the smaller end
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")
        )
        new = materialize(small.select("x.*").filter("u <> v").distinct(), "cc")
        drop(e)
        e = new
        left, now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (left, now) == before:
            break
        before = left, now
    else:
        raise RuntimeError("connected components did not settle")
    nodes = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(roots).groupBy("id").agg(F.min("component").alias("component"))


class Bloom:
    """A set of 64-bit hashes in a bit map of a stated size: no false negatives.

    Its size is bounded whatever goes in. A fuller map lets more through, which
    costs time and never changes a result: what passes is compared exactly.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, hashes: DataFrame, words: int = 1 << 19) -> Bloom:
        """Of the only column of ``hashes`` (long), in ``words`` 64-bit words; bits are united before they are collected."""
        h = F.col(hashes.columns[0])
        at = hashes.select(F.explode(F.array(h, _turned(h))).alias("h"))
        at = at.select(F.pmod("h", F.lit(words)).alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 58) as int))").alias("bit"))
        got = at.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        bits = np.zeros(words, np.int64)
        bits[np.asarray(got.column("word").combine_chunks(), np.int64)] = np.asarray(got.column("bits").combine_chunks(), np.int64)
        return cls(bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        x = h.view(np.uint64)
        found = np.ones(len(h), bool)
        for y in (x, (x << np.uint64(32)) | (x >> np.uint64(32))):
            word = (y.view(np.int64) % len(self.bits)).astype(np.int64)
            found &= (self.bits[word].view(np.uint64) >> (y >> np.uint64(58))) & np.uint64(1) == 1
        return found


def _turned(h: Column) -> Column:
    """The halves of a 64-bit hash the other way round."""
    return F.shiftleft(h, 32).bitwiseOR(F.shiftrightunsigned(h, 32))
