"""Session factory and table loader shared by queries, tests and the bench."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_spark(app: str = "ragloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that every job here assumes.

    An existing session is returned as it is, so a cluster's own settings win.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir`` (a local or a remote path)."""
    if table not in TABLES:
        raise ValueError(f"unknown table {table!r}")
    return spark.read.parquet(f"{sf_dir.rstrip(os.sep)}/{table}.parquet")


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` over all cores by a hash of ``key`` (without one, in turn), if they come in fewer partitions (as a file of one row group does); as they are otherwise."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *key) if rows.rdd.getNumPartitions() < cores else rows


def slices(batches, rows: int = 128):
    """The same rows in small batches, so that a worker holds few texts and results at once.

    Workers outlive their tasks; what Arrow and the C library no longer need
    goes back at the end.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder of ``spark.checkpoint.dir``; to a temporary one only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="ragloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
