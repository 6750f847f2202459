"""An append-only table of step metrics, written once whatever is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """One micro-batch in a folder of its own: written again, it replaces itself.

    Rows get a ``metric_id`` by batch and place in it.
    """
    numbered = rows.withColumn("metric_id", F.concat_ws("-", F.lit(batch_id), F.monotonically_increasing_id()))
    numbered.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def append_metrics(stream: DataFrame, path: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Write a stream of metrics to ``path``; ``checkpoint`` keeps what was read, so a restart goes on where it stopped.

    A batch that was written but not recorded as done is read again from the
    same offsets under the same number, and so adds nothing.
    """
    writer = stream.writeStream.foreachBatch(lambda rows, batch_id: write_batch(rows, batch_id, path)).option("checkpointLocation", checkpoint)
    for key, value in options.items():
        writer = writer.option(key, value)
    return writer.trigger(availableNow=True).start()


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All metrics, with ``batch`` and ``metric_id``."""
    return spark.read.parquet(path)
