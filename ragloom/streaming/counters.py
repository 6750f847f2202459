"""Counters over event time; each takes a stream or a table and gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _counts(events: DataFrame, keys: list[str], span: str, late: str) -> DataFrame:
    return _timed(events, late).groupBy(F.window("ts", span).alias("w"), *keys).agg(F.count("*").alias("n"))


def daily_counts(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Events of every day and key; state goes once the watermark has passed the day."""
    return _counts(events, keys, "1 day", late).select(F.to_date("w.start").alias("day"), *keys, "n")


def over_limit(events: DataFrame, keys: list[str], most: int, late: str = "1 hour") -> DataFrame:
    """Fixed hours in which a key has more than ``most`` events."""
    return _counts(events, keys, "1 hour", late).filter(F.col("n") > most).select(F.unix_seconds("w.start").alias("hour_start"), *keys, "n")


def alerts(events: DataFrame, value: Column, threshold: float) -> DataFrame:
    """Events whose value is above the threshold; no state."""
    return events.filter(value > threshold)
