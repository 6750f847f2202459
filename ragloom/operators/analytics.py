"""Event, feedback and queue analytics as single-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def percent(part: Column, whole: Column, digits: int) -> Column:
    """100 * part / whole, 0 where the whole is 0."""
    return F.round(F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0)), digits)


def daily_trend(events: DataFrame, *, message: str = "click", response: str = "view") -> DataFrame:
    """Events, sessions, messages and the mean response value of every day."""
    return events.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("events"),
        F.countDistinct("user_id").alias("sessions"),
        F.sum(F.when(F.col("event_type") == message, 1).otherwise(0)).alias("messages"),
        F.round(F.avg(F.when(F.col("event_type") == response, F.col("value"))), 6).alias("avg_response"),
    )


def usage(events: DataFrame) -> DataFrame:
    """Dashboard totals in one scan."""
    kind = F.col("event_type")
    return events.agg(
        F.count("*").alias("events"),
        F.countDistinct("user_id").alias("sessions"),
        count_where(kind == "signup").alias("opened"),
        count_where(kind == "click").alias("messages"),
        F.round(F.avg(F.when(kind == "view", F.col("value"))), 6).alias("avg_response"),
        F.round(F.sum("value"), 4).alias("total"),
        percent(count_where(kind == "error"), F.count("*"), 2).alias("error_rate"),
    )


def histogram(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def sessions(events: DataFrame) -> DataFrame:
    """Totals, seconds from first to last event, and errors of every session."""
    return events.groupBy("user_id").agg(
        F.count("*").alias("events"),
        F.countDistinct("event_type").alias("kinds"),
        count_where(F.col("event_type") == "error").alias("errors"),
        (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("micros"),
    )


def ratings(labels: DataFrame, col: str, names: dict[int, str]) -> DataFrame:
    """Counts and percentages of every rating, zero where there is none."""
    total = F.count(col)
    aggs = [total.alias("total")]
    for value, name in names.items():
        n = count_where(F.col(col) == value)
        aggs += [n.alias(name), percent(n, total, 1).alias(f"{name}_percent")]
    return labels.agg(*aggs)


def gaps(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Mean whole minutes between a row and the one before it."""
    w = Window.partitionBy(by).orderBy(*order)
    minutes = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 60_000_000)
    return rows.withColumn("gap", minutes).groupBy(by).agg(F.round(F.avg("gap"), 6).alias("avg_gap"), F.count("gap").alias("gaps"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def oldest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def priority_page(rows: DataFrame, col: str, ranks: dict[str, int], order: list[str], offset: int, limit: int) -> DataFrame:
    """A page of rows in the order of stated priorities, then first come first."""
    rank = F.coalesce(*(F.when(F.col(col) == k, v) for k, v in ranks.items()), F.lit(len(ranks) + 1))
    return rows.withColumn("rank", rank).orderBy("rank", *order).offset(offset).limit(limit)
