"""Figures of the desk and the crawler over tables in their own shape: handoffs, operators, failures, contacts, storage, changes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)


def score_bucket(json: Column, path: str) -> Column:
    """high from 0.7, medium from 0.4, low below, none without a number at the path."""
    score = F.get_json_object(json, path).try_cast("double")
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").when(score.isNotNull(), "low").otherwise("none")


def handoff_metrics(handoffs: DataFrame) -> DataFrame:
    """One row: counts by status, rates in percent, mean waiting and resolution in minutes (0 without any)."""
    n, count = F.count("*"), lambda s: F.count_if(F.col("status") == s)
    minutes = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)) / 60, 2)
    return handoffs.agg(
        n.alias("total"), count("pending").alias("pending"), count("resolved").alias("resolved"), count("timeout").alias("timed_out"), _share(count("resolved"), n).alias("resolution_rate"),
        _share(count("timeout"), n).alias("timeout_rate"), minutes("wait_seconds").alias("wait_minutes"), minutes("resolution_seconds").alias("resolution_minutes"),
    )


def utilisation(current: Column, most: Column) -> Column:
    """Percent of an operator's conversations in use; 0 for one who takes none."""
    return F.when(most > 0, current / most * 100).otherwise(0.0)


def routing_stats(handoffs: DataFrame, operators: DataFrame, minutes: int = 5) -> DataFrame:
    """One row: handoffs, those assigned within ``minutes``, their rate, mean waiting, and mean utilisation of operators that take any."""
    quick = F.col("operator_id").isNotNull() & (F.col("assigned_at") <= F.col("requested_at") + F.make_dt_interval(mins=F.lit(minutes)))
    ours = handoffs.agg(F.count("*").alias("total"), F.count_if(quick).alias("auto"), F.round(F.coalesce(F.avg("wait_seconds"), F.lit(0.0)) / 60, 2).alias("wait_minutes"))
    theirs = operators.filter("most > 0").agg(F.round(F.coalesce(F.avg(utilisation(F.col("current"), F.col("most"))), F.lit(0.0)), 2).alias("utilisation"))
    return ours.withColumn("utilisation", theirs.select("utilisation").scalar()).withColumn("auto_rate", _share(F.col("auto"), F.col("total")))


def failure_categories(failures: DataFrame, message: str, *latest: Column, n: int = 10) -> DataFrame:
    """(category, n) of the latest failures, by their message."""
    m = F.coalesce(F.col(message), F.lit(""))
    kind = F.when(F.contains(m, F.lit("MaxAttemptsExceeded")), "max_attempts").when(F.contains(m, F.lit("timeout")), "timeout").otherwise("other")
    return failures.orderBy(*latest).limit(n).groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


def merged_contacts(hits: DataFrame, key: str, kinds: Sequence[str]) -> DataFrame:
    """Distinct values of every kind of contact of a key, sorted and comma-joined, and the mean confidence."""
    joined = [F.array_join(F.sort_array(F.collect_set(F.nullif(F.trim(c), F.lit("")))), ",").alias(c) for c in kinds]
    return hits.groupBy(key).agg(*joined, F.round(F.avg(F.col("confidence").cast("double")), 4).alias("confidence"))


def storage_audit(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, by: str) -> DataFrame:
    """Documents, chunks and vectors of every ``by``, and chunks without vectors (negative: vectors without chunks)."""
    counted = lambda df, name: df.groupBy(by).agg(F.count("*").alias(name))
    every = reduce(lambda a, b: a.join(b, by, "full"), (counted(docs, "docs"), counted(chunks, "chunks"), counted(vectors, "vectors"))).fillna(0, ["docs", "chunks", "vectors"])
    return every.withColumn("missing", F.col("chunks") - F.col("vectors"))


def changes(fetched: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(url, state): new, updated or unchanged against a snapshot by address, or by title where a snapshot has no address.

    ``fetched``: url, title, hash; ``snapshot``: id, url, title, hash. The address goes before the title.
    """
    by_url = snapshot.filter("url is not null").groupBy("url").agg(F.min_by("hash", "id").alias("old"))
    by_title = snapshot.filter("url is null and title is not null").groupBy("title").agg(F.min_by("hash", "id").alias("older"))
    both = fetched.join(by_url, "url", "left").join(by_title, "title", "left").withColumn("known", F.coalesce("old", "older"))
    return both.select("url", F.when(F.col("known").isNull(), "new").when(F.col("known") == F.col("hash"), "unchanged").otherwise("updated").alias("state"))


def admitted(url: Column, *, hosts: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """https only; the host holds one of ``hosts``, the address matches one of ``include`` and none of ``exclude``; empty lists ask for nothing."""
    host = F.try_parse_url(url, F.lit("HOST"))
    ok = (F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https") & host.isNotNull()
    if hosts:
        ok = ok & reduce(lambda a, b: a | b, (F.contains(host, F.lit(h)) for h in hosts))
    if include:
        ok = ok & reduce(lambda a, b: a | b, (url.rlike(p) for p in include))
    for p in exclude:
        ok = ok & ~url.rlike(p)
    return F.coalesce(ok, F.lit(False))


def links_of(text: Column) -> Column:
    """Distinct addresses of a text: those of Markdown links, then bare ones that did not come before."""
    marked = F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\((https?://[^)\s]+)\)"), F.lit(1))
    bare = F.regexp_extract_all(F.regexp_replace(text, r"\[[^\]]*\]\((https?://[^)\s]+)\)", " "), F.lit(r"https?://[^\s)\]<>\"']+"), F.lit(0))
    return F.array_distinct(F.concat(marked, bare))


def blended(a: str, b: str, first: float = 0.6, second: float = 0.4) -> Column:
    """The weighted sum of two vectors of one size; null if sizes differ."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: first * x.cast("double") + second * y.cast("double")))
