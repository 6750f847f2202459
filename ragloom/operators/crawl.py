"""Pages reached from seeds, level by level, over a table of fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import resolve
from ..session import ensure_checkpoints


def links(pages: DataFrame) -> DataFrame:
    """(source, target): distinct resolved links of every page, https and http only."""
    found = pages.select(F.col("url").alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("href"))
    return found.select("source", resolve(F.col("href"), F.col("source")).alias("target")).filter("target is not null and target <> source").distinct()


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth) of every address within ``max_depth`` links of a seed, at its smallest depth.

    ``edges`` holds (source, target), ``seeds`` (url). Each level joins the
    last one's addresses with the links and drops what was seen; it is
    checkpointed (in spark.checkpoint.dir), so plans stay short and levels
    survive lost executors. Empty levels end the walk.
    """
    ensure_checkpoints(seeds.sparkSession)
    seen = level = seeds.select("url").filter("url is not null").distinct().withColumn("depth", F.lit(0)).checkpoint()
    for depth in range(1, max_depth + 1):
        found = level.join(edges, F.col("url") == F.col("source")).select(F.col("target").alias("url")).distinct()
        level = found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def to_fetch(candidates: DataFrame, known: DataFrame, now: Column, days: int | None) -> DataFrame:
    """The candidates (url, …) that are not known, or were fetched ``days`` ago or longer; null days: known ones never again.

    ``known``: (url, scraped_at); of several fetches the last counts, and a null
    time is none. Each candidate stays once for each of its rows.
    """
    last = known.filter("url is not null").groupBy("url").agg(F.max("scraped_at").alias("scraped_at"))
    fresh = last if days is None else last.filter(F.col("scraped_at") > now - F.make_dt_interval(F.lit(days)))
    return candidates.join(fresh.select("url"), "url", "left_anti")


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``rank`` (from 1) in a global order, without a task that holds them all.

    Rows are range-partitioned and sorted; each partition's count, a row each,
    tells where the next one starts.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", (before - F.col("_first") + 1).alias("_shift"))
    return placed.withColumn("_part", part).join(F.broadcast(counts), "_part").withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def ordered_links(pages: DataFrame) -> DataFrame:
    """(source, target, position): each resolved link of a page at its first place, https and http only."""
    found = pages.select(F.col("url").alias("source"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("position", "href"))
    found = found.select("source", resolve(F.col("href"), F.col("source")).alias("target"), "position").filter("target is not null and target <> source")
    return found.groupBy("source", "target").agg(F.min("position").alias("position"))


def crawl(edges: DataFrame, seeds: DataFrame, *, max_depth: int, max_pages: int, allowed: Column | None = None) -> DataFrame:
    """(url, depth, rank, expanded) of the addresses that a crawl with a budget visits, in the order of a queue.

    ``edges``: (source, target, position); ``seeds``: (url, position), both
    positions in reading order. A level's new addresses follow each other by
    the rank of the first page that links to them and the place of the link;
    as many are admitted as the budget leaves. So any partitioning gives the
    same pages as one queue. ``allowed`` is a condition on ``url``. Addresses
    at ``max_depth`` are visited, but not ``expanded`` by their links. Each
    level is checkpointed; visited addresses are kept by key.
    """
    ensure_checkpoints(seeds.sparkSession)
    fine = F.lit(True) if allowed is None else allowed
    first = seeds.filter(F.col("url").isNotNull() & fine).groupBy("url").agg(F.min("position").alias("position")).withColumn("page", F.lit(0).cast("long"))
    seen = level = ranked(first, "page", "position", "url").filter(F.col("rank") <= max_pages).select("url", F.lit(0).alias("depth"), "rank").checkpoint()
    left = max_pages - level.count()
    for depth in range(1, max_depth + 1):
        if left <= 0:
            break
        found = level.join(edges, F.col("url") == F.col("source")).select(F.col("target").alias("url"), F.struct(F.col("rank").alias("page"), "position").alias("by"))
        new = found.filter(fine).groupBy("url").agg(F.min("by").alias("by")).join(seen.select("url"), "url", "left_anti").select("url", "by.page", "by.position")
        taken = max_pages - left
        level = ranked(new, "page", "position", "url").filter(F.col("rank") <= left).select("url", F.lit(depth).alias("depth"), (F.col("rank") + taken).alias("rank")).checkpoint()
        n = level.count()
        if not n:
            break
        left -= n
        seen = seen.unionByName(level)
    return seen.withColumn("expanded", F.col("depth") < max_depth)


def collected(sources: list[DataFrame], most: int, allowed: Column | None = None) -> DataFrame:
    """(url, rank) of the first ``most`` distinct addresses of several lists (url, position), one list after the other.

    ``allowed`` holds for all lists but the first, which are seeds.
    """
    ensure_checkpoints(sources[0].sparkSession)
    both = None
    for i, rows in enumerate(sources):
        rows = rows.filter("url is not null") if not i or allowed is None else rows.filter(F.col("url").isNotNull() & allowed)
        rows = rows.select("url", F.struct(F.lit(i).alias("list"), F.col("position").cast("long").alias("position")).alias("by"))
        both = rows if both is None else both.unionByName(rows)
    first = both.groupBy("url").agg(F.min("by").alias("by")).select("url", "by.list", "by.position")
    return ranked(first, "list", "position", "url").filter(F.col("rank") <= most).select("url", "rank")
