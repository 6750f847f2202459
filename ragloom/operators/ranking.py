"""Rank arithmetic, diversity, context packing, routing scores and change detection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\n\n---\n\n"
#: What a part needs besides its length, and the most candidates that diversity looks at.
PART_MARGIN = 5
MMR_CANDIDATES = 15
#: A similarity beyond which no later one is looked at.
ENOUGH = 0.95


def rerank(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    """Ranks from 1 in each group, in the order given."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def position_scores(ranked: DataFrame, by: str) -> DataFrame:
    """``bias``: 1 falling by a tenth over the list; ``linear``: 1 falling to 0 at its end."""
    n = F.count("*").over(Window.partitionBy(by))
    at = F.col("rank") - 1
    return ranked.withColumn("bias", F.round(1 - at / n * 0.1, 6)).withColumn("linear", F.round(1 - at / F.greatest(F.lit(1), n - 1), 6))


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    norms = np.maximum(np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :], 1e-12)
    return x @ y.T / norms


def _nearest(similarities: np.ndarray) -> float:
    """The largest similarity, from 0 up, or the first above ENOUGH in the order of selection."""
    above = np.flatnonzero(similarities > ENOUGH)
    return float(max([0.0, *(similarities[: above[0] + 1] if len(above) else similarities)]))


def mmr(candidates: DataFrame, k: int, weight: float) -> DataFrame:
    """Greedy maximal marginal relevance over (query_id, id, q, v, rank): (query_id, id, position).

    Looks at the first MMR_CANDIDATES of each query, which bounds a group. Of
    equal scores the earlier candidate wins; similarity to what is selected
    counts from 0 up, and as the first above ENOUGH if there is one. A weight of 0.99 or more is a plain sort by similarity.
    """

    def select(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        v = np.stack(rows["v"].to_list()).astype(float)
        near = _cosine(v, np.asarray(rows["q"].iloc[0], float)[None, :])[:, 0]
        if weight >= 0.99:
            chosen = np.argsort(-near, kind="stable")[:k].tolist()
        else:
            each, chosen, left = _cosine(v, v), [], list(range(len(v)))
            while left and len(chosen) < k:
                best = max(left, key=lambda i: weight * near[i] - (1 - weight) * _nearest(each[i, chosen]))
                chosen.append(best)
                left.remove(best)
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "id": rows["id"].to_numpy()[chosen], "position": np.arange(1, len(chosen) + 1)})

    few = candidates.filter(F.col("rank") <= MMR_CANDIDATES).select("query_id", "id", "q", "v", "rank")
    return few.groupBy("query_id").applyInPandas(select, "query_id long, id long, position long")


def pack(parts: DataFrame, by: str, text: str, order: list[str], budget: int) -> DataFrame:
    """(by, parts, context): the parts in order until the first that would exceed the budget of characters.

    Empty parts are left out; a group whose first part is too long has no row.
    """
    w = Window.partitionBy(by).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.sum(F.length(text)).over(before), F.lit(0)) + F.greatest(F.lit(0), F.row_number().over(w) - 2) * len(SEPARATOR)
    fits = held + F.length(text) + PART_MARGIN <= budget
    rows = parts.filter(F.length(text) > 0).withColumn("_fits", fits).withColumn("_n", F.row_number().over(w))
    rows = rows.withColumn("_keep", F.min("_fits").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_keep")
    sorted_parts = F.sort_array(F.collect_list(F.struct("_n", F.col(text).alias("t"))))
    return rows.groupBy(by).agg(F.count("*").alias("parts"), sorted_parts.alias("_p")).select(by, "parts", F.array_join("_p.t", SEPARATOR).alias("context"))


def operator_score(skills: Column, required: Column, preferred: Column, load: Column, most: Column, minutes: Column, rating: Column, handled: Column, priority: Column) -> Column:
    """Points of an operator for a request: skills 30, free capacity 25, response 20, satisfaction 15, experience 10.

    Unknown response time counts as 5 minutes, unknown rating as 3.5.
    """
    share = lambda wanted, points: F.when(F.size(wanted) > 0, F.size(F.array_intersect(skills, wanted)) / F.size(wanted) * points)
    asked = F.least(F.lit(30.0), F.coalesce(share(required, 20), F.lit(20.0)) + F.coalesce(share(preferred, 10), F.lit(0.0)))
    skill = F.when((F.size(required) == 0) & (F.size(preferred) == 0), 15.0).otherwise(asked)
    free = (1 - F.when(most > 0, load / most).otherwise(0.0)) * 25
    minutes, rating = F.coalesce(minutes, F.lit(5)), F.coalesce(rating, F.lit(3.5))
    response = F.when(minutes <= 2, 20.0).when(minutes <= 10, 20 - (minutes - 2) / 8 * 20).otherwise(0.0)
    satisfaction = F.when(rating >= 4.5, 15).when(rating >= 4, 12).when(rating >= 3.5, 8).when(rating >= 3, 5).otherwise(0)
    bonus = F.when((priority == "urgent") & (handled > 50), 10).when((priority == "high") & (handled > 20), 5).otherwise(0)
    return skill + free + response + satisfaction + bonus


def changes(now: DataFrame, before: DataFrame, key: str, text: str) -> DataFrame:
    """(key, state): new, updated, unchanged or removed since the snapshot, by digest."""
    x = now.select(key, F.sha2(text, 256).alias("_now"), F.lit(True).alias("_in"))
    y = before.select(key, F.sha2(text, 256).alias("_then"), F.lit(True).alias("_was"))
    state = F.when(F.col("_was").isNull(), "new").when(F.col("_in").isNull(), "removed").when(F.col("_now").eqNullSafe(F.col("_then")), "unchanged").otherwise("updated")
    return x.join(y, key, "full").select(key, state.alias("state"))


#: Words of no weight, and the shares of the five parts of the lexical score.
STOP_WORDS = "il la di da in con su per tra fra a e o ma se come quando dove che chi cosa".split()
SHARES = {"overlap": 0.3, "frequency": 0.25, "length": 0.15, "exact": 0.25, "position": 0.05}


def lexical_score(query: Column, text: Column, position: Column, total: Column) -> Column:
    """Points of a candidate: keyword overlap, term frequency, length, exact phrase and position (from 0)."""
    q, t = F.lower(query), F.lower(text)
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    asked, held = words(q), words(t)
    share = F.size(F.filter(asked, lambda w: F.array_contains(held, w))) / F.size(asked)
    overlap = F.when(F.size(asked) == 0, 0.0).when(share >= 0.99, 1.0).otherwise(share)
    n = F.octet_length(text)
    times = lambda w: F.when(F.length(w) > 0, (F.length(t) - F.length(F.replace(t, w, F.lit("")))) / F.length(w)).otherwise(0.0)
    count = F.aggregate(F.split(q, r"\s+"), F.lit(0.0), lambda s, w: s + times(w))
    frequency = F.least(F.lit(1.0), count / F.greatest(F.lit(1.0), n / 100))
    length = F.when(n < 100, F.greatest(F.lit(0.7), n / 100)).when(n <= 1_000, 1.0).otherwise(F.greatest(F.lit(0.5), 1_000 / n))
    phrase = F.trim(q)
    at = F.transform(F.split(phrase, r"\s+"), lambda w: F.position(w, t))
    near = (F.array_min(at) > 0) & (F.array_max(at) - F.array_min(at) < 50) & (F.size(at) > 1)
    exact = F.when(F.contains(t, phrase), 1.0).when(near, 0.8).otherwise(0.0)
    parts = {"overlap": overlap, "frequency": frequency, "length": length, "exact": exact, "position": 1 - position / total * 0.1}
    return sum((parts[k] * w for k, w in SHARES.items()), F.lit(0.0))
