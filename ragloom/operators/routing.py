"""Requests and operators: who suits whom, and an assignment in rounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoints
from . import ranking

#: Points that an operator needs to take a request from the queue.
LEAST_SCORE = 30.0
#: Requests of a tenant that a round serves.
BLOCK = 4_096
#: What a request's scores depend on.
PROFILE = ("tenant", "required", "preferred", "priority")


def _profile() -> Column:
    return F.xxhash64(*(F.col(c) if c in ("tenant", "priority") else F.array_join(F.sort_array(F.coalesce(c, F.array().cast("array<string>"))), "\x1f") for c in PROFILE))


def suited(requests: DataFrame, operators: DataFrame) -> DataFrame:
    """(profile, tenant, operator_id, capacity, score) of every operator for every kind of request of its tenant.

    ``requests``: tenant, required, preferred (arrays of skills or null),
    priority; ``operators``: tenant, operator_id, skills, load, most, minutes,
    rating, handled. Requests that ask for the same are one kind, so pairs grow
    with kinds and not with requests. Operators without room take no part.
    """
    none = F.array().cast("array<string>")
    kinds = requests.select(_profile().alias("profile"), "tenant", *(F.coalesce(c, none).alias(c) for c in ("required", "preferred")), "priority").dropDuplicates(["profile"])
    able = operators.filter(F.col("load") < F.col("most")).withColumn("skills", F.coalesce("skills", none))
    both = kinds.join(able, "tenant")
    score = ranking.operator_score(*(F.col(c) for c in ("skills", "required", "preferred", "load", "most", "minutes", "rating", "handled", "priority")))
    return both.select("profile", "tenant", "operator_id", (F.col("most") - F.col("load")).cast("long").alias("capacity"), F.round(score, 6).alias("score"))


def best_operator(requests: DataFrame, operators: DataFrame) -> DataFrame:
    """(request_id, operator_id, score): the best operator with room of each request's tenant; the smaller id of equal ones. Requests of tenants without one are left out."""
    best = suited(requests, operators).groupBy("profile").agg(F.max(F.struct("score", (-F.col("operator_id")).alias("first"))).alias("b"))
    return requests.select("request_id", _profile().alias("profile")).join(best, "profile").select("request_id", (-F.col("b.first")).alias("operator_id"), F.col("b.score").alias("score"))


def _served(fits: dict[int, list[tuple]], asking: list[tuple]) -> list[tuple]:
    """(request_id, operator_id, score) of requests (request_id, profile) in their order: each takes the first of its kind's operators (operator_id, room, score) that has room."""
    room = {o: n for rows in fits.values() for o, n, _ in rows}
    at, out = dict.fromkeys(fits, 0), []
    for request, profile in asking:
        rows = fits.get(profile, [])
        i = at.get(profile, 0)
        while i < len(rows) and not room[rows[i][0]]:
            i += 1
        at[profile] = i
        if i < len(rows):
            room[rows[i][0]] -= 1
            out.append((request, rows[i][0], rows[i][2]))
    return out


def assign(requests: DataFrame, operators: DataFrame, order: list[str], least: float = LEAST_SCORE, block: int = BLOCK) -> DataFrame:
    """(request_id, operator_id, score) of an assignment that respects capacity, skills and the queue.

    The result is that of one queue by ``order`` and request_id, in which each
    request takes the best operator with room; scores are those of the
    beginning. Operators never get room back, so of the requests that ask for
    the same only as many can be served as their operators have room for, and
    only the first in the queue; others go at once. In every round the next
    ``block`` requests of each tenant are served together, each kind from its
    first ``block`` operators with room, as so many requests fill no more: a
    round holds no tenant's whole queue, and there are as many rounds as the
    largest tenant has blocks. Each round is checkpointed. Requests that nobody
    takes have no row.
    """
    ensure_checkpoints(requests.sparkSession)
    fits = suited(requests, operators).filter(F.col("score") >= least)
    best = Window.partitionBy("profile").orderBy(F.desc("score"), "operator_id")
    fits = fits.select("tenant", "profile", "operator_id", "capacity", "score").checkpoint()
    room = fits.groupBy("profile").agg(F.sum("capacity").alias("room"))
    most = room.agg(F.max("room")).first()[0] or 0
    keys = [*order, "request_id"]
    asked = requests.select("request_id", *order, "tenant", _profile().alias("profile"))
    first = asked.withColumn("turn", F.row_number().over(Window.partitionBy("profile").orderBy(*keys))).filter(F.col("turn") <= most)
    open_ = first.join(room, "profile").filter(F.col("turn") <= F.col("room")).select("request_id", *order, "tenant", "profile").checkpoint()
    schema = T.StructType([requests.schema["request_id"], operators.schema["operator_id"], T.StructField("score", T.DoubleType())])

    def serve(asking: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        kinds: dict[int, list[tuple]] = {}
        for profile, *rest in near.sort_values("place")[["profile", "operator_id", "capacity", "score"]].itertuples(index=False, name=None):
            kinds.setdefault(profile, []).append(tuple(rest))
        asking = asking.sort_values("turn")[["request_id", "profile"]]
        return pd.DataFrame(_served(kinds, list(asking.itertuples(index=False, name=None))), columns=schema.names)

    found = None
    while found is None or not open_.isEmpty():
        now = open_.withColumn("turn", F.row_number().over(Window.partitionBy("tenant").orderBy(*keys))).filter(F.col("turn") <= block).select("request_id", "tenant", "profile", "turn").checkpoint()
        near = fits.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= block)
        got = now.groupBy("tenant").cogroup(near.groupBy("tenant")).applyInPandas(serve, schema).checkpoint()
        used = got.groupBy("operator_id").agg(F.count("*").alias("used"))
        left = F.col("capacity") - F.coalesce("used", F.lit(0))
        fits = fits.join(used, "operator_id", "left").select("tenant", "profile", "operator_id", left.alias("capacity"), "score").filter("capacity > 0").checkpoint()
        open_ = open_.join(now.select("request_id"), "request_id", "left_anti").join(fits.select("profile").distinct(), "profile", "left_semi").select("request_id", *order, "tenant", "profile").checkpoint()
        found = got if found is None else found.unionByName(got)
    return found.select("request_id", "operator_id", "score")
