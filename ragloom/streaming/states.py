"""State over events: sessions, handoffs, recent requests, error limits, polling; for tables, and for streams with state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# They must equal those of existing deployments.
STATUS_OF = {"request": "pending", "assign": "assigned", "start": "in_progress", "resolve": "resolved", "escalate": "escalated", "cancel": "cancelled"}
ACTIVE = ("pending", "assigned", "in_progress")
TRANSITIONS = {"running": ("completed", "failed", "cancelled"), "completed": (), "failed": (), "cancelled": ()}
TIMEOUT_MINUTES = 60


def sessions(events: DataFrame, key: str, ts: str, at_most: str = "10 minutes") -> DataFrame:
    """(key, first, last, seconds, n) of every client, and (stream only) the watermark that lets it be kept."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_t", at_most)
    out = timed.groupBy(key).agg(F.min("_t").alias("first"), F.max("_t").alias("last"), F.count("*").alias("n"))
    return out.select(key, "first", "last", (F.unix_seconds("last") - F.unix_seconds("first")).alias("seconds"), "n")


def recent(events: DataFrame, key: str, ts: str, tie: str, n: int = 100) -> DataFrame:
    """The last ``n`` events of every key, newest first by (ts, tie), with their place."""
    order = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return events.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def valid_transition(before: Column, after: Column) -> Column:
    """Whether a crawl may go from one status to another: to itself or along TRANSITIONS; other words are no status."""
    known = list(TRANSITIONS)
    moves = [(a, b) for a, to in TRANSITIONS.items() for b in to]
    along = F.concat_ws(">", before, after).isin([f"{a}>{b}" for a, b in moves])
    return F.coalesce(before.isin(known) & after.isin(known) & ((before == after) | along), F.lit(False))


def handoff_status(events: DataFrame, key: str, ts: str, action: str, as_of: Column | None = None, minutes: int = TIMEOUT_MINUTES) -> DataFrame:
    """(key, status) after all events; a pending request that is ``minutes`` old at ``as_of`` has timed out.

    A request while another is active changes nothing. Order is by ``ts``, of
    equals by action. Only the last event of each kind matters, so nothing is
    gathered by key.
    """
    at = F.struct(F.col(ts).alias("t"), F.col(action).alias("a"))
    asks = F.col(action) == "request"
    rows = events.filter(F.col(action).isin(list(STATUS_OF)))
    rows = rows.groupBy(key).agg(F.max(F.when(~asks, at)).alias("last"), F.max(F.when(asks, at)).alias("asked"), F.min(F.when(asks, at)).alias("first_asked"))
    # the request that opened what is pending: the first after the last closing event
    opened = events.filter(asks).select(F.col(key).alias("_k"), at.alias("r")).join(rows.select(F.col(key).alias("_k"), "last"), "_k").filter("last is null or r > last").groupBy("_k").agg(F.min("r.t").alias("opened"))
    status = F.lit(None).cast("string")
    for name, value in STATUS_OF.items():
        status = F.when(F.col("last.a") == name, value).otherwise(status)
    closed = ~F.coalesce(status.isin(*ACTIVE), F.lit(False))
    after = F.col("last").isNull() | (F.col("asked") > F.col("last"))
    rows = rows.select(key, F.when(closed & F.col("asked").isNotNull() & after, "pending").otherwise(status).alias("status"))
    rows = rows.join(opened, F.col(key) == F.col("_k"), "left")
    late = F.lit(False) if as_of is None else (F.col("status") == "pending") & (F.col("opened") <= as_of - F.make_dt_interval(mins=F.lit(minutes)))
    return rows.select(key, F.when(late, "timeout").otherwise(F.col("status")).alias("status"))


def handoff_stream(events: DataFrame, key: str, ts: str, action: str, minutes: int = TIMEOUT_MINUTES, late: str = "10 minutes") -> DataFrame:
    """The same on a stream, in update mode: one status is held per key, and event time ends pending requests."""

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [keys[0]], "status": ["timeout"]})
            return
        rows = pd.concat(parts).sort_values([ts, action])
        opened = None
        for t, a in zip(rows[ts], rows[action], strict=True):
            if a in STATUS_OF and not (a == "request" and status in ACTIVE):
                status = STATUS_OF[a]
                opened = t
        if status is not None:
            state.update((status,))
            if status == "pending" and opened is not None:
                state.setTimeoutTimestamp(max(int(opened.timestamp() * 1000) + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame({key: [keys[0]], "status": [status]})

    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).select(key, ts, action)
    kind = timed.schema[key].dataType.simpleString()
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, status string", "status string", "update", GroupStateTimeout.EventTimeTimeout)


def error_limits(errors: DataFrame, key: str, kind: str, most: int) -> DataFrame:
    """(key, kind, n, total, disabled): errors of every kind, and whether a key has more than ``most`` of all kinds."""
    per = errors.groupBy(key, kind).agg(F.count("*").alias("n"))
    total = per.groupBy(key).agg(F.sum("n").alias("total"))
    return per.join(total, key).withColumn("disabled", F.col("total") > most)


def since(rows: DataFrame, id_col: str, last: int) -> DataFrame:
    """What came after the last id that a poller saw, in order."""
    return rows.filter(F.col(id_col) > last).orderBy(id_col)
