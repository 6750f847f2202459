"""Named conditions of forms, responses, sessions, messages, operators and crawls, and small row sets of the console."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Conditions that are one comparison: name to column and value.
FORMS = {"pending": ("status", "pending"), "responded": ("status", "responded"), "closed": ("status", "closed"), "active": ("has_active_conversation", True), "urgent": ("conversation_priority", "urgent")}
RESPONSES = {"email": ("response_type", "email"), "web": ("response_type", "web"), "sent": ("email_sent", True), "urgent": ("priority", "urgent"), "starters": ("is_thread_starter", True), "unnotified": ("admin_notified", False), "unread": ("user_read", False)}
SESSIONS = {"active": ("status", "active"), "waiting": ("status", "waiting_operator")}


def is_(scope: str, table: dict[str, tuple[str, object]]) -> Column:
    column, value = table[scope]
    return F.coalesce(F.col(column) == value, F.lit(False))


def ago(as_of: Column, minutes: int) -> Column:
    return as_of - F.make_dt_interval(mins=F.lit(minutes))


def recent_activity(as_of: Column, hours: int = 24) -> Column:
    return F.col("last_response_at") >= ago(as_of, 60 * hours)


def mail_pending() -> Column:
    return (F.col("response_type") == "email") & ~F.col("email_sent")


def online(as_of: Column) -> Column:
    """An operator who is available or busy and was seen in the last five minutes."""
    return F.col("is_operator") & F.col("operator_status").isin("available", "busy") & (F.col("last_seen_at") >= ago(as_of, 5))


def stale(as_of: Column, hours: int = 24, ghosts: bool = False) -> Column:
    """A crawl session that is older than ``hours``, or, of ghosts, one that found no page."""
    return (F.col("pages_found") == 0) if ghosts else F.col("created_at") < ago(as_of, 60 * hours)


def due(as_of: Column) -> Column:
    """A schedule that never ran, or not within its interval."""
    return F.col("last_run_at").isNull() | (F.col("last_run_at") <= as_of - F.make_dt_interval(mins=F.col("interval_minutes")))


def users(rows: DataFrame, roles: DataFrame, *, search: str, role: str, page: int, size: int) -> DataFrame:
    """A page of users whose name or mail contains the words, with a role in any tenant, newest first."""
    low = search.lower()
    found = rows.filter(F.contains(F.lower("name"), F.lit(low)) | F.contains(F.lower("email"), F.lit(low)))
    found = found.join(roles.filter(F.col("role") == role).select("user_id"), found["id"] == F.col("user_id"), "left_semi")
    return found.orderBy(F.desc("created_at"), F.desc("id")).offset((page - 1) * size).limit(size)


def polled(messages: DataFrame, ts: str, tie: str, since: Column, offset: int = 0, limit: int = 50) -> DataFrame:
    """Messages from a time on, oldest first, a page at a time."""
    return messages.filter(F.col(ts) >= since).orderBy(ts, tie).offset(offset).limit(limit)


def source_url(text: Column) -> Column:
    """The address of a labelled line, else the first address in a text."""
    labelled = F.regexp_extract(text, r"(?i)\*\*URL:\*\*\s+(https?://[^\s]+)", 1)
    first = F.regexp_extract(text, r"(?i)(https?://[^\s)]+)", 1)
    return F.coalesce(F.nullif(labelled, F.lit("")), F.nullif(first, F.lit("")))


def crawl_plan(seeds: Column, sitemap: Column, depth: Column, scripted: Column, per_second: Column) -> Column:
    """Estimated addresses and seconds of a crawl: ten links a page, three in ten pass, 45 or 5 seconds each or what the rate allows."""
    levels = F.greatest(F.lit(1), depth)
    urls = (seeds * ((F.pow(F.lit(10.0), levels) - 1) / 9) + sitemap) * 0.3
    each = F.greatest(F.when(scripted, 45.0).otherwise(5.0), F.when(per_second > 0, 1 / per_second).otherwise(0.0))
    return F.struct(urls.alias("urls"), (urls * each).alias("seconds"))
