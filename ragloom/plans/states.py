"""Sessions, handoffs, limits and other state over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import states
from .registry import add, add_derived

add("ST2_recent_requests", "events", lambda e: states.recent(e, "user_id", "ts", "event_id", 5).select("user_id", "place", "event_id"),
    'SELECT user_id, place, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS place FROM events) WHERE place <= 5')
add("ST6_sessions", "events", lambda e: states.sessions(e, "user_id", "ts").select("user_id", "seconds", "n"), "SELECT user_id, (floor(epoch(max(ts))) - floor(epoch(min(ts))))::BIGINT AS seconds, count(*) AS n FROM events GROUP BY 1")
add("ST11_error_limits", "events", lambda e: states.error_limits(e.filter("event_type in ('error', 'signup')"), "user_id", "event_type", 9),
    "SELECT user_id, event_type, n, (sum(n) OVER (PARTITION BY user_id))::BIGINT AS total, sum(n) OVER (PARTITION BY user_id) > 9 AS disabled FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1, 2)")
add("ST13_since", "events", lambda e: states.since(e, "event_id", 900).select("event_id", "event_type"), "SELECT event_id, event_type FROM events WHERE event_id > 900")
_MOVES = """SELECT CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'paused' END AS a,
    CASE user_id % 6 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' WHEN 3 THEN 'cancelled' WHEN 4 THEN 'dispatched' ELSE 'paused' END AS b FROM events"""
add_derived("ST9_transitions", {"m": _MOVES}, lambda m: m.select("a", "b", states.valid_transition(F.col("a"), F.col("b")).alias("valid")),
    "SELECT a, b, coalesce(a IN ('running', 'completed', 'failed', 'cancelled') AND b IN ('running', 'completed', 'failed', 'cancelled') AND (a = b OR (a = 'running' AND b IN ('completed', 'failed', 'cancelled'))), FALSE) AS valid FROM m")
_HANDOFFS = """SELECT user_id AS h, CAST(ts AS TIMESTAMP) AS t, CASE event_type WHEN 'click' THEN 'request' WHEN 'view' THEN 'request' WHEN 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'assign' WHEN 1 THEN 'resolve' ELSE 'escalate' END WHEN 'error' THEN 'cancel' ELSE 'noise' END AS a FROM events"""
_STATUS = """, k AS (SELECT h, max(CASE WHEN a <> 'request' THEN t END) AS closed, arg_max(a, t) FILTER (WHERE a <> 'request') AS last FROM e WHERE a IN ('request', 'assign', 'start', 'resolve', 'escalate', 'cancel') GROUP BY 1),
o AS (SELECT k.h, last, min(t) AS opened FROM k LEFT JOIN e ON k.h = e.h AND a = 'request' AND (closed IS NULL OR t > closed) GROUP BY ALL),
s AS (SELECT h, opened, CASE WHEN last = 'assign' THEN 'assigned' WHEN last = 'start' THEN 'in_progress' WHEN opened IS NOT NULL THEN 'pending' WHEN last = 'resolve' THEN 'resolved' WHEN last = 'escalate' THEN 'escalated' WHEN last = 'cancel' THEN 'cancelled' END AS status FROM o)"""
add_derived("ST8_handoff_status", {"e": _HANDOFFS}, lambda e: states.handoff_status(e, "h", "t", "a"), _STATUS + " SELECT h, status FROM s")
add_derived("ST7_handoff_timeouts", {"e": _HANDOFFS}, lambda e: states.handoff_status(e, "h", "t", "a", F.lit("2024-01-31 00:00:00").cast("timestamp")),
    _STATUS + " SELECT h, CASE WHEN status = 'pending' AND opened <= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 60 MINUTE THEN 'timeout' ELSE status END AS status FROM s")
