"""State on streams as on tables."""

from pyspark.sql import functions as F

from ragloom.streaming import states

HANDOFFS = """SELECT h, CAST(t AS TIMESTAMP) AS t, a FROM (VALUES (1, '2024-01-01 10:00:00', 'request'), (1, '2024-01-01 10:05:00', 'request'), (2, '2024-01-01 10:00:00', 'request'), (2, '2024-01-01 10:01:00', 'assign'), (2, '2024-01-01 10:30:00', 'request'),
    (3, '2024-01-01 09:00:00', 'request'), (3, '2024-01-01 09:10:00', 'resolve'), (3, '2024-01-01 10:50:00', 'request'), (4, '2024-01-01 09:00:00', 'request'), (4, '2024-01-01 09:10:00', 'assign'), (4, '2024-01-01 09:20:00', 'escalate'), (5, '2024-01-01 10:59:00', 'cancel'), (6, '2024-01-01 10:00:01', 'request'), (6, '2024-01-01 10:00:02', 'noise')) AS x(h, t, a)"""


def test_handoffs_on_a_stream(spark, tmp_path):
    events = spark.sql(HANDOFFS)
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    out = states.handoff_stream(stream, "h", "t", "a").writeStream.format("memory").queryName("handoffs").outputMode("update")
    out.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(90)
    # the newest event is of 10:59, so with ten minutes of lateness nothing pending is an hour old
    want = {r.h: r.status for r in states.handoff_status(events, "h", "t", "a").collect()}
    got = {r.h: r.status for r in spark.table("handoffs").collect()}
    assert got == want and got[1] == "pending" and got[2] == "assigned"


def test_sessions_of_a_stream(spark, tmp_path):
    rows = spark.range(60).selectExpr("timestamp_seconds(1700000000 + id * 60) AS ts", "id % 4 AS k")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = states.sessions(stream, "k", "ts").writeStream.format("memory").queryName("sessions").outputMode("complete")
    out.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(map(tuple, spark.table("sessions").collect())) == sorted(map(tuple, states.sessions(rows, "k", "ts").collect()))


def test_recent_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 4, 3), (2, 1, 4)], "k int, ts int, id int")
    got = sorted((r.k, r.place, r.id) for r in states.recent(rows, "k", "ts", "id", 2).collect())
    assert got == [(1, 1, 2), (1, 2, 1), (2, 1, 4)]
    assert states.since(rows, "id", 2).select(F.col("id")).collect() == [(3,), (4,)]
