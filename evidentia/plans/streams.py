"""Queries of the streaming operators, over all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.plans.register import query
from evidentia.streaming import events as ev


@query("q_ext_stream_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf):
    return ev.batched(ev.window_counts, "update", ["start", "event_type"])(spark, sf).withColumn("total", F.round("total", 4))


@query(
    "q_ext_stream_sliding",
    "SELECT date_trunc('hour', ts) - to_hours(k) AS start, event_type, count(*) AS n FROM events, range(0, 2) r(k) GROUP BY ALL",
)
def sliding(spark, sf):
    return ev.batched(lambda e: ev.window_counts(e, "2 hours", "1 hour"), "update", ["start", "event_type"])(spark, sf).select("start", "event_type", "n")


@query(
    "q_ext_stream_sessions",
    """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM l)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
)
def sessions(spark, sf):
    """Sessions over the whole table at once; the streaming form is ``events.sessions``."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("q_ext_stream_dedup", "SELECT DISTINCT event_id, event_type FROM events")
def dedup(spark, sf):
    return ev.batched(ev.first_of_key, "append")(spark, sf).select("event_id", "event_type")
