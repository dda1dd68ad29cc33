"""Streaming plans, run to the end of what is there; their results equal the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.jobs import closed_sessions, deduplicated, file_stream, gap_sessions, latest_revision, run_to_end
from .common import EV


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users cut at gaps of 30 minutes."""
    e = file_stream(spark, f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return run_to_end(gap_sessions(e, "user_id", "ts", "30 minutes", "1 hour"), "complete")


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of raw events reduced to the first of each id, counted by action and day."""
    e = file_stream(spark, f"{d}/raw_events.parquet").select("event_id", "event_action", "ts")
    return run_to_end(deduplicated(e, "event_id", "ts")).groupBy("event_action", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def stream_closed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions emitted when their close arrives, over first deliveries."""
    e = file_stream(spark, f"{d}/raw_events.parquet").select("event_id", "sensor", "session_id", "event_action", "ts")
    return latest_revision(run_to_end(closed_sessions(deduplicated(e, "event_id", "ts"))), "sensor", "session_id")


QUERIES = {f.__name__: f for f in (stream_sessions, stream_dedup, stream_closed_sessions)}
SQL = {
    "stream_sessions": """WITH g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events),
        s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM g)
        SELECT user_id, min(ts)::TIMESTAMPTZ AS started, max(ts)::TIMESTAMPTZ AS ended, count(*) AS events FROM s GROUP BY user_id, i""",
    "stream_dedup": f"SELECT event_action, CAST(ts AS DATE) AS day, count(*) AS n FROM {EV} GROUP BY 1, 2",
    "stream_closed_sessions": f"""SELECT sensor, session_id, count(*) AS events, count(*) FILTER (event_action = 'command.input') AS commands, min(ts) AS started, max(ts) AS ended FROM {EV} GROUP BY 1, 2
        HAVING count(*) FILTER (event_action = 'session.closed') > 0""",
}
