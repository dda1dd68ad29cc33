"""Problem 2: per-address session results where a few addresses hold most sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import balanced_distinct_counts, balanced_join, plan_placement
from ..session import table

MIN_SHARE = 0.01
MIN_SESSIONS = 5


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sessions_rollup").select(
        F.col("source.ip").alias("source_ip"), "sensor", "session_id", "command_count", "login_success_count", "started_at", "ended_at"
    )


def address_totals(sessions: DataFrame) -> DataFrame:
    """One row per address (one for null): distinct sessions, commands, successful sessions, first and last time."""
    out, _ = balanced_distinct_counts(
        sessions,
        "source_ip",
        ["sensor", "session_id"],
        {
            "total_commands": F.sum(F.coalesce("command_count", F.lit(0))),
            "successful_sessions": F.sum((F.coalesce("login_success_count", F.lit(0)) > 0).cast("long")),
            "first_seen": F.min("started_at"),
            "last_seen": F.max(F.coalesce("ended_at", "started_at")),
        },
        {"total_commands": "sum", "successful_sessions": "sum", "first_seen": "min", "last_seen": "max"},
    )
    return out.withColumnRenamed("n", "total_sessions")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with at least one percent of all distinct sessions and at least five."""
    s = _sessions(spark, sf_dir).select("source_ip", "sensor", "session_id")
    per_ip, _ = balanced_distinct_counts(s, "source_ip", ["sensor", "session_id"], {}, {})
    total = per_ip.agg(F.sum("n").alias("total"))
    return (
        per_ip.join(F.broadcast(total))  # one row
        .filter(F.col("source_ip").isNotNull() & (F.col("n") >= MIN_SESSIONS) & (F.col("n") * 100 >= F.col("total")))
        .select("source_ip")
    )


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address_totals(_sessions(spark, sf_dir))


def p2_session_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct session beside its address's rollup: the balanced join itself."""
    s = _sessions(spark, sf_dir).filter(F.col("source_ip").isNotNull()).select("source_ip", "sensor", "session_id", "command_count")
    p = plan_placement(s, "source_ip")
    ips = (
        table(spark, sf_dir, "ips_rollup")
        .filter(F.col("source_ip").isNotNull())
        .groupBy("source_ip")
        .agg(F.max("total_sessions").alias("ip_sessions"), F.max("total_commands").alias("ip_commands"))
    )
    joined = balanced_join(s, ips, "source_ip", ["sensor", "session_id"], p, "left")
    return joined.groupBy("source_ip", "sensor", "session_id").agg(
        F.max("command_count").alias("command_count"), F.max("ip_sessions").alias("ip_sessions"), F.max("ip_commands").alias("ip_commands")
    )


QUERIES = {"p2_found": p2_found, "p2_totals": p2_totals, "p2_session_share": p2_session_share}

_S = "(SELECT source.ip AS source_ip, sensor, session_id, max(command_count) AS command_count, max(login_success_count) AS ok, max(started_at) AS started_at, max(ended_at) AS ended_at FROM sessions_rollup GROUP BY 1, 2, 3)"
SQL = {
    "p2_found": f"""SELECT source_ip FROM (SELECT source_ip, count(*) AS n FROM {_S} GROUP BY 1)
        WHERE source_ip IS NOT NULL AND n >= 5 AND n * 100 >= (SELECT count(*) FROM {_S})""",
    "p2_totals": f"""SELECT source_ip, count(*) AS total_sessions, CAST(sum(coalesce(command_count, 0)) AS BIGINT) AS total_commands,
        CAST(sum(CASE WHEN coalesce(ok, 0) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS successful_sessions,
        min(started_at) AS first_seen, max(coalesce(ended_at, started_at)) AS last_seen FROM {_S} GROUP BY 1""",
    "p2_session_share": f"""SELECT s.source_ip, sensor, session_id, command_count, ip_sessions, ip_commands FROM {_S} s
        LEFT JOIN (SELECT source_ip, max(total_sessions) AS ip_sessions, max(total_commands) AS ip_commands FROM ips_rollup GROUP BY 1) i
        ON s.source_ip = i.source_ip WHERE s.source_ip IS NOT NULL""",
}
