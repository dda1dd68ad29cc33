"""Views of the tables that several plans share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize, short_hash
from ..session import table


def events(spark: SparkSession, d: str) -> DataFrame:
    """raw_events with repeated deliveries of one event_id removed."""
    return table(spark, d, "raw_events").dropDuplicates(["event_id"])


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """sessions_rollup, the latest row of each (sensor, session_id)."""
    s = table(spark, d, "sessions_rollup")
    rest = [c for c in s.columns if c not in ("sensor", "session_id", "rolled_up_at")]
    latest = s.groupBy("sensor", "session_id").agg(F.max(F.struct("rolled_up_at", "login_fail_count", "started_at")).alias("k"), F.max_by(F.struct(*rest), F.struct("rolled_up_at", "login_fail_count")).alias("v"))
    return latest.select("sensor", "session_id", F.col("k.rolled_up_at").alias("rolled_up_at"), *[F.col(f"v.{c}").alias(c) for c in rest])


def slim_sessions(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """As sessions, with only `cols` read and moved."""
    names = [c.replace(".", "_") for c in cols]
    s = table(spark, d, "sessions_rollup").select("sensor", "session_id", F.struct("rolled_up_at", "login_fail_count").alias("at"), F.struct(*[F.col(c).alias(n) for c, n in zip(cols, names, strict=True)]).alias("v"))
    return s.groupBy("sensor", "session_id").agg(F.max_by("v", "at").alias("v")).select("sensor", "session_id", *[F.col(f"v.{c}").alias(c) for c in names])


def command_events(spark: SparkSession, d: str) -> DataFrame:
    """Command inputs with the normalised command and its hash."""
    e = events(spark, d).filter((F.col("event_action") == "command.input") & F.col("command_line").isNotNull())
    return e.withColumn("command", normalize(F.col("command_line"))).withColumn("h", short_hash(F.col("command")))


EV = "(SELECT DISTINCT ON (event_id) * FROM raw_events)"
SESS = "(SELECT * FROM sessions_rollup QUALIFY row_number() OVER (PARTITION BY sensor, session_id ORDER BY rolled_up_at DESC, login_fail_count DESC) = 1)"
CMD = rf"""(SELECT *, substr(sha256(command), 1, 16) AS h FROM (SELECT *, trim(regexp_replace(command_line, '\s+', ' ', 'g')) AS command
    FROM {EV} WHERE event_action = 'command.input' AND command_line IS NOT NULL))"""
