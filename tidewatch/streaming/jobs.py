"""Incremental forms: deduplicated ingest, gap sessions, and sessions that end with their closing event."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    """A new folder inside the cluster's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A parquet table (file or folder) as a stream, with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path + "*")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all there is and give the rows written (append), or those of the last batch (complete)."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    out = f"{folder}/out"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def deduplicated(events: DataFrame, key: str, time: str, late: str = "30 days") -> DataFrame:
    """First delivery of each key; a key is remembered until the watermark passes `late`."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def gap_sessions(events: DataFrame, user: str, time: str, gap: str, late: str) -> DataFrame:
    """Sessions that end after `gap` without an event."""
    s = events.withWatermark(time, late).groupBy(F.col(user), F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.max(time).alias("ended"))
    return s.select(user, F.col("w.start").alias("started"), "ended", "events")


CLOSED = "sensor string, session_id string, events long, commands long, started timestamp, ended timestamp, revision long"
STATE = "events long, commands long, started timestamp, ended timestamp, closed boolean, revision long"


def closing(is_close: Callable[[pd.DataFrame], pd.Series] = lambda b: b["event_action"] == "session.closed", idle_ms: int = 7 * 86_400_000) -> Callable:
    """State function: counts a session's events; once its close has arrived, a row is emitted, and a further revision of it for
    every later micro-batch with events of the session.  Sessions are forgotten when the watermark is `idle_ms` past their last event.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        events, commands, started, ended, closed, revision = state.get if state.exists else (0, 0, None, None, False, 0)
        for b in batches:
            events += len(b)
            commands += int((b["event_action"] == "command.input").sum())
            lo, hi = b["ts"].min(), b["ts"].max()
            started = lo if started is None else min(started, lo)
            ended = hi if ended is None else max(ended, hi)
            closed = bool(closed or is_close(b).any())
        revision += closed
        state.update((events, commands, started, ended, closed, revision))
        # Event time only: a wall-clock timeout would keep an available-now run going for ever.
        state.setTimeoutTimestamp(max(int(ended.timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        if closed:
            yield pd.DataFrame({"sensor": [key[0]], "session_id": [key[1]], "events": [events], "commands": [commands], "started": [started], "ended": [ended], "revision": [revision]})

    return run


def latest_revision(rows: DataFrame, *key: str) -> DataFrame:
    """The last revision of each key, without the revision: what a sink that upserts by key holds."""
    rest = [c for c in rows.columns if c not in (*key, "revision")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "revision").alias("x")).select(*key, *[F.col(f"x.{c}").alias(c) for c in rest])


def closed_sessions(events: DataFrame) -> DataFrame:
    """Revisions of closed sessions; see latest_revision()."""
    e = events.select("sensor", "session_id", "event_action", "ts")
    return e.groupBy("sensor", "session_id").applyInPandasWithState(closing(), CLOSED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
