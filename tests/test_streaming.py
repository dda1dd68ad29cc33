from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.streaming.jobs import closed_sessions, deduplicated, file_stream, gap_sessions, latest_revision, run_to_end

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


def write(spark, folder, batches):
    schema = "event_id long, sensor string, session_id string, event_action string, ts timestamp"
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(folder)


def ev(i, s, action, minutes):
    return (i, "e", s, action, T0 + dt.timedelta(minutes=minutes))


def test_state_lasts_over_batches(spark, tmp_path):
    f = str(tmp_path / "in")
    write(spark, f, [[ev(1, "a", "session.connect", 0), ev(2, "b", "session.connect", 1)], [ev(3, "a", "command.input", 2), ev(3, "a", "command.input", 2)], [ev(4, "a", "session.closed", 3)]])
    e = file_stream(spark, f, 1)
    got = latest_revision(run_to_end(closed_sessions(deduplicated(e, "event_id", "ts"))), "sensor", "session_id").collect()
    assert [(r.session_id, r.events, r.commands) for r in got] == [("a", 3, 1)]


def test_events_behind_the_close_count(spark, tmp_path):
    """Rows that arrive in later micro-batches than the close, out of order, still belong to the session."""
    f = str(tmp_path / "in")
    write(spark, f, [
        [ev(1, "a", "session.connect", 0), ev(5, "b", "session.closed", 9)], [ev(4, "a", "session.closed", 30)], [ev(2, "a", "command.input", 5), ev(3, "a", "command.input", 7)],
        [ev(6, "b", "command.input", 2)], [ev(2, "a", "command.input", 5), ev(7, "c", "session.connect", 3)],
    ])
    rows = run_to_end(closed_sessions(deduplicated(file_stream(spark, f, 1), "event_id", "ts")))
    got = {r.session_id: (r.events, r.commands) for r in latest_revision(rows, "sensor", "session_id").collect()}
    assert got == {"a": (4, 2), "b": (2, 1)}


def test_gaps(spark, tmp_path):
    f = str(tmp_path / "in")
    write(spark, f, [[ev(1, "a", "x", 0), ev(2, "a", "x", 10)], [ev(3, "a", "x", 60), ev(4, "b", "x", 5)]])
    s = gap_sessions(file_stream(spark, f, 1).select("session_id", "ts"), "session_id", "ts", "30 minutes", "2 hours")
    got = run_to_end(s, "complete").orderBy("session_id", "started").collect()
    assert [(r.session_id, r.events) for r in got] == [("a", 2), ("a", 1), ("b", 1)]


def test_empty_stream(spark, tmp_path):
    f = str(tmp_path / "in")
    spark.createDataFrame([], "event_id long, ts timestamp").write.parquet(f)
    e = spark.readStream.schema("event_id long, ts timestamp").parquet(f)
    assert run_to_end(deduplicated(e, "event_id", "ts")).agg(F.count("*")).first()[0] == 0
