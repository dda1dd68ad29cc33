"""The whole session row, and rolling up only what changed (survey B1-B4, B6, B12, B17, B23, S21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..session import table
from .common import CMD, EV, SESS, command_events, events, slim_sessions
from .commands import PUBLIC_SQL
from .sessions import SQL as SESSIONS
from .sessions import session_artifacts, session_credentials, session_entropy, session_novelty, session_signature, session_stream_text

KEY = ["sensor", "session_id"]
COUNTERS = {
    "login_success_count": "login.success", "login_fail_count": "login.failed", "file_download_count": "session.file_download", "file_upload_count": "session.file_upload", "command_input_count": "command.input",
    "command_success_count": "command.success", "command_failure_count": "command.failed", "proxy_request_count": "direct-tcpip.request", "proxy_data_count": "direct-tcpip.data",
}
ATTRIBUTES = {
    "source_ip": "source.ip", "source_port": "source.port", "country": "source.geo.country_iso_code", "asn": "source.asn.number", "asn_org": "source.asn.org", "user_name": "user_name", "password": "password",
}


def _first(col: str | Column) -> Column:
    """The first value that isn't null, in time order."""
    c = F.col(col) if isinstance(col, str) else col
    return F.min_by(c, F.when(c.isNotNull(), F.struct("ts", "event_id")))


def _base(e: DataFrame) -> DataFrame:
    a = F.col("event_action")
    return e.groupBy(*KEY).agg(
        F.coalesce(F.min(F.when(a == "session.connect", F.col("ts"))), F.min("ts")).alias("started_at"),
        F.max(F.when(a == "session.closed", F.col("ts"))).alias("ended_at"),
        F.max(F.when(a == "session.closed", F.col("duration"))).alias("duration"),
        *[F.count_if(a == action).alias(name) for name, action in COUNTERS.items()],
        *[_first(col).alias(name) for name, col in ATTRIBUTES.items()],
        _first(F.coalesce("hassh", F.md5(F.col("hassh_algorithms").cast("binary")))).alias("hassh"),
        F.count_distinct("file_sha256").alias("distinct_files"),
        X.most_restrictive(F.col("classification")).alias("classification"),
    ).filter("ended_at is not null")


def session_intents(spark: SparkSession, d: str) -> DataFrame:
    """Dominant intent of a session's unique commands and its three commonest with their counts, ties by name."""
    c = command_events(spark, d).select(*KEY, "h").distinct().join(table(spark, d, "commands").select(F.col("command_hash").alias("h"), "intent").filter(F.col("intent").isNotNull()), "h")
    n = c.groupBy(*KEY, "intent").agg(F.count(F.lit(1)).alias("n"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "intent"))), 1, 3)  # one entry per intent
    g = n.groupBy(*KEY).agg(top.alias("t"))
    return g.select(*KEY, F.col("t")[0]["intent"].alias("dominant_intent"), F.array_join(F.transform("t", lambda x: F.concat_ws("=", x["intent"], (-x["m"]).cast("string"))), ",").alias("intent_distribution"))


def session_bigram_set(spark: SparkSession, d: str) -> DataFrame:
    """The distinct consecutive command pairs of a session and their signature."""
    w = Window.partitionBy(*KEY).orderBy("ts", "event_id")
    p = command_events(spark, d).select(*KEY, F.concat_ws(">", "h", F.lead("h").over(w)).alias("g"), F.lead("h").over(w).alias("b")).filter(F.col("b").isNotNull())
    s = p.groupBy(*KEY).agg(F.array_sort(F.collect_set("g")).alias("gs"))
    return s.select(*KEY, F.size("gs").alias("bigrams"), X.short_hash(F.array_join("gs", "|"), 32).alias("bigram_signature"))


def session_document(spark: SparkSession, d: str) -> DataFrame:
    """One row per closed session with all its fields: times, counters, first attributes, command and artifact signatures, intents, novelty, credentials.

    All parts are grouped by the session key, so the joins reuse that partitioning.
    """
    out = _base(events(spark, d)).withColumn("uid", F.concat_ws(":", F.coalesce("sensor", F.lit("default")), "session_id")).withColumn("anchor_at", F.coalesce("ended_at", "started_at"))
    signature = session_signature(spark, d).select(*KEY, F.col("n").alias("unique_commands"), F.col("signature").alias("command_signature"))
    entropy = session_entropy(spark, d).select(*KEY, "entropy", F.col("commands").alias("command_count"))
    stream = session_stream_text(spark, d).select(*KEY, F.col("text_hash").alias("stream_hash"), F.col("chars").alias("stream_chars"))
    artifacts = session_artifacts(spark, d).select(*KEY, F.col("n").alias("artifact_count"), F.sha2("artifacts", 256).alias("artifact_signature"))
    credentials = session_credentials(spark, d).select(*KEY, F.col("n").alias("credential_count"), "credentials")
    for part in (signature, entropy, stream, session_bigram_set(spark, d), artifacts, session_intents(spark, d), session_novelty(spark, d), credentials):
        out = out.join(part, KEY, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("unique_commands", "command_count", "bigrams", "artifact_count", "credential_count")}
    return out.withColumns(zero | {"entropy": F.coalesce("entropy", F.lit(0.0))})


def session_since(spark: SparkSession, d: str, days: int = 3) -> DataFrame:
    """The incremental run: only sessions whose close is newer than the stored high-water mark are rolled up again, over all their events.

    The mark is the newest close of the stored rows less `days`, since closes arrive late; `watermark` is the mark to store afterwards.
    """
    mark = slim_sessions(spark, d, "ended_at").agg((F.max("ended_at") - F.expr(f"INTERVAL {days} DAYS")).alias("mark"))  # one row
    e = events(spark, d)
    fresh = e.filter(F.col("event_action") == "session.closed").join(F.broadcast(mark)).filter(F.col("mark").isNull() | (F.col("ts") > F.col("mark"))).select(*KEY).distinct()
    rows = _base(e.join(fresh, KEY, "left_semi"))
    newest = rows.agg(F.max("ended_at").alias("watermark"))  # one row
    return rows.join(F.broadcast(newest)).select(*KEY, "started_at", "ended_at", *[c for c in COUNTERS], "source_ip", "classification", "watermark")


def rollup_decision(spark: SparkSession, d: str) -> DataFrame:
    """Whether all sessions are rolled up again, per enrichment setting in the cache: commands changed after the last roll-up, no version stored, another version, or clean.

    The stored version of a setting is its config_hash; the current one that of the newest entry.
    """
    c = table(spark, d, "enrichment_cache")
    rolled = table(spark, d, "sessions_rollup").agg(F.max("rolled_up_at").alias("rolled"))  # one row
    now = c.filter(F.col("config_hash") != "").agg(F.max(F.struct("enriched_at", "config_hash"))["config_hash"].alias("current"))  # one row
    g = c.groupBy("model", F.coalesce("config_hash", F.lit("")).alias("stored")).agg(F.max("enriched_at").alias("changed"), F.count_distinct("command_hash").alias("commands")).join(F.broadcast(rolled)).join(F.broadcast(now))
    why = F.when(F.col("changed") > F.col("rolled"), "command_corpus_dirty").when(F.col("stored") == "", "no_stored_schema_hash").when(F.col("stored") != F.col("current"), "rollup_schema_changed").otherwise("clean")
    return g.select("model", "stored", "commands", why.alias("reason"), (why != "clean").alias("full"))


QUERIES = {f.__name__: f for f in (session_intents, session_bigram_set, session_document, session_since, rollup_decision)}


def _first_sql(x: str) -> str:
    return f"first({x} ORDER BY ts, event_id) FILTER ({x} IS NOT NULL)"


_HASSH = "coalesce(hassh, md5(hassh_algorithms))"


def _base_sql(source: str) -> str:
    return f"""(SELECT sensor, session_id, coalesce(min(ts) FILTER (event_action = 'session.connect'), min(ts)) AS started_at, max(ts) FILTER (event_action = 'session.closed') AS ended_at, max(duration) FILTER (event_action = 'session.closed') AS duration,
        {', '.join(f"count(*) FILTER (event_action = '{a}') AS {n}" for n, a in COUNTERS.items())}, {', '.join(f'{_first_sql(c)} AS {n}' for n, c in ATTRIBUTES.items())}, {_first_sql(_HASSH)} AS hassh,
        count(DISTINCT file_sha256) AS distinct_files, {PUBLIC_SQL} AS classification FROM {source} GROUP BY 1, 2 HAVING count(*) FILTER (event_action = 'session.closed') > 0)"""


SQL = {
    "session_intents": f"""WITH n AS (SELECT sensor, session_id, intent, count(*) AS n FROM (SELECT DISTINCT sensor, session_id, h FROM {CMD}) JOIN commands ON h = command_hash WHERE intent IS NOT NULL GROUP BY 1, 2, 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY sensor, session_id ORDER BY n DESC, intent) AS r FROM n)
        SELECT sensor, session_id, min(intent) FILTER (r = 1) AS dominant_intent, string_agg(intent || '=' || n, ',' ORDER BY r) FILTER (r <= 3) AS intent_distribution FROM r GROUP BY 1, 2""",
    "session_bigram_set": f"""SELECT sensor, session_id, CAST(count(DISTINCT g) AS INTEGER) AS bigrams, substr(sha256(string_agg(DISTINCT g, '|' ORDER BY g)), 1, 32) AS bigram_signature FROM
        (SELECT sensor, session_id, h || '>' || lead(h) OVER (PARTITION BY sensor, session_id ORDER BY ts, event_id) AS g FROM {CMD}) WHERE g IS NOT NULL GROUP BY 1, 2""",
    "session_since": f"""WITH m AS (SELECT max(ended_at) - INTERVAL 3 DAY AS mark FROM {SESS}), f AS (SELECT DISTINCT sensor, session_id FROM {EV}, m WHERE event_action = 'session.closed' AND (mark IS NULL OR ts > mark)),
        b AS (SELECT * FROM {_base_sql(f'(SELECT e.* FROM {EV} e SEMI JOIN f USING (sensor, session_id))')})
        SELECT sensor, session_id, started_at, ended_at, {', '.join(COUNTERS)}, source_ip, classification, max(ended_at) OVER () AS watermark FROM b""",
    "rollup_decision": """WITH r AS (SELECT max(rolled_up_at) AS rolled FROM sessions_rollup), cur AS (SELECT config_hash AS current FROM enrichment_cache WHERE config_hash <> '' ORDER BY enriched_at DESC, config_hash DESC LIMIT 1),
        g AS (SELECT model, coalesce(config_hash, '') AS stored, max(enriched_at) AS changed, count(DISTINCT command_hash) AS commands FROM enrichment_cache GROUP BY 1, 2)
        SELECT model, stored, commands, CASE WHEN changed > rolled THEN 'command_corpus_dirty' WHEN stored = '' THEN 'no_stored_schema_hash' WHEN stored <> current THEN 'rollup_schema_changed' ELSE 'clean' END AS reason,
        NOT (changed <= rolled AND stored <> '' AND stored = current) AS full FROM g, r, cur""",
}
SQL["session_document"] = f"""SELECT b.*, coalesce(sensor, 'default') || ':' || session_id AS uid, coalesce(ended_at, started_at) AS anchor_at, coalesce(s1.n, 0) AS unique_commands, s1.signature AS command_signature, coalesce(s2.entropy, 0) AS entropy, coalesce(s2.commands, 0) AS command_count,
    s3.text_hash AS stream_hash, s3.chars AS stream_chars, coalesce(s4.bigrams, 0) AS bigrams, s4.bigram_signature, coalesce(s5.n, 0) AS artifact_count, sha256(s5.artifacts) AS artifact_signature, s6.dominant_intent, s6.intent_distribution,
    s7.mean_novelty, s7.max_novelty, s7.mean_confidence, coalesce(s8.n, 0) AS credential_count, s8.credentials FROM {_base_sql(EV)} b LEFT JOIN ({SESSIONS['session_signature']}) s1 USING (sensor, session_id) LEFT JOIN ({SESSIONS['session_entropy']}) s2 USING (sensor, session_id)
    LEFT JOIN ({SESSIONS['session_stream_text']}) s3 USING (sensor, session_id) LEFT JOIN ({SQL['session_bigram_set']}) s4 USING (sensor, session_id) LEFT JOIN ({SESSIONS['session_artifacts']}) s5 USING (sensor, session_id) LEFT JOIN ({SQL['session_intents']}) s6 USING (sensor, session_id)
    LEFT JOIN ({SESSIONS['session_novelty']}) s7 USING (sensor, session_id) LEFT JOIN ({SESSIONS['session_credentials']}) s8 USING (sensor, session_id)"""
