"""Session layer: one row per (sensor, session_id) from raw events, and what is derived from it (survey B1-B26, S1-S13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dist as D
from ..functions import text as X
from ..session import table
from .commands import PREDICATE_SQL, PUBLIC_SQL, rule_hits
from .commands import SQL as COMMANDS
from .common import CMD, EV, SESS, command_events, events, slim_sessions

KEY = ["sensor", "session_id"]


def session_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Closed sessions: start (connect, else first event), end, counters, first attributes, classification."""
    e = events(spark, d)
    a = F.col("event_action")
    return (
        e.groupBy(*KEY)
        .agg(
            F.count_if(a == "session.closed").alias("closes"),
            F.coalesce(F.min(F.when(a == "session.connect", F.col("ts"))), F.min("ts")).alias("started_at"),
            F.max(F.when(a == "session.closed", F.col("ts"))).alias("ended_at"),
            F.max(F.when(a == "session.closed", F.col("duration"))).alias("duration"),
            F.count_if(a == "login.success").alias("login_success"),
            F.count_if(a == "login.failed").alias("login_failed"),
            F.count_if(a == "command.input").alias("commands"),
            F.count_if(a == "session.file_download").alias("downloads"),
            F.min_by("source.ip", F.when(F.col("source.ip").isNotNull(), F.struct("ts", "event_id"))).alias("source_ip"),
            F.min_by("user_name", F.when(F.col("user_name").isNotNull(), F.struct("ts", "event_id"))).alias("user_name"),
            F.min_by("hassh", F.when(F.col("hassh").isNotNull(), F.struct("ts", "event_id"))).alias("hassh"),
            X.most_restrictive(F.col("classification")).alias("classification"),
        )
        .filter("closes > 0")
        .drop("closes")
    )


def open_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions without a close: they wait for the next run."""
    closed = events(spark, d).filter(F.col("event_action") == "session.closed").select(*KEY).distinct()
    seen = events(spark, d).groupBy(*KEY).agg(F.max("ts").alias("last_event"), F.count(F.lit(1)).alias("events"))
    return seen.join(closed, KEY, "left_anti")


def session_uid(spark: SparkSession, d: str) -> DataFrame:
    """Raw ids that occur on several sensors, with their sensor-namespaced keys."""
    s = events(spark, d).select(F.concat_ws(":", F.coalesce("sensor", F.lit("default")), "session_id").alias("uid"), "session_id").distinct()
    return s.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("uid")), ",").alias("uids")).filter("n > 1")


def _commands(spark: SparkSession, d: str) -> DataFrame:
    return command_events(spark, d).select(*KEY, "event_id", "ts", "h", "command")


def session_intent_mode(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent intent of a session's unique commands, ties by name, with its share."""
    c = _commands(spark, d).select(*KEY, "h").distinct().join(table(spark, d, "commands").select(F.col("command_hash").alias("h"), "intent").filter(F.col("intent").isNotNull()), "h")
    n = c.groupBy(*KEY, "intent").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*KEY)
    return n.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "intent"))).withColumn("total", F.sum("n").over(w)).filter("r = 1").select(*KEY, "intent", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def session_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Shannon entropy (bits) of a session's commands."""
    n = _commands(spark, d).groupBy(*KEY, "h").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*KEY).agg(F.round(D.entropy(F.collect_list(F.col("n").cast("double"))), 4).alias("entropy"), F.sum("n").alias("commands"))


def session_signature(spark: SparkSession, d: str) -> DataFrame:
    """Sorted unique command hashes and their 32-digit signature."""
    s = _commands(spark, d).groupBy(*KEY).agg(F.array_sort(F.collect_set("h")).alias("hs"))
    return s.select(*KEY, F.size("hs").alias("n"), X.short_hash(F.array_join("hs", "|"), 32).alias("signature"))


def session_bigrams(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive command pairs in time order, counted over all sessions."""
    w = Window.partitionBy(*KEY).orderBy("ts", "event_id")
    p = _commands(spark, d).select(*KEY, "h", F.lead("h").over(w).alias("b")).filter(F.col("b").isNotNull())
    return p.groupBy(F.col("h").alias("first_hash"), F.col("b").alias("second_hash")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*KEY)).alias("sessions"))


def session_stream_text(spark: SparkSession, d: str) -> DataFrame:
    """A session's commands in order as one text (hash and length given)."""
    s = _commands(spark, d).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "command"))).alias("x"))
    t = F.array_join("x.command", "\n")
    return s.select(*KEY, F.sha2(t, 256).alias("text_hash"), F.length(t).alias("chars"))


def session_idf_weight(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commands").select("command_hash", F.round(D.pool_weight(F.col("occurrence_count")), 6).alias("weight"))


def session_novelty(spark: SparkSession, d: str) -> DataFrame:
    """Mean and greatest novelty and mean confidence over a session's unique commands."""
    c = table(spark, d, "commands").select(F.col("command_hash").alias("h"), F.col("cluster.novelty_score").cast("double").alias("v"), "confidence")
    s = _commands(spark, d).select(*KEY, "h").distinct().join(c, "h")
    return s.groupBy(*KEY).agg(F.round(F.avg("v"), 4).alias("mean_novelty"), F.round(F.max("v"), 4).alias("max_novelty"), F.round(F.avg("confidence"), 2).alias("mean_confidence"))


def session_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Kind-prefixed indicators, rule hits and file hashes of a session, sorted."""
    ioc = table(spark, d, "commands").select(F.col("command_hash").alias("h"), F.explode("indicators").alias("i")).select("h", F.concat_ws(":", "i.ioc_kind", "i.ioc_value").alias("a"))
    from_cmd = _commands(spark, d).select(*KEY, "h").join(ioc, "h").select(*KEY, "a")
    files = events(spark, d).filter(F.col("file_sha256").isNotNull()).select(*KEY, F.concat(F.lit("hash:"), F.col("file_sha256")).alias("a"))
    rules = rule_hits(spark, d).select(F.col("command_hash").alias("h"), F.explode(F.split("hits", ",")).alias("r")).select("h", F.concat(F.lit("rule:"), "r").alias("a"))
    s = from_cmd.unionByName(files).unionByName(_commands(spark, d).select(*KEY, "h").distinct().join(rules, "h").select(*KEY, "a")).groupBy(*KEY).agg(F.array_sort(F.collect_set("a")).alias("x"))
    return s.select(*KEY, F.size("x").alias("n"), F.array_join("x", " ").alias("artifacts"))


# What a web or streaming client says that never stands in a real credential.
REQUEST_WORDS = ["GET", "POST", "HEAD", "PUT", "DELETE", "OPTIONS", "TRACE", "CONNECT", "PATCH"]
HEADER_NAMES = ["user-agent", "accept-encoding", "accept-language", "content-length", "content-type", "cache-control", "cseq", "referer", "upgrade-insecure-requests"]


def protocol_noise(c: F.Column) -> F.Column:
    """A protocol version or URL scheme anywhere, a request word in front, or a header's name before a colon anywhere."""
    version = F.exists(F.array(*map(F.lit, ["HTTP", "RTSP", "ICY"])), lambda p: F.regexp_like(c, F.concat(F.lit(r"\b"), p, F.lit(r"/\d"))))
    scheme = F.lower(c).rlike(r"\b[a-z][a-z0-9+.-]*://")
    request = F.upper(F.regexp_extract(c, r"^([A-Za-z]+)\s", 1)).isin(REQUEST_WORDS)
    # Every piece that a colon ends, with what stands before its last name character taken off.
    names = F.transform(F.split(F.lower(c), ":"), lambda x: F.regexp_extract(F.rtrim(x), r"([a-z-]+)$", 1))
    before_colon = F.slice(names, 1, F.size(names) - 1)
    header = F.exists(before_colon, lambda n: F.exists(F.array(*map(F.lit, HEADER_NAMES)), lambda h: (n == h) | F.endswith(n, F.concat(F.lit("-"), h))) | n.rlike(r"^(?:.*-)?(?:sec|x)-[a-z-]+$"))
    return version | scheme | request | header


def session_credentials(spark: SparkSession, d: str) -> DataFrame:
    """user:password pairs tried in a session without protocol noise; either side may be empty."""
    e = events(spark, d).filter(F.col("event_action").startswith("login.") & (F.col("user_name").isNotNull() | F.col("password").isNotNull()))
    cred = F.concat(F.coalesce("user_name", F.lit("")), F.lit(":"), F.coalesce("password", F.lit("")))
    e = e.select(*KEY, cred.alias("c")).filter(~protocol_noise(F.col("c")))
    return e.groupBy(*KEY).agg(F.array_sort(F.collect_set("c")).alias("x")).select(*KEY, F.size("x").alias("n"), F.array_join("x", " ").alias("credentials"))


def file_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Each downloaded file with the command before it, and what links them: url, destination, or order alone."""
    w = Window.partitionBy(*KEY).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = events(spark, d).filter(F.col("event_action").isin("command.input", "session.file_download"))
    last = F.last(F.when(F.col("event_action") == "command.input", F.col("command_line")), ignorenulls=True).over(w)
    f = e.select(*KEY, "event_id", "event_action", "file_sha256", "url", "destfile", last.alias("c")).filter((F.col("event_action") == "session.file_download") & F.col("file_sha256").isNotNull())
    basis = F.when(F.coalesce(F.contains("c", "url"), F.lit(False)), "url_match").when(F.coalesce(F.contains("c", "destfile"), F.lit(False)), "destfile_match").when(F.col("c").isNotNull(), "preceding_command")
    return f.select(*KEY, "event_id", "file_sha256", X.short_hash(X.normalize(F.col("c"))).alias("command_hash"), basis.alias("basis"))


def filename_match(spark: SparkSession, d: str) -> DataFrame:
    """Downloads linked to the first command of the session that names the file as a whole token (specific names only)."""
    f = events(spark, d).filter((F.col("event_action") == "session.file_download") & F.col("filename").isNotNull()).select(*KEY, F.col("event_id").alias("download_id"), "filename")
    name = F.element_at(F.split("filename", "/"), -1)
    f = f.withColumn("name", name).filter(F.col("name").rlike(r"\.[A-Za-z0-9]{1,6}$") | (F.length("name") >= 5))
    c = _commands(spark, d).select(*KEY, "ts", "event_id", "command", "h")
    # Joined on session and token, so a session's files don't meet all of its commands; only names that are sought are kept.
    token = c.select(*KEY, "ts", "event_id", "h", F.explode(F.array_distinct(F.split("command", r"[^A-Za-z0-9_.\-]+"))).alias("name"))
    hit = f.join(token.join(f.select("name").distinct(), "name", "left_semi"), [*KEY, "name"])
    return hit.groupBy(*KEY, "download_id", "name").agg(F.min_by("h", F.struct("ts", "event_id")).alias("command_hash"))


def hassh_fill(spark: SparkSession, d: str) -> DataFrame:
    """Client fingerprint, computed from the algorithms where it is missing; sessions per fingerprint."""
    e = events(spark, d).filter(F.col("hassh").isNotNull() | F.col("hassh_algorithms").isNotNull())
    return e.groupBy(F.coalesce("hassh", F.md5(F.col("hassh_algorithms").cast("binary"))).alias("fingerprint")).agg(F.count_distinct(F.struct(*KEY)).alias("sessions"))


def class_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Most restrictive classification per address."""
    s = slim_sessions(spark, d, "source.ip", "classification")
    return s.groupBy("source_ip").agg(X.most_restrictive(F.col("classification")).alias("classification"), F.count(F.lit(1)).alias("sessions"))


def session_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Predicates folded over a session: any for most, all for menu-only, several architectures for multi-arch."""
    c = F.col("command_line")
    per = table(spark, d, "commands").select(
        F.col("command_hash").alias("h"), *[X.predicate(c, k).alias(k) for k in X.PREDICATES], X.appliance_word(c).alias("menu"), X.architectures(c).alias("arch")
    )
    s = _commands(spark, d).select(*KEY, "h").distinct().join(per, "h").groupBy(*KEY).agg(
        *[F.bool_or(k).alias(k) for k in X.PREDICATES], F.bool_and("menu").alias("menu_only"), F.array_distinct(F.flatten(F.collect_list("arch"))).alias("arch")
    )
    multi = F.col("has_uname_m") | (F.col("has_case_word") & (F.size("arch") >= 1)) | (F.size("arch") >= 2)
    return s.select(*KEY, multi.alias("multi_arch"), "has_c2_launch", "has_self_spread", "has_host_info", (F.col("has_key_write") & F.col("has_immutability")).alias("key_write_immutability"), "menu_only", (F.col("has_directory_chain") & F.col("has_tool_fallback")).alias("hetero_fallback"))


def rollup_preserve(spark: SparkSession, d: str) -> DataFrame:
    """A fresh roll-up of counters that keeps the columns other steps own (playbook, cluster)."""
    fresh = session_rollup(spark, d).select(*KEY, F.col("commands").alias("command_count"))
    old = slim_sessions(spark, d, "playbook_id", "cluster.id", "command_count").withColumnRenamed("command_count", "old_count")
    return old.join(fresh, KEY, "left").select(*KEY, F.coalesce("command_count", "old_count").alias("command_count"), "playbook_id", "cluster_id")


def ingest_fields(spark: SparkSession, d: str) -> DataFrame:
    """Parsed event fields: category, outcome, address family, download host, path and extension."""
    a = F.col("event_action")
    e = events(spark, d)
    return e.select(
        "event_id",
        F.when(a.startswith("login."), "authentication").when(a == "session.file_download", "file").when(a == "command.input", "process").otherwise("network").alias("category"),
        F.when(a == "login.failed", "failure").when(a == "login.success", "success").otherwise("unknown").alias("outcome"),
        F.when(F.col("source.ip").contains(":"), "ipv6").when(F.col("source.ip").isNotNull(), "ipv4").alias("network_type"),
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://([^/:?]+)", 1)).alias("url_host"),
        F.regexp_extract(F.coalesce("url", F.lit("")), r"\.([A-Za-z0-9]{1,6})(?:\?|$)", 1).alias("extension"),
    )


def late_events(spark: SparkSession, d: str) -> DataFrame:
    """Events per day that a processing watermark would have missed: arrived over an hour after they happened."""
    lag = F.unix_micros("ingested_at") - F.unix_micros("ts")
    e = events(spark, d)
    return e.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("events"), F.count_if(lag > 3_600_000_000).alias("late"), F.max(F.floor(lag / 1_000_000)).alias("worst_seconds"))


QUERIES = {
    f.__name__: f
    for f in (
        session_rollup, open_sessions, session_uid, session_intent_mode, session_entropy, session_signature, session_bigrams, session_stream_text, session_idf_weight, session_novelty,
        session_artifacts, session_credentials, file_attribution, filename_match, hassh_fill, class_aggregate, session_predicates, rollup_preserve, ingest_fields, late_events,
    )
}

_NOISE = rf"""regexp_matches(c, '\b(HTTP|RTSP|ICY)/\d') OR regexp_matches(c, '(?i)\b[a-z][a-z0-9+.-]*://') OR regexp_matches(c, '(?i)^({'|'.join(REQUEST_WORDS)})\s')
        OR regexp_matches(c, '(?i)\b({'|'.join(HEADER_NAMES)}|sec-[a-z-]+|x-[a-z-]+)\s*:')"""
_ARCH = "list_filter([" + ", ".join(rf"CASE WHEN regexp_matches(lower(command_line), '\b{a}\b') THEN '{a}' END" for a in X.ARCHITECTURES) + "], lambda x: x IS NOT NULL)"
_ROLL = f"""SELECT sensor, session_id, coalesce(min(ts) FILTER (event_action = 'session.connect'), min(ts)) AS started_at, max(ts) FILTER (event_action = 'session.closed') AS ended_at,
    max(duration) FILTER (event_action = 'session.closed') AS duration, count(*) FILTER (event_action = 'login.success') AS login_success, count(*) FILTER (event_action = 'login.failed') AS login_failed,
    count(*) FILTER (event_action = 'command.input') AS commands, count(*) FILTER (event_action = 'session.file_download') AS downloads,
    first(source.ip ORDER BY ts, event_id) FILTER (source.ip IS NOT NULL) AS source_ip, first(user_name ORDER BY ts, event_id) FILTER (user_name IS NOT NULL) AS user_name,
    first(hassh ORDER BY ts, event_id) FILTER (hassh IS NOT NULL) AS hassh, {PUBLIC_SQL} AS classification
    FROM {EV} GROUP BY 1, 2 HAVING count(*) FILTER (event_action = 'session.closed') > 0"""
_UC = f"(SELECT DISTINCT sensor, session_id, h FROM {CMD})"
SQL = {
    "session_rollup": _ROLL,
    "open_sessions": f"SELECT sensor, session_id, max(ts) AS last_event, count(*) AS events FROM {EV} GROUP BY 1, 2 HAVING count(*) FILTER (event_action = 'session.closed') = 0",
    "session_uid": f"""SELECT session_id, count(*) AS n, string_agg(uid, ',' ORDER BY uid) AS uids FROM (SELECT DISTINCT session_id, coalesce(sensor, 'default') || ':' || session_id AS uid FROM {EV}) GROUP BY 1 HAVING count(*) > 1""",
    "session_intent_mode": f"""SELECT sensor, session_id, intent, n, round(n / sum(n) OVER (PARTITION BY sensor, session_id), 6) AS share FROM
        (SELECT sensor, session_id, intent, count(*) AS n FROM {_UC} JOIN commands ON h = command_hash WHERE intent IS NOT NULL GROUP BY 1, 2, 3)
        QUALIFY row_number() OVER (PARTITION BY sensor, session_id ORDER BY n DESC, intent) = 1""",
    "session_entropy": f"""SELECT sensor, session_id, round(sum(-p * log2(p)), 4) + 0 AS entropy, CAST(sum(n) AS BIGINT) AS commands FROM (SELECT *, n / sum(n) OVER (PARTITION BY sensor, session_id) AS p FROM
        (SELECT sensor, session_id, h, count(*) AS n FROM {CMD} GROUP BY 1, 2, 3)) GROUP BY 1, 2""",
    "session_signature": f"""SELECT sensor, session_id, CAST(len(hs) AS INTEGER) AS n, substr(sha256(array_to_string(hs, '|')), 1, 32) AS signature FROM
        (SELECT sensor, session_id, list_sort(list(DISTINCT h)) AS hs FROM {CMD} GROUP BY 1, 2)""",
    "session_bigrams": f"""SELECT h AS first_hash, b AS second_hash, count(*) AS n, count(DISTINCT (sensor, session_id)) AS sessions FROM (SELECT sensor, session_id, h, lead(h) OVER w AS b
        FROM {CMD} WINDOW w AS (PARTITION BY sensor, session_id ORDER BY ts, event_id)) WHERE b IS NOT NULL GROUP BY 1, 2""",
    "session_stream_text": f"""SELECT sensor, session_id, sha256(t) AS text_hash, CAST(length(t) AS INTEGER) AS chars FROM (SELECT sensor, session_id, array_to_string(list(command ORDER BY ts, event_id), chr(10)) AS t FROM {CMD} GROUP BY 1, 2)""",
    "session_idf_weight": "SELECT command_hash, round(greatest(ln(100001 / (greatest(least(coalesce(occurrence_count, 1), 100000), 1) + 1)), 0.0001), 6) AS weight FROM commands",
    "session_novelty": f"""SELECT sensor, session_id, round(avg(CAST(cluster.novelty_score AS DOUBLE)), 4) AS mean_novelty, round(max(CAST(cluster.novelty_score AS DOUBLE)), 4) AS max_novelty, round(avg(confidence), 2) AS mean_confidence
        FROM {_UC} JOIN commands ON h = command_hash GROUP BY 1, 2""",
    "session_artifacts": f"""SELECT sensor, session_id, CAST(len(x) AS INTEGER) AS n, array_to_string(x, ' ') AS artifacts FROM (SELECT sensor, session_id, list_sort(list(DISTINCT a)) AS x FROM (
        SELECT sensor, session_id, i.ioc_kind || ':' || i.ioc_value AS a FROM {_UC} JOIN (SELECT command_hash, unnest(indicators) AS i FROM commands) ON h = command_hash
        UNION ALL SELECT sensor, session_id, 'rule:' || r FROM {_UC} JOIN (SELECT command_hash, unnest(string_split(hits, ',')) AS r FROM ({COMMANDS['rule_hits']})) ON h = command_hash
        UNION ALL SELECT sensor, session_id, 'hash:' || file_sha256 FROM {EV} WHERE file_sha256 IS NOT NULL) GROUP BY 1, 2)""",
    "session_credentials": f"""SELECT sensor, session_id, CAST(len(x) AS INTEGER) AS n, array_to_string(x, ' ') AS credentials FROM (SELECT sensor, session_id, list_sort(list(DISTINCT c)) AS x FROM
        (SELECT sensor, session_id, coalesce(user_name, '') || ':' || coalesce(password, '') AS c FROM {EV} WHERE event_action LIKE 'login.%' AND (user_name IS NOT NULL OR password IS NOT NULL))
        WHERE NOT ({_NOISE}) GROUP BY 1, 2)""",
    "file_attribution": rf"""WITH c AS (SELECT * FROM {CMD}), f AS (SELECT * FROM {EV} WHERE event_action = 'session.file_download' AND file_sha256 IS NOT NULL)
        SELECT f.sensor, f.session_id, f.event_id, f.file_sha256, arg_max(c.h, (c.ts, c.event_id)) AS command_hash, CASE WHEN contains(arg_max(c.command_line, (c.ts, c.event_id)), any_value(f.url)) THEN 'url_match'
        WHEN contains(arg_max(c.command_line, (c.ts, c.event_id)), any_value(f.destfile)) THEN 'destfile_match' WHEN count(c.h) > 0 THEN 'preceding_command' END AS basis
        FROM f LEFT JOIN c ON f.sensor = c.sensor AND f.session_id = c.session_id AND (c.ts, c.event_id) < (f.ts, f.event_id) GROUP BY 1, 2, 3, 4""",
    "filename_match": rf"""SELECT f.sensor, f.session_id, f.event_id AS download_id, name, arg_min(h, (c.ts, c.event_id)) AS command_hash FROM
        (SELECT *, string_split(filename, '/')[-1] AS name FROM {EV} WHERE event_action = 'session.file_download' AND filename IS NOT NULL) f
        JOIN {CMD} c ON f.sensor = c.sensor AND f.session_id = c.session_id AND list_contains(regexp_split_to_array(c.command, '[^A-Za-z0-9_.\-]+'), name)
        WHERE regexp_matches(name, '\.[A-Za-z0-9]{{1,6}}$') OR length(name) >= 5 GROUP BY 1, 2, 3, 4""",
    "hassh_fill": f"SELECT coalesce(hassh, md5(hassh_algorithms)) AS fingerprint, count(DISTINCT (sensor, session_id)) AS sessions FROM {EV} WHERE hassh IS NOT NULL OR hassh_algorithms IS NOT NULL GROUP BY 1",
    "class_aggregate": f"SELECT source.ip AS source_ip, {PUBLIC_SQL} AS classification, count(*) AS sessions FROM {SESS} GROUP BY 1",
    "session_predicates": f"""WITH p AS (SELECT command_hash, {', '.join(f'coalesce({v}, false) AS {k}' for k, v in PREDICATE_SQL.items())},
        coalesce(lower(trim(command_line)) IN ('sh', 'shell', 'enable', 'system', 'linuxshell', 'help', 'busybox'), false) AS menu, {_ARCH} AS arch FROM commands),
        s AS (SELECT sensor, session_id, {', '.join(f'bool_or({k}) AS {k}' for k in PREDICATE_SQL)}, bool_and(menu) AS menu_only, len(list_distinct(flatten(list(arch)))) AS n FROM {_UC} JOIN p ON h = command_hash GROUP BY 1, 2)
        SELECT sensor, session_id, has_uname_m OR (has_case_word AND n >= 1) OR n >= 2 AS multi_arch, has_c2_launch, has_self_spread, has_host_info, has_key_write AND has_immutability AS key_write_immutability, menu_only,
        has_directory_chain AND has_tool_fallback AS hetero_fallback FROM s""",
    "rollup_preserve": f"""SELECT s.sensor, s.session_id, coalesce(r.commands, s.command_count) AS command_count, s.playbook_id, s.cluster.id AS cluster_id FROM {SESS} s LEFT JOIN ({_ROLL}) r ON s.sensor = r.sensor AND s.session_id = r.session_id""",
    "ingest_fields": rf"""SELECT event_id, CASE WHEN event_action LIKE 'login.%' THEN 'authentication' WHEN event_action = 'session.file_download' THEN 'file' WHEN event_action = 'command.input' THEN 'process' ELSE 'network' END AS category,
        CASE event_action WHEN 'login.failed' THEN 'failure' WHEN 'login.success' THEN 'success' ELSE 'unknown' END AS outcome, CASE WHEN contains(source.ip, ':') THEN 'ipv6' WHEN source.ip IS NOT NULL THEN 'ipv4' END AS network_type,
        lower(regexp_extract(coalesce(url, ''), '^[a-z]+://([^/:?]+)', 1)) AS url_host, regexp_extract(coalesce(url, ''), '\.([A-Za-z0-9]{{1,6}})(?:\?|$)', 1) AS extension FROM {EV}""",
    "late_events": f"""SELECT CAST(ts AS DATE) AS day, count(*) AS events, count(*) FILTER (epoch_us(ingested_at) - epoch_us(ts) > 3600000000) AS late, CAST(max(floor((epoch_us(ingested_at) - epoch_us(ts)) / 1000000)) AS BIGINT) AS worst_seconds FROM {EV} GROUP BY 1""",
}
