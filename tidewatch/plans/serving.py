"""Serving queries: search, facets of entities, activity bands, interest, episodes, comparison (survey J1-J21, D28-D30)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dist as D
from ..session import table
from .common import EV, SESS, events, slim_sessions


def search(spark: SparkSession, d: str) -> DataFrame:
    """One query ("root") over commands, playbooks and files, case-insensitive, merged by score, 40 best."""
    q = "root"
    c = table(spark, d, "commands").filter(F.lower("command_line").contains(q)).select(F.lit("command").alias("type"), F.col("command_hash").alias("id"), F.col("command_line").alias("label"), F.log1p(F.col("occurrence_count")).alias("score"))
    p = table(spark, d, "session_clusters").filter(F.contains(F.lower("playbook_name"), F.lit(q))).groupBy("playbook_id").agg(F.min("playbook_name").alias("label"), F.sum("n_sessions").alias("n"))
    p = p.select(F.lit("playbook"), "playbook_id", "label", F.log1p("n"))
    f = events(spark, d).filter(F.contains(F.lower("filename"), F.lit(q))).groupBy("file_sha256").agg(F.min("filename").alias("label"), F.count(F.lit(1)).alias("n")).filter("file_sha256 is not null")
    f = f.select(F.lit("file"), "file_sha256", "label", F.log1p("n"))
    return c.union(p).union(f).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "type", "id").limit(40)


def history_bands(spark: SparkSession, d: str) -> DataFrame:
    """Sessions per playbook and day over the whole axis, days without any as 0."""
    s = slim_sessions(spark, d, "playbook_id", "started_at").filter("started_at is not null").withColumn("day", F.to_date("started_at"))
    axis = s.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    p = s.filter("playbook_id is not null")
    grid = p.select("playbook_id").distinct().join(F.broadcast(axis)).select("playbook_id", F.explode(F.sequence("a", "b")).alias("day"))
    n = p.groupBy("playbook_id", "day").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["playbook_id", "day"], "left").select("playbook_id", "day", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def history_score(spark: SparkSession, d: str) -> DataFrame:
    """Interest of playbooks: mass, liveness (last fifth), trend (late against early half), recurrence (episodes) and escalation, each min-max scaled over all."""
    b = history_bands(spark, d)
    w = Window.partitionBy("playbook_id").orderBy("day")
    n_all = F.count(F.lit(1)).over(Window.partitionBy("playbook_id"))
    x = b.withColumn("i", F.row_number().over(w)).withColumn("m", n_all)
    gap = F.greatest(F.lit(2), F.floor(F.col("m") / 15))
    last = F.last(F.when(F.col("n") > 0, F.col("i")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("starts", ((F.col("n") > 0) & (last.isNull() | (F.col("i") - last > gap))).cast("int"))
    half, fifth = F.floor(F.col("m") / 2), F.greatest(F.floor(F.col("m") / 5), F.lit(1))
    g = x.groupBy("playbook_id").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("i") > F.col("m") - fifth, F.col("n")).otherwise(0)).alias("recent"), F.sum(F.when(F.col("i") <= half, F.col("n")).otherwise(0)).alias("early"),
        F.sum(F.when(F.col("i") > F.col("m") - half, F.col("n")).otherwise(0)).alias("late"), F.sum("starts").alias("episodes"),
    )
    nov = slim_sessions(spark, d, "playbook_id", "cluster.novelty_score").filter("playbook_id is not null").groupBy("playbook_id").agg(F.avg(F.col("cluster_novelty_score").cast("double")).alias("esc"))
    g = g.join(nov, "playbook_id").select(
        "playbook_id", F.round(F.log1p("total"), 8).alias("mass"), F.round(F.col("recent") / F.col("total"), 8).alias("live"), F.round(F.coalesce((F.col("late") - F.col("early")) / F.expr("nullif(late + early, 0)"), F.lit(0.0)), 8).alias("trend"),
        (F.col("episodes") - 1).cast("double").alias("rec"), F.round(F.coalesce("esc", F.lit(0.0)), 5).alias("esc"),
    )
    # One row of extremes instead of a window over everything in one partition.
    names = {"mass": 0.30, "live": 0.25, "trend": 0.20, "rec": 0.15, "esc": 0.10}
    ends = g.agg(*[F.min(k).alias(f"lo_{k}") for k in names], *[F.max(k).alias(f"hi_{k}") for k in names])
    score = sum((wt * D.min_max(F.col(k), F.col(f"lo_{k}"), F.col(f"hi_{k}")) for k, wt in names.items()), F.lit(0.0))
    return g.join(F.broadcast(ends)).select("playbook_id", F.round(100 * score, 1).alias("interest"), F.when(F.col("trend") >= 0.15, "up").when(F.col("trend") <= -0.15, "down").otherwise("flat").alias("direction"))


def episodes(spark: SparkSession, d: str) -> DataFrame:
    """Active spells of an address: sessions not more than two days apart."""
    s = slim_sessions(spark, d, "source.ip", "started_at").filter("source_ip is not null and started_at is not null")
    w = Window.partitionBy("source_ip").orderBy("started_at", "sensor", "session_id")
    new = (F.unix_micros("started_at") - F.unix_micros(F.lag("started_at").over(w)) > 2 * 86_400_000_000).cast("int")
    e = s.withColumn("new", F.coalesce(new, F.lit(1))).withColumn("episode", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("source_ip", "episode").agg(F.count(F.lit(1)).alias("sessions"), F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"))


def standouts(spark: SparkSession, d: str) -> DataFrame:
    """Ten session clusters with the highest mean novelty * log1p(addresses)."""
    s = slim_sessions(spark, d, "cluster.id", "cluster.novelty_score", "source.ip").filter("cluster_id is not null")
    g = s.groupBy("cluster_id").agg(F.avg(F.col("cluster_novelty_score").cast("double")).alias("nov"), F.count_distinct("source_ip").alias("addresses"))
    return g.select("cluster_id", "addresses", F.round(F.col("nov") * F.log1p("addresses"), 5).alias("score")).orderBy(F.desc("score"), "cluster_id").limit(10)


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """Sessions in order with the swim-lane of their sensor, gap to the one before on the lane, and the lane's total."""
    s = slim_sessions(spark, d, "started_at", "source.ip", "command_count").filter("started_at is not null and command_count > 0")
    # Numbered day by day, and days placed by a table of a row per sensor and day, so a busy sensor is many tasks' work.
    s = s.withColumn("day", F.to_date("started_at"))
    lane = Window.partitionBy("sensor").orderBy("day")
    days = s.groupBy("sensor", "day").agg(F.count(F.lit(1)).alias("n"), F.max("started_at").alias("last"))
    days = days.select(
        "sensor", "day", F.coalesce(F.sum("n").over(lane.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"), F.lag("last").over(lane).alias("previous"), F.sum("n").over(Window.partitionBy("sensor")).alias("total")
    )
    w = Window.partitionBy("sensor", "day").orderBy("started_at", "session_id")
    gap = F.floor((F.unix_micros("started_at") - F.unix_micros(F.coalesce(F.lag("started_at").over(w), "previous"))) / 1_000_000)
    return s.join(days, ["sensor", "day"]).select("sensor", "session_id", "started_at", "source_ip", (F.col("before") + F.row_number().over(w)).cast("int").alias("position"), gap.alias("gap_seconds"), "total")


def sensor_health(spark: SparkSession, d: str) -> DataFrame:
    """Last event of every sensor and whether it is behind the newest by more than six hours."""
    e = events(spark, d).filter("sensor is not null").groupBy("sensor").agg(F.max("ts").alias("last_event"), F.count(F.lit(1)).alias("events"))
    now = e.agg(F.max("last_event").alias("now"))
    return e.join(F.broadcast(now)).select("sensor", "last_event", "events", F.when(F.col("last_event") < F.col("now") - F.expr("INTERVAL 6 HOURS"), "behind").otherwise("ok").alias("state"))


def run_health(spark: SparkSession, d: str) -> DataFrame:
    """Latest enrichment of each (model, prompt version), and the start of its current burst (calls at most six hours apart)."""
    e = table(spark, d, "enrichment_cache").select("model", "prompt_version", "enriched_at", "command_hash").distinct()
    w = Window.partitionBy("model", "prompt_version").orderBy("enriched_at", "command_hash")
    new = (F.unix_micros("enriched_at") - F.unix_micros(F.lag("enriched_at").over(w)) > 6 * 3_600_000_000).cast("int")
    b = e.withColumn("b", F.sum(F.coalesce(new, F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = b.groupBy("model", "prompt_version", "b").agg(F.min("enriched_at").alias("burst_start"), F.max("enriched_at").alias("last_call"), F.count(F.lit(1)).alias("calls"))
    top = g.groupBy("model", "prompt_version").agg(F.max(F.struct("b", "burst_start", "last_call", "calls")).alias("x"))
    return top.select("model", "prompt_version", F.col("x.burst_start").alias("burst_start"), F.col("x.last_call").alias("last_call"), F.col("x.calls").alias("calls"))


def compare_playbooks(spark: SparkSession, d: str) -> DataFrame:
    """Each playbook against the one with the most sessions: shared and own commands, Jaccard similarity."""
    s = slim_sessions(spark, d, "playbook_id", "command_set").filter("playbook_id is not null")
    g = s.select("playbook_id", F.explode_outer(F.array_compact("command_set")).alias("h")).groupBy("playbook_id").agg(F.collect_set("h").alias("hs"))
    n = s.groupBy("playbook_id").agg(F.count(F.lit(1)).alias("n"))
    big = n.orderBy(F.desc("n"), "playbook_id").limit(1).join(g, "playbook_id").select(F.col("playbook_id").alias("against"), F.col("hs").alias("bs"))
    x = g.join(F.broadcast(big)).filter("playbook_id <> against")
    return x.select("playbook_id", "against", F.size(F.array_intersect("hs", "bs")).alias("shared"), F.size(F.array_except("hs", "bs")).alias("own"), F.size(F.array_except("bs", "hs")).alias("missing"), F.round(D.jaccard(F.col("hs"), F.col("bs")), 6).alias("jaccard"))


def pivot_intents(spark: SparkSession, d: str) -> DataFrame:
    """Sessions per sensor with one column for each of four intents."""
    s = slim_sessions(spark, d, "dominant_intent")
    p = s.groupBy("sensor").pivot("dominant_intent", ["host_recon", "cryptomining", "download_ingress", "unknown"]).count()
    return p.select("sensor", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("host_recon", "cryptomining", "download_ingress", "unknown")])


def brief_citations(spark: SparkSession, d: str) -> DataFrame:
    """Documents that name an address of the data (bracketed dots undone), with the addresses."""
    t = F.regexp_replace("text", r"\[\.\]|\(\.\)", ".")
    named = table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b((?:\d{1,3}\.){3}\d{1,3})\b")))).alias("ip"))
    known = table(spark, d, "commands").select(F.explode("indicators").alias("i")).filter(F.col("i.ioc_kind") == "ip").select(F.col("i.ioc_value").alias("ip")).distinct()
    return named.join(known, "ip", "left_semi").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("ip")), ",").alias("cited"))


QUERIES = {f.__name__: f for f in (search, history_bands, history_score, episodes, standouts, timeline, sensor_health, run_health, compare_playbooks, pivot_intents, brief_citations)}

_BANDS = f"""ax AS (SELECT min(CAST(started_at AS DATE)) AS a, max(CAST(started_at AS DATE)) AS b FROM {SESS}), pb AS (SELECT playbook_id, CAST(started_at AS DATE) AS day, count(*) AS n FROM {SESS} WHERE playbook_id IS NOT NULL AND started_at IS NOT NULL GROUP BY 1, 2),
    bands AS (SELECT p.playbook_id, CAST(g.day AS DATE) AS day, coalesce(n, 0) AS n FROM (SELECT DISTINCT playbook_id FROM pb) p, (SELECT unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM ax) g LEFT JOIN pb ON pb.playbook_id = p.playbook_id AND pb.day = CAST(g.day AS DATE))"""
SQL = {
    "search": f"""SELECT * FROM (SELECT 'command' AS type, command_hash AS id, command_line AS label, round(ln(1 + occurrence_count), 6) AS score FROM commands WHERE contains(lower(command_line), 'root')
        UNION ALL SELECT 'playbook', playbook_id, min(playbook_name), round(ln(1 + sum(n_sessions)), 6) FROM session_clusters WHERE contains(lower(playbook_name), 'root') GROUP BY playbook_id
        UNION ALL SELECT 'file', file_sha256, min(filename), round(ln(1 + count(*)), 6) FROM {EV} WHERE contains(lower(filename), 'root') AND file_sha256 IS NOT NULL GROUP BY file_sha256) ORDER BY score DESC, type, id LIMIT 40""",
    "history_bands": f"WITH {_BANDS} SELECT playbook_id, day, n FROM bands",
    "history_score": f"""WITH {_BANDS}, x AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY playbook_id) AS m FROM bands WINDOW w AS (PARTITION BY playbook_id ORDER BY day)),
        y AS (SELECT *, max(CASE WHEN n > 0 THEN i END) OVER (PARTITION BY playbook_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM x),
        g AS (SELECT playbook_id, round(ln(1 + sum(n)), 8) AS mass, round(coalesce(sum(n) FILTER (i > m - greatest(m // 5, 1)), 0) / sum(n), 8) AS live, coalesce(sum(n) FILTER (i <= m // 2), 0) AS e, coalesce(sum(n) FILTER (i > m - m // 2), 0) AS l,
        count(*) FILTER (n > 0 AND (last IS NULL OR i - last > greatest(2, m // 15))) - 1 AS rec FROM y GROUP BY 1),
        nv AS (SELECT playbook_id, round(coalesce(avg(cluster.novelty_score::DOUBLE), 0), 5) AS esc FROM {SESS} WHERE playbook_id IS NOT NULL GROUP BY 1),
        h AS (SELECT g.*, esc, round(coalesce((l - e) / nullif(l + e, 0), 0), 8) AS trend FROM g JOIN nv ON g.playbook_id = nv.playbook_id),
        z AS (SELECT min(mass) AS am, max(mass) AS bm, min(live) AS al, max(live) AS bl, min(trend) AS tl, max(trend) AS th, min(rec) AS ar, max(rec) AS br, min(esc) AS ae, max(esc) AS be FROM h)
        SELECT playbook_id, round(100 * (0.30 * CASE WHEN bm > am THEN (mass - am) / (bm - am) ELSE 0.5 END + 0.25 * CASE WHEN bl > al THEN (live - al) / (bl - al) ELSE 0.5 END + 0.20 * CASE WHEN th > tl THEN (trend - tl) / (th - tl) ELSE 0.5 END
        + 0.15 * CASE WHEN br > ar THEN (rec - ar) / (br - ar) ELSE 0.5 END + 0.10 * CASE WHEN be > ae THEN (esc - ae) / (be - ae) ELSE 0.5 END), 1) AS interest,
        CASE WHEN trend >= 0.15 THEN 'up' WHEN trend <= -0.15 THEN 'down' ELSE 'flat' END AS direction FROM h, z""",
    "episodes": f"""WITH s AS (SELECT source.ip AS source_ip, started_at, sensor, session_id, epoch_us(started_at) - epoch_us(lag(started_at) OVER (PARTITION BY source.ip ORDER BY started_at, sensor, session_id)) AS gap FROM {SESS} WHERE source.ip IS NOT NULL AND started_at IS NOT NULL),
        e AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 172800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY source_ip ORDER BY started_at, sensor, session_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM s)
        SELECT source_ip, episode, count(*) AS sessions, min(started_at) AS first_seen, max(started_at) AS last_seen FROM e GROUP BY 1, 2""",
    "standouts": f"SELECT cluster.id AS cluster_id, count(DISTINCT source.ip) AS addresses, round(avg(cluster.novelty_score::DOUBLE) * ln(1 + count(DISTINCT source.ip)), 5) AS score FROM {SESS} WHERE cluster.id IS NOT NULL GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10",
    "timeline": f"""SELECT sensor, session_id, started_at, source.ip AS source_ip, CAST(row_number() OVER w AS INTEGER) AS position, (epoch_us(started_at) - epoch_us(lag(started_at) OVER w)) // 1000000 AS gap_seconds, count(*) OVER (PARTITION BY sensor) AS total
        FROM {SESS} WHERE started_at IS NOT NULL AND command_count > 0 WINDOW w AS (PARTITION BY sensor ORDER BY started_at, session_id)""",
    "sensor_health": f"""WITH e AS (SELECT sensor, max(ts) AS last_event, count(*) AS events FROM {EV} WHERE sensor IS NOT NULL GROUP BY 1)
        SELECT sensor, last_event, events, CASE WHEN last_event < (SELECT max(last_event) FROM e) - INTERVAL 6 HOURS THEN 'behind' ELSE 'ok' END AS state FROM e""",
    "run_health": """WITH e AS (SELECT DISTINCT model, prompt_version, enriched_at, command_hash FROM enrichment_cache), g AS (SELECT *, epoch_us(enriched_at) - epoch_us(lag(enriched_at) OVER (PARTITION BY model, prompt_version ORDER BY enriched_at, command_hash)) AS gap FROM e),
        b AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY model, prompt_version ORDER BY enriched_at, command_hash ROWS UNBOUNDED PRECEDING) AS b FROM g)
        SELECT model, prompt_version, min(enriched_at) AS burst_start, max(enriched_at) AS last_call, count(*) AS calls FROM b GROUP BY model, prompt_version, b QUALIFY row_number() OVER (PARTITION BY model, prompt_version ORDER BY b DESC) = 1""",
    "compare_playbooks": f"""WITH s AS (SELECT playbook_id AS p, command_set FROM {SESS} WHERE playbook_id IS NOT NULL), n AS (SELECT p, count(*) AS n FROM s GROUP BY 1), b AS (SELECT p AS against FROM n ORDER BY n DESC, p LIMIT 1),
        c AS (SELECT DISTINCT p, h FROM (SELECT p, unnest(command_set) AS h FROM s) WHERE h IS NOT NULL), o AS (SELECT h FROM c, b WHERE p = against), k AS (SELECT count(*) AS k FROM o),
        j AS (SELECT n.p, count(c.h) AS mine, count(o.h) AS shared FROM n LEFT JOIN c ON c.p = n.p LEFT JOIN o ON o.h = c.h GROUP BY 1)
        SELECT p AS playbook_id, against, CAST(shared AS INTEGER) AS shared, CAST(mine - shared AS INTEGER) AS own, CAST(k - shared AS INTEGER) AS missing, round(CASE WHEN mine + k - shared = 0 THEN 1 ELSE shared / (mine + k - shared) END, 6) AS jaccard FROM j, b, k WHERE p <> against""",
    "pivot_intents": f"""SELECT sensor, count(*) FILTER (dominant_intent = 'host_recon') AS host_recon, count(*) FILTER (dominant_intent = 'cryptomining') AS cryptomining, count(*) FILTER (dominant_intent = 'download_ingress') AS download_ingress,
        count(*) FILTER (dominant_intent = 'unknown') AS unknown FROM {SESS} GROUP BY 1""",
    "brief_citations": r"""WITH d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(regexp_replace(text, '\[\.\]|\(\.\)', '.', 'g'), '\b(?:\d{1,3}\.){3}\d{1,3}\b')) AS ip FROM documents), k AS (SELECT DISTINCT i.ioc_value AS ip FROM (SELECT unnest(indicators) AS i FROM commands) WHERE i.ioc_kind = 'ip')
        SELECT doc_id, string_agg(ip, ',' ORDER BY ip) AS cited FROM d JOIN k USING (ip) GROUP BY 1""",
}
