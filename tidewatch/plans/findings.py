"""Findings: hunts, noise gate, upsert, facets (survey H20-H35)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators.hunts import load_hunts, run_hunts
from ..operators.upsert import tombstone, upsert
from .common import SESS, slim_sessions

HUNTS = [
    {"id": "miner-staging", "where": {"intent_in": ["cryptomining"], "command_count_gte": 5}},
    {"id": "brute-force", "where": {"login_fail_gte": 4, "window_days": 7}},
    {"id": "weak-root", "where": {"artifact_any": ["root:admin1", "root:123456", "admin:admin1"]}, "cap": 50},
    {"id": "novel-busy", "where": {"novelty_gte": 0.4, "command_count_gte": 8}},
    {"id": "asleep", "where": {"intent_in": ["host_recon"]}, "enabled": False},
]


def hunts(spark: SparkSession, d: str) -> DataFrame:
    """Matches of all enabled hunts over all sessions (credentials as artifacts); `now` is the newest session's start."""
    s = slim_sessions(spark, d, "started_at", "dominant_intent", "command_count", "cluster.novelty_score", "credentials", "login_fail_count")
    s = s.withColumnRenamed("credentials", "artifacts").withColumnRenamed("cluster_novelty_score", "novelty")
    now = s.agg(F.max("started_at").alias("now"))
    hit = run_hunts(s.join(F.broadcast(now)), load_hunts(HUNTS), F.col("now"), [F.desc("started_at"), "sensor", "session_id"])
    return hit.select("hunt_id", "sensor", "session_id", "rank", F.concat(F.lit("find-hun-"), X.short_hash(F.concat_ws(":", "hunt_id", "sensor", "session_id"))).alias("finding_id"))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """One finding per (kind, session): outlier sessions, sessions with many failed logins, confidential sessions."""
    s = slim_sessions(spark, d, "started_at", "source.ip", "cluster.is_outlier", "cluster.novelty_score", "login_fail_count", "classification", "command_count")
    kinds = F.array_compact(F.array(F.when(F.col("cluster_is_outlier"), F.lit("outlier")), F.when(F.col("login_fail_count") >= 4, F.lit("brute")), F.when(F.col("classification") == "confidential", F.lit("confidential"))))
    f = s.select("sensor", "session_id", "started_at", "source_ip", F.explode(kinds).alias("kind"), F.round(F.coalesce(F.col("cluster_novelty_score").cast("double"), F.lit(0.0)) + F.log1p(F.coalesce("command_count", F.lit(0))), 5).alias("score"))
    return f.withColumn("finding_id", F.concat(F.lit("find-"), F.substring("kind", 1, 3), F.lit("-"), X.short_hash(F.concat_ws(":", "kind", "sensor", "session_id"))))


def noise_gate(spark: SparkSession, d: str) -> DataFrame:
    """Kinds that more than 0.5 percent of all sessions raise are suppressed."""
    total = slim_sessions(spark, d, "started_at").agg(F.count(F.lit(1)).alias("total"))
    n = _findings(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("emitted")).join(F.broadcast(total))
    return n.select("kind", "emitted", F.round(F.col("emitted") / F.col("total"), 6).alias("share"), (F.col("emitted") / F.col("total") > 0.005).alias("suppressed"))


def findings_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Findings before a date as the old table (all confirmed), all findings as the new batch; status and first sighting survive."""
    f = _findings(spark, d).select("finding_id", "kind", "score", F.col("started_at").alias("first_seen_at"))
    cut = F.to_timestamp(F.lit("2026-01-15 00:00:00"))
    old = f.filter(F.col("first_seen_at") < cut).withColumn("score", F.lit(0.0)).withColumn("status", F.lit("confirmed")).withColumn("first_seen_at", F.col("first_seen_at") - F.expr("INTERVAL 1 DAY"))
    return upsert(old, f, ["finding_id"], ["status", "first_seen_at"], {"status": "new"})


def findings_tombstone(spark: SparkSession, d: str) -> DataFrame:
    """Findings whose address is still active in the last ten days of the data."""
    f = _findings(spark, d).filter(F.col("source_ip").isNotNull()).select("finding_id", "source_ip")
    live = slim_sessions(spark, d, "source.ip", "started_at").filter(F.col("source_ip").isNotNull() & (F.col("started_at") >= F.to_timestamp(F.lit("2026-01-20 00:00:00"))))
    return tombstone(f, live, ["source_ip"]).select("finding_id", "source_ip")


PICK = {"kind": "outlier", "sensor": "edge-01"}


def facets(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every facet value under the other facets' filters (a facet doesn't filter itself)."""
    band = F.when(F.col("score") < 0.5, "low").when(F.col("score") < 1.5, "mid").otherwise("high")
    f = _findings(spark, d).select("kind", "sensor", band.alias("band"))
    parts = []
    for facet in ("kind", "sensor", "band"):
        cond = F.lit(True)
        for other, value in PICK.items():
            if other != facet:
                cond = cond & (F.col(other) == value)
        parts.append(f.filter(cond).groupBy(F.col(facet).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(facet).alias("facet"), "value", "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def findings_page(spark: SparkSession, d: str) -> DataFrame:
    """The inbox's second page of 25, best score first."""
    return _findings(spark, d).orderBy(F.desc("score"), "finding_id").offset(25).limit(25).select("finding_id", "kind", "score")


def findings_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per sensor: findings, those of the last week, addresses, worst finding."""
    f = _findings(spark, d)
    newest = f.agg(F.max("started_at").alias("t"))
    return f.join(F.broadcast(newest)).groupBy("sensor").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(F.col("started_at") > F.col("t") - F.expr("INTERVAL 7 DAYS")).alias("recent"), F.count_distinct("source_ip").alias("addresses"),
        F.min(F.struct(-F.col("score"), "finding_id"))["finding_id"].alias("worst"),
    )


def evidence_quality(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of an address's findings: a single point, strong (both thresholds met) or moderate."""
    g = _findings(spark, d).filter(F.col("source_ip").isNotNull()).groupBy("source_ip").agg(F.count_distinct(F.struct("sensor", "session_id")).alias("sessions"), F.count_distinct("kind").alias("kinds"))
    band = F.when(F.col("sessions") <= 1, "Single-point").when((F.col("sessions") >= 5) & (F.col("kinds") >= 2), "Strong").otherwise("Moderate")
    return g.select("source_ip", band.alias("quality"), F.format_string("%s: %d sessions, %d kinds", band, "sessions", "kinds").alias("verdict"))


QUERIES = {f.__name__: f for f in (hunts, noise_gate, findings_upsert, findings_tombstone, facets, findings_page, findings_summary, evidence_quality)}

_F = f"""f AS (SELECT *, 'find-' || substr(kind, 1, 3) || '-' || substr(sha256(kind || ':' || sensor || ':' || session_id), 1, 16) AS finding_id FROM (
    SELECT sensor, session_id, started_at, source.ip AS source_ip, unnest(list_filter([CASE WHEN cluster.is_outlier THEN 'outlier' END, CASE WHEN login_fail_count >= 4 THEN 'brute' END,
    CASE WHEN classification = 'confidential' THEN 'confidential' END], lambda x: x IS NOT NULL)) AS kind, round(coalesce(cluster.novelty_score::DOUBLE, 0) + ln(1 + coalesce(command_count, 0)), 5) AS score FROM {SESS}))"""
SQL = {
    "hunts": f"""WITH s AS (SELECT *, (SELECT max(started_at) FROM sessions_rollup) AS now FROM {SESS}), h AS (
        SELECT 'miner-staging' AS hunt_id, 500 AS cap, * FROM s WHERE dominant_intent = 'cryptomining' AND command_count >= 5
        UNION ALL SELECT 'brute-force', 500, * FROM s WHERE login_fail_count >= 4 AND started_at >= now - INTERVAL 7 DAYS
        UNION ALL SELECT 'weak-root', 50, * FROM s WHERE list_has_any(credentials, ['root:admin1', 'root:123456', 'admin:admin1'])
        UNION ALL SELECT 'novel-busy', 500, * FROM s WHERE cluster.novelty_score >= 0.4 AND command_count >= 8)
        SELECT hunt_id, sensor, session_id, CAST(row_number() OVER (PARTITION BY hunt_id ORDER BY started_at DESC, sensor, session_id) AS INTEGER) AS rank,
        'find-hun-' || substr(sha256(hunt_id || ':' || sensor || ':' || session_id), 1, 16) AS finding_id FROM h QUALIFY rank <= cap""",
    "noise_gate": f"WITH {_F}, t AS (SELECT count(*) AS total FROM {SESS}) SELECT kind, count(*) AS emitted, round(count(*) / any_value(total), 6) AS share, count(*) / any_value(total) > 0.005 AS suppressed FROM f, t GROUP BY 1",
    "findings_upsert": f"""WITH {_F} SELECT finding_id, kind, score, CASE WHEN started_at < TIMESTAMPTZ '2026-01-15 00:00:00+00' THEN started_at - INTERVAL 1 DAY ELSE started_at END AS first_seen_at,
        CASE WHEN started_at < TIMESTAMPTZ '2026-01-15 00:00:00+00' THEN 'confirmed' ELSE 'new' END AS status FROM f""",
    "findings_tombstone": f"WITH {_F} SELECT finding_id, source_ip FROM f WHERE source_ip IN (SELECT source.ip FROM {SESS} WHERE source.ip IS NOT NULL AND started_at >= TIMESTAMPTZ '2026-01-20 00:00:00+00')",
    "facets": f"""WITH {_F}, b AS (SELECT kind, sensor, CASE WHEN score < 0.5 THEN 'low' WHEN score < 1.5 THEN 'mid' ELSE 'high' END AS band FROM f)
        SELECT 'kind' AS facet, kind AS value, count(*) AS n FROM b WHERE sensor = 'edge-01' GROUP BY 2 UNION ALL SELECT 'sensor', sensor, count(*) FROM b WHERE kind = 'outlier' GROUP BY 2
        UNION ALL SELECT 'band', band, count(*) FROM b WHERE kind = 'outlier' AND sensor = 'edge-01' GROUP BY 2""",
    "findings_page": f"WITH {_F} SELECT finding_id, kind, score FROM f ORDER BY score DESC, finding_id LIMIT 25 OFFSET 25",
    "findings_summary": f"""WITH {_F} SELECT sensor, count(*) AS findings, count(*) FILTER (started_at > (SELECT max(started_at) FROM f) - INTERVAL 7 DAYS) AS recent, count(DISTINCT source_ip) AS addresses,
        first(finding_id ORDER BY score DESC, finding_id) AS worst FROM f GROUP BY 1""",
    "evidence_quality": f"""WITH {_F}, g AS (SELECT source_ip, count(DISTINCT (sensor, session_id)) AS s, count(DISTINCT kind) AS k FROM f WHERE source_ip IS NOT NULL GROUP BY 1),
        q AS (SELECT *, CASE WHEN s <= 1 THEN 'Single-point' WHEN s >= 5 AND k >= 2 THEN 'Strong' ELSE 'Moderate' END AS quality FROM g) SELECT source_ip, quality, quality || ': ' || s || ' sessions, ' || k || ' kinds' AS verdict FROM q""",
}
