"""Entities tracked over runs, and what changed (survey G1-G15, H1-H19).  A run is a week of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dist as D
from ..session import table
from .common import SESS, slim_sessions

KEEP_SNAPSHOTS = 3
RETIRE_AFTER = 3


def _run(ts: Column) -> Column:
    return F.date_trunc("week", ts).cast("date")


def _dated(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return slim_sessions(spark, d, "started_at", *cols).withColumn("run", _run(F.col("started_at"))).filter(F.col("run").isNotNull())


def lifecycle_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Per playbook and run: sessions, addresses, mean novelty, most frequent intent (ties by name)."""
    s = _dated(spark, d, "playbook_id", "source.ip", "cluster.novelty_score", "dominant_intent").filter(F.col("playbook_id").isNotNull())
    base = s.groupBy("playbook_id", "run").agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct("source_ip").alias("addresses"), F.round(F.avg(F.col("cluster_novelty_score").cast("double")), 4).alias("mean_novelty"))
    mode = s.filter(F.col("dominant_intent").isNotNull()).groupBy("playbook_id", "run", "dominant_intent").agg(F.count(F.lit(1)).alias("n")).groupBy("playbook_id", "run").agg(F.min(F.struct(-F.col("n"), "dominant_intent"))["dominant_intent"].alias("dominant_intent"))
    return base.join(mode, ["playbook_id", "run"], "left")


def lifecycle_state(spark: SparkSession, d: str) -> DataFrame:
    """Runs observed, runs since last seen (silent), first and last run, retired or not, last snapshots."""
    s = _dated(spark, d, "playbook_id")
    runs = s.select("run").distinct()
    last = runs.agg(F.max("run").alias("newest"))
    seen = s.filter(F.col("playbook_id").isNotNull()).select("playbook_id", "run").distinct()
    g = seen.groupBy("playbook_id").agg(F.count(F.lit(1)).alias("runs_observed"), F.min("run").alias("first_run"), F.max("run").alias("last_run"), F.array_sort(F.collect_list("run")).alias("r"))
    silent = (F.datediff("newest", "last_run") / 7).cast("int")
    return g.join(F.broadcast(last)).select(
        "playbook_id", "runs_observed", "first_run", "last_run", silent.alias("silent_runs"), (silent >= RETIRE_AFTER).alias("retired"),
        F.array_join(F.transform(F.slice("r", F.greatest(F.size("r") - KEEP_SNAPSHOTS + 1, F.lit(1)), KEEP_SNAPSHOTS), lambda x: x.cast("string")), ",").alias("snapshots"),
    )


def provisional_anchors(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle_state(spark, d).filter("runs_observed >= 3 and silent_runs = 0").select("playbook_id", "runs_observed")


def thresholds(spark: SparkSession, d: str) -> DataFrame:
    """p50 to p99 (linear) of sessions and addresses per snapshot, with the lower limit of the upper band."""
    s = lifecycle_snapshots(spark, d)
    parts = []
    for layer in ("sessions", "addresses"):
        p = s.agg(F.percentile(layer, [0.5, 0.75, 0.9, 0.95, 0.99]).alias("p"), F.count(F.lit(1)).alias("n"))
        parts.append(p.select(F.lit(layer).alias("layer"), *[F.round(F.col("p")[i], 6).alias(k) for i, k in enumerate(("p50", "p75", "p90", "p95", "p99"))], "n", F.greatest(F.round(F.col("p")[1]), F.lit(2.0)).alias("band")))
    return parts[0].unionByName(parts[1])


def new_playbooks(spark: SparkSession, d: str) -> DataFrame:
    s = _dated(spark, d, "playbook_id", "source.ip").filter(F.col("playbook_id").isNotNull())
    g = s.groupBy("playbook_id").agg(F.count_distinct("run").alias("runs"), F.count(F.lit(1)).alias("s"), F.count_distinct("source_ip").alias("i"))
    return g.filter("runs <= 2").select("playbook_id", F.round(F.log1p("s") + F.log1p("i"), 6).alias("score"))


def verdict_flip(spark: SparkSession, d: str) -> DataFrame:
    """Addresses whose most frequent intent differs from the run before."""
    s = _dated(spark, d, "source.ip", "dominant_intent").filter(F.col("source_ip").isNotNull() & F.col("dominant_intent").isNotNull())
    m = s.groupBy("source_ip", "run", "dominant_intent").agg(F.count(F.lit(1)).alias("n")).groupBy("source_ip", "run").agg(F.min(F.struct(-F.col("n"), "dominant_intent"))["dominant_intent"].alias("intent"))
    p = m.withColumn("before", F.lag("intent").over(Window.partitionBy("source_ip").orderBy("run")))
    return p.filter("before <> intent").select("source_ip", "run", "before", F.col("intent").alias("now"))


def _distribution(s: DataFrame, who: str, what: str) -> DataFrame:
    n = s.groupBy(who, "run", what).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return n.groupBy(who, "run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(what).cast("string"), "n")))).alias("m"), F.sum("n").alias("total"))


def js_shift(spark: SparkSession, d: str) -> DataFrame:
    """Jensen-Shannon distance of an address's playbooks between its latest two runs, with at least five sessions in the latest."""
    s = _dated(spark, d, "source.ip", "playbook_id").filter(F.col("source_ip").isNotNull() & F.col("playbook_id").isNotNull())
    w = Window.partitionBy("source_ip").orderBy("run")
    p = _distribution(s, "source_ip", "playbook_id").withColumn("prior", F.lag("m").over(w)).withColumn("r", F.row_number().over(Window.partitionBy("source_ip").orderBy(F.desc("run"))))
    return p.filter("r = 1 and total >= 5 and prior is not null").select("source_ip", "run", F.round(D.jensen_shannon(F.col("prior"), F.col("m")), 5).alias("js"))


def outlier_burst(spark: SparkSession, d: str) -> DataFrame:
    """Credentials that at least three outlier sessions of one day share, with addresses and score."""
    s = slim_sessions(spark, d, "source.ip", "started_at", "cluster.is_outlier", "credentials").filter("cluster_is_outlier")
    c = s.select(F.to_date("started_at").alias("day"), "sensor", "session_id", "source_ip", F.explode(F.array_distinct("credentials")).alias("credential"))
    g = c.groupBy("day", "credential").agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct("source_ip").alias("addresses")).filter("sessions >= 3")
    return g.withColumn("score", F.round(F.log1p("sessions") + F.log1p("addresses"), 6))


def convergence(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of playbooks whose address sets overlap by at least half of the smaller one."""
    p = slim_sessions(spark, d, "source.ip", "playbook_id").filter("source_ip is not null and playbook_id is not null").select("source_ip", "playbook_id").distinct()
    n = p.groupBy("playbook_id").agg(F.count(F.lit(1)).alias("n"))
    sets = p.groupBy("source_ip").agg(F.array_sort(F.collect_set("playbook_id")).alias("x")).filter(F.size("x") > 1)
    pair = sets.select("x", F.posexplode("x").alias("i", "a")).select("a", F.explode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    out = pair.join(n.select(F.col("playbook_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("playbook_id").alias("b"), F.col("n").alias("nb")), "b")
    out = out.withColumn("ratio", F.round(F.col("common") / F.least("na", "nb"), 6)).filter("ratio >= 0.5")
    return out.select("a", "b", "common", "ratio", F.round(F.col("ratio") + F.log1p("common"), 6).alias("score"))


def _first_last(df: DataFrame, who: str, col: str) -> DataFrame:
    g = df.groupBy(who).agg(F.min(F.struct("run", col))[col].alias("a"), F.max(F.struct("run", col))[col].alias("b"), F.count(F.lit(1)).alias("runs"))
    return g.filter("runs > 1")


def drift_commands(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard similarity of a playbook's commands between its first and latest run, with what came and went."""
    s = _dated(spark, d, "playbook_id", "command_set").filter(F.col("playbook_id").isNotNull()).select("playbook_id", "run", F.explode(F.array_compact("command_set")).alias("h"))
    p = _first_last(s.groupBy("playbook_id", "run").agg(F.array_sort(F.collect_set("h")).alias("hs")), "playbook_id", "hs")
    return p.select("playbook_id", F.round(D.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.size(F.array_except("b", "a")).alias("added"), F.size(F.array_except("a", "b")).alias("removed"), (D.jaccard(F.col("a"), F.col("b")) < 0.5).alias("drift"))


def drift_geo(spark: SparkSession, d: str) -> DataFrame:
    """Cosine distance of a playbook's networks between its first and latest run."""
    s = _dated(spark, d, "playbook_id", "source.asn.number").filter("playbook_id is not null and source_asn_number is not null")
    n = s.groupBy("playbook_id", "run", "source_asn_number").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("playbook_id")
    e = n.withColumn("r0", F.min("run").over(w)).withColumn("r1", F.max("run").over(w)).filter("r0 < r1")
    v = e.groupBy("playbook_id", "source_asn_number").agg(F.sum(F.when(F.col("run") == F.col("r0"), F.col("n")).otherwise(0)).cast("double").alias("x"), F.sum(F.when(F.col("run") == F.col("r1"), F.col("n")).otherwise(0)).cast("double").alias("y"))
    g = v.groupBy("playbook_id").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return g.select("playbook_id", F.round(1 - F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")), 6).alias("distance"))


def drift_size(spark: SparkSession, d: str) -> DataFrame:
    s = _dated(spark, d, "playbook_id", "source.ip").filter("playbook_id is not null")
    p = _first_last(s.groupBy("playbook_id", "run").agg(F.count_distinct("source_ip").alias("n")), "playbook_id", "n")
    grown = (F.col("b") - F.col("a") >= 3) & ((F.col("a") == 0) | ((F.col("b") - F.col("a")) / F.col("a") >= 0.75))
    return p.select("playbook_id", F.col("a").alias("first_addresses"), F.col("b").alias("last_addresses"), F.coalesce(grown, F.lit(False)).alias("drift"))


def resurgence(spark: SparkSession, d: str) -> DataFrame:
    """The latest gap of at least 48 hours between consecutive sessions of an address."""
    s = slim_sessions(spark, d, "source.ip", "started_at").filter(F.col("source_ip").isNotNull())
    w = Window.partitionBy("source_ip").orderBy("started_at", "sensor", "session_id")
    g = s.select("source_ip", "started_at", F.lag("started_at").over(w).alias("before")).withColumn("hours", F.floor((F.unix_micros("started_at") - F.unix_micros("before")) / 3_600_000_000))
    x = g.filter("hours >= 48").groupBy("source_ip").agg(F.max(F.struct("started_at", "hours")).alias("x"), F.count(F.lit(1)).alias("gaps"))
    return x.select("source_ip", F.col("x.started_at").alias("resumed_at"), F.col("x.hours").alias("hours"), "gaps")


def coverage_findings(spark: SparkSession, d: str) -> DataFrame:
    """Session clusters ranked by ln(1 + sessions) * (mean novelty + 0.01)."""
    s = slim_sessions(spark, d, "cluster.id", "cluster.is_outlier", "cluster.novelty_score", "source.ip", "started_at").filter("cluster_id is not null and not cluster_is_outlier")
    g = s.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct("source_ip").alias("addresses"), F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"), F.avg(F.col("cluster_novelty_score").cast("double")).alias("nov"))
    return g.select("cluster_id", "sessions", "addresses", "first_seen", "last_seen", F.round(F.log1p("sessions") * (F.coalesce("nov", F.lit(0.0)) + 0.01), 5).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        lifecycle_snapshots, lifecycle_state, provisional_anchors, thresholds, new_playbooks, verdict_flip, js_shift, outlier_burst, convergence, drift_commands, drift_geo, drift_size, resurgence, coverage_findings,
    )
}

_D = f"(SELECT *, CAST(date_trunc('week', started_at) AS DATE) AS run FROM {SESS} WHERE started_at IS NOT NULL)"
_SNAP = f"""(SELECT playbook_id, run, count(*) AS sessions, count(DISTINCT source.ip) AS addresses, round(avg(cluster.novelty_score::DOUBLE), 4) AS mean_novelty,
    (SELECT x.i FROM (SELECT dominant_intent AS i, count(*) AS n FROM {_D} y WHERE y.playbook_id = z.playbook_id AND y.run = z.run AND dominant_intent IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) x) AS dominant_intent
    FROM {_D} z WHERE playbook_id IS NOT NULL GROUP BY 1, 2)"""
_STATE = f"""(SELECT playbook_id, count(*) AS runs_observed, min(run) AS first_run, max(run) AS last_run, CAST((SELECT max(run) FROM {_D}) - max(run) AS INTEGER) // 7 AS silent_runs,
    array_to_string(list_sort(list(run::VARCHAR))[-3:], ',') AS snapshots FROM (SELECT DISTINCT playbook_id, run FROM {_D} WHERE playbook_id IS NOT NULL) GROUP BY 1)"""
_TH = "round(quantile_cont({0}, 0.5), 6) AS p50, round(quantile_cont({0}, 0.75), 6) AS p75, round(quantile_cont({0}, 0.9), 6) AS p90, round(quantile_cont({0}, 0.95), 6) AS p95, round(quantile_cont({0}, 0.99), 6) AS p99, count(*) AS n, greatest(round(quantile_cont({0}, 0.75)), 2) AS band"
SQL = {
    "lifecycle_snapshots": f"SELECT * FROM {_SNAP}",
    "lifecycle_state": f"SELECT playbook_id, runs_observed, first_run, last_run, silent_runs, silent_runs >= 3 AS retired, snapshots FROM {_STATE}",
    "provisional_anchors": f"SELECT playbook_id, runs_observed FROM {_STATE} WHERE runs_observed >= 3 AND silent_runs = 0",
    "thresholds": f"WITH s AS (SELECT playbook_id, run, count(*) AS sessions, count(DISTINCT source.ip) AS addresses FROM {_D} WHERE playbook_id IS NOT NULL GROUP BY 1, 2) SELECT 'sessions' AS layer, {_TH.format('sessions')} FROM s UNION ALL SELECT 'addresses', {_TH.format('addresses')} FROM s",
    "new_playbooks": f"SELECT playbook_id, round(ln(1 + count(*)) + ln(1 + count(DISTINCT source.ip)), 6) AS score FROM {_D} WHERE playbook_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT run) <= 2",
    "verdict_flip": f"""WITH m AS (SELECT source_ip, run, intent FROM (SELECT source.ip AS source_ip, run, dominant_intent AS intent, count(*) AS n FROM {_D} WHERE source.ip IS NOT NULL AND dominant_intent IS NOT NULL GROUP BY 1, 2, 3)
        QUALIFY row_number() OVER (PARTITION BY source_ip, run ORDER BY n DESC, intent) = 1)
        SELECT source_ip, run, before, intent AS now FROM (SELECT *, lag(intent) OVER (PARTITION BY source_ip ORDER BY run) AS before FROM m) WHERE before <> intent""",
    "js_shift": f"""WITH n AS (SELECT source.ip AS ip, run, playbook_id AS p, count(*) AS n FROM {_D} WHERE source.ip IS NOT NULL AND playbook_id IS NOT NULL GROUP BY 1, 2, 3),
        r AS (SELECT ip, run, sum(n) AS total, row_number() OVER (PARTITION BY ip ORDER BY run DESC) AS k FROM n GROUP BY 1, 2),
        a AS (SELECT n.ip, n.run, p, n / total AS x FROM n JOIN r USING (ip, run) WHERE k = 1 AND total >= 5), b AS (SELECT n.ip, p, n / total AS y FROM n JOIN r USING (ip, run) WHERE k = 2),
        j AS (SELECT coalesce(a.ip, b.ip) AS ip, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN b ON a.ip = b.ip AND a.p = b.p)
        SELECT j.ip AS source_ip, r1.run, round(sqrt(greatest(sum(CASE WHEN x > 0 THEN x * log2(x / ((x + y) / 2)) / 2 ELSE 0 END + CASE WHEN y > 0 THEN y * log2(y / ((x + y) / 2)) / 2 ELSE 0 END), 0)), 5) AS js
        FROM j JOIN r r1 ON r1.ip = j.ip AND r1.k = 1 AND r1.total >= 5 JOIN r r2 ON r2.ip = j.ip AND r2.k = 2 GROUP BY 1, 2""",
    "outlier_burst": f"""SELECT day, credential, count(*) AS sessions, count(DISTINCT source_ip) AS addresses, round(ln(1 + count(*)) + ln(1 + count(DISTINCT source_ip)), 6) AS score FROM
        (SELECT CAST(started_at AS DATE) AS day, source.ip AS source_ip, unnest(list_distinct(credentials)) AS credential FROM {SESS} WHERE cluster.is_outlier) GROUP BY 1, 2 HAVING count(*) >= 3""",
    "convergence": f"""WITH p AS (SELECT DISTINCT source.ip AS ip, playbook_id AS p FROM {SESS} WHERE source.ip IS NOT NULL AND playbook_id IS NOT NULL), n AS (SELECT p, count(*) AS n FROM p GROUP BY 1),
        j AS (SELECT x.p AS a, y.p AS b, count(*) AS common FROM p x JOIN p y ON x.ip = y.ip AND x.p < y.p GROUP BY 1, 2), r AS (SELECT a, b, common, round(common / least(na.n, nb.n), 6) AS ratio FROM j JOIN n na ON na.p = a JOIN n nb ON nb.p = b)
        SELECT a, b, common, ratio, round(ratio + ln(1 + common), 6) AS score FROM r WHERE ratio >= 0.5""",
    "drift_commands": f"""WITH c AS (SELECT DISTINCT playbook_id AS p, run, h FROM (SELECT playbook_id, run, unnest(command_set) AS h FROM {_D} WHERE playbook_id IS NOT NULL) WHERE h IS NOT NULL),
        e AS (SELECT p, min(run) AS r0, max(run) AS r1 FROM c GROUP BY 1 HAVING min(run) < max(run)), f AS (SELECT p, h, bool_or(run = r0) AS a, bool_or(run = r1) AS b FROM c JOIN e USING (p) WHERE run IN (r0, r1) GROUP BY 1, 2)
        SELECT p AS playbook_id, round(count(*) FILTER (a AND b) / count(*), 6) AS jaccard, CAST(count(*) FILTER (b AND NOT a) AS INTEGER) AS added, CAST(count(*) FILTER (a AND NOT b) AS INTEGER) AS removed, count(*) FILTER (a AND b) / count(*) < 0.5 AS drift FROM f GROUP BY 1""",
    "drift_geo": f"""WITH n AS (SELECT playbook_id AS p, run, source.asn.number AS a, count(*) AS n FROM {_D} WHERE playbook_id IS NOT NULL AND source.asn.number IS NOT NULL GROUP BY 1, 2, 3),
        e AS (SELECT p, min(run) AS r0, max(run) AS r1 FROM n GROUP BY 1 HAVING min(run) < max(run)), v AS (SELECT p, a, coalesce(sum(n) FILTER (run = r0), 0) AS x, coalesce(sum(n) FILTER (run = r1), 0) AS y FROM n JOIN e USING (p) GROUP BY 1, 2)
        SELECT p AS playbook_id, round(1 - sum(x * y) / sqrt(sum(x * x)::DOUBLE * sum(y * y)), 6) + 0 AS distance FROM v GROUP BY 1""",
    "drift_size": f"""WITH n AS (SELECT playbook_id AS p, run, count(DISTINCT source.ip) AS n FROM {_D} WHERE playbook_id IS NOT NULL GROUP BY 1, 2), g AS (SELECT p, arg_min(n, run) AS a, arg_max(n, run) AS b FROM n GROUP BY 1 HAVING count(*) > 1)
        SELECT p AS playbook_id, a AS first_addresses, b AS last_addresses, b - a >= 3 AND (a = 0 OR (b - a) / a >= 0.75) AS drift FROM g""",
    "resurgence": f"""WITH g AS (SELECT source.ip AS ip, started_at, (epoch_us(started_at) - epoch_us(lag(started_at) OVER (PARTITION BY source.ip ORDER BY started_at, sensor, session_id))) // 3600000000 AS hours FROM {SESS} WHERE source.ip IS NOT NULL)
        SELECT ip AS source_ip, max(started_at) AS resumed_at, arg_max(hours, (started_at, hours)) AS hours, count(*) AS gaps FROM g WHERE hours >= 48 GROUP BY 1""",
    "coverage_findings": f"""SELECT cluster.id AS cluster_id, count(*) AS sessions, count(DISTINCT source.ip) AS addresses, min(started_at) AS first_seen, max(started_at) AS last_seen,
        round(ln(1 + count(*)) * (coalesce(avg(cluster.novelty_score::DOUBLE), 0) + 0.01), 5) AS score FROM {SESS} WHERE cluster.id IS NOT NULL AND NOT cluster.is_outlier GROUP BY 1""",
}
