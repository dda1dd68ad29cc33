"""Entities followed over daily runs, campaigns meeting campaigns, and what changed (survey F9, F10, G2-G5, G7, G8, G14, H2, H3, H5-H8, H13, H14, H17, H18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dist as D
from ..functions import text as X
from ..operators.graph import connected_components
from ..session import cut_lineage
from .campaigns import _ART, _COMP, _UID, _artifacts, uid
from .common import CMD, SESS, command_events, slim_sessions

#: Snapshots kept of an entity, silent runs after which it is retired, and runs after which it is stable.
SNAPSHOTS, STABLE = 30, 8
RETIRE = {"playbook": 120, "campaign": 120, "address": 28}
OVERLAP, GREW = 0.4, 1.5
BURST_HOURS, BURST_SESSIONS, BURST_TOP = 24, 5, 200


def _day(ts: str | Column) -> Column:
    return F.to_date(ts)


def _infra(spark: SparkSession, d: str) -> DataFrame:
    """(campaign_id, uid, source_ip): members of infrastructure campaigns, components of sessions over artifacts that two or more share."""
    a = cut_lineage(_artifacts(spark, d))
    shared = a.groupBy("artifact").agg(F.count_distinct("uid").alias("df")).filter("df >= 2").select("artifact")
    use = a.join(shared, "artifact")
    m = use.join(connected_components(use, "uid", "artifact"), use.uid == F.col("node")).select("component", "uid", "source_ip").distinct()
    big = m.groupBy("component").agg(F.count_distinct("uid").alias("s"), F.count_distinct("source_ip").alias("i")).filter("s >= 3 and i >= 2").select("component")
    return m.join(big, "component").select(F.concat(F.lit("cmp-inf-"), X.short_hash(F.col("component"))).alias("campaign_id"), "uid", "source_ip")


def entity_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Per entity (playbook, address, campaign) and day: sessions, addresses, mean novelty, most frequent intent."""
    s = slim_sessions(spark, d, "started_at", "playbook_id", "source.ip", "cluster.novelty_score", "dominant_intent").withColumn("uid", uid())
    s = s.select("uid", _day("started_at").alias("day"), "playbook_id", "source_ip", F.col("cluster_novelty_score").cast("double").alias("nov"), "dominant_intent").filter("day is not null")
    member = s.join(_infra(spark, d).select("campaign_id", "uid").distinct(), "uid")
    rest = ["day", "source_ip", "nov", "dominant_intent"]
    e = (
        s.filter("playbook_id is not null").select(F.lit("playbook").alias("entity"), F.col("playbook_id").alias("id"), *rest)
        .unionByName(s.filter("source_ip is not null").select(F.lit("address").alias("entity"), F.col("source_ip").alias("id"), *rest))
        .unionByName(member.select(F.lit("campaign").alias("entity"), F.col("campaign_id").alias("id"), *rest))
    )
    # One pass: counts per intent first, then the day's sums over them.
    base = e.groupBy("entity", "id", "day").agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct("source_ip").alias("addresses"), F.round(F.avg("nov"), 4).alias("mean_novelty"))
    n = e.filter("dominant_intent is not null").groupBy("entity", "id", "day", "dominant_intent").agg(F.count(F.lit(1)).alias("n"))
    mode = n.groupBy("entity", "id", "day").agg(F.min(F.struct(-F.col("n"), "dominant_intent"))["dominant_intent"].alias("intent"))
    return base.join(mode, ["entity", "id", "day"], "left")


def lifecycle_docs(spark: SparkSession, d: str) -> DataFrame:
    """One row per entity: runs observed, silent runs since, first and last day, the last SNAPSHOTS snapshots, retired or stable."""
    s = entity_snapshots(spark, d)
    newest = slim_sessions(spark, d, "started_at").agg(F.max(_day("started_at")).alias("newest"))  # one row
    snap = F.struct("day", F.concat_ws(":", F.col("day").cast("string"), F.col("sessions").cast("string"), F.col("addresses").cast("string"), F.coalesce("intent", F.lit("-"))).alias("text"))
    g = s.groupBy("entity", "id").agg(F.count(F.lit(1)).alias("runs_observed"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.array_sort(F.collect_list(snap)).alias("x"))  # a row per day
    silent = F.datediff("newest", "last_day")
    after = F.create_map(*[F.lit(v) for kv in RETIRE.items() for v in kv])[F.col("entity")]
    kept = F.slice(F.col("x.text"), F.greatest(F.size("x") - SNAPSHOTS + 1, F.lit(1)), SNAPSHOTS)
    return g.join(F.broadcast(newest)).select(
        "entity", "id", "runs_observed", "first_day", "last_day", silent.alias("silent_runs"), (silent >= after).alias("retired"), ((F.col("runs_observed") >= STABLE) & (silent == 0)).alias("stable"),
        F.size(kept).alias("snapshots"), X.short_hash(F.array_join(kept, "|")).alias("history_hash"),
    )


def band_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Lower limits of the strong evidence band: 75th percentile of the latest snapshot's sessions and addresses of playbooks, at least 2; 20 and 5 without any."""
    s = entity_snapshots(spark, d).filter("entity = 'playbook'")
    last = s.groupBy("id").agg(F.max(F.struct("day", "sessions", "addresses")).alias("x")).select("x.sessions", "x.addresses")
    p = last.agg(F.percentile("sessions", 0.75).alias("s"), F.percentile("addresses", 0.75).alias("a"), F.count(F.lit(1)).alias("n"))
    limit = lambda c, default: F.when(F.col("n") > 0, F.greatest(F.bround(c, 0), F.lit(2.0))).otherwise(float(default)).cast("int")
    return p.select(limit(F.col("s"), 20).alias("sessions"), limit(F.col("a"), 5).alias("addresses"), "n")


def _new_entities(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle_docs(spark, d).filter("runs_observed = 1")


def new_entities(spark: SparkSession, d: str) -> DataFrame:
    """Playbooks, campaigns and addresses seen in one run only, with ln(1 + sessions) + ln(1 + addresses)."""
    one = _new_entities(spark, d).select("entity", "id")
    return entity_snapshots(spark, d).join(one, ["entity", "id"]).select("entity", "id", F.round(F.log1p("sessions") + F.log1p("addresses"), 6).alias("score"))


def campaign_findings(spark: SparkSession, d: str) -> DataFrame:
    """One finding per infrastructure campaign: ln(1 + addresses) * ln(1 + sessions)."""
    g = _infra(spark, d).groupBy("campaign_id").agg(F.count_distinct("uid").alias("sessions"), F.count_distinct("source_ip").alias("addresses"))
    return g.withColumn("score", F.round(F.log1p("addresses") * F.log1p("sessions"), 6)).withColumn("finding_id", F.concat(F.lit("find-cam-"), X.short_hash(F.concat(F.lit("campaign:"), "campaign_id"))))


def behaviour_shift(spark: SparkSession, d: str) -> DataFrame:
    """Addresses whose playbooks changed between their latest two days: another commonest one, or a Jensen-Shannon distance of at least 0.3; five sessions on the latest day."""
    s = slim_sessions(spark, d, "started_at", "source.ip", "playbook_id").filter("source_ip is not null and playbook_id is not null and started_at is not null")
    n = s.groupBy("source_ip", _day("started_at").alias("day"), "playbook_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    m = n.groupBy("source_ip", "day").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("playbook_id", "n")))).alias("m"), F.sum("n").alias("total"), F.min(F.struct(-F.col("n"), "playbook_id"))["playbook_id"].alias("mode")
    )
    w = Window.partitionBy("source_ip").orderBy("day")
    p = m.withColumn("prior", F.lag("m").over(w)).withColumn("was", F.lag("mode").over(w)).withColumn("r", F.row_number().over(Window.partitionBy("source_ip").orderBy(F.desc("day"))))
    j = p.filter("r = 1 and total >= 5 and prior is not null").withColumn("js", F.round(D.jensen_shannon(F.col("prior"), F.col("m")), 5))
    return j.filter((F.col("was") != F.col("mode")) | (F.col("js") >= 0.3)).select("source_ip", "day", "was", F.col("mode").alias("now"), "js")


def artifact_burst(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts (urls and file hashes) that at least five outlier sessions of the last 24 hours share; the 200 highest scores."""
    s = slim_sessions(spark, d, "started_at", "cluster.is_outlier").withColumn("uid", uid())
    newest = s.agg(F.max("started_at").alias("t"))  # one row
    hot = s.filter("cluster_is_outlier").join(F.broadcast(newest)).filter(F.col("started_at") >= F.col("t") - F.expr(f"INTERVAL {BURST_HOURS} HOURS")).select("uid")
    g = _artifacts(spark, d).join(hot, "uid").groupBy("artifact").agg(F.count_distinct("uid").alias("sessions"), F.count_distinct("source_ip").alias("addresses")).filter(F.col("sessions") >= BURST_SESSIONS)
    return g.withColumn("score", F.round(F.log1p("sessions") + F.log1p("addresses"), 6)).orderBy(F.desc("score"), "artifact").limit(BURST_TOP)


def _common(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y, common, nx, ny, ratio): groups of `a` and `b` (g, ip) with addresses in common; addresses with the same groups are counted together."""
    na, nb = (z.groupBy("g").agg(F.count(F.lit(1)).alias("n")) for z in (a, b))
    both = a.groupBy("ip").agg(F.array_sort(F.collect_set("g")).alias("xs")).join(b.groupBy("ip").agg(F.array_sort(F.collect_set("g")).alias("ys")), "ip").groupBy("xs", "ys").agg(F.count(F.lit(1)).alias("w"))
    pair = both.select("ys", "w", F.explode("xs").alias("x")).select("x", "w", F.explode("ys").alias("y")).groupBy("x", "y").agg(F.sum("w").alias("common"))
    out = pair.join(na.select(F.col("g").alias("x"), F.col("n").alias("nx")), "x").join(nb.select(F.col("g").alias("y"), F.col("n").alias("ny")), "y")
    return out.withColumn("ratio", F.round(F.col("common") / F.least("nx", "ny"), 6))


def _playbook_members(spark: SparkSession, d: str, until: Column | None = None) -> DataFrame:
    """Behaviour groups: the addresses of each playbook.  A campaign of several playbooks is held by the addresses all of them have."""
    s = slim_sessions(spark, d, "source.ip", "playbook_id", "started_at").filter("source_ip is not null and playbook_id is not null")
    return (s.filter(until) if until is not None else s).select(F.col("playbook_id").alias("g"), F.col("source_ip").alias("ip")).distinct()


def campaign_convergence(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of infrastructure campaigns whose addresses overlap by OVERLAP of the smaller one."""
    m = _infra(spark, d).filter("source_ip is not null").select(F.col("campaign_id").alias("g"), F.col("source_ip").alias("ip")).distinct()
    c = _common(m, m).filter(F.col("x") < F.col("y")).filter(F.col("ratio") >= OVERLAP)
    return c.select(F.col("x").alias("a"), F.col("y").alias("b"), "common", "ratio", F.round(F.col("ratio") + F.log1p("common"), 6).alias("score"))


def operations(spark: SparkSession, d: str) -> DataFrame:
    """Behaviour and infrastructure campaigns of which at least OVERLAP of the smaller one's addresses are common; with the earlier start and later end."""
    s = slim_sessions(spark, d, "source.ip", "playbook_id", "started_at").withColumn("uid", uid())
    infra = cut_lineage(_infra(spark, d))
    m = infra.filter("source_ip is not null").select(F.col("campaign_id").alias("g"), F.col("source_ip").alias("ip")).distinct()
    when = s.filter("playbook_id is not null").select(F.col("playbook_id").alias("g"), "started_at").unionByName(infra.select(F.col("campaign_id").alias("g"), "uid").distinct().join(s, "uid").select("g", "started_at"))
    span = when.groupBy("g").agg(F.min("started_at").alias("a"), F.max("started_at").alias("b"))
    c = _common(_playbook_members(spark, d), m).filter(F.col("ratio") >= OVERLAP)
    c = c.join(span.select(F.col("g").alias("x"), F.col("a").alias("xa"), F.col("b").alias("xb")), "x").join(span.select(F.col("g").alias("y"), F.col("a").alias("ya"), F.col("b").alias("yb")), "y")
    key = F.array_join(F.array_sort(F.array("x", "y")), "|")
    return c.select(
        F.concat(F.lit("op-"), X.short_hash(key)).alias("operation_id"), F.col("x").alias("behaviour_id"), F.col("y").alias("infrastructure_id"), F.col("common").alias("shared_addresses"), "ratio",
        F.least("xa", "ya").alias("first_seen"), F.greatest("xb", "yb").alias("last_seen"),
    )


def operation_emergence(spark: SparkSession, d: str) -> DataFrame:
    """Operations that formed in the last week of the data, or grew to 1.5 times the addresses they shared before."""
    newest = slim_sessions(spark, d, "started_at").agg(F.max("started_at").alias("t")).first().t  # one value
    if newest is None:
        return spark.createDataFrame([], "operation_id string, event string, shared_addresses bigint, prior bigint")
    infra = _infra(spark, d).filter("source_ip is not null")
    s = slim_sessions(spark, d, "started_at").select(uid().alias("uid"), "started_at")
    early = F.col("started_at") <= F.lit(newest) - F.expr("INTERVAL 7 DAYS")
    timed = cut_lineage(infra.join(s, "uid").select(F.col("campaign_id").alias("g"), F.col("source_ip").alias("ip"), "started_at"))
    now = _common(_playbook_members(spark, d), timed.select("g", "ip").distinct()).filter(F.col("ratio") >= OVERLAP)
    before = _common(_playbook_members(spark, d, early), timed.filter(early).select("g", "ip").distinct()).filter(F.col("ratio") >= OVERLAP).select("x", "y", F.col("common").alias("prior"))
    j = now.join(before, ["x", "y"], "left")
    event = F.when(F.col("prior").isNull(), "formed").when(F.col("common") >= F.floor(F.col("prior") * GREW), F.concat(F.lit("grew_"), F.col("common").cast("string")))
    return j.select(F.concat(F.lit("op-"), X.short_hash(F.array_join(F.array_sort(F.array("x", "y")), "|"))).alias("operation_id"), event.alias("event"), F.col("common").alias("shared_addresses"), "prior").filter("event is not null")


def _first_last(sets: DataFrame) -> DataFrame:
    """(playbook_id, item, a, b): items of a playbook's first and last day that has any; `sets` is (playbook_id, day, item), distinct."""
    w = Window.partitionBy("playbook_id")
    e = sets.withColumn("r0", F.min("day").over(w)).withColumn("r1", F.max("day").over(w)).filter("r0 < r1 and day in (r0, r1)")
    return e.groupBy("playbook_id", "item").agg(F.bool_or(F.col("day") == F.col("r0")).alias("a"), F.bool_or(F.col("day") == F.col("r1")).alias("b"))


def _similarity(sets: DataFrame) -> DataFrame:
    """(playbook_id, jaccard, added, removed), counted item by item: no playbook's set is held in one row."""
    f = _first_last(sets)
    return f.groupBy("playbook_id").agg(
        F.round(F.count_if(F.col("a") & F.col("b")) / F.count(F.lit(1)), 6).alias("jaccard"), F.count_if(F.col("b") & ~F.col("a")).alias("added"), F.count_if(F.col("a") & ~F.col("b")).alias("removed")
    )


def _drift_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = slim_sessions(spark, d, "started_at", "playbook_id", "command_set").filter("playbook_id is not null and started_at is not null").withColumn("uid", uid()).withColumn("day", _day("started_at"))
    commands = s.select("playbook_id", "day", F.explode(F.array_compact("command_set")).alias("item")).distinct()
    w = Window.partitionBy("uid").orderBy("ts", "event_id")
    grams = command_events(spark, d).select(uid().alias("uid"), "ts", "event_id", "h").select("uid", F.concat_ws(">", "h", F.lead("h").over(w)).alias("item"), F.lead("h").over(w).alias("b")).filter("b is not null").select("uid", "item").distinct()
    pairs = grams.join(s.select("uid", "playbook_id", "day"), "uid").select("playbook_id", "day", "item").distinct()
    artifacts = _artifacts(spark, d).select("uid", F.col("artifact").alias("item")).join(s.select("uid", "playbook_id", "day"), "uid").select("playbook_id", "day", "item").distinct()
    return commands, pairs, artifacts


def drift_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts of a playbook on its first and its last day that has any; drift at a Jaccard distance of 0.5."""
    return _similarity(_drift_sets(spark, d)[2]).select("playbook_id", F.round(1 - F.col("jaccard"), 6).alias("distance"), "added", "removed", (1 - F.col("jaccard") >= 0.5).alias("drift"))


def drift_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Command pairs of a playbook on its first and last day: drift below a Jaccard similarity of 0.4, only where the commands themselves didn't drift."""
    commands, pairs, _ = _drift_sets(spark, d)
    fired = _similarity(commands).filter("jaccard < 0.5").select("playbook_id", F.lit(True).alias("fired"))
    j = _similarity(pairs).join(fired, "playbook_id", "left")
    return j.select("playbook_id", "jaccard", F.coalesce("fired", F.lit(False)).alias("command_fired"), ((F.col("jaccard") < 0.4) & F.col("fired").isNull()).alias("drift"))


def resurfaced(spark: SparkSession, d: str) -> DataFrame:
    """Playbooks and campaigns active in the latest run after a gap of at least 48 hours between snapshots; the latest such gap."""
    s = entity_snapshots(spark, d).filter("entity <> 'address'")
    newest = slim_sessions(spark, d, "started_at").agg(F.max(_day("started_at")).alias("newest"))  # one row
    w = Window.partitionBy("entity", "id").orderBy("day")
    g = s.select("entity", "id", "day", F.datediff("day", F.lag("day").over(w)).alias("gap"), F.max("day").over(Window.partitionBy("entity", "id")).alias("last")).join(F.broadcast(newest)).filter("last = newest and gap > 2")
    return g.groupBy("entity", "id").agg(F.max(F.struct("day", "gap")).alias("x")).select("entity", "id", F.col("x.day").alias("resumed"), F.col("x.gap").alias("gap_days"))


def drift_all(spark: SparkSession, d: str, suppressed: tuple[str, ...] = ()) -> DataFrame:
    """All set drifts of playbooks as findings, with a delta signature; signatures an analyst rejected are left out."""
    commands, pairs, artifacts = _drift_sets(spark, d)
    c, p, a = _similarity(commands), _similarity(pairs), _similarity(artifacts)
    fired = c.filter("jaccard < 0.5")
    parts = [
        fired.select(F.lit("command_drift").alias("kind"), "*"),
        p.filter("jaccard < 0.4").join(fired.select("playbook_id"), "playbook_id", "left_anti").select(F.lit("sequence_drift").alias("kind"), "*"),
        a.filter("1 - jaccard >= 0.5").select(F.lit("artifact_drift").alias("kind"), "*"),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("delta", X.short_hash(F.concat_ws("|", "kind", "playbook_id", F.col("added").cast("string"), F.col("removed").cast("string"))))
    return out.filter(~F.col("delta").isin(list(suppressed))) if suppressed else out


def confirm_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The baseline a later drift is measured against, per playbook: sessions, addresses, commands, networks, commonest network and intent, a signature of the command set."""
    s = slim_sessions(spark, d, "playbook_id", "source.ip", "source.asn.number", "dominant_intent", "command_set").filter("playbook_id is not null")

    def mode(col: str, name: str) -> DataFrame:
        n = s.filter(F.col(col).isNotNull()).groupBy("playbook_id", F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("playbook_id").agg(F.min(F.struct(-F.col("n"), "v"))["v"].alias(name), F.count(F.lit(1)).alias(f"{name}s"))

    base = s.groupBy("playbook_id").agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct("source_ip").alias("addresses"))
    hs = s.select("playbook_id", F.explode(F.array_compact("command_set")).alias("h")).distinct()
    # The signature is a sum over the set, so no set is held in one row.
    sig = hs.groupBy("playbook_id").agg(F.count(F.lit(1)).alias("commands"), F.sum(F.conv(F.substring(F.sha2("h", 256), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("signature"))
    return base.join(sig, "playbook_id", "left").join(mode("source_asn_number", "network"), "playbook_id", "left").join(mode("dominant_intent", "intent"), "playbook_id", "left")


QUERIES = {
    f.__name__: f
    for f in (
        entity_snapshots, lifecycle_docs, band_thresholds, new_entities, campaign_findings, behaviour_shift, artifact_burst, campaign_convergence, operations, operation_emergence, drift_artifacts, drift_sequence, resurfaced, drift_all, confirm_anchors,
    )
}

_INFRA = f"""{_COMP}, im0 AS (SELECT DISTINCT component, a.uid, source_ip FROM a JOIN df USING (artifact) JOIN k ON k.node = a.uid WHERE df >= 2),
    im AS (SELECT 'cmp-inf-' || substr(sha256(component), 1, 16) AS campaign_id, uid, source_ip FROM im0 WHERE component IN (SELECT component FROM im0 GROUP BY 1 HAVING count(DISTINCT uid) >= 3 AND count(DISTINCT source_ip) >= 2))"""
_S = f"se AS (SELECT {_UID} AS uid, CAST(started_at AS DATE) AS day, started_at, playbook_id, source.ip AS ip, source.asn.number AS asn, cluster.novelty_score::DOUBLE AS nov, cluster.is_outlier AS outlier, dominant_intent, command_set FROM {SESS})"
_ENT = """en AS (SELECT 'playbook' AS entity, playbook_id AS id, day, ip, nov, dominant_intent FROM se WHERE playbook_id IS NOT NULL AND day IS NOT NULL UNION ALL SELECT 'address', ip, day, ip, nov, dominant_intent FROM se WHERE ip IS NOT NULL AND day IS NOT NULL
    UNION ALL SELECT 'campaign', campaign_id, day, ip, nov, dominant_intent FROM se JOIN (SELECT DISTINCT campaign_id, uid FROM im) USING (uid) WHERE day IS NOT NULL),
    md AS (SELECT entity, id, day, dominant_intent AS intent FROM en WHERE dominant_intent IS NOT NULL GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY entity, id, day ORDER BY count(*) DESC, dominant_intent) = 1),
    sn AS (SELECT e.*, intent FROM (SELECT entity, id, day, count(*) AS sessions, count(DISTINCT ip) AS addresses, round(avg(nov), 4) AS mean_novelty FROM en GROUP BY 1, 2, 3) e LEFT JOIN md USING (entity, id, day))"""
_W = f"WITH RECURSIVE {_INFRA}, {_S}, {_ENT}"
_DOC = """lc AS (SELECT entity, id, count(*) AS runs_observed, min(day) AS first_day, max(day) AS last_day, CAST((SELECT max(day) FROM se) - max(day) AS INTEGER) AS silent_runs,
    list(day::VARCHAR || ':' || sessions || ':' || addresses || ':' || coalesce(intent, '-') ORDER BY day)[-30:] AS x FROM sn GROUP BY 1, 2)"""


def _common_sql(a: str, b: str) -> str:
    return f"""SELECT x, y, common, round(common / least(nx, ny), 6) AS ratio FROM (SELECT p.g AS x, q.g AS y, count(*) AS common FROM {a} p JOIN {b} q ON p.ip = q.ip GROUP BY 1, 2)
        JOIN (SELECT g AS x, count(*) AS nx FROM {a} GROUP BY 1) USING (x) JOIN (SELECT g AS y, count(*) AS ny FROM {b} GROUP BY 1) USING (y)"""


_GR = "pm AS (SELECT DISTINCT playbook_id AS g, ip FROM se WHERE ip IS NOT NULL AND playbook_id IS NOT NULL), cm AS (SELECT DISTINCT campaign_id AS g, source_ip AS ip FROM im WHERE source_ip IS NOT NULL)"
_OPID = "'op-' || substr(sha256(least(x, y) || '|' || greatest(x, y)), 1, 16)"
_DRIFT = f"""cs AS (SELECT DISTINCT playbook_id, day, h AS item FROM (SELECT playbook_id, day, unnest(command_set) AS h FROM se WHERE playbook_id IS NOT NULL AND day IS NOT NULL) WHERE h IS NOT NULL),
    gr AS (SELECT DISTINCT uid, item FROM (SELECT {_UID} AS uid, h || '>' || lead(h) OVER (PARTITION BY sensor, session_id ORDER BY ts, event_id) AS item FROM {CMD}) WHERE item IS NOT NULL),
    gs AS (SELECT DISTINCT playbook_id, day, item FROM gr JOIN se USING (uid) WHERE playbook_id IS NOT NULL AND day IS NOT NULL),
    ar AS (SELECT DISTINCT playbook_id, day, artifact AS item FROM a JOIN se USING (uid) WHERE playbook_id IS NOT NULL AND day IS NOT NULL)"""


def _sim_sql(t: str) -> str:
    return f"""(WITH e AS (SELECT *, min(day) OVER (PARTITION BY playbook_id) AS r0, max(day) OVER (PARTITION BY playbook_id) AS r1 FROM {t}), f AS (SELECT playbook_id, item, bool_or(day = r0) AS a, bool_or(day = r1) AS b FROM e WHERE r0 < r1 AND day IN (r0, r1) GROUP BY 1, 2)
        SELECT playbook_id, round(count(*) FILTER (a AND b) / count(*), 6) AS jaccard, count(*) FILTER (b AND NOT a) AS added, count(*) FILTER (a AND NOT b) AS removed FROM f GROUP BY 1)"""


SQL = {
    "entity_snapshots": f"{_W} SELECT * FROM sn",
    "lifecycle_docs": f"""{_W}, {_DOC} SELECT entity, id, runs_observed, first_day, last_day, silent_runs, silent_runs >= CASE entity WHEN 'address' THEN 28 ELSE 120 END AS retired, runs_observed >= 8 AND silent_runs = 0 AS stable,
        CAST(len(x) AS INTEGER) AS snapshots, substr(sha256(array_to_string(x, '|')), 1, 16) AS history_hash FROM lc""",
    "band_thresholds": f"""{_W}, l AS (SELECT sessions, addresses FROM sn WHERE entity = 'playbook' QUALIFY row_number() OVER (PARTITION BY id ORDER BY day DESC) = 1)
        SELECT CAST(coalesce(greatest(round_even(quantile_cont(sessions, 0.75), 0), 2), 20) AS INTEGER) AS sessions, CAST(coalesce(greatest(round_even(quantile_cont(addresses, 0.75), 0), 2), 5) AS INTEGER) AS addresses, count(*) AS n FROM l""",
    "new_entities": f"{_W}, {_DOC} SELECT entity, id, round(ln(1 + sessions) + ln(1 + addresses), 6) AS score FROM sn JOIN lc USING (entity, id) WHERE runs_observed = 1",
    "campaign_findings": f"""WITH RECURSIVE {_INFRA} SELECT campaign_id, count(DISTINCT uid) AS sessions, count(DISTINCT source_ip) AS addresses, round(ln(1 + count(DISTINCT source_ip)) * ln(1 + count(DISTINCT uid)), 6) AS score,
        'find-cam-' || substr(sha256('campaign:' || campaign_id), 1, 16) AS finding_id FROM im GROUP BY 1""",
    "behaviour_shift": f"""WITH {_S}, n AS (SELECT ip, day, playbook_id AS p, count(*) AS n FROM se WHERE ip IS NOT NULL AND playbook_id IS NOT NULL AND day IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT ip, day, sum(n) AS total, first(p ORDER BY n DESC, p) AS mode,
        row_number() OVER (PARTITION BY ip ORDER BY day DESC) AS k FROM n GROUP BY 1, 2), c AS (SELECT x.ip, x.day, y.day AS d2, y.mode AS was, x.mode AS now, x.total AS t1, y.total AS t2 FROM r x JOIN r y ON x.ip = y.ip AND x.k = 1 AND y.k = 2 AND x.total >= 5),
        j AS (SELECT c.ip, n.p, sum(CASE WHEN n.day = c.day THEN n / t1 ELSE 0 END) AS x, sum(CASE WHEN n.day = d2 THEN n / t2 ELSE 0 END) AS y FROM c JOIN n ON n.ip = c.ip AND n.day IN (c.day, d2) GROUP BY 1, 2),
        s AS (SELECT ip, round(sqrt(greatest(sum(CASE WHEN x > 0 THEN x * log2(x / ((x + y) / 2)) / 2 ELSE 0 END + CASE WHEN y > 0 THEN y * log2(y / ((x + y) / 2)) / 2 ELSE 0 END), 0)), 5) AS js FROM j GROUP BY 1)
        SELECT ip AS source_ip, day, was, now, js FROM c JOIN s USING (ip) WHERE was <> now OR js >= 0.3""",
    "artifact_burst": f"""WITH {_ART}, {_S}, o AS (SELECT uid FROM se WHERE outlier AND started_at >= (SELECT max(started_at) FROM se) - INTERVAL 24 HOUR)
        SELECT artifact, count(DISTINCT uid) AS sessions, count(DISTINCT source_ip) AS addresses, round(ln(1 + count(DISTINCT uid)) + ln(1 + count(DISTINCT source_ip)), 6) AS score FROM a JOIN o USING (uid) GROUP BY 1 HAVING count(DISTINCT uid) >= 5 ORDER BY score DESC, artifact LIMIT 200""",
    "campaign_convergence": f"WITH RECURSIVE {_INFRA}, {_S}, {_GR} SELECT x AS a, y AS b, common, ratio, round(ratio + ln(1 + common), 6) AS score FROM ({_common_sql('cm', 'cm')}) WHERE x < y AND ratio >= 0.4",
    "operations": f"""WITH RECURSIVE {_INFRA}, {_S}, {_GR}, sp AS (SELECT playbook_id AS g, min(started_at) AS lo, max(started_at) AS hi FROM se WHERE playbook_id IS NOT NULL GROUP BY 1 UNION ALL
        SELECT campaign_id, min(started_at), max(started_at) FROM (SELECT DISTINCT campaign_id, uid FROM im) JOIN se USING (uid) GROUP BY 1)
        SELECT {_OPID} AS operation_id, x AS behaviour_id, y AS infrastructure_id, common AS shared_addresses, ratio, least(p.lo, q.lo) AS first_seen, greatest(p.hi, q.hi) AS last_seen FROM ({_common_sql('pm', 'cm')}) JOIN sp p ON p.g = x JOIN sp q ON q.g = y WHERE ratio >= 0.4""",
    "operation_emergence": f"""WITH RECURSIVE {_INFRA}, {_S}, lim AS (SELECT max(started_at) - INTERVAL 7 DAY AS t FROM se), tm AS (SELECT campaign_id AS g, source_ip AS ip, started_at FROM im JOIN se USING (uid) WHERE source_ip IS NOT NULL),
        pm AS (SELECT DISTINCT playbook_id AS g, ip FROM se WHERE ip IS NOT NULL AND playbook_id IS NOT NULL), pe AS (SELECT DISTINCT playbook_id AS g, ip FROM se, lim WHERE ip IS NOT NULL AND playbook_id IS NOT NULL AND started_at <= t),
        cm AS (SELECT DISTINCT g, ip FROM tm), ce AS (SELECT DISTINCT g, ip FROM tm, lim WHERE started_at <= t), nw AS (SELECT * FROM ({_common_sql('pm', 'cm')}) WHERE ratio >= 0.4), ol AS (SELECT x, y, common AS prior FROM ({_common_sql('pe', 'ce')}) WHERE ratio >= 0.4)
        SELECT * FROM (SELECT {_OPID} AS operation_id, CASE WHEN prior IS NULL THEN 'formed' WHEN common >= floor(prior * 1.5) THEN 'grew_' || common END AS event, common AS shared_addresses, prior FROM nw LEFT JOIN ol USING (x, y)) WHERE event IS NOT NULL""",
    "drift_artifacts": f"WITH {_ART}, {_S}, {_DRIFT} SELECT playbook_id, round(1 - jaccard, 6) AS distance, added, removed, 1 - jaccard >= 0.5 AS drift FROM {_sim_sql('ar')}",
    "drift_sequence": f"""WITH {_ART}, {_S}, {_DRIFT}, c AS (SELECT * FROM {_sim_sql('cs')}) SELECT g.playbook_id, g.jaccard, coalesce(c.jaccard < 0.5, false) AS command_fired, g.jaccard < 0.4 AND NOT coalesce(c.jaccard < 0.5, false) AS drift
        FROM {_sim_sql('gs')} g LEFT JOIN c USING (playbook_id)""",
    "resurfaced": f"""{_W}, g AS (SELECT entity, id, day, day - lag(day) OVER (PARTITION BY entity, id ORDER BY day) AS gap, max(day) OVER (PARTITION BY entity, id) AS last FROM sn WHERE entity <> 'address')
        SELECT entity, id, max(day) AS resumed, CAST(arg_max(gap, day) AS INTEGER) AS gap_days FROM g WHERE last = (SELECT max(day) FROM se) AND gap > 2 GROUP BY 1, 2""",
    "drift_all": f"""WITH {_ART}, {_S}, {_DRIFT}, c AS (SELECT * FROM {_sim_sql('cs')}), u AS (SELECT 'command_drift' AS kind, * FROM c WHERE jaccard < 0.5 UNION ALL SELECT 'sequence_drift', * FROM {_sim_sql('gs')} WHERE jaccard < 0.4 AND playbook_id NOT IN (SELECT playbook_id FROM c WHERE jaccard < 0.5)
        UNION ALL SELECT 'artifact_drift', * FROM {_sim_sql('ar')} WHERE 1 - jaccard >= 0.5) SELECT *, substr(sha256(kind || '|' || playbook_id || '|' || added || '|' || removed), 1, 16) AS delta FROM u""",
    "confirm_anchors": f"""WITH {_S}, s AS (SELECT * FROM se WHERE playbook_id IS NOT NULL), b AS (SELECT playbook_id, count(*) AS sessions, count(DISTINCT ip) AS addresses FROM s GROUP BY 1),
        h AS (SELECT playbook_id, count(*) AS commands, CAST(sum(('0x' || substr(sha256(h), 1, 12))::HUGEINT) AS VARCHAR) AS signature FROM (SELECT DISTINCT playbook_id, h FROM (SELECT playbook_id, unnest(command_set) AS h FROM s) WHERE h IS NOT NULL) GROUP BY 1),
        nw AS (SELECT playbook_id, first(asn ORDER BY n DESC, asn) AS network, count(*) AS networks FROM (SELECT playbook_id, asn, count(*) AS n FROM s WHERE asn IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
        it AS (SELECT playbook_id, first(dominant_intent ORDER BY n DESC, dominant_intent) AS intent, count(*) AS intents FROM (SELECT playbook_id, dominant_intent, count(*) AS n FROM s WHERE dominant_intent IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
        SELECT * FROM b LEFT JOIN h USING (playbook_id) LEFT JOIN nw USING (playbook_id) LEFT JOIN it USING (playbook_id)""",
}
