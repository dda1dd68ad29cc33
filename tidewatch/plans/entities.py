"""Entity views, identity upkeep and remaining joins (survey B19, B25, D31, E4-E16, H13-H22, I11, J1-J6, J20, L22-L31)."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dist as D
from ..functions import text as X
from ..operators.graph import connected_components
from ..operators.nearest import as_arrays, mean_vectors, nearest, similar_pairs, usable
from ..session import table
from .campaigns import uid
from .common import CMD, EV, SESS, command_events, events, slim_sessions
from .intel import _SIG, consensus

ANCHOR = 0.96


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "session_clusters").filter(usable(F.col("centroid"), 96))


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    return as_arrays(mean_vectors(_clusters(spark, d).filter(F.col("playbook_id").isNotNull()), "playbook_id", "centroid", unit=True), "playbook_id")


def anchor_match(spark: SparkSession, d: str) -> DataFrame:
    """Clusters without a playbook take the nearest anchor's id at cosine 0.96, else a minted one."""
    c = nearest(_clusters(spark, d).filter(F.col("playbook_id").isNull()).select("cluster_id", "centroid"), "centroid", _anchors(spark, d), "playbook_id", "vec")
    best = F.get("nearest", F.lit(0))
    minted = F.concat(F.lit("spb-"), X.short_hash(F.col("cluster_id")))
    return c.select("cluster_id", F.when(best["cosine"] >= ANCHOR, best["label"]).otherwise(minted).alias("playbook_id"), (best["cosine"] >= ANCHOR).alias("reused"), F.round(best["cosine"], 5).alias("cosine"))


def prototype_components(spark: SparkSession, d: str) -> DataFrame:
    """Anchors linked where each other's cosine reaches 0.9, consolidated to the least id."""
    return connected_components(similar_pairs(_anchors(spark, d), "playbook_id", "vec", 0.9)).select(F.col("node").alias("playbook_id"), F.col("component").alias("canonical"))


def anchor_drift(spark: SparkSession, d: str) -> DataFrame:
    """Per playbook the share of its sessions whose vector misses the anchor (cosine below 0.94); 15 percent mint a satellite."""
    s = slim_sessions(spark, d, "playbook_id", "embedding").filter(F.col("playbook_id").isNotNull() & usable(F.col("embedding"), 96))
    a = _anchors(spark, d).withColumnRenamed("playbook_id", "p")
    j = s.join(a, s.playbook_id == a.p).withColumn("c", F.round(D.cosine(F.col("embedding"), F.col("vec")), 6))
    g = j.groupBy("playbook_id").agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg((F.col("c") < 0.94).cast("int")), 6).alias("novel"))
    return g.select("playbook_id", "sessions", "novel", (F.col("novel") >= 0.15).alias("satellite"))


def predicate_split(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a playbook with and without any predicate; both sides must have three sessions to split."""
    names = ["has_uname_m", "has_c2_launch", "has_self_spread", "has_key_write"]
    c = table(spark, d, "commands").select(F.col("command_hash").alias("h"), F.coalesce(F.greatest(*[F.coalesce(F.col(f"predicates.{n}"), F.lit(False)) for n in names]), F.lit(False)).alias("any"))
    s = slim_sessions(spark, d, "playbook_id", "command_set").filter("playbook_id is not null")
    e = s.select("playbook_id", uid().alias("uid"), F.explode(F.array_compact("command_set")).alias("h")).join(c, "h").groupBy("playbook_id", "uid").agg(F.bool_or("any").alias("any"))
    g = e.groupBy("playbook_id").agg(F.count_if("any").alias("active"), F.count_if(~F.col("any")).alias("quiet"))
    return g.withColumn("split", (F.col("active") >= 3) & (F.col("quiet") >= 3))


def technique_distribution(spark: SparkSession, d: str) -> DataFrame:
    s = slim_sessions(spark, d, "cluster.id", "dominant_intent").filter("cluster_id is not null and dominant_intent is not null")
    n = s.groupBy("cluster_id", "dominant_intent").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cluster_id")
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "dominant_intent"))).filter("rank <= 3")


def id_fragmentation(spark: SparkSession, d: str) -> DataFrame:
    """Playbooks held by several clusters of one run, and how many runs they span."""
    c = table(spark, d, "session_clusters").filter("playbook_id is not null")
    g = c.groupBy("playbook_id", "run_id").agg(F.count(F.lit(1)).alias("n")).groupBy("playbook_id")
    return g.agg(F.count(F.lit(1)).alias("runs"), F.max("n").alias("most_in_a_run"), F.sum("n").alias("clusters"))


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Playbooks of the newest and the previous run: kept, added or gone."""
    c = table(spark, d, "session_clusters").filter("playbook_id is not null")
    runs = table(spark, d, "session_clusters").groupBy("run_id").agg(F.max("created_at").alias("t")).orderBy(F.desc("t"), F.desc("run_id")).limit(2)
    r = runs.agg(F.max(F.struct("t", "run_id"))["run_id"].alias("new"), F.min(F.struct("t", "run_id"))["run_id"].alias("old"))
    m = c.join(F.broadcast(r)).groupBy("playbook_id").agg(F.bool_or(F.col("run_id") == F.col("new")).alias("n"), F.bool_or(F.col("run_id") == F.col("old")).alias("o"))
    return m.filter("n or o").select("playbook_id", F.when(F.col("n") & F.col("o"), "kept").when(F.col("n"), "added").otherwise("gone").alias("change"))


def _bigrams(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("sensor", "session_id").orderBy("ts", "event_id")
    b = command_events(spark, d).select("sensor", "session_id", F.concat_ws("|", "h", F.lead("h").over(w)).alias("b"), F.lead("h").over(w).alias("x")).filter("x is not null")
    s = slim_sessions(spark, d, "playbook_id", "started_at").filter("playbook_id is not null and started_at is not null").withColumn("run", F.date_trunc("week", "started_at").cast("date"))
    return b.join(s, ["sensor", "session_id"]).select("playbook_id", "run", "b")


def sequence_drift(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard similarity of a playbook's command pairs between its first and latest run; below 0.4 is drift."""
    g = _bigrams(spark, d).groupBy("playbook_id", "run").agg(F.collect_set("b").alias("bs")).groupBy("playbook_id").agg(F.min_by("bs", "run").alias("a"), F.max_by("bs", "run").alias("z"), F.count(F.lit(1)).alias("runs")).filter("runs > 1")
    j = F.round(D.jaccard(F.col("a"), F.col("z")), 6)
    return g.select("playbook_id", j.alias("jaccard"), (j < 0.4).alias("drift"))


def status_changes(spark: SparkSession, d: str) -> DataFrame:
    """A batch of status changes against sessions' outlier findings: unknown status rejected, equal status a no-op, else a history entry."""
    s = slim_sessions(spark, d, "cluster.is_outlier", "classification", "login_fail_count").filter("cluster_is_outlier")
    old = F.when(F.col("classification") == "public", "confirmed").otherwise("new")
    new = F.when(F.col("login_fail_count") >= 4, "confirmed").when(F.col("login_fail_count") == 3, "weird").otherwise("rejected")
    x = s.select(uid().alias("uid"), old.alias("was"), new.alias("wanted"))
    valid = F.col("wanted").isin("new", "confirmed", "rejected")
    result = F.when(~valid, "invalid").when(F.col("was") == F.col("wanted"), "unchanged").otherwise("changed")
    return x.select("uid", result.alias("result"), F.when(result == "changed", F.col("wanted")).otherwise(F.col("was")).alias("status"), F.when(result == "changed", F.concat_ws("->", "was", "wanted")).alias("history"))


def query_detect(spark: SparkSession, d: str) -> DataFrame:
    """What kind of reference a search text is, over all addresses, hashes, playbooks and indicator values."""
    c = table(spark, d, "commands")
    parts = [
        slim_sessions(spark, d, "source.ip").select(F.col("source_ip").alias("q")), c.select(F.col("command_hash").alias("q")), table(spark, d, "session_clusters").select(F.col("cluster_id").alias("q")),
        table(spark, d, "session_clusters").select(F.col("playbook_id").alias("q")), c.select(F.explode("indicators").alias("i")).select(F.col("i.ioc_value").alias("q")),
        events(spark, d).select(F.col("file_sha256").alias("q")), slim_sessions(spark, d, "source.asn.number").select(F.concat(F.lit("AS"), F.col("source_asn_number").cast("string")).alias("q")),
    ]
    q = parts[0]
    for p in parts[1:]:
        q = q.unionByName(p)
    t = F.col("q")
    kind = (
        F.when(t.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(t.rlike(r"^(?i)as\d+$"), "asn").when(t.rlike(r"^[0-9a-f]{64}$"), "file").when(t.rlike(r"^[0-9a-f]{16}$"), "command")
        .when(t.startswith("spb-"), "playbook").when(t.startswith("sescl-"), "session_cluster").when(t.rlike(r"^[A-Z]{2}$"), "country").otherwise("freetext")
    )
    return q.filter("q is not null").distinct().groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def ip_profile(spark: SparkSession, d: str) -> DataFrame:
    """Footprint of an address: events, sessions, distinct commands, credentials, files, sensors."""
    e = events(spark, d).filter(F.col("source.ip").isNotNull())
    cmd = F.when(F.col("event_action") == "command.input", X.short_hash(X.normalize(F.col("command_line"))))
    return e.groupBy(F.col("source.ip").alias("source_ip")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct(F.struct("sensor", "session_id")).alias("sessions"), F.count_distinct(cmd).alias("commands"), F.count_distinct("file_sha256").alias("files"),
        F.count_distinct("sensor").alias("sensors"), F.count_distinct(F.concat_ws(":", "user_name", "password")).alias("credentials"),
    )


def command_profile(spark: SparkSession, d: str) -> DataFrame:
    """Footprint of a command over session rollups: sessions, addresses, playbooks and its dominant playbook."""
    s = slim_sessions(spark, d, "source.ip", "playbook_id", "command_set").select("sensor", "session_id", "source_ip", "playbook_id", F.explode(F.array_distinct(F.array_compact("command_set"))).alias("command_hash"))
    g = s.groupBy("command_hash").agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct("source_ip").alias("addresses"), F.count_distinct("playbook_id").alias("playbooks"))
    m = s.filter("playbook_id is not null").groupBy("command_hash", "playbook_id").agg(F.count(F.lit(1)).alias("n")).groupBy("command_hash").agg(F.min(F.struct(-F.col("n"), "playbook_id"))["playbook_id"].alias("dominant"))
    return g.join(m, "command_hash", "left")


def file_droppers(spark: SparkSession, d: str) -> DataFrame:
    """Three addresses that dropped each file most often."""
    f = events(spark, d).filter(F.col("file_sha256").isNotNull() & F.col("source.ip").isNotNull()).groupBy("file_sha256", F.col("source.ip").alias("source_ip")).agg(F.count(F.lit(1)).alias("drops"), F.min("ts").alias("first_drop"))
    return f.withColumn("rank", F.row_number().over(Window.partitionBy("file_sha256").orderBy(F.desc("drops"), "source_ip"))).filter("rank <= 3")


def attach_intel(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with the consensus on their address; no address, no verdict (which isn't a clean one)."""
    s = slim_sessions(spark, d, "source.ip")
    return s.join(consensus(spark, d).select("source_ip", "malicious", "label"), "source_ip", "left").select("sensor", "session_id", "malicious", "label")


def naming_context(spark: SparkSession, d: str) -> DataFrame:
    """Most covered commands of a playbook while their lines fit into 200 characters together."""
    s = slim_sessions(spark, d, "playbook_id", "command_set").filter("playbook_id is not null")
    n = s.select("playbook_id", F.explode(F.array_distinct(F.array_compact("command_set"))).alias("command_hash")).groupBy("playbook_id", "command_hash").agg(F.count(F.lit(1)).alias("n"))
    x = n.join(table(spark, d, "commands").select("command_hash", "command_line"), "command_hash")
    w = Window.partitionBy("playbook_id").orderBy(F.desc("n"), "command_hash")
    x = x.withColumn("rank", F.row_number().over(w)).withColumn("used", F.sum(F.length("command_line")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("used <= 200")
    return x.select("playbook_id", "rank", "command_hash", "n", "used")


def scale_projection(spark: SparkSession, d: str) -> DataFrame:
    """Events and sessions per sensor and day, projected to a hundred sensors and a year."""
    e = events(spark, d).filter("sensor is not null")
    g = e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("sensor", "session_id")).alias("s"), F.count_distinct("sensor").alias("k"), F.count_distinct(F.to_date("ts")).alias("days"))
    f = F.lit(100 * 365)
    return g.select(F.round(F.col("n") / F.col("k") / F.col("days"), 4).alias("events_per_sensor_day"), F.round(F.col("n") / F.col("k") / F.col("days") * f).cast("long").alias("events_year"), F.round(F.col("s") / F.col("k") / F.col("days") * f).cast("long").alias("sessions_year"))


BLOCKS = [("commands", 32), ("intents", 8), ("logins", 4), ("credentials", 8), ("network", 8), ("playbooks", 16)]


def _signed_hash(names: list[tuple[str, float]], dim: int) -> np.ndarray:
    v = np.zeros(dim)
    for name, weight in names:
        h = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big")
        v[(h >> 1) % dim] += weight if h & 1 else -weight
    return v


def session_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """76 numbers per session: signed feature hashes of its commands, intent, logins, credentials, network and playbook, unit length."""
    s = slim_sessions(spark, d, "command_set", "dominant_intent", "login_success_count", "login_fail_count", "credentials", "source.asn.number", "playbook_id")

    def run(cs: pd.Series, it: pd.Series, ok: pd.Series, bad: pd.Series, cr: pd.Series, asn: pd.Series, pb: pd.Series) -> pd.Series:
        out = []
        for c, i, o, b, r, a, p in zip(cs, it, ok, bad, cr, asn, pb, strict=True):
            feats = [
                [(x, 1.0) for x in (c if c is not None else []) if x], [(i, 1.0)] if isinstance(i, str) else [], [("ok", np.log1p(o if o == o and o else 0)), ("bad", np.log1p(b if b == b and b else 0))],
                [(x, 1.0) for x in (r if r is not None else []) if x], [(str(int(a)), 1.0)] if a == a and a is not None else [], [(p, 1.0)] if isinstance(p, str) else [],
            ]
            v = np.concatenate([_signed_hash(f, n) for f, (_, n) in zip(feats, BLOCKS, strict=True)])
            n = np.linalg.norm(v)
            out.append((v / n if n > 0 else v).astype(np.float32))
        return pd.Series(out, index=cs.index)

    f = F.pandas_udf(run, "array<float>")
    return s.select("sensor", "session_id", f("command_set", "dominant_intent", "login_success_count", "login_fail_count", "credentials", "source_asn_number", "playbook_id").alias("fingerprint"))


QUERIES = {
    f.__name__: f
    for f in (
        anchor_match, prototype_components, anchor_drift, predicate_split, technique_distribution, id_fragmentation, snapshot_diff, sequence_drift, status_changes, query_detect, ip_profile, command_profile, file_droppers,
        attach_intel, naming_context, scale_projection, session_fingerprint,
    )
}

_UIDS = "coalesce(sensor, 'default') || ':' || session_id"
_ANC = """c AS (SELECT *, list_transform(centroid, lambda x: x::DOUBLE / sqrt(list_dot_product(centroid::DOUBLE[], centroid::DOUBLE[]))) AS u FROM session_clusters WHERE centroid IS NOT NULL AND len(centroid) = 96
    AND list_dot_product(centroid::DOUBLE[], centroid::DOUBLE[]) > 0), m AS (SELECT playbook_id AS p, i, avg(u[i + 1]) AS v FROM c, range(96) t(i) WHERE playbook_id IS NOT NULL GROUP BY 1, 2), anc AS (SELECT p, list(v ORDER BY i) AS v FROM m GROUP BY 1)"""
SQL = {
    "anchor_match": f"""WITH {_ANC}, b AS (SELECT cluster_id, p, list_cosine_similarity(u, v) AS cos FROM c, anc WHERE playbook_id IS NULL QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY round(list_cosine_similarity(u, v), 12) DESC, p) = 1)
        SELECT cluster_id, CASE WHEN cos >= 0.96 THEN p ELSE 'spb-' || substr(sha256(cluster_id), 1, 16) END AS playbook_id, cos >= 0.96 AS reused, round(cos, 5) AS cosine FROM b""",
    "prototype_components": f"""WITH RECURSIVE {_ANC}, e AS (SELECT a.p AS s, b.p AS t FROM anc a, anc b WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.9), r(n, k) AS (SELECT s, t FROM e UNION SELECT r.n, e.t FROM r JOIN e ON r.k = e.s)
        SELECT n AS playbook_id, min(k) AS canonical FROM r GROUP BY 1""",
    "anchor_drift": f"""WITH {_ANC}, s AS (SELECT playbook_id, embedding FROM {SESS} WHERE playbook_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 96 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
        g AS (SELECT playbook_id, count(*) AS sessions, round(avg(CAST(round(list_cosine_similarity(embedding::DOUBLE[], v), 6) < 0.94 AS INTEGER)), 6) AS novel FROM s JOIN anc ON playbook_id = p GROUP BY 1) SELECT *, novel >= 0.15 AS satellite FROM g""",
    "predicate_split": f"""WITH c AS (SELECT command_hash, coalesce(predicates.has_uname_m, false) OR coalesce(predicates.has_c2_launch, false) OR coalesce(predicates.has_self_spread, false) OR coalesce(predicates.has_key_write, false) AS a FROM commands),
        e AS (SELECT playbook_id, uid, bool_or(a) AS a FROM (SELECT playbook_id, {_UIDS} AS uid, unnest(command_set) AS h FROM {SESS} WHERE playbook_id IS NOT NULL) JOIN c ON h = command_hash GROUP BY 1, 2),
        g AS (SELECT playbook_id, count(*) FILTER (a) AS active, count(*) FILTER (NOT a) AS quiet FROM e GROUP BY 1) SELECT *, active >= 3 AND quiet >= 3 AS split FROM g""",
    "technique_distribution": f"""SELECT cluster_id, dominant_intent, n, round(n / sum(n) OVER (PARTITION BY cluster_id), 6) AS share, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, dominant_intent) AS INTEGER) AS rank FROM
        (SELECT cluster.id AS cluster_id, dominant_intent, count(*) AS n FROM {SESS} WHERE cluster.id IS NOT NULL AND dominant_intent IS NOT NULL GROUP BY 1, 2) QUALIFY rank <= 3""",
    "id_fragmentation": "SELECT playbook_id, count(*) AS runs, max(n) AS most_in_a_run, CAST(sum(n) AS BIGINT) AS clusters FROM (SELECT playbook_id, run_id, count(*) AS n FROM session_clusters WHERE playbook_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "snapshot_diff": """WITH r AS (SELECT run_id, row_number() OVER (ORDER BY max(created_at) DESC, run_id DESC) AS k FROM session_clusters GROUP BY 1), m AS (SELECT playbook_id, bool_or(k = 1) AS n, bool_or(k = 2) AS o FROM session_clusters JOIN r USING (run_id) WHERE playbook_id IS NOT NULL GROUP BY 1)
        SELECT playbook_id, CASE WHEN n AND o THEN 'kept' WHEN n THEN 'added' ELSE 'gone' END AS change FROM m WHERE n OR o""",
    "sequence_drift": f"""WITH b AS (SELECT sensor, session_id, h || '|' || lead(h) OVER (PARTITION BY sensor, session_id ORDER BY ts, event_id) AS b FROM {CMD}), s AS (SELECT sensor, session_id, playbook_id AS p, CAST(date_trunc('week', started_at) AS DATE) AS run FROM {SESS} WHERE playbook_id IS NOT NULL AND started_at IS NOT NULL),
        x AS (SELECT DISTINCT p, run, b FROM b JOIN s USING (sensor, session_id) WHERE b IS NOT NULL), e AS (SELECT p, min(run) AS r0, max(run) AS r1 FROM x GROUP BY 1 HAVING min(run) < max(run)),
        f AS (SELECT p, b, bool_or(run = r0) AS a, bool_or(run = r1) AS z FROM x JOIN e USING (p) WHERE run IN (r0, r1) GROUP BY 1, 2) SELECT p AS playbook_id, round(count(*) FILTER (a AND z) / count(*), 6) AS jaccard, round(count(*) FILTER (a AND z) / count(*), 6) < 0.4 AS drift FROM f GROUP BY 1""",
    "status_changes": f"""WITH x AS (SELECT {_UIDS} AS uid, CASE WHEN classification = 'public' THEN 'confirmed' ELSE 'new' END AS was, CASE WHEN login_fail_count >= 4 THEN 'confirmed' WHEN login_fail_count = 3 THEN 'weird' ELSE 'rejected' END AS wanted FROM {SESS} WHERE cluster.is_outlier),
        y AS (SELECT *, CASE WHEN wanted NOT IN ('new', 'confirmed', 'rejected') THEN 'invalid' WHEN was = wanted THEN 'unchanged' ELSE 'changed' END AS result FROM x)
        SELECT uid, result, CASE WHEN result = 'changed' THEN wanted ELSE was END AS status, CASE WHEN result = 'changed' THEN was || '->' || wanted END AS history FROM y""",
    "query_detect": f"""WITH q AS (SELECT source.ip AS q FROM {SESS} UNION SELECT command_hash FROM commands UNION SELECT cluster_id FROM session_clusters UNION SELECT playbook_id FROM session_clusters UNION SELECT i.ioc_value FROM (SELECT unnest(indicators) AS i FROM commands)
        UNION SELECT file_sha256 FROM {EV} UNION SELECT 'AS' || source.asn.number FROM {SESS}) SELECT CASE WHEN regexp_full_match(q, '\\d{{1,3}}(\\.\\d{{1,3}}){{3}}') THEN 'ip' WHEN regexp_full_match(q, '(?i)as\\d+') THEN 'asn' WHEN regexp_full_match(q, '[0-9a-f]{{64}}') THEN 'file'
        WHEN regexp_full_match(q, '[0-9a-f]{{16}}') THEN 'command' WHEN starts_with(q, 'spb-') THEN 'playbook' WHEN starts_with(q, 'sescl-') THEN 'session_cluster' WHEN regexp_full_match(q, '[A-Z]{{2}}') THEN 'country' ELSE 'freetext' END AS kind, count(*) AS n FROM q WHERE q IS NOT NULL GROUP BY 1""",
    "ip_profile": rf"""SELECT source.ip AS source_ip, count(*) AS events, count(DISTINCT (sensor, session_id)) AS sessions, count(DISTINCT CASE WHEN event_action = 'command.input' THEN substr(sha256(substr(trim(regexp_replace(command_line, '\s+', ' ', 'g')), 1, 4096)), 1, 16) END) AS commands,
        count(DISTINCT file_sha256) AS files, count(DISTINCT sensor) AS sensors, count(DISTINCT concat_ws(':', user_name, password)) AS credentials FROM {EV} WHERE source.ip IS NOT NULL GROUP BY 1""",
    "command_profile": f"""WITH s AS (SELECT source.ip AS ip, playbook_id, unnest(list_distinct(command_set)) AS h FROM {SESS}), m AS (SELECT h, playbook_id FROM (SELECT h, playbook_id, count(*) AS n FROM s WHERE h IS NOT NULL AND playbook_id IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY h ORDER BY n DESC, playbook_id) = 1)
        SELECT s.h AS command_hash, count(*) AS sessions, count(DISTINCT ip) AS addresses, count(DISTINCT s.playbook_id) AS playbooks, any_value(m.playbook_id) AS dominant FROM s LEFT JOIN m ON m.h = s.h WHERE s.h IS NOT NULL GROUP BY 1""",
    "file_droppers": f"""SELECT *, CAST(row_number() OVER (PARTITION BY file_sha256 ORDER BY drops DESC, source_ip) AS INTEGER) AS rank FROM (SELECT file_sha256, source.ip AS source_ip, count(*) AS drops, min(ts) AS first_drop FROM {EV} WHERE file_sha256 IS NOT NULL AND source.ip IS NOT NULL GROUP BY 1, 2) QUALIFY rank <= 3""",
    "attach_intel": f"""WITH {_SIG}, a AS (SELECT source_ip, bool_or(coalesce(m, false) AND direct) AS d, bool_or(clean) AS cl, bool_or(coalesce(m, false)) AS an, first(l ORDER BY pos) FILTER (m AND l IS NOT NULL) AS bad, first(l ORDER BY pos) FILTER (NOT m AND l IS NOT NULL) AS good FROM v GROUP BY 1),
        b AS (SELECT *, CASE WHEN d THEN true WHEN cl THEN false ELSE an END AS mal FROM a) SELECT sensor, session_id, mal AS malicious, CASE WHEN b.source_ip IS NOT NULL THEN coalesce(CASE WHEN mal THEN bad ELSE good END, bad, good, 'unknown') END AS label FROM {SESS} s LEFT JOIN b ON b.source_ip = s.source.ip""",
    "naming_context": f"""WITH n AS (SELECT playbook_id, h, count(*) AS n FROM (SELECT playbook_id, unnest(list_distinct(command_set)) AS h FROM {SESS} WHERE playbook_id IS NOT NULL) WHERE h IS NOT NULL GROUP BY 1, 2)
        SELECT playbook_id, CAST(row_number() OVER w AS INTEGER) AS rank, h AS command_hash, n, CAST(sum(length(command_line)) OVER (PARTITION BY playbook_id ORDER BY n DESC, h ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM n JOIN commands ON h = command_hash WINDOW w AS (PARTITION BY playbook_id ORDER BY n DESC, h) QUALIFY used <= 200""",
    "scale_projection": f"""WITH g AS (SELECT count(*) AS n, count(DISTINCT (sensor, session_id)) AS s, count(DISTINCT sensor) AS k, count(DISTINCT CAST(ts AS DATE)) AS d FROM {EV} WHERE sensor IS NOT NULL)
        SELECT round(n / k / d, 4) AS events_per_sensor_day, CAST(round(n / k / d * 36500) AS BIGINT) AS events_year, CAST(round(s / k / d * 36500) AS BIGINT) AS sessions_year FROM g""",
}
