"""Campaigns, graphs, itemsets, operations (survey F1-F16, E9-E13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dist as D
from ..functions import text as X
from ..operators.graph import connected_components
from ..operators.itemsets import closed_itemsets, frequent_itemsets
from ..session import cut_lineage, table
from .common import CMD, EV, SESS, command_events, events, slim_sessions



MAX_SET = 6


def uid() -> Column:
    """A session's key in one string; the sensor is part of it, since raw ids repeat across sensors."""
    return F.concat_ws(":", F.coalesce("sensor", F.lit("default")), "session_id")


def ip_playbooks(spark: SparkSession, d: str) -> DataFrame:
    """Per address: its playbooks, sessions with one, first and last start."""
    s = slim_sessions(spark, d, "source.ip", "playbook_id", "started_at").filter(F.col("source_ip").isNotNull() & F.col("playbook_id").isNotNull())
    return s.groupBy("source_ip").agg(F.array_join(F.array_sort(F.collect_set("playbook_id")), ",").alias("playbooks"), F.count(F.lit(1)).alias("sessions"), F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return slim_sessions(spark, d, "source.ip", "playbook_id").select("source_ip", "playbook_id")


def itemsets(spark: SparkSession, d: str) -> DataFrame:
    """Playbooks that at least five addresses share, two to six together."""
    s = frequent_itemsets(_pairs(spark, d), "source_ip", "playbook_id", 5, MAX_SET)
    return s.select(F.array_join("items", ",").alias("items"), "size", "support")


def closed_sets(spark: SparkSession, d: str) -> DataFrame:
    """Those of two to six without one more playbook that the same addresses all have."""
    s = closed_itemsets(frequent_itemsets(_pairs(spark, d), "source_ip", "playbook_id", 5, MAX_SET))
    return s.select(F.array_join("items", ",").alias("items"), "size", "support")


def intent_itemsets(spark: SparkSession, d: str) -> DataFrame:
    """Intents that at least 30 sessions' commands share, two to three together."""
    c = table(spark, d, "commands").select(F.col("command_hash").alias("h"), "intent")
    s = command_events(spark, d).select(uid().alias("uid"), "h").distinct().join(c, "h")
    return frequent_itemsets(s, "uid", "intent", 30, 3).select(F.array_join("items", ",").alias("items"), "size", "support")


def behaviour_campaigns(spark: SparkSession, d: str) -> DataFrame:
    """Closed playbook sets with their members (addresses holding the whole set), and a content-addressed id."""
    sets = closed_itemsets(frequent_itemsets(_pairs(spark, d), "source_ip", "playbook_id", 5, MAX_SET))
    return sets.select(F.concat(F.lit("cmp-beh-"), X.short_hash(F.array_join("items", "|"))).alias("campaign_id"), F.array_join("items", ",").alias("playbooks"), F.col("support").alias("members"), F.col("first_owner").alias("first_member"))


def _artifacts(spark: SparkSession, d: str) -> DataFrame:
    """(uid, source_ip, artifact): urls and file hashes a session touched."""
    c = table(spark, d, "commands").select(F.col("command_hash").alias("h"), F.explode("indicators").alias("i")).filter(F.col("i.ioc_kind") == "url").select("h", F.concat(F.lit("url:"), F.col("i.ioc_value")).alias("artifact"))
    a = command_events(spark, d).select(uid().alias("uid"), F.col("source.ip").alias("source_ip"), "h").join(c, "h").select("uid", "source_ip", "artifact")
    f = events(spark, d).filter(F.col("file_sha256").isNotNull()).select(uid().alias("uid"), F.col("source.ip").alias("source_ip"), F.concat(F.lit("hash:"), F.col("file_sha256")).alias("artifact"))
    return a.unionByName(f).distinct()


def components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the session-artifact graph over artifacts that at least two sessions touch."""
    a = _artifacts(spark, d).select("uid", "artifact").distinct()
    shared = a.groupBy("artifact").agg(F.count(F.lit(1)).alias("df")).filter("df >= 2")
    return connected_components(a.join(shared, "artifact"), "uid", "artifact").select("node", "component")


def infrastructure_campaigns(spark: SparkSession, d: str) -> DataFrame:
    """Components of at least three sessions and two addresses, with the artifact ranked first by count * idf."""
    a = cut_lineage(_artifacts(spark, d))
    n = a.agg(F.count_distinct("uid").alias("total"))
    df = a.groupBy("artifact").agg(F.count_distinct("uid").alias("df"))
    use = a.join(df.filter("df >= 2"), "artifact")
    comp = connected_components(use, "uid", "artifact")
    m = use.join(comp, use.uid == comp.node)
    head = m.groupBy("component").agg(F.count_distinct("uid").alias("sessions"), F.count_distinct("source_ip").alias("addresses")).filter("sessions >= 3 and addresses >= 2")
    top = m.groupBy("component", "artifact", "df").agg(F.count_distinct("uid").alias("c")).join(F.broadcast(n)).withColumn("score", F.round(F.col("c") * D.idf(F.col("total"), F.col("df")), 6))
    best = top.groupBy("component").agg(F.min(F.struct(-F.col("score"), "artifact"))["artifact"].alias("artifact"), F.max("score").alias("score"))
    return head.join(best, "component").select(F.concat(F.lit("cmp-inf-"), X.short_hash(F.col("component"))).alias("campaign_id"), "sessions", "addresses", "artifact", "score")


def artifact_idf(spark: SparkSession, d: str) -> DataFrame:
    a = _artifacts(spark, d)
    n = a.agg(F.count_distinct("uid").alias("total"))
    df = a.groupBy("artifact").agg(F.count_distinct("uid").alias("df"), F.count_distinct("source_ip").alias("addresses"))
    return df.join(F.broadcast(n)).select("artifact", "df", "addresses", F.round(D.idf(F.col("total"), F.col("df")), 6).alias("idf"))


def operations_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Playbooks and file hashes whose address sets overlap by at least half of the smaller one (two in common at least)."""
    p = _pairs(spark, d).filter("source_ip is not null and playbook_id is not null").distinct()
    f = events(spark, d).filter(F.col("file_sha256").isNotNull() & F.col("source.ip").isNotNull()).select(F.col("source.ip").alias("source_ip"), "file_sha256").distinct()
    np_, nf = p.groupBy("playbook_id").agg(F.count(F.lit(1)).alias("np")), f.groupBy("file_sha256").agg(F.count(F.lit(1)).alias("nf"))
    both = p.join(f, "source_ip").groupBy("playbook_id", "file_sha256").agg(F.count(F.lit(1)).alias("common")).filter("common >= 2")
    out = both.join(np_, "playbook_id").join(nf, "file_sha256").withColumn("ratio", F.round(F.col("common") / F.least("np", "nf"), 6)).filter("ratio >= 0.5")
    return out.select(F.concat(F.lit("op-"), X.short_hash(F.array_join(F.array_sort(F.array("playbook_id", "file_sha256")), ","))).alias("operation_id"), "playbook_id", "file_sha256", "common", "ratio")


def file_crossref(spark: SparkSession, d: str) -> DataFrame:
    """Per file and address: first drop, and the first session of the address at or after it whose commands name the file."""
    e = events(spark, d)
    f = e.filter(F.col("file_sha256").isNotNull() & F.col("filename").isNotNull() & F.col("source.ip").isNotNull())
    drop = f.groupBy("file_sha256", F.col("source.ip").alias("source_ip")).agg(F.min("ts").alias("first_drop"), F.min_by(F.element_at(F.split("filename", "/"), -1), F.struct("ts", "event_id")).alias("name"), F.min_by(uid(), F.struct("ts", "event_id")).alias("drop_uid"), F.count_distinct(uid()).alias("drops"))
    c = command_events(spark, d).select(F.col("source.ip").alias("source_ip"), uid().alias("uid"), "ts", "event_id", F.explode(F.array_distinct(F.split("command", r"[^A-Za-z0-9_.\-]+"))).alias("name"))
    # Joined on address and token, so a busy address's files don't meet all of its commands.
    named = c.join(drop.select("name").distinct(), "name", "left_semi")
    run = drop.join(named, ["source_ip", "name"]).filter(F.col("ts") >= F.col("first_drop"))
    first = run.groupBy("file_sha256", "source_ip").agg(F.min_by("uid", F.struct("ts", "event_id")).alias("run_uid"), F.min("ts").alias("first_run"))
    return drop.join(first, ["file_sha256", "source_ip"], "left").select(
        F.concat(F.lit("fcx-"), X.short_hash(F.concat_ws(":", "file_sha256", "source_ip"))).alias("crossref_id"), "name", "first_drop", "first_run", "drops", (F.col("run_uid") != F.col("drop_uid")).alias("cross_session")
    )


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Typed edges between addresses, sessions, commands, files, clusters, playbooks, networks and countries, with weights."""
    s = slim_sessions(spark, d, "source.ip", "source.asn.number", "source.geo.country_iso_code", "playbook_id", "cluster.id", "command_set").withColumn("uid", uid())

    def edge(df: DataFrame, kind: str, a: F.Column, b: F.Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), a.alias("src"), b.alias("dst")).filter("src is not null and dst is not null")

    ran = s.select("uid", F.explode(F.array_compact("command_set")).alias("h"))
    files = events(spark, d).filter(F.col("file_sha256").isNotNull()).select(uid().alias("uid"), "file_sha256")
    c = F.col
    parts = [
        edge(s, "saw", c("source_ip"), c("uid")), edge(ran, "ran", c("uid"), c("h")), edge(files, "dropped", c("uid"), c("file_sha256")), edge(s, "member_of", c("uid"), c("cluster_id")),
        edge(s, "playbook", c("uid"), c("playbook_id")), edge(s, "asn", c("source_ip"), c("source_asn_number").cast("string")), edge(s, "country", c("source_ip"), c("source_geo_country_iso_code")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind", "src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with their degree per edge kind and direction, and the drawn size log1p(degree)."""
    e = graph_edges(spark, d)
    both = e.select(F.col("src").alias("node"), "kind", F.lit("out").alias("side")).unionByName(e.select(F.col("dst").alias("node"), "kind", F.lit("in").alias("side")))
    n = both.groupBy("node", "kind", "side").agg(F.count(F.lit(1)).alias("degree"))
    return n.select("node", "kind", "side", "degree", F.round(F.log1p("degree"), 6).alias("size"))


def two_hop_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses linked through a shared dropped file (two hops over the property graph), as membership: all addresses of one file are linked, whatever pair one asks for."""
    f = events(spark, d).filter(F.col("file_sha256").isNotNull() & F.col("source.ip").isNotNull()).select(F.col("source.ip").alias("ip"), "file_sha256").distinct()
    n = f.groupBy("file_sha256").agg(F.count(F.lit(1)).alias("addresses"), F.min("ip").alias("hub")).filter("addresses > 1")
    return f.join(n, "file_sha256").select("ip", "file_sha256", "hub", "addresses")


def command_specificity(spark: SparkSession, d: str) -> DataFrame:
    """How specific a command is to playbooks: ln(C / df) / ln(C), df being the playbooks that use it."""
    s = slim_sessions(spark, d, "playbook_id", "command_set").filter(F.col("playbook_id").isNotNull())
    p = s.select("playbook_id", F.explode(F.array_compact("command_set")).alias("command_hash")).distinct()
    total = s.agg(F.count_distinct("playbook_id").alias("c"))
    df = p.groupBy("command_hash").agg(F.count(F.lit(1)).alias("df"))
    v = F.when(F.col("c") <= 1, 0.0).otherwise(F.greatest(F.least(F.log(F.col("c") / F.col("df")) / F.log("c"), F.lit(1.0)), F.lit(0.0)))
    return df.join(F.broadcast(total)).select("command_hash", "df", F.round(v, 3).alias("specificity"))


def playbook_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Five commands with the widest session coverage per playbook, and whether they set it apart (below 0.25 elsewhere)."""
    s = slim_sessions(spark, d, "playbook_id", "command_set").filter(F.col("playbook_id").isNotNull()).withColumn("uid", uid())
    size = s.groupBy("playbook_id").agg(F.count(F.lit(1)).alias("n"))
    p = s.select("uid", "playbook_id", F.explode(F.array_compact("command_set")).alias("command_hash")).distinct()
    cov = p.groupBy("playbook_id", "command_hash").agg(F.count(F.lit(1)).alias("sessions")).join(size, "playbook_id").withColumn("coverage", F.col("sessions") / F.col("n"))
    by_cmd = Window.partitionBy("command_hash").orderBy(F.desc("coverage"), "playbook_id")
    top = cov.withColumn("r", F.row_number().over(by_cmd)).filter("r <= 2").groupBy("command_hash").agg(F.max(F.when(F.col("r") == 1, F.col("coverage"))).alias("c1"), F.max(F.when(F.col("r") == 1, F.col("playbook_id"))).alias("p1"), F.max(F.when(F.col("r") == 2, F.col("coverage"))).alias("c2"))
    other = F.coalesce(F.when(F.col("p1") == F.col("playbook_id"), F.col("c2")).otherwise(F.col("c1")), F.lit(0.0))
    out = cov.join(top, "command_hash").withColumn("rank", F.row_number().over(Window.partitionBy("playbook_id").orderBy(F.desc("sessions"), "command_hash"))).filter("rank <= 5")
    return out.select("playbook_id", "command_hash", "sessions", F.round("coverage", 6).alias("coverage"), "rank", ((F.col("coverage") >= 0.25) & (other < 0.25)).alias("distinctive"))


def name_collisions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "session_clusters").filter(F.col("playbook_name").isNotNull() & F.col("playbook_id").isNotNull())
    return c.groupBy(F.lower(F.trim("playbook_name")).alias("name")).agg(F.count_distinct("playbook_id").alias("playbooks"), F.count(F.lit(1)).alias("clusters")).filter("playbooks > 1")


def mint_playbooks(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic ids minted from the member sessions of each stored cluster."""
    s = slim_sessions(spark, d, "cluster.id").filter(F.col("cluster_id").isNotNull()).withColumn("uid", uid())
    ordered = s.select("cluster_id", "uid").repartition("cluster_id").sortWithinPartitions("cluster_id", "uid")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes a cluster's members as they come by; none are held."""
        held, members, h = None, 0, None
        for b in batches:
            done = []
            for c, u in zip(b.column("cluster_id").to_pylist(), b.column("uid").to_pylist(), strict=True):
                if c != held:
                    if h:
                        done.append((held, members, h.hexdigest()))
                    held, members, h = c, 0, hashlib.sha256()
                h.update((("\n" if members else "") + u).encode())
                members += 1
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("cluster_id", "members", "digest"), x, strict=True)) for x in done])
        if h:
            yield pa.RecordBatch.from_pylist([{"cluster_id": held, "members": members, "digest": h.hexdigest()}])

    g = ordered.mapInArrow(digest, "cluster_id string, members bigint, digest string")
    return g.select("cluster_id", "members", F.concat(F.lit("spb-"), X.short_hash(F.concat(F.lit("sescl-"), F.substring("digest", 1, 16)))).alias("minted_id"))


QUERIES = {
    f.__name__: f
    for f in (
        ip_playbooks, itemsets, closed_sets, intent_itemsets, behaviour_campaigns, components, infrastructure_campaigns, artifact_idf, operations_overlap, file_crossref, graph_edges, graph_degrees,
        two_hop_addresses, command_specificity, playbook_coverage, name_collisions, mint_playbooks,
    )
}

_UID = "coalesce(sensor, 'default') || ':' || session_id"
_PAIR = f"p AS (SELECT DISTINCT source.ip AS o, playbook_id AS i FROM {SESS} WHERE source.ip IS NOT NULL AND playbook_id IS NOT NULL)"


def _sets(pair: str, k: int, size: int) -> str:
    """Level by level: owners' sets (own), each extended by a later item if it is frequent."""
    own = [f"p AS MATERIALIZED (SELECT o, i FROM p0 WHERE i IN (SELECT i FROM p0 GROUP BY 1 HAVING count(*) >= {k}))", "v1 AS (SELECT o, i AS items, [i] AS l, i AS last FROM p)"]
    for s in range(2, size + 1):
        often = f" AND v.items IN (SELECT items FROM f{s - 1})" if s > 2 else ""
        own.append(f"v{s} AS MATERIALIZED (SELECT v.o, v.items || ',' || p.i AS items, list_append(v.l, p.i) AS l, p.i AS last FROM v{s - 1} v JOIN p ON v.o = p.o WHERE p.i > v.last{often})")
        own.append(f"f{s} AS MATERIALIZED (SELECT items, CAST({s} AS INTEGER) AS size, count(*) AS support, any_value(l) AS l FROM v{s} GROUP BY 1 HAVING count(*) >= {k})")
    levels = range(2, size + 1)
    return (
        "WITH " + pair.replace("p AS", "p0 AS", 1) + ", " + ", ".join(own) + ", s AS (" + " UNION ALL ".join(f"SELECT * FROM f{x}" for x in levels) + "), held AS MATERIALIZED ("
        + " UNION ALL ".join(f"SELECT o, items, l FROM v{x} WHERE items IN (SELECT items FROM f{x})" for x in levels) + ")"
    )


#: Closed: no item outside the set is held by as many of its owners as the set has.
_CLOSED = """more AS (SELECT DISTINCT g.items FROM (SELECT h.items, p.i, count(*) AS n FROM held h JOIN p USING (o) WHERE NOT list_contains(h.l, p.i) GROUP BY 1, 2) g JOIN s ON s.items = g.items AND s.support = g.n), c AS (SELECT * FROM s ANTI JOIN more USING (items))"""
_ART = f"""a AS (SELECT DISTINCT * FROM (SELECT {_UID} AS uid, source.ip AS source_ip, 'url:' || i.ioc_value AS artifact FROM {CMD} JOIN (SELECT command_hash, unnest(indicators) AS i FROM commands) ON h = command_hash WHERE i.ioc_kind = 'url'
    UNION ALL SELECT {_UID}, source.ip, 'hash:' || file_sha256 FROM {EV} WHERE file_sha256 IS NOT NULL)), df AS (SELECT artifact, count(DISTINCT uid) AS df, count(DISTINCT source_ip) AS addresses FROM a GROUP BY 1)"""
_COMP = f"""{_ART}, e AS (SELECT DISTINCT uid AS u, artifact AS v FROM a JOIN df USING (artifact) WHERE df >= 2), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
    r(node, comp) AS (SELECT u, u FROM b UNION SELECT b.v, r.comp FROM r JOIN b ON r.node = b.u WHERE r.comp < b.v), k AS (SELECT node, min(comp) AS component FROM r GROUP BY 1),
    roots AS (SELECT node, component FROM k)"""
_COV = f"""s AS (SELECT {_UID} AS uid, playbook_id, command_set FROM {SESS} WHERE playbook_id IS NOT NULL), p AS (SELECT DISTINCT uid, playbook_id, h FROM (SELECT uid, playbook_id, unnest(command_set) AS h FROM s) WHERE h IS NOT NULL)"""
SQL = {
    "ip_playbooks": f"""SELECT source.ip AS source_ip, string_agg(DISTINCT playbook_id, ',' ORDER BY playbook_id) AS playbooks, count(*) AS sessions, min(started_at) AS first_seen, max(started_at) AS last_seen
        FROM {SESS} WHERE source.ip IS NOT NULL AND playbook_id IS NOT NULL GROUP BY 1""",
    "itemsets": _sets(_PAIR, 5, 6) + " SELECT items, size, support FROM s",
    "closed_sets": _sets(_PAIR, 5, 6) + f", {_CLOSED} SELECT items, size, support FROM c",
    "intent_itemsets": _sets(f"p AS (SELECT DISTINCT {_UID} AS o, intent AS i FROM {CMD} JOIN commands ON h = command_hash WHERE intent IS NOT NULL)", 30, 3) + " SELECT items, size, support FROM s",
    "behaviour_campaigns": _sets(_PAIR, 5, 6)
    + f""", {_CLOSED}
        SELECT 'cmp-beh-' || substr(sha256(replace(items, ',', '|')), 1, 16) AS campaign_id, items AS playbooks, count(*) AS members, min(o) AS first_member FROM c JOIN held USING (items) GROUP BY 1, 2""",
    "components": f"WITH RECURSIVE {_COMP} SELECT node, component FROM roots",
    "infrastructure_campaigns": f"""WITH RECURSIVE {_COMP}, m AS (SELECT a.*, df, component FROM a JOIN df USING (artifact) JOIN k ON k.node = a.uid WHERE df >= 2),
        h AS (SELECT component, count(DISTINCT uid) AS sessions, count(DISTINCT source_ip) AS addresses FROM m GROUP BY 1 HAVING count(DISTINCT uid) >= 3 AND count(DISTINCT source_ip) >= 2),
        t AS (SELECT component, artifact, round(count(DISTINCT uid) * (ln((SELECT count(DISTINCT uid) FROM a) + 1) - ln(df + 1)), 6) AS score FROM m GROUP BY component, artifact, df
        QUALIFY row_number() OVER (PARTITION BY component ORDER BY score DESC, artifact) = 1)
        SELECT 'cmp-inf-' || substr(sha256(component), 1, 16) AS campaign_id, sessions, addresses, artifact, score FROM h JOIN t USING (component)""",
    "artifact_idf": f"WITH {_ART} SELECT artifact, df, addresses, round(ln((SELECT count(DISTINCT uid) FROM a) + 1) - ln(df + 1), 6) AS idf FROM df",
    "operations_overlap": f"""WITH {_PAIR}, f AS (SELECT DISTINCT source.ip AS o, file_sha256 AS f FROM {EV} WHERE file_sha256 IS NOT NULL AND source.ip IS NOT NULL), np AS (SELECT i, count(*) AS n FROM p GROUP BY 1), nf AS (SELECT f, count(*) AS n FROM f GROUP BY 1),
        b AS (SELECT p.i, f.f, count(*) AS common FROM p JOIN f ON p.o = f.o GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT 'op-' || substr(sha256(least(b.i, b.f) || ',' || greatest(b.i, b.f)), 1, 16) AS operation_id, b.i AS playbook_id, b.f AS file_sha256, common, round(common / least(np.n, nf.n), 6) AS ratio
        FROM b JOIN np ON np.i = b.i JOIN nf ON nf.f = b.f WHERE round(common / least(np.n, nf.n), 6) >= 0.5""",
    "file_crossref": rf"""WITH f AS (SELECT *, source.ip AS ip, {_UID} AS uid FROM {EV} WHERE file_sha256 IS NOT NULL AND filename IS NOT NULL AND source.ip IS NOT NULL),
        d AS (SELECT file_sha256, ip, min(ts) AS first_drop, arg_min(string_split(filename, '/')[-1], (ts, event_id)) AS name, arg_min(uid, (ts, event_id)) AS drop_uid, count(DISTINCT uid) AS drops FROM f GROUP BY 1, 2),
        r AS (SELECT d.file_sha256, d.ip, arg_min({_UID}, (ts, event_id)) AS run_uid, min(ts) AS first_run FROM d JOIN {CMD} c ON c.source.ip = d.ip AND c.ts >= first_drop
        AND list_contains(regexp_split_to_array(command, '[^A-Za-z0-9_.\-]+'), name) GROUP BY 1, 2)
        SELECT 'fcx-' || substr(sha256(d.file_sha256 || ':' || d.ip), 1, 16) AS crossref_id, name, first_drop, first_run, drops, run_uid <> drop_uid AS cross_session FROM d LEFT JOIN r ON d.file_sha256 = r.file_sha256 AND d.ip = r.ip""",
    "command_specificity": f"""WITH {_COV}, t AS (SELECT count(DISTINCT playbook_id) AS c FROM s), d AS (SELECT h, count(DISTINCT playbook_id) AS df FROM p GROUP BY 1)
        SELECT h AS command_hash, df, round(CASE WHEN c <= 1 THEN 0 ELSE greatest(least(ln(c / df) / ln(c), 1), 0) END, 3) AS specificity FROM d, t""",
    "playbook_coverage": f"""WITH {_COV}, n AS (SELECT playbook_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT playbook_id, h, count(*) AS sessions, count(*) / any_value(n) AS coverage FROM p JOIN n USING (playbook_id) GROUP BY 1, 2)
        SELECT playbook_id, h AS command_hash, sessions, round(coverage, 6) AS coverage, CAST(row_number() OVER (PARTITION BY playbook_id ORDER BY sessions DESC, h) AS INTEGER) AS rank,
        coverage >= 0.25 AND NOT EXISTS (SELECT 1 FROM c x WHERE x.h = c.h AND x.playbook_id <> c.playbook_id AND x.coverage >= 0.25) AS distinctive FROM c QUALIFY rank <= 5""",
    "name_collisions": "SELECT lower(trim(playbook_name)) AS name, count(DISTINCT playbook_id) AS playbooks, count(*) AS clusters FROM session_clusters WHERE playbook_name IS NOT NULL AND playbook_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT playbook_id) > 1",
    "mint_playbooks": f"""SELECT cluster_id, members, 'spb-' || substr(sha256('sescl-' || substr(sha256(t), 1, 16)), 1, 16) AS minted_id FROM (SELECT cluster.id AS cluster_id, count(*) AS members, string_agg({_UID}, chr(10) ORDER BY {_UID}) AS t
        FROM {SESS} WHERE cluster.id IS NOT NULL GROUP BY 1)""",
    "two_hop_addresses": f"""WITH f AS (SELECT DISTINCT source.ip AS ip, file_sha256 FROM {EV} WHERE file_sha256 IS NOT NULL AND source.ip IS NOT NULL), h AS (SELECT *, min(ip) OVER (PARTITION BY file_sha256) AS hub FROM f)
        SELECT ip, file_sha256, hub, count(*) OVER (PARTITION BY file_sha256) AS addresses FROM h QUALIFY addresses > 1""",
}
_EDGES = f"""(SELECT kind, src, dst, count(*) AS weight FROM (WITH s AS (SELECT *, {_UID} AS uid FROM {SESS})
    SELECT 'saw' AS kind, source.ip AS src, uid AS dst FROM s UNION ALL SELECT 'ran', uid, h FROM (SELECT uid, unnest(command_set) AS h FROM s) UNION ALL SELECT 'dropped', {_UID}, file_sha256 FROM {EV}
    UNION ALL SELECT 'member_of', uid, cluster.id FROM s UNION ALL SELECT 'playbook', uid, playbook_id FROM s UNION ALL SELECT 'asn', source.ip, CAST(source.asn.number AS VARCHAR) FROM s
    UNION ALL SELECT 'country', source.ip, source.geo.country_iso_code FROM s) WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2, 3)"""
SQL["graph_edges"] = f"SELECT * FROM {_EDGES}"
SQL["graph_degrees"] = f"""SELECT node, kind, side, count(*) AS degree, round(ln(1 + count(*)), 6) AS size FROM (SELECT src AS node, kind, 'out' AS side FROM {_EDGES} UNION ALL SELECT dst, kind, 'in' FROM {_EDGES}) GROUP BY 1, 2, 3"""
