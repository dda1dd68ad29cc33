"""Recomputation and pairwise upkeep (survey A25, A31, D29, E12, H18, I4, K8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dist as D
from ..functions import text as X
from ..session import table
from .commands import _DIGITS, _QUAD, RULES, _match, _rule
from .common import SESS, slim_sessions
from .lifecycle import SQL as LIFE
from .lifecycle import drift_commands, drift_geo, drift_size


def retriage(spark: SparkSession, d: str) -> DataFrame:
    """Rule reasons computed anew while runtime reasons stay; the stored reasons are the indicator kinds, prefixed."""
    c = table(spark, d, "commands")
    stored = F.array_distinct(F.transform(F.coalesce("indicators", F.array().cast(c.schema["indicators"].dataType)), lambda i: F.concat(F.lit("ioc_"), i["ioc_kind"])))
    kept = F.filter(stored, lambda r: r != "ioc_ip")
    fresh = F.array_compact(F.array(F.when(F.col("command_line").rlike(X.IPV4), F.lit("ip_literal")), F.when(F.col("confidence") <= 4, F.lit("low_confidence"))))
    return c.select("command_hash", F.array_join(F.array_sort(F.array_union(kept, fresh)), ",").alias("reasons"))


def rule_changes(spark: SparkSession, d: str) -> DataFrame:
    """Commands whose rule hits differ from an older stamp (made by the first three rules)."""
    c = F.col("command_line")

    def hits(rules: list) -> F.Column:
        return F.array_sort(F.array_compact(F.array(*[F.when(_rule(c, k, v), F.lit(i)) for i, k, v in rules])))

    x = table(spark, d, "commands").select("command_hash", hits(RULES[:3]).alias("old"), hits(RULES).alias("new"))
    return x.filter(~F.col("old").eqNullSafe(F.col("new"))).select("command_hash", F.array_join(F.array_except("new", "old"), ",").alias("added"))


def nearest_addresses(spark: SparkSession, d: str) -> DataFrame:
    """For every playbook the three others with the most similar address sets (Jaccard), through shared addresses."""
    p = slim_sessions(spark, d, "source.ip", "playbook_id").filter("source_ip is not null and playbook_id is not null").select("source_ip", "playbook_id").distinct()
    n = p.groupBy("playbook_id").agg(F.count(F.lit(1)).alias("n"))
    sets = p.groupBy("source_ip").agg(F.array_sort(F.collect_set("playbook_id")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("w"))
    both = sets.select("x", "w", F.explode("x").alias("a")).select("a", "w", F.explode("x").alias("b")).filter("a <> b").groupBy("a", "b").agg(F.sum("w").alias("common"))
    j = both.join(n.select(F.col("playbook_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("playbook_id").alias("b"), F.col("n").alias("nb")), "b")
    j = j.withColumn("jaccard", F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 6))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("jaccard"), "b"))).filter("rank <= 3").select(F.col("a").alias("playbook_id"), F.col("b").alias("other"), "common", "jaccard", "rank")


def indistinguishable(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of playbooks no command sets apart: none that a quarter of one's sessions run and under a quarter of the other's."""
    s = slim_sessions(spark, d, "playbook_id", "command_set").filter("playbook_id is not null")
    size = s.groupBy("playbook_id").agg(F.count(F.lit(1)).alias("n"))
    c = s.select("playbook_id", F.explode(F.array_distinct(F.array_compact("command_set"))).alias("h")).groupBy("playbook_id", "h").agg(F.count(F.lit(1)).alias("k")).join(size, "playbook_id")
    feats = c.filter("k / n >= 0.25").groupBy("playbook_id").agg(F.array_sort(F.collect_set("h")).alias("f"))
    # No separating command means equal sets of widely run commands, so groups are found by hashing the sets.
    full = size.select("playbook_id").join(feats, "playbook_id", "left").withColumn("sig", F.sha2(F.array_join(F.coalesce("f", F.array().cast("array<string>")), "|"), 256))
    g = full.groupBy("sig").agg(F.count(F.lit(1)).alias("members"), F.min("playbook_id").alias("first"))
    return full.join(g, "sig").filter("members > 1").select("playbook_id", F.col("first").alias("group_id"), "members")


def drift_findings(spark: SparkSession, d: str) -> DataFrame:
    """All kinds of drift in one list with content-addressed ids."""
    a = drift_commands(spark, d).filter("drift").select(F.lit("command_drift").alias("kind"), "playbook_id", F.concat_ws("/", "added", "removed").alias("delta"))
    b = drift_geo(spark, d).filter("distance >= 0.4").select(F.lit("geo_drift").alias("kind"), "playbook_id", F.lit("networks").alias("delta"))
    c = drift_size(spark, d).filter("drift").select(F.lit("size_drift").alias("kind"), "playbook_id", F.concat_ws("/", "first_addresses", "last_addresses").alias("delta"))
    u = a.unionByName(b).unionByName(c)
    return u.select("kind", "playbook_id", "delta", F.concat(F.lit("find-dri-"), X.short_hash(F.concat_ws(":", "playbook_id", "kind", "delta"))).alias("finding_id"))


def provider_merge(spark: SparkSession, d: str) -> DataFrame:
    """Per-model blocks of a hash merged over time: the newest block of each model, in one map; how many blocks it has."""
    e = table(spark, d, "enrichment_cache")
    last = e.groupBy("command_hash", "model").agg(F.max(F.struct("enriched_at", "config_hash")).alias("x"))
    g = last.groupBy("command_hash").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.col("x.config_hash").alias("c"))))).alias("m"), F.max("x.enriched_at").alias("refreshed"))
    return g.select("command_hash", F.size("m").alias("blocks"), F.array_join(F.transform(F.map_entries("m"), lambda v: F.concat(v["key"], F.lit("="), F.coalesce(v["value"], F.lit("")))), ";").alias("text"), "refreshed")


def label_overlap(spark: SparkSession, d: str) -> DataFrame:
    """For each intent the stored cluster that shares most commands with it, both ways (Jaccard of the pair)."""
    c = table(spark, d, "commands").filter("intent is not null and cluster.id is not null").select("intent", F.col("cluster.id").alias("cluster"))
    n = c.groupBy("intent", "cluster").agg(F.count(F.lit(1)).alias("n"))
    w = n.withColumn("a", F.sum("n").over(Window.partitionBy("intent"))).withColumn("b", F.sum("n").over(Window.partitionBy("cluster"))).withColumn("j", F.round(F.col("n") / (F.col("a") + F.col("b") - F.col("n")), 6))
    return w.withColumn("r", F.row_number().over(Window.partitionBy("intent").orderBy(F.desc("j"), "cluster"))).filter("r = 1").select("intent", "cluster", "n", F.col("j").alias("jaccard"))


def session_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Every session against its playbook's most typical session (the most frequent command set): Jaccard of the commands."""
    s = slim_sessions(spark, d, "playbook_id", "command_set").filter("playbook_id is not null").withColumn("hs", F.array_sort(F.array_distinct(F.array_compact("command_set")))).filter(F.size("hs") > 0)
    t = s.groupBy("playbook_id", "hs").agg(F.count(F.lit(1)).alias("n")).groupBy("playbook_id").agg(F.min(F.struct(-F.col("n"), "hs"))["hs"].alias("typical"))
    return s.join(t, "playbook_id").select("sensor", "session_id", "playbook_id", F.round(D.jaccard(F.col("hs"), F.col("typical")), 6).alias("jaccard"))


QUERIES = {f.__name__: f for f in (retriage, rule_changes, nearest_addresses, indistinguishable, drift_findings, provider_merge, label_overlap, session_similarity)}

_COVER = f"""s AS (SELECT sensor || ':' || session_id AS uid, playbook_id, command_set FROM {SESS} WHERE playbook_id IS NOT NULL), n AS (SELECT playbook_id, count(*) AS n FROM s GROUP BY 1),
    c AS (SELECT playbook_id, h, count(*) AS k FROM (SELECT playbook_id, unnest(list_distinct(command_set)) AS h FROM s) WHERE h IS NOT NULL GROUP BY 1, 2)"""
SQL = {
    "retriage": f"""SELECT command_hash, array_to_string(list_sort(list_distinct(list_concat(list_filter(list_transform(coalesce(indicators, []), lambda i: 'ioc_' || i.ioc_kind), lambda r: r <> 'ioc_ip'),
        list_filter([CASE WHEN len(regexp_extract_all({_DIGITS}, {_QUAD})) > 0 THEN 'ip_literal' END, CASE WHEN confidence <= 4 THEN 'low_confidence' END], lambda x: x IS NOT NULL)))), ',') AS reasons FROM commands""",
    "rule_changes": "SELECT command_hash, added FROM (SELECT command_hash, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_match(k, v)} THEN '{i}' END" for i, k, v in RULES[3:]) + "], lambda x: x IS NOT NULL), ',') AS added FROM commands) WHERE added <> ''",
    "nearest_addresses": f"""WITH p AS (SELECT DISTINCT source.ip AS ip, playbook_id AS p FROM {SESS} WHERE source.ip IS NOT NULL AND playbook_id IS NOT NULL), n AS (SELECT p, count(*) AS n FROM p GROUP BY 1),
        j AS (SELECT x.p AS a, y.p AS b, count(*) AS common FROM p x JOIN p y ON x.ip = y.ip AND x.p <> y.p GROUP BY 1, 2), r AS (SELECT a, b, common, round(common / (na.n + nb.n - common), 6) AS jaccard FROM j JOIN n na ON na.p = a JOIN n nb ON nb.p = b)
        SELECT a AS playbook_id, b AS other, common, jaccard, CAST(row_number() OVER (PARTITION BY a ORDER BY jaccard DESC, b) AS INTEGER) AS rank FROM r QUALIFY rank <= 3""",
    "indistinguishable": f"""WITH {_COVER}, f AS (SELECT n.playbook_id, coalesce(string_agg(h, '|' ORDER BY h) FILTER (k / n >= 0.25), '') AS sig FROM n LEFT JOIN c USING (playbook_id) GROUP BY 1)
        SELECT playbook_id, min(playbook_id) OVER (PARTITION BY sig) AS group_id, count(*) OVER (PARTITION BY sig) AS members FROM f QUALIFY members > 1""",
    "drift_findings": f"""WITH u AS (SELECT 'command_drift' AS kind, playbook_id, added || '/' || removed AS delta FROM ({LIFE['drift_commands']}) WHERE drift UNION ALL SELECT 'geo_drift', playbook_id, 'networks' FROM ({LIFE['drift_geo']}) WHERE distance >= 0.4
        UNION ALL SELECT 'size_drift', playbook_id, first_addresses || '/' || last_addresses FROM ({LIFE['drift_size']}) WHERE drift) SELECT *, 'find-dri-' || substr(sha256(playbook_id || ':' || kind || ':' || delta), 1, 16) AS finding_id FROM u""",
    "provider_merge": """WITH l AS (SELECT command_hash, model, enriched_at, config_hash FROM enrichment_cache QUALIFY row_number() OVER (PARTITION BY command_hash, model ORDER BY enriched_at DESC, config_hash DESC) = 1)
        SELECT command_hash, CAST(count(*) AS INTEGER) AS blocks, string_agg(model || '=' || coalesce(config_hash, ''), ';' ORDER BY model) AS text, max(enriched_at) AS refreshed FROM l GROUP BY 1""",
    "label_overlap": """WITH n AS (SELECT intent, cluster.id AS cluster, count(*) AS n FROM commands WHERE intent IS NOT NULL AND cluster.id IS NOT NULL GROUP BY 1, 2),
        w AS (SELECT intent, cluster, n, round(n / (sum(n) OVER (PARTITION BY intent) + sum(n) OVER (PARTITION BY cluster) - n), 6) AS jaccard FROM n) SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY intent ORDER BY jaccard DESC, cluster) = 1""",
    "session_similarity": f"""WITH s AS (SELECT sensor, session_id, playbook_id, list_sort(list_distinct(list_filter(command_set, lambda x: x IS NOT NULL))) AS hs FROM {SESS} WHERE playbook_id IS NOT NULL AND command_set IS NOT NULL),
        t AS (SELECT playbook_id, hs AS ty FROM (SELECT playbook_id, hs, count(*) AS n FROM s WHERE len(hs) > 0 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY playbook_id ORDER BY n DESC, hs) = 1)
        SELECT sensor, session_id, playbook_id, round(len(list_intersect(hs, ty)) / (len(hs) + len(ty) - len(list_intersect(hs, ty))), 6) AS jaccard FROM s JOIN t USING (playbook_id) WHERE len(hs) > 0""",
}
