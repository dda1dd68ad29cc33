"""Address layer: roll-ups over sessions and feature blocks (survey C1-C16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dist as D
from ..functions import text as X
from ..session import table
from .commands import PUBLIC_SQL
from .common import EV, SESS, events, slim_sessions


def ip_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Per address over its distinct sessions: counts, times, mean duration, distinct credentials, playbooks, classification."""
    s = slim_sessions(spark, d, "source.ip", "login_success_count", "command_count", "started_at", "ended_at", "duration", "playbook_id", "classification").filter(F.col("source_ip").isNotNull())
    return s.groupBy("source_ip").agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_if(F.col("login_success_count") > 0).alias("successful_sessions"),
        F.count_if(F.col("command_count") > 0).alias("command_sessions"),
        F.sum("command_count").alias("total_commands"),
        F.min("started_at").alias("first_seen"),
        F.max(F.coalesce("ended_at", "started_at")).alias("last_seen"),
        F.round(F.avg(F.col("duration") / 1e9), 4).alias("mean_duration_s"),
        F.count_distinct("playbook_id").alias("playbooks"),
        X.most_restrictive(F.col("classification")).alias("classification"),
    )


def ip_refresh(spark: SparkSession, d: str) -> DataFrame:
    """All sessions of the addresses that were active in the last week of the data, counted again."""
    s = slim_sessions(spark, d, "source.ip", "started_at").filter(F.col("source_ip").isNotNull())
    newest = s.agg(F.max("started_at").alias("t"))
    touched = s.join(F.broadcast(newest)).filter(F.col("started_at") > F.col("t") - F.expr("INTERVAL 7 DAYS")).select("source_ip").distinct()
    return s.join(touched, "source_ip", "left_semi").groupBy("source_ip").agg(F.count(F.lit(1)).alias("sessions"))


def ip_credentials(spark: SparkSession, d: str) -> DataFrame:
    s = slim_sessions(spark, d, "source.ip", "credentials").filter(F.col("source_ip").isNotNull())
    return s.select("source_ip", F.explode("credentials").alias("c")).groupBy("source_ip").agg(F.array_join(F.array_sort(F.collect_set("c")), " ").alias("credentials"), F.count_distinct("c").alias("n"))


def ip_playbook_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Playbooks of an address with counts and rank (ties by id); rank 1 is the dominant one."""
    s = slim_sessions(spark, d, "source.ip", "playbook_id").filter(F.col("source_ip").isNotNull() & F.col("playbook_id").isNotNull())
    n = s.groupBy("source_ip", "playbook_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("source_ip").orderBy(F.desc("n"), "playbook_id")))


def ip_active_days(spark: SparkSession, d: str) -> DataFrame:
    days = F.greatest((F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 86400e6, F.lit(0.0))
    i = table(spark, d, "ips_rollup").select("source_ip", "run_id", "first_seen", "last_seen").distinct()
    return i.select("source_ip", "run_id", F.round(F.coalesce(days, F.lit(0.0)), 6).alias("active_days"))


def ip_hassh_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Id over an address's dominant client fingerprint and the sorted set of all."""
    e = events(spark, d).filter(F.col("hassh").isNotNull() & F.col("source.ip").isNotNull()).groupBy(F.col("source.ip").alias("source_ip"), "hassh").agg(F.count(F.lit(1)).alias("n"))
    s = e.groupBy("source_ip").agg(F.min(F.struct(-F.col("n"), "hassh"))["hassh"].alias("dominant"), F.array_sort(F.collect_set("hassh")).alias("hs"))
    return s.select("source_ip", "dominant", F.concat(F.lit("hcl-"), X.short_hash(F.concat_ws("|", "dominant", F.array_join("hs", "|")))).alias("hassh_cluster"))


def top_asns(spark: SparkSession, d: str) -> DataFrame:
    s = slim_sessions(spark, d, "source.asn.number", "source.ip").filter(F.col("source_asn_number").isNotNull())
    return s.groupBy(F.col("source_asn_number").alias("asn")).agg(F.count_distinct("source_ip").alias("addresses")).orderBy(F.desc("addresses"), "asn").limit(20)


BINS = 16


def credential_bins(spark: SparkSession, d: str) -> DataFrame:
    """Hashed histogram of an address's credentials, L1-normalised (one row per filled bin)."""
    s = slim_sessions(spark, d, "source.ip", "credentials").filter(F.col("source_ip").isNotNull())
    c = s.select("source_ip", F.explode("credentials").alias("c")).distinct()
    # First 64 bits of sha256 mod a power of two: the last hex digits of that prefix decide.
    b = F.conv(F.substring(F.sha2("c", 256), 16, 1), 16, 10).cast("int") % BINS
    n = c.groupBy("source_ip", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("weight", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source_ip")), 6))


def behaviour_block(spark: SparkSession, d: str) -> DataFrame:
    """Clipped log-scaled volume, commands, success ratio of each address and run."""
    i = table(spark, d, "ips_rollup").groupBy("source_ip", "run_id").agg(F.max("total_sessions").alias("s"), F.max("successful_sessions").alias("ok"), F.max("total_commands").alias("c"))
    return i.select(
        "source_ip", "run_id", F.round(D.log_scaled(F.col("s"), 1e5), 6).alias("f_sessions"), F.round(D.log_scaled(F.col("c"), 1e4), 6).alias("f_commands"),
        F.round(F.when(F.col("s") > 0, F.col("ok") / F.col("s")).otherwise(0.0), 6).alias("f_success"),
    )


def country_onehot(spark: SparkSession, d: str) -> DataFrame:
    """One-hot of the five commonest countries and the rest, per address (its most frequent country)."""
    s = slim_sessions(spark, d, "source.ip", "source.geo.country_iso_code").filter(F.col("source_ip").isNotNull()).withColumnRenamed("source_geo_country_iso_code", "cc")
    mode = s.filter(F.col("cc").isNotNull()).groupBy("source_ip", "cc").agg(F.count(F.lit(1)).alias("n")).groupBy("source_ip").agg(F.min(F.struct(-F.col("n"), "cc"))["cc"].alias("cc"))
    top = mode.groupBy("cc").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cc").limit(5).agg(F.collect_list("cc").alias("top"))
    m = mode.join(F.broadcast(top))
    return m.select("source_ip", F.when(F.array_contains("top", F.col("cc")), F.col("cc")).otherwise("other").alias("country"), F.array_position("top", F.col("cc")).alias("slot"))


def intent_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of intents over an address's sessions, and their diversity (entropy)."""
    s = slim_sessions(spark, d, "source.ip", "dominant_intent").filter(F.col("source_ip").isNotNull() & F.col("dominant_intent").isNotNull())
    n = s.groupBy("source_ip", "dominant_intent").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("source_ip").agg(F.round(D.entropy(F.array_sort(F.collect_list(F.col("n").cast("double")))), 4).alias("diversity"), F.round(F.max("n") / F.sum("n"), 6).alias("top_share"), F.count(F.lit(1)).alias("intents"))


def cluster_bags(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF of session clusters inside each address's bag unit length."""
    s = slim_sessions(spark, d, "source.ip", "cluster.id").filter(F.col("source_ip").isNotNull() & F.col("cluster_id").isNotNull())
    n = s.groupBy("source_ip", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    df = n.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("df"))
    total = n.agg(F.count_distinct("source_ip").alias("total"))
    w = n.join(df, "cluster_id").join(F.broadcast(total)).withColumn("w", F.col("n") * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1))
    return w.select("source_ip", "cluster_id", "n", F.round(F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("source_ip"))), 6).alias("weight"))


def cluster_playbooks(spark: SparkSession, d: str) -> DataFrame:
    """Address clusters with their three commonest playbooks, over the sessions of their members."""
    ip = table(spark, d, "ips_rollup").filter(F.col("cluster.id").isNotNull() & (F.col("cluster.id") != "-1")).select("source_ip", F.col("cluster.id").alias("ip_cluster")).distinct()
    s = slim_sessions(spark, d, "source.ip", "playbook_id").filter(F.col("playbook_id").isNotNull())
    n = s.join(ip, "source_ip").groupBy("ip_cluster", "playbook_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("ip_cluster").orderBy(F.desc("n"), "playbook_id"))).filter("rank <= 3")


QUERIES = {
    f.__name__: f
    for f in (ip_rollup, ip_refresh, ip_credentials, ip_playbook_distribution, ip_active_days, ip_hassh_cluster, top_asns, credential_bins, behaviour_block, country_onehot, intent_shares, cluster_bags, cluster_playbooks)
}

SQL = {
    "ip_rollup": f"""SELECT source.ip AS source_ip, count(*) AS total_sessions, count(*) FILTER (login_success_count > 0) AS successful_sessions, count(*) FILTER (command_count > 0) AS command_sessions,
        CAST(sum(command_count) AS BIGINT) AS total_commands, min(started_at) AS first_seen, max(coalesce(ended_at, started_at)) AS last_seen, round(avg(duration / 1e9), 4) AS mean_duration_s,
        count(DISTINCT playbook_id) AS playbooks, {PUBLIC_SQL} AS classification FROM {SESS} WHERE source.ip IS NOT NULL GROUP BY 1""",
    "ip_refresh": f"""WITH s AS (SELECT source.ip AS ip, started_at FROM {SESS} WHERE source.ip IS NOT NULL)
        SELECT ip AS source_ip, count(*) AS sessions FROM s WHERE ip IN (SELECT ip FROM s WHERE started_at > (SELECT max(started_at) FROM s) - INTERVAL 7 DAYS) GROUP BY 1""",
    "ip_credentials": f"""SELECT source_ip, array_to_string(list_sort(list(DISTINCT c)), ' ') AS credentials, count(DISTINCT c) AS n FROM (SELECT source.ip AS source_ip, unnest(credentials) AS c FROM {SESS} WHERE source.ip IS NOT NULL) GROUP BY 1""",
    "ip_playbook_distribution": f"""SELECT source_ip, playbook_id, n, CAST(row_number() OVER (PARTITION BY source_ip ORDER BY n DESC, playbook_id) AS INTEGER) AS rank FROM
        (SELECT source.ip AS source_ip, playbook_id, count(*) AS n FROM {SESS} WHERE source.ip IS NOT NULL AND playbook_id IS NOT NULL GROUP BY 1, 2)""",
    "ip_active_days": "SELECT DISTINCT source_ip, run_id, round(coalesce(greatest((epoch_us(last_seen) - epoch_us(first_seen)) / 86400e6, 0), 0), 6) AS active_days FROM (SELECT DISTINCT source_ip, run_id, first_seen, last_seen FROM ips_rollup)",
    "ip_hassh_cluster": f"""SELECT source_ip, dominant, 'hcl-' || substr(sha256(dominant || '|' || hs), 1, 16) AS hassh_cluster FROM (SELECT source_ip, first(hassh ORDER BY n DESC, hassh) AS dominant, string_agg(hassh, '|' ORDER BY hassh) AS hs FROM
        (SELECT source.ip AS source_ip, hassh, count(*) AS n FROM {EV} WHERE hassh IS NOT NULL AND source.ip IS NOT NULL GROUP BY 1, 2) GROUP BY 1)""",
    "top_asns": f"SELECT source.asn.number AS asn, count(DISTINCT source.ip) AS addresses FROM {SESS} WHERE source.asn.number IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "credential_bins": f"""SELECT source_ip, bin, n, round(n / sum(n) OVER (PARTITION BY source_ip), 6) AS weight FROM (SELECT source_ip, CAST(('0x' || substr(sha256(c), 1, 16))::UBIGINT % 16 AS INTEGER) AS bin, count(*) AS n FROM
        (SELECT DISTINCT source.ip AS source_ip, unnest(credentials) AS c FROM {SESS} WHERE source.ip IS NOT NULL) GROUP BY 1, 2)""",
    "behaviour_block": """SELECT source_ip, run_id, round(least(greatest(ln(1 + coalesce(s, 0)) / ln(1 + 1e5), 0), 1), 6) AS f_sessions, round(least(greatest(ln(1 + coalesce(c, 0)) / ln(1 + 1e4), 0), 1), 6) AS f_commands,
        round(CASE WHEN s > 0 THEN ok / s ELSE 0 END, 6) AS f_success FROM (SELECT source_ip, run_id, max(total_sessions) AS s, max(successful_sessions) AS ok, max(total_commands) AS c FROM ips_rollup GROUP BY 1, 2)""",
    "country_onehot": f"""WITH m AS (SELECT source_ip, first(cc ORDER BY n DESC, cc) AS cc FROM (SELECT source.ip AS source_ip, source.geo.country_iso_code AS cc, count(*) AS n FROM {SESS}
        WHERE source.ip IS NOT NULL AND source.geo.country_iso_code IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
        t AS (SELECT cc, row_number() OVER (ORDER BY n DESC, cc) AS slot FROM (SELECT cc, count(*) AS n FROM m GROUP BY 1) ORDER BY n DESC, cc LIMIT 5)
        SELECT source_ip, CASE WHEN slot IS NULL THEN 'other' ELSE m.cc END AS country, coalesce(slot, 0) AS slot FROM m LEFT JOIN t ON m.cc = t.cc""",
    "intent_shares": f"""SELECT source_ip, round(-sum(p * log2(p)), 4) + 0 AS diversity, round(max(n) / sum(n), 6) AS top_share, count(*) AS intents FROM (SELECT source_ip, n, n / sum(n) OVER (PARTITION BY source_ip) AS p FROM
        (SELECT source.ip AS source_ip, dominant_intent, count(*) AS n FROM {SESS} WHERE source.ip IS NOT NULL AND dominant_intent IS NOT NULL GROUP BY 1, 2)) GROUP BY 1""",
    "cluster_bags": f"""WITH n AS (SELECT source.ip AS source_ip, cluster.id AS cluster_id, count(*) AS n FROM {SESS} WHERE source.ip IS NOT NULL AND cluster.id IS NOT NULL GROUP BY 1, 2), df AS (SELECT cluster_id, count(*) AS df FROM n GROUP BY 1),
        w AS (SELECT source_ip, n.cluster_id, n, n * (ln((1 + (SELECT count(DISTINCT source_ip) FROM n)) / (1 + df)) + 1) AS w FROM n JOIN df ON n.cluster_id = df.cluster_id)
        SELECT source_ip, cluster_id, n, round(w / sqrt(sum(w * w) OVER (PARTITION BY source_ip)), 6) AS weight FROM w""",
    "cluster_playbooks": f"""SELECT ip_cluster, playbook_id, n, CAST(row_number() OVER (PARTITION BY ip_cluster ORDER BY n DESC, playbook_id) AS INTEGER) AS rank FROM (SELECT ip_cluster, playbook_id, count(*) AS n FROM {SESS} s
        JOIN (SELECT DISTINCT source_ip, cluster.id AS ip_cluster FROM ips_rollup WHERE cluster.id IS NOT NULL AND cluster.id <> '-1') i ON s.source.ip = i.source_ip WHERE playbook_id IS NOT NULL GROUP BY 1, 2) QUALIFY rank <= 3""",
}
