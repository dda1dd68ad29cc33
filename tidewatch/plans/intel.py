"""Intelligence on artifacts: canonical forms, network lists, provider verdicts, consensus, queue (survey I1-I20, L1-L5)."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import net as N
from ..session import table
from .common import CMD, EV, SESS, command_events, events, slim_sessions

NETS = [("10.0.0.0/8", "inner"), ("10.0.128.0/17", "upper"), ("198.18.0.0/15", "bench"), ("198.18.46.0/24", "hot"), ("203.0.113.0/24", "doc")]


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).filter(F.col("url").isNotNull())
    return e.groupBy(N.canonical_url(F.col("url")).alias("url")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_sha256").alias("files")).filter(F.col("url").isNotNull())


def address_classes(spark: SparkSession, d: str) -> DataFrame:
    s = slim_sessions(spark, d, "source.ip").filter(F.col("source_ip").isNotNull())
    return s.groupBy(N.address_class(F.col("source_ip")).alias("class")).agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct("source_ip").alias("addresses"))


def cidr_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Each address with the most specific listed network that contains it."""
    s = slim_sessions(spark, d, "source.ip").filter(F.col("source_ip").isNotNull())
    m = N.match_networks(s.groupBy("source_ip").agg(F.count(F.lit(1)).alias("sessions")), "source_ip", N.networks(spark, NETS))
    return m.select("source_ip", "sessions", "cidr", "network")


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """(source_ip, provider, pos, malicious, direct, clean, confidence, label): verdicts of three providers drawn from the data.

    downloads: direct evidence; volume: by sessions, with confidence growing by powers of ten; quiet: authoritative that an
    address with one session and no login is clean.
    """
    s = slim_sessions(spark, d, "source.ip", "login_success_count").filter(F.col("source_ip").isNotNull())
    f = events(spark, d).filter(F.col("file_sha256").isNotNull() & F.col("source.ip").isNotNull()).groupBy(F.col("source.ip").alias("source_ip")).agg(F.count(F.lit(1)).alias("files"))
    g = s.groupBy("source_ip").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("login_success_count", F.lit(0))).alias("ok")).join(f, "source_ip", "left")
    c = F.col
    conf = F.greatest(F.least(F.round(4 + 1.2 * F.log10("n")).cast("int"), F.lit(10)), F.lit(4))

    def signal(name: str, pos: int, mal, direct, clean, cf, label):  # noqa: ANN001, ANN202
        return F.struct(F.lit(name).alias("provider"), F.lit(pos).alias("pos"), mal.alias("malicious"), direct.alias("direct"), clean.alias("clean"), cf.alias("confidence"), label.alias("label"))

    none = F.lit(None).cast("boolean")
    rows = F.array(
        signal("downloads", 1, F.when(c("files") > 0, True), F.coalesce(c("files") > 0, F.lit(False)), F.lit(False), F.when(c("files") > 0, 9), F.when(c("files") > 0, "dropper")),
        signal("volume", 2, F.when(c("n") >= 5, True), F.lit(False), F.lit(False), F.when(c("n") >= 5, conf), F.when(c("n") >= 20, "scanner").when(c("n") >= 5, "noisy")),
        signal("quiet", 3, F.when((c("n") == 1) & (c("ok") == 0), False).otherwise(none), F.lit(False), (c("n") == 1) & (c("ok") == 0), F.when((c("n") == 1) & (c("ok") == 0), 8), F.when((c("n") == 1) & (c("ok") == 0), "benign")),
    )
    return g.select("source_ip", F.explode(rows).alias("s")).select("source_ip", "s.*")


def consensus(spark: SparkSession, d: str) -> DataFrame:
    """Direct malicious beats authoritative clean beats any vote; label of the first provider of the winning side; rarity of opinions."""
    s = _signals(spark, d)
    direct = F.bool_or(F.coalesce("malicious", F.lit(False)) & F.col("direct"))
    clean = F.bool_or("clean")
    anyone = F.bool_or(F.coalesce("malicious", F.lit(False)))
    g = s.groupBy("source_ip").agg(
        direct.alias("direct"), clean.alias("clean"), anyone.alias("any"), F.count_if("malicious").alias("votes"), F.count("malicious").alias("opinions"), F.count(F.lit(1)).alias("providers"),
        F.max(F.when(F.col("malicious"), F.col("confidence"))).alias("confidence"), F.min_by("label", F.when(F.col("malicious") & F.col("label").isNotNull(), F.col("pos"))).alias("bad_label"),
        F.min_by("label", F.when(~F.col("malicious") & F.col("label").isNotNull(), F.col("pos"))).alias("good_label"),
    )
    mal = F.when(F.col("direct"), True).when(F.col("clean"), False).otherwise(F.col("any"))
    label = F.coalesce(F.when(mal, F.col("bad_label")).otherwise(F.col("good_label")), "bad_label", "good_label", F.lit("unknown"))
    return g.select("source_ip", mal.alias("malicious"), label.alias("label"), "votes", "confidence", F.round((F.col("providers") - F.col("opinions")) / F.col("providers"), 6).alias("rarity"))


def priority_queue(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts of commands by 0.5 novelty + 0.2 (1 - confidence / 10) + 0.15 spread + 0.15 half-life (168 h); 20 best per kind."""
    c = table(spark, d, "commands")
    newest = c.agg(F.max("last_seen").alias("now"))
    e = c.select(F.explode("indicators").alias("i"), F.col("cluster.novelty_score").cast("double").alias("nov"), "confidence", "unique_source_ips", "last_seen")
    g = e.groupBy(F.col("i.ioc_kind").alias("kind"), F.col("i.ioc_value").alias("value")).agg(F.max("nov").alias("nov"), F.min("confidence").alias("conf"), F.max("unique_source_ips").alias("ips"), F.max("last_seen").alias("seen"))
    hours = F.floor((F.unix_micros("now") - F.unix_micros("seen")) / 3_600_000_000)
    score = 0.5 * F.coalesce("nov", F.lit(0.0)) + 0.2 * F.coalesce(1 - F.col("conf") / 10, F.lit(0.0)) + 0.15 * F.least(F.col("ips") / 100, F.lit(1.0)) + 0.15 * F.pow(F.lit(0.5), hours / 168)
    q = g.join(F.broadcast(newest)).withColumn("priority", F.round(score, 5))
    return q.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("priority"), "value"))).filter("rank <= 20").select("kind", "value", "priority", "rank")


def refresh_due(spark: SparkSession, d: str) -> DataFrame:
    """Hashes whose latest enrichment is older than five days at the end of the data, or that have none."""
    e = table(spark, d, "enrichment_cache").groupBy("command_hash").agg(F.max("enriched_at").alias("at"))
    now = e.agg(F.max("at").alias("now"))
    c = table(spark, d, "commands").select("command_hash").join(e, "command_hash", "left").join(F.broadcast(now))
    return c.filter(F.col("at").isNull() | (F.col("at") < F.col("now") - F.expr("INTERVAL 5 DAYS"))).select("command_hash", F.col("at").alias("refreshed_at"))


def hash_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Dropped files: occurrences, addresses, modal name (ties by name) and priority boost."""
    f = events(spark, d).filter(F.col("file_sha256").isNotNull()).select("file_sha256", "url", "source.ip", F.element_at(F.split("filename", "/"), -1).alias("name"))
    mode = f.filter("name is not null").groupBy("file_sha256", "name").agg(F.count(F.lit(1)).alias("n")).groupBy("file_sha256").agg(F.min(F.struct(-F.col("n"), "name"))["name"].alias("name"))
    g = f.groupBy("file_sha256").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ip").alias("addresses"), F.bool_or(F.col("url").isNotNull()).alias("has_url")).join(mode, "file_sha256", "left")
    return g.select("file_sha256", "n", "addresses", "has_url", "name", F.when(F.col("has_url"), 2.0).when(F.col("name").contains("authorized_keys"), 1.0).otherwise(2.0).alias("boost"))


FEEDS = {"alpha": ["abuse"], "beta": ["abuse", "hole"], "gamma": ["hole"], "delta": ["own"], "downloads": ["own"], "volume": ["count"], "quiet": ["count", "own"]}


def independent_votes(spark: SparkSession, d: str) -> DataFrame:
    """Most providers with an opinion whose upstream feeds don't overlap, per address."""
    s = _signals(spark, d).filter(F.col("malicious").isNotNull()).groupBy("source_ip").agg(F.array_sort(F.collect_set("provider")).alias("ps"))

    @F.pandas_udf("int")
    def best(v: pd.Series) -> pd.Series:
        memo: dict = {}

        def size(ps: tuple) -> int:
            if ps not in memo:
                fits = [k for k in range(len(ps) + 1) for c in combinations(ps, k) if len(set().union(*(FEEDS[p] for p in c))) == sum(len(FEEDS[p]) for p in c)]
                memo[ps] = max(fits)
            return memo[ps]

        return v.map(lambda ps: size(tuple(ps)))

    return s.select("source_ip", best("ps").alias("independent"), F.size("ps").alias("opinions"))


def spend_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Enrichment cost per day and model, with what is left of the daily budget (not below 0)."""
    e = table(spark, d, "enrichment_cache").groupBy(F.to_date("enriched_at").alias("day"), "model").agg(F.count(F.lit(1)).alias("calls"))
    spent = F.sum(F.col("calls") * 3).over(Window.partitionBy("day").orderBy("model").rowsBetween(Window.unboundedPreceding, 0))
    return e.select("day", "model", "calls", spent.alias("spent"), F.greatest(F.lit(400) - spent, F.lit(0)).alias("left"))


QUERIES = {f.__name__: f for f in (canonical_urls, address_classes, cidr_range_join, consensus, priority_queue, refresh_due, hash_artifacts, independent_votes, spend_by_day)}

_IPN = "(string_split({0}, '.')[1]::BIGINT * 16777216 + string_split({0}, '.')[2]::BIGINT * 65536 + string_split({0}, '.')[3]::BIGINT * 256 + string_split({0}, '.')[4]::BIGINT)"
_SIG = f"""g AS (SELECT source.ip AS source_ip, count(*) AS n, sum(coalesce(login_success_count, 0)) AS ok, (SELECT count(*) FROM {EV} e WHERE e.file_sha256 IS NOT NULL AND e.source.ip = s.source.ip) AS files FROM {SESS} s WHERE source.ip IS NOT NULL GROUP BY source.ip),
    v AS (SELECT source_ip, 1 AS pos, CASE WHEN files > 0 THEN true END AS m, files > 0 AS direct, false AS clean, CASE WHEN files > 0 THEN 9 END AS c, CASE WHEN files > 0 THEN 'dropper' END AS l FROM g
    UNION ALL SELECT source_ip, 2, CASE WHEN n >= 5 THEN true END, false, false, CASE WHEN n >= 5 THEN greatest(least(CAST(round(4 + 1.2 * log10(n)) AS INTEGER), 10), 4) END, CASE WHEN n >= 20 THEN 'scanner' WHEN n >= 5 THEN 'noisy' END FROM g
    UNION ALL SELECT source_ip, 3, CASE WHEN n = 1 AND ok = 0 THEN false END, false, n = 1 AND ok = 0, CASE WHEN n = 1 AND ok = 0 THEN 8 END, CASE WHEN n = 1 AND ok = 0 THEN 'benign' END FROM g)"""
SQL = {
    "canonical_urls": rf"""WITH u AS (SELECT trim(url) AS u, file_sha256 FROM {EV} WHERE url IS NOT NULL), p AS (SELECT file_sha256, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS h,
        regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?[^/:?#]+:(\d+)', 1) AS p, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS t FROM u)
        SELECT s || '://' || h || CASE WHEN p = '' OR (s = 'http' AND p = '80') OR (s = 'https' AND p = '443') OR (s = 'ftp' AND p = '21') THEN '' ELSE ':' || p END || CASE WHEN t = '' THEN '/' ELSE t END AS url,
        count(*) AS n, count(DISTINCT file_sha256) AS files FROM p WHERE s <> '' AND contains(h, '.') GROUP BY 1""",
    "address_classes": f"""WITH s AS (SELECT source.ip AS ip FROM {SESS} WHERE source.ip IS NOT NULL), c AS (SELECT ip, CASE WHEN regexp_matches(ip, '^10\\.|^192\\.168\\.|^172\\.(1[6-9]|2[0-9]|3[01])\\.') THEN 'private' WHEN regexp_matches(ip, '^127\\.') THEN 'loopback'
        WHEN regexp_matches(ip, '^169\\.254\\.') THEN 'link_local' WHEN regexp_matches(ip, '^(192\\.0\\.2|198\\.51\\.100|203\\.0\\.113)\\.') THEN 'documentation' WHEN regexp_matches(ip, '^198\\.1[89]\\.') THEN 'benchmark'
        WHEN regexp_matches(ip, '^(22[4-9]|23[0-9])\\.') THEN 'multicast' ELSE 'public' END AS class FROM s) SELECT class, count(*) AS sessions, count(DISTINCT ip) AS addresses FROM c GROUP BY 1""",
    "cidr_range_join": f"""WITH n(cidr, network, lo, hi, bits) AS (VALUES ('10.0.0.0/8', 'inner', 167772160, 184549375, 8), ('10.0.128.0/17', 'upper', 167804928, 167837695, 17), ('198.18.0.0/15', 'bench', 3323068416, 3323199487, 15),
        ('198.18.46.0/24', 'hot', 3323080192, 3323080447, 24), ('203.0.113.0/24', 'doc', 3405803776, 3405804031, 24)), s AS (SELECT source.ip AS ip, count(*) AS sessions FROM {SESS} WHERE source.ip IS NOT NULL GROUP BY 1)
        SELECT ip AS source_ip, any_value(sessions) AS sessions, arg_max(cidr, bits) AS cidr, arg_max(network, bits) AS network FROM s LEFT JOIN n ON {_IPN.format('ip')} BETWEEN lo AND hi GROUP BY 1""",
    "consensus": f"""WITH {_SIG}, a AS (SELECT source_ip, bool_or(coalesce(m, false) AND direct) AS d, bool_or(clean) AS cl, bool_or(coalesce(m, false)) AS an, count(*) FILTER (m) AS votes, count(m) AS opinions, count(*) AS providers, max(c) FILTER (m) AS confidence,
        first(l ORDER BY pos) FILTER (m AND l IS NOT NULL) AS bad, first(l ORDER BY pos) FILTER (NOT m AND l IS NOT NULL) AS good FROM v GROUP BY 1), b AS (SELECT *, CASE WHEN d THEN true WHEN cl THEN false ELSE an END AS mal FROM a)
        SELECT source_ip, mal AS malicious, coalesce(CASE WHEN mal THEN bad ELSE good END, bad, good, 'unknown') AS label, votes, confidence, round((providers - opinions) / providers, 6) AS rarity FROM b""",
    "priority_queue": """WITH e AS (SELECT unnest(indicators) AS i, cluster.novelty_score::DOUBLE AS nov, confidence, unique_source_ips, last_seen FROM commands), n AS (SELECT max(last_seen) AS now FROM commands),
        g AS (SELECT i.ioc_kind AS kind, i.ioc_value AS value, max(nov) AS nov, min(confidence) AS conf, max(unique_source_ips) AS ips, max(last_seen) AS seen FROM e GROUP BY 1, 2),
        q AS (SELECT kind, value, round(0.5 * coalesce(nov, 0) + 0.2 * coalesce(1 - conf / 10, 0) + 0.15 * least(ips / 100, 1) + 0.15 * pow(0.5, ((epoch_us(now) - epoch_us(seen)) // 3600000000) / 168), 5) AS priority FROM g, n)
        SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY priority DESC, value) AS INTEGER) AS rank FROM q QUALIFY rank <= 20""",
    "refresh_due": """WITH e AS (SELECT command_hash, max(enriched_at) AS seen FROM enrichment_cache GROUP BY 1) SELECT c.command_hash, seen AS refreshed_at FROM commands c LEFT JOIN e ON c.command_hash = e.command_hash
        WHERE seen IS NULL OR seen < (SELECT max(seen) FROM e) - INTERVAL 5 DAYS""",
    "hash_artifacts": f"""WITH f AS (SELECT file_sha256, url, source.ip AS ip, string_split(filename, '/')[-1] AS name FROM {EV} WHERE file_sha256 IS NOT NULL), m AS (SELECT file_sha256, name FROM (SELECT file_sha256, name, count(*) AS n FROM f WHERE name IS NOT NULL GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY file_sha256 ORDER BY n DESC, name) = 1), g AS (SELECT file_sha256, count(*) AS n, count(DISTINCT ip) AS addresses, bool_or(url IS NOT NULL) AS has_url FROM f GROUP BY 1)
        SELECT g.file_sha256, n, addresses, has_url, name, CASE WHEN has_url THEN 2.0::DOUBLE WHEN contains(name, 'authorized_keys') THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS boost FROM g LEFT JOIN m ON g.file_sha256 = m.file_sha256""",
    "spend_by_day": """WITH e AS (SELECT CAST(enriched_at AS DATE) AS day, model, count(*) AS calls FROM enrichment_cache GROUP BY 1, 2), s AS (SELECT *, CAST(sum(calls * 3) OVER (PARTITION BY day ORDER BY model ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM e)
        SELECT day, model, calls, spent, greatest(400 - spent, 0) AS left FROM s""",
}
