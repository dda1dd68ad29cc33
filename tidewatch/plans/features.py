"""Feature blocks of addresses and the vector they make together (survey C6-C11, C14, C16).

Features are rows (source_ip, pos, value); a missing row is a zero.  Positions: behaviour 0-3, first tier 4-28
(intents 11, playbook bins 8, diversity 2, active days, volume 3), credential bins 29-44, client fingerprint bins 45-52,
networks 53-73 (the largest, then one for the rest), countries from 74 on, in order of their codes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dist as D
from ..operators.nearest import as_arrays, mean_vectors, nearest, usable
from ..session import table
from .common import EV, SESS, events, slim_sessions

# The closed set of intents, in order; scales of the features; weights of the blocks.
INTENTS = ["account_manipulation", "benign_noise", "credential_data_access", "cryptomining", "ddos_botnet", "defense_evasion", "download_ingress", "execute_payload", "host_recon", "install_persistence", "unknown"]
SCALES = {"sessions": 100_000.0, "duration": 3_600.0, "days": 365.0, "commands": 10_000.0, "per_session": 100.0, "downloads": 100.0, "playbooks": 50.0}
WEIGHTS = {"behaviour": 0.05, "tier1": 0.10, "credentials": 0.10, "hassh": 0.05, "network": 0.10, "country": 0.10}
CREDENTIAL_BINS, HASSH_BINS, PLAYBOOK_BINS, TOP_NETWORKS = 16, 8, 8, 20
AT = {"behaviour": 0, "intents": 4, "playbooks": 15, "diversity": 23, "days": 25, "volume": 26, "credentials": 29, "hassh": 45, "network": 53, "country": 74}


def _bin(c: Column, k: int) -> Column:
    """First 64 bits of sha256 modulo a power of two up to 16: the last digit of that prefix decides."""
    return F.conv(F.substring(F.sha2(c, 256), 16, 1), 16, 10).cast("int") % k


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    cols = ["source.ip", "source.geo.country_iso_code", "source.asn.number", "login_success_count", "command_count", "duration", "started_at", "ended_at", "dominant_intent", "playbook_id", "credentials", "cluster.novelty_score"]
    return slim_sessions(spark, d, *cols).filter(F.col("source_ip").isNotNull())


def _shares(counts: DataFrame, at: int, slot: str, weight: float) -> DataFrame:
    """(source_ip, pos, value): counts (source_ip, slot, n) as shares of the address's sum."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy("source_ip"))
    return counts.select("source_ip", (F.lit(at) + F.col(slot)).cast("int").alias("pos"), (share * weight).alias("value"))


def _mode(s: DataFrame, col: str) -> DataFrame:
    n = s.filter(F.col(col).isNotNull()).groupBy("source_ip", F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("source_ip").agg(F.min(F.struct(-F.col("n"), "v"))["v"].alias("v"))


def _rows(df: DataFrame, cells: list[tuple[int, Column]]) -> DataFrame:
    return df.select("source_ip", F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), v.cast("double").alias("value")) for p, v in cells])).alias("x")).select("source_ip", "x.pos", "x.value")


def ip_behaviour(spark: SparkSession, d: str) -> DataFrame:
    """Volume, success rate, mean novelty and mean duration, each between 0 and 1 times the block's weight."""
    g = _sessions(spark, d).groupBy("source_ip").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("login_success_count") > 0).alias("ok"), F.avg(F.col("cluster_novelty_score").cast("double")).alias("nov"), F.avg(F.col("duration") / 1e9).alias("dur")
    )
    w = WEIGHTS["behaviour"]
    clip = lambda x: F.greatest(F.least(F.coalesce(x, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    cells = [D.log_scaled(F.col("n"), SCALES["sessions"]), clip(F.col("ok") / F.col("n")), clip(F.col("nov")), D.log_scaled(F.col("dur"), SCALES["duration"])]
    return _rows(g, [(i, F.round(c * w, 8)) for i, c in enumerate(cells)]).filter("value <> 0")


def ip_tier1(spark: SparkSession, d: str) -> DataFrame:
    """Shares of intents and of playbook bins, diversity, active days and volume."""
    s, w = _sessions(spark, d), WEIGHTS["tier1"]
    names = F.array(*map(F.lit, INTENTS))
    intents = s.filter(F.col("dominant_intent").isNotNull()).groupBy("source_ip", "dominant_intent").agg(F.count(F.lit(1)).alias("n"))
    shares = _shares(intents.withColumn("slot", F.array_position(names, F.col("dominant_intent")) - 1), AT["intents"], "slot", w).filter(F.col("pos") >= AT["intents"])
    playbooks = s.filter(F.col("playbook_id").isNotNull()).groupBy("source_ip", "playbook_id").agg(F.count(F.lit(1)).alias("n"))
    bins = _shares(playbooks.groupBy("source_ip", _bin(F.col("playbook_id"), PLAYBOOK_BINS).alias("slot")).agg(F.sum("n").alias("n")), AT["playbooks"], "slot", w)
    loads = events(spark, d).filter((F.col("event_action") == "session.file_download") & F.col("source.ip").isNotNull()).groupBy(F.col("source.ip").alias("source_ip")).agg(F.count(F.lit(1)).alias("loads"))
    g = s.groupBy("source_ip").agg(
        F.count(F.lit(1)).alias("n"), F.sum("command_count").alias("c"), F.count_distinct("dominant_intent").alias("ui"), F.count_distinct("playbook_id").alias("up"), F.min("started_at").alias("a"), F.max(F.coalesce("ended_at", "started_at")).alias("b")
    ).join(loads, "source_ip", "left")
    days = F.greatest((F.unix_micros("b") - F.unix_micros("a")) / 86400e6, F.lit(0.0))
    cells = [
        (AT["diversity"], D.log_scaled(F.col("ui"), len(INTENTS))), (AT["diversity"] + 1, D.log_scaled(F.col("up"), SCALES["playbooks"])), (AT["days"], D.log_scaled(days, SCALES["days"])),
        (AT["volume"], D.log_scaled(F.col("c"), SCALES["commands"])), (AT["volume"] + 1, F.least(F.coalesce("c", F.lit(0)) / F.col("n") / SCALES["per_session"], F.lit(1.0))), (AT["volume"] + 2, D.log_scaled(F.col("loads"), SCALES["downloads"])),
    ]
    out = shares.unionByName(bins).unionByName(_rows(g, [(p, v * w) for p, v in cells]))
    return out.select("source_ip", "pos", F.round("value", 8).alias("value")).filter("value <> 0")


def ip_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Country, network (the largest one by one, the rest together) and hashed credentials of an address."""
    s = _sessions(spark, d)
    country, network = _mode(s, "source_geo_country_iso_code"), _mode(s, "source_asn_number")
    # Two tables of a row per country code and of TOP_NETWORKS rows.
    codes = country.select("v").distinct().select("v", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("v")) - 1).alias("slot"))
    top = network.groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").limit(TOP_NETWORKS)
    top = top.select("v", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "v")) - 1).alias("slot"))
    everyone = s.select("source_ip").distinct()
    nets = everyone.join(network, "source_ip", "left").join(F.broadcast(top), "v", "left").select("source_ip", (F.lit(AT["network"]) + F.coalesce("slot", F.lit(TOP_NETWORKS))).cast("int").alias("pos"), F.lit(WEIGHTS["network"]).alias("value"))
    lands = country.join(F.broadcast(codes), "v").select("source_ip", (F.lit(AT["country"]) + F.col("slot")).cast("int").alias("pos"), F.lit(WEIGHTS["country"]).alias("value"))
    creds = s.select("source_ip", F.explode("credentials").alias("c")).filter(F.col("c").isNotNull()).distinct()
    bins = _shares(creds.groupBy("source_ip", _bin(F.col("c"), CREDENTIAL_BINS).alias("slot")).agg(F.count(F.lit(1)).alias("n")), AT["credentials"], "slot", WEIGHTS["credentials"])
    return nets.unionByName(lands).unionByName(bins).select("source_ip", "pos", F.round("value", 8).alias("value"))


def ip_hassh_block(spark: SparkSession, d: str) -> DataFrame:
    """Hashed histogram of an address's client fingerprints over its sessions."""
    e = events(spark, d).filter(F.col("source.ip").isNotNull() & (F.col("hassh").isNotNull() | F.col("hassh_algorithms").isNotNull()))
    h = e.select(F.col("source.ip").alias("source_ip"), "sensor", "session_id", F.coalesce("hassh", F.md5(F.col("hassh_algorithms").cast("binary"))).alias("h")).distinct()
    n = h.groupBy("source_ip", _bin(F.col("h"), HASSH_BINS).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    return _shares(n, AT["hassh"], "slot", WEIGHTS["hassh"]).select("source_ip", "pos", F.round("value", 8).alias("value"))


def ip_features(spark: SparkSession, d: str) -> DataFrame:
    """All blocks of an address as one sparse vector."""
    return reduce(DataFrame.unionByName, [f(spark, d) for f in (ip_behaviour, ip_tier1, ip_attribution, ip_hassh_block)])


def ip_assign(spark: SparkSession, d: str) -> DataFrame:
    """Addresses with a vector and without a cluster: the nearest cluster's mean direction and its cosine."""
    i = table(spark, d, "ips_rollup").filter(usable(F.col("embedding"), 96))
    i = i.groupBy("source_ip").agg(F.max_by(F.struct("embedding", F.col("cluster.id").alias("cid"), "run_id"), F.struct("run_id", F.col("cluster.id").isNotNull(), F.col("cluster.id"))).alias("x"))
    i = i.select("source_ip", "x.embedding", F.when(F.col("x.cid") != "-1", F.col("x.cid")).alias("cid"))
    means = as_arrays(mean_vectors(i.filter("cid is not null"), "cid", "embedding", unit=True), "cid")
    best = F.get("nearest", F.lit(0))
    return nearest(i.filter("cid is null"), "embedding", means, "cid", "vec").select("source_ip", best["label"].alias("cluster_id"), F.round(best["cosine"], 5).alias("cosine"))


QUERIES = {f.__name__: f for f in (ip_behaviour, ip_tier1, ip_attribution, ip_hassh_block, ip_features, ip_assign)}


def _bin_sql(c: str, k: int) -> str:
    return f"(strpos('0123456789abcdef', substr(sha256({c}), 16, 1)) - 1) % {k}"


def _log_sql(x: str, top: float) -> str:
    return f"least(greatest(ln(1 + coalesce({x}, 0)::DOUBLE) / ln(1 + {top}::DOUBLE), 0), 1)"


_S = f"s AS (SELECT source.ip AS ip, source.geo.country_iso_code AS cc, source.asn.number AS asn, * EXCLUDE (source) FROM {SESS} WHERE source.ip IS NOT NULL)"


def _share_sql(counts: str, at: int, w: float) -> str:
    return f"SELECT ip AS source_ip, CAST({at} + slot AS INTEGER) AS pos, round(n / sum(n) OVER (PARTITION BY ip) * {w}, 8) AS value FROM ({counts})"


_BEHAVIOUR = f"""(WITH {_S}, g AS (SELECT ip, count(*) AS n, count(*) FILTER (login_success_count > 0) AS ok, avg(cluster.novelty_score::DOUBLE) AS nov, avg(duration / 1e9) AS dur FROM s GROUP BY 1)
    SELECT * FROM (SELECT ip AS source_ip, unnest([0, 1, 2, 3])::INTEGER AS pos, unnest([round({_log_sql('n', 1e5)} * 0.05, 8), round(ok / n * 0.05, 8), round(least(greatest(coalesce(nov, 0), 0), 1) * 0.05, 8), round({_log_sql('dur', 3600)} * 0.05, 8)]) AS value FROM g) WHERE value <> 0)"""
_TIER1 = f"""(WITH {_S}, dl AS (SELECT source.ip AS ip, count(*) AS loads FROM {EV} WHERE event_action = 'session.file_download' AND source.ip IS NOT NULL GROUP BY 1),
    g AS (SELECT ip, count(*) AS n, sum(command_count) AS c, count(DISTINCT dominant_intent) AS ui, count(DISTINCT playbook_id) AS up, greatest((epoch_us(max(coalesce(ended_at, started_at))) - epoch_us(min(started_at))) / 86400e6, 0) AS days FROM s GROUP BY 1),
    a AS ({_share_sql(f"SELECT ip, coalesce(list_position([{', '.join(repr(x) for x in INTENTS)}], dominant_intent), -99) - 1 AS slot, count(*) AS n FROM s WHERE dominant_intent IS NOT NULL GROUP BY 1, 2", AT['intents'], 0.1)}),
    b AS ({_share_sql(f"SELECT ip, {_bin_sql('playbook_id', 8)} AS slot, count(*) AS n FROM s WHERE playbook_id IS NOT NULL GROUP BY 1, 2", AT['playbooks'], 0.1)}),
    c AS (SELECT ip AS source_ip, unnest([23, 24, 25, 26, 27, 28])::INTEGER AS pos, unnest([round({_log_sql('ui', len(INTENTS))} * 0.1, 8), round({_log_sql('up', 50)} * 0.1, 8), round({_log_sql('days', 365)} * 0.1, 8), round({_log_sql('c', 1e4)} * 0.1, 8),
    round(least(coalesce(c, 0) / n / 100, 1) * 0.1, 8), round({_log_sql('loads', 100)} * 0.1, 8)]) AS value FROM g LEFT JOIN dl USING (ip))
    SELECT * FROM (SELECT * FROM a WHERE pos >= 4 UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) WHERE value <> 0)"""
_ATTRIBUTION = f"""(WITH {_S}, cm AS (SELECT ip, cc FROM s WHERE cc IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY ip ORDER BY count(*) DESC, cc) = 1), nm AS (SELECT ip, asn FROM s WHERE asn IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY ip ORDER BY count(*) DESC, asn) = 1),
    cv AS (SELECT cc, row_number() OVER (ORDER BY cc) - 1 AS slot FROM (SELECT DISTINCT cc FROM cm)), tn AS (SELECT asn, row_number() OVER (ORDER BY n DESC, asn) - 1 AS slot FROM (SELECT asn, count(*) AS n FROM nm GROUP BY 1 ORDER BY n DESC, asn LIMIT 20))
    SELECT i.ip AS source_ip, CAST(53 + coalesce(slot, 20) AS INTEGER) AS pos, 0.1::DOUBLE AS value FROM (SELECT DISTINCT ip FROM s) i LEFT JOIN nm USING (ip) LEFT JOIN tn USING (asn) UNION ALL SELECT ip, CAST(74 + slot AS INTEGER), 0.1 FROM cm JOIN cv USING (cc)
    UNION ALL ({_share_sql(f"SELECT ip, {_bin_sql('c', 16)} AS slot, count(*) AS n FROM (SELECT DISTINCT ip, unnest(credentials) AS c FROM s) WHERE c IS NOT NULL GROUP BY 1, 2", AT['credentials'], 0.1)}))"""
_HASSH = "(" + _share_sql(f"SELECT ip, {_bin_sql('h', 8)} AS slot, count(*) AS n FROM (SELECT DISTINCT source.ip AS ip, sensor, session_id, coalesce(hassh, md5(hassh_algorithms)) AS h FROM {EV} WHERE source.ip IS NOT NULL AND (hassh IS NOT NULL OR hassh_algorithms IS NOT NULL)) GROUP BY 1, 2", AT["hassh"], 0.05) + ")"
SQL = {
    "ip_behaviour": f"SELECT * FROM {_BEHAVIOUR}",
    "ip_tier1": f"SELECT * FROM {_TIER1}",
    "ip_attribution": f"SELECT * FROM {_ATTRIBUTION}",
    "ip_hassh_block": f"SELECT * FROM {_HASSH}",
    "ip_features": " UNION ALL ".join(f"SELECT source_ip, pos, value FROM {x}" for x in (_BEHAVIOUR, _TIER1, _ATTRIBUTION, _HASSH)),
    "ip_assign": """WITH i AS (SELECT source_ip, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u, CASE WHEN cluster.id <> '-1' THEN cluster.id END AS cid FROM ips_rollup
        WHERE embedding IS NOT NULL AND len(embedding) = 96 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 QUALIFY row_number() OVER (PARTITION BY source_ip ORDER BY run_id DESC, cluster.id IS NOT NULL DESC, cluster.id DESC) = 1),
        m AS (SELECT cid, p, avg(u[p + 1]) AS v FROM i, range(96) r(p) WHERE cid IS NOT NULL GROUP BY 1, 2), c AS (SELECT cid, list(v ORDER BY p) AS v FROM m GROUP BY 1)
        SELECT source_ip, c.cid AS cluster_id, round(list_cosine_similarity(u, v), 5) AS cosine FROM i, c WHERE i.cid IS NULL QUALIFY row_number() OVER (PARTITION BY source_ip ORDER BY round(list_cosine_similarity(u, v), 12) DESC, c.cid) = 1""",
}
