"""Vector layer: norms, pooling, centroids, novelty, rescue, assignment, density clusters (survey B9, D1-D31, E1-E4)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dist as D
from ..operators import clustering as C
from ..operators.nearest import as_arrays, mean_vectors, nearest, unit_distance, usable, weighted_sums
from ..session import table
from .common import CMD, SESS, command_events, slim_sessions

TAU, SURE = 0.94, 0.98


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter(F.col("embedding").isNotNull())


def _cmd(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commands").filter(usable(F.col("embedding"), 96)).select("command_hash", "embedding", F.col("cluster.id").alias("cluster_id"), (F.coalesce("cluster.is_outlier", F.lit(True)) | F.col("cluster.id").isNull() | (F.col("cluster.id") == "-1")).alias("noise"))


def _cmd_centroids(spark: SparkSession, d: str) -> DataFrame:
    return as_arrays(mean_vectors(_cmd(spark, d).filter(~F.col("noise")), "cluster_id", "embedding", unit=True), "cluster_id")


def vec_norm(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d)
    return e.select("vec_id", F.round(D.norm(F.col("embedding")), 5).alias("norm"), F.round(D.norm(D.unit(F.col("embedding"))), 5).alias("unit_norm"))


def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    return mean_vectors(_emb(spark, d), "label", "embedding").select("label", "pos", F.round("value", 5).alias("value"))


def command_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Mean unit vector of each stored command cluster, outliers left out."""
    return mean_vectors(_cmd(spark, d).filter(~F.col("noise")), "cluster_id", "embedding", unit=True).select("cluster_id", "pos", F.round("value", 5).alias("value"))


def vec_pool(spark: SparkSession, d: str) -> DataFrame:
    """A session's vector: rarity-weighted sum of its unique commands' unit vectors, made unit (one row per dimension)."""
    c = table(spark, d, "commands").filter(usable(F.col("embedding"), 96)).select(F.col("command_hash").alias("h"), "embedding", D.pool_weight(F.col("occurrence_count")).alias("w"))
    s = command_events(spark, d).select("sensor", "session_id", "h").distinct().join(c, "h")
    p = weighted_sums(s, ["sensor", "session_id"], "w", "embedding")
    return p.select("sensor", "session_id", F.posexplode("vec").alias("pos", "x")).select("sensor", "session_id", "pos", F.round("x", 5).alias("value"))


def novelty(spark: SparkSession, d: str) -> DataFrame:
    """1 - max(0, best cosine) of each vector against the label centroids, and the nearest label."""
    e = nearest(_emb(spark, d), "embedding", as_arrays(mean_vectors(_emb(spark, d), "label", "embedding"), "label"), "label", "vec")
    best = F.get("nearest", F.lit(0))
    return e.select("vec_id", best["label"].cast("int").alias("nearest_label"), F.round(1 - F.greatest(best["cosine"], F.lit(0.0)), 5).alias("novelty"))


def command_novelty(spark: SparkSession, d: str) -> DataFrame:
    """Novelty of every usable command against the stored clusters; outliers score 1 by decision."""
    e = nearest(_cmd(spark, d), "embedding", _cmd_centroids(spark, d), "cluster_id", "vec")
    best = F.get("nearest", F.lit(0))
    return e.select("command_hash", F.when(F.col("noise"), 1.0).otherwise(F.round(1 - F.greatest(best["cosine"], F.lit(0.0)), 5)).alias("novelty"))


def rescue_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Outlier commands that reach a cluster centroid with cosine 0.8 join it."""
    e = nearest(_cmd(spark, d).filter("noise"), "embedding", _cmd_centroids(spark, d), "cluster_id", "vec")
    best = F.get("nearest", F.lit(0))
    return e.filter(best["cosine"] >= 0.8).select("command_hash", best["label"].alias("cluster_id"), F.round(best["cosine"], 5).alias("cosine"))


def rescue_radius(spark: SparkSession, d: str) -> DataFrame:
    """Outliers within the 90th percentile of the members' distance to their own centroid join the nearest cluster."""
    cents = _cmd_centroids(spark, d)
    unit_c = cents.select("cluster_id", F.col("vec").alias("c"))
    members = _cmd(spark, d).filter("not noise").join(unit_c, "cluster_id")
    radius = members.withColumn("gap", unit_distance(F.col("embedding"), F.col("c"))).agg(F.percentile("gap", 0.9).alias("radius"))
    noise = nearest(_cmd(spark, d).filter("noise"), "embedding", cents, "cluster_id", "vec").withColumn("cluster_id", F.get("nearest", F.lit(0))["label"])
    near = noise.join(unit_c, "cluster_id").withColumn("gap", unit_distance(F.col("embedding"), F.col("c")))
    return near.join(F.broadcast(radius)).filter("gap <= radius").select("command_hash", "cluster_id", F.round("gap", 5).alias("gap"))


def assign_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Every usable command against the stored clusters as anchors: sure, inside the band, or novel."""
    e = nearest(_cmd(spark, d), "embedding", _cmd_centroids(spark, d), "cluster_id", "vec")
    c = F.round(F.get("nearest", F.lit(0))["cosine"], 4)
    status = F.when(c >= SURE, "confident").when(c >= TAU, "band").otherwise("novel")
    return e.select("command_hash", F.when(status != "novel", F.get("nearest", F.lit(0))["label"]).alias("anchor"), c.alias("cosine"), status.alias("status"))


def scalar_block(spark: SparkSession, d: str) -> DataFrame:
    """Scaled command scalars that are joined to the vector: volume, addresses, confidence, reuse."""
    c = F.col
    reuse = F.when(c("unique_sessions") > 0, F.least(c("occurrence_count") / c("unique_sessions") / 10, F.lit(1.0))).otherwise(0.0)
    return table(spark, d, "commands").select(
        "command_hash", F.round(D.log_scaled(c("occurrence_count"), 1e5) * 0.05, 6).alias("f_count"), F.round(D.log_scaled(c("unique_source_ips"), 1e4) * 0.05, 6).alias("f_ips"),
        F.round(F.coalesce(c("confidence"), F.lit(5)) / 10 * 0.05, 6).alias("f_confidence"), F.round(reuse * 0.05, 6).alias("f_reuse"),
    )


def session_scalars(spark: SparkSession, d: str) -> DataFrame:
    s = slim_sessions(spark, d, "command_count", "unique_commands", "login_success_count", "cluster.novelty_score")
    tries = F.coalesce(F.col("login_success_count"), F.lit(0))
    return s.select(
        "sensor", "session_id", F.round(D.log_scaled(F.col("command_count"), 1000), 6).alias("f_commands"), F.round(D.log_scaled(F.col("unique_commands"), 1000), 6).alias("f_unique"),
        F.least(tries, F.lit(1)).cast("double").alias("f_success"), F.round(F.coalesce(F.col("cluster_novelty_score").cast("double"), F.lit(0.0)), 5).alias("f_novelty"),
    )


def tfidf_docs(spark: SparkSession, d: str) -> DataFrame:
    """Five strongest terms of each document: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), unit length."""
    t = table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]{2,})"))).alias("term"))
    tf = t.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = tf.agg(F.count_distinct("doc_id").alias("n"))
    w = tf.join(df, "term").join(F.broadcast(n)).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    w = w.withColumn("weight", F.round(F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id"))), 6))
    return w.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term"))).filter("rank <= 5").select("doc_id", "term", "tf", "weight", "rank")


def hdbscan_vec(spark: SparkSession, d: str) -> DataFrame:
    return C.label_matrix(_emb(spark, d), "vec_id", "embedding", lambda x: C.hdbscan(C.unit_rows(x), 5, 2))


def hdbscan_prototypes(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters of the session cluster centroids."""
    c = table(spark, d, "session_clusters").filter(usable(F.col("centroid"), 96))
    return C.label_matrix(c, "cluster_id", "centroid", lambda x: C.hdbscan(C.unit_rows(x), 3, 2))


def merge_linkage(spark: SparkSession, d: str) -> DataFrame:
    """Session clusters whose centroids all keep cosine 0.94 with one another, by complete linkage."""
    c = table(spark, d, "session_clusters").filter(usable(F.col("centroid"), 96))
    return C.label_matrix(c, "cluster_id", "centroid", lambda x: C.complete_linkage(x, TAU))


def svd_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters after reducing the vectors to 24 dimensions."""
    return C.label_matrix(_emb(spark, d), "vec_id", "embedding", lambda x: C.hdbscan(C.svd_reduce(C.unit_rows(x), 24), 5, 2))


def fusion_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters of full and of reduced centroids fused by average linkage of their disagreement."""
    c = table(spark, d, "session_clusters").filter(usable(F.col("centroid"), 96))

    def fit(x: np.ndarray) -> np.ndarray:
        a, b = C.hdbscan(C.unit_rows(x), 3, 2), C.hdbscan(C.svd_reduce(C.unit_rows(x), 16), 3, 2)
        return C.average_linkage(C.disagreement(a, b), max(len(set(a[a >= 0])), len(set(b[b >= 0])), 1))

    return C.label_matrix(c, "cluster_id", "centroid", fit)


def nearest_playbooks(spark: SparkSession, d: str) -> DataFrame:
    """For every session cluster the three most similar playbooks by mean centroid, its own left out."""
    c = table(spark, d, "session_clusters").filter(usable(F.col("centroid"), 96))
    p = as_arrays(mean_vectors(c.filter(F.col("playbook_id").isNotNull()), "playbook_id", "centroid", unit=True), "playbook_id")
    e = nearest(c.select("cluster_id", "playbook_id", "centroid"), "centroid", p, "playbook_id", "vec", ordered=4)
    x = e.select("cluster_id", F.posexplode(F.filter("nearest", lambda n: ~n["label"].eqNullSafe(F.col("playbook_id")))).alias("i", "n")).filter("i < 3")
    return x.select("cluster_id", (F.col("i") + 1).alias("rank"), F.col("n.label").alias("playbook_id"), F.round("n.cosine", 5).alias("cosine"))


def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the three newest runs; reference centroids are always kept."""
    c = table(spark, d, "session_clusters")
    runs = c.groupBy("run_id").agg(F.max("created_at").alias("t"))
    keep = runs.orderBy(F.desc("t"), F.desc("run_id")).limit(3).select("run_id")
    return c.join(F.broadcast(keep.withColumn("kept", F.lit(True))), "run_id", "left").filter(F.col("kept") | (F.col("doc_type") == "reference_centroid")).select("cluster_id", "run_id", "doc_type")


def predicate_signature(spark: SparkSession, d: str) -> DataFrame:
    """Mean of stored predicates per command cluster, and whether any is modal (at least half)."""
    names = ["has_uname_m", "has_c2_launch", "has_self_spread", "has_host_recon", "has_key_write", "has_immutability"]
    c = table(spark, d, "commands").filter(F.col("cluster.id").isNotNull() & (F.col("cluster.id") != "-1"))
    g = c.groupBy(F.col("cluster.id").alias("cluster_id")).agg(*[F.avg(F.col(f"predicates.{n}").cast("int")).alias(n) for n in names], F.count(F.lit(1)).alias("members"))
    return g.select("cluster_id", "members", *[F.round(n, 6).alias(n) for n in names], F.coalesce(F.greatest(*names) >= 0.5, F.lit(False)).alias("modal"))


def cluster_bag(spark: SparkSession, d: str) -> DataFrame:
    """A session's bag of command clusters as text; unclustered commands become one token."""
    c = table(spark, d, "commands").select(F.col("command_hash").alias("h"), F.when(F.col("cluster.id") == "-1", None).otherwise(F.col("cluster.id")).alias("cid"))
    s = slim_sessions(spark, d, "command_set").select("sensor", "session_id", F.explode(F.array_distinct(F.array_compact("command_set"))).alias("h")).join(c, "h", "left")
    return s.groupBy("sensor", "session_id").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("cid", F.lit("outlier")))), " ").alias("bag"))


QUERIES = {
    f.__name__: f
    for f in (
        vec_norm, label_centroids, command_centroids, vec_pool, novelty, command_novelty, rescue_cosine, rescue_radius, assign_cascade, scalar_block, session_scalars, tfidf_docs, hdbscan_vec, hdbscan_prototypes,
        merge_linkage, svd_vectors, fusion_clusters, nearest_playbooks, latest_runs, predicate_signature, cluster_bag,
    )
}

_N = "sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[]))"
_U = "(SELECT *, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM commands WHERE embedding IS NOT NULL AND len(embedding) = 96 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0)"
_NOISE = "(coalesce(cluster.is_outlier, true) OR cluster.id IS NULL OR cluster.id = '-1')"
_CENT = f"""c AS (SELECT *, {_NOISE} AS noise, cluster.id AS cid FROM {_U}), m AS (SELECT cid, i AS pos, avg(u[i + 1]) AS value FROM c, range(96) t(i) WHERE NOT noise GROUP BY 1, 2),
    cent AS (SELECT cid, list(value ORDER BY pos) AS v FROM m GROUP BY 1)"""
_BEST = f"{_CENT}, best AS (SELECT c.command_hash, noise, u, cent.cid AS label, v, list_cosine_similarity(u, v) AS cos FROM c, cent QUALIFY row_number() OVER (PARTITION BY command_hash ORDER BY round(list_cosine_similarity(u, v), 12) DESC, cent.cid) = 1)"
SQL = {
    "vec_norm": f"SELECT vec_id, round({_N.format('embedding')}, 5) AS norm, CASE WHEN {_N.format('embedding')} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS unit_norm FROM embeddings",
    "label_centroids": "SELECT label, CAST(i AS INTEGER) AS pos, round(avg(embedding[i + 1]::DOUBLE), 5) + 0 AS value FROM embeddings, range(64) t(i) GROUP BY 1, 2",
    "command_centroids": f"WITH {_CENT} SELECT cid AS cluster_id, CAST(pos AS INTEGER) AS pos, round(value, 5) + 0 AS value FROM m",
    "vec_pool": f"""WITH c AS (SELECT command_hash, u, greatest(ln(100001 / (greatest(least(coalesce(occurrence_count, 1), 100000), 1) + 1)), 0.0001) AS w FROM {_U}),
        p AS (SELECT sensor, session_id, i AS pos, sum(u[i + 1] * w) AS y FROM (SELECT DISTINCT sensor, session_id, h FROM {CMD}) JOIN c ON h = command_hash, range(96) t(i) GROUP BY 1, 2, 3)
        SELECT sensor, session_id, CAST(pos AS INTEGER) AS pos, round(y / sqrt(sum(y * y) OVER (PARTITION BY sensor, session_id)), 5) + 0 AS value FROM p""",
    "novelty": """WITH m AS (SELECT label, i, avg(embedding[i + 1]::DOUBLE) AS v FROM embeddings, range(64) t(i) GROUP BY 1, 2), c AS (SELECT label, list(v ORDER BY i) AS v FROM m GROUP BY 1)
        SELECT vec_id, c.label AS nearest_label, round(1 - greatest(list_cosine_similarity(embedding::DOUBLE[], v), 0), 5) + 0 AS novelty FROM embeddings, c
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], v), 12) DESC, CAST(c.label AS VARCHAR)) = 1""",
    "command_novelty": f"WITH {_BEST} SELECT command_hash, CASE WHEN noise THEN 1.0::DOUBLE ELSE round(1 - greatest(cos, 0), 5) + 0 END AS novelty FROM best",
    "rescue_cosine": f"WITH {_BEST} SELECT command_hash, label AS cluster_id, round(cos, 5) AS cosine FROM best WHERE noise AND cos >= 0.8",
    "rescue_radius": f"""WITH {_BEST}, r AS (SELECT quantile_cont(list_distance(u, v), 0.9) AS radius FROM c JOIN cent ON c.cid = cent.cid WHERE NOT noise)
        SELECT command_hash, label AS cluster_id, round(list_distance(u, v), 5) AS gap FROM best, r WHERE noise AND list_distance(u, v) <= radius""",
    "assign_cascade": f"""WITH {_BEST} SELECT command_hash, CASE WHEN round(cos, 4) >= 0.94 THEN label END AS anchor, round(cos, 4) AS cosine,
        CASE WHEN round(cos, 4) >= 0.98 THEN 'confident' WHEN round(cos, 4) >= 0.94 THEN 'band' ELSE 'novel' END AS status FROM best""",
    "scalar_block": """SELECT command_hash, round(least(greatest(ln(1 + coalesce(occurrence_count, 0)) / ln(1 + 1e5), 0), 1) * 0.05, 6) AS f_count,
        round(least(greatest(ln(1 + coalesce(unique_source_ips, 0)) / ln(1 + 1e4), 0), 1) * 0.05, 6) AS f_ips, round(coalesce(confidence, 5) / 10 * 0.05, 6) AS f_confidence,
        round(CASE WHEN unique_sessions > 0 THEN least(occurrence_count / unique_sessions / 10, 1) ELSE 0 END * 0.05, 6) AS f_reuse FROM commands""",
    "session_scalars": f"""SELECT sensor, session_id, round(least(greatest(ln(1 + coalesce(command_count, 0)) / ln(1001), 0), 1), 6) AS f_commands, round(least(greatest(ln(1 + coalesce(unique_commands, 0)) / ln(1001), 0), 1), 6) AS f_unique,
        CAST(least(coalesce(login_success_count, 0), 1) AS DOUBLE) AS f_success, round(coalesce(cluster.novelty_score::DOUBLE, 0), 5) AS f_novelty FROM {SESS}""",
    "tfidf_docs": r"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\pL\pN_]{2,}')) AS term FROM documents) GROUP BY 1, 2),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), w AS (SELECT doc_id, tf.term, tf, (1 + ln(tf)) * (ln((1 + (SELECT count(DISTINCT doc_id) FROM tf)) / (1 + df)) + 1) AS w FROM tf JOIN df ON tf.term = df.term),
        n AS (SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w)
        SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS INTEGER) AS rank FROM n QUALIFY rank <= 5""",
    "nearest_playbooks": """WITH c AS (SELECT *, list_transform(centroid, lambda x: x::DOUBLE / sqrt(list_dot_product(centroid::DOUBLE[], centroid::DOUBLE[]))) AS u FROM session_clusters
        WHERE centroid IS NOT NULL AND len(centroid) = 96 AND list_dot_product(centroid::DOUBLE[], centroid::DOUBLE[]) > 0),
        m AS (SELECT playbook_id AS p, i, avg(u[i + 1]) AS v FROM c, range(96) t(i) WHERE playbook_id IS NOT NULL GROUP BY 1, 2), pb AS (SELECT p, list(v ORDER BY i) AS v FROM m GROUP BY 1),
        s AS (SELECT cluster_id, p, list_cosine_similarity(u, v) AS cos FROM c, pb WHERE p IS DISTINCT FROM playbook_id)
        SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY round(cos, 12) DESC, p) AS INTEGER) AS rank, p AS playbook_id, round(cos, 5) AS cosine FROM s QUALIFY rank <= 3""",
    "latest_runs": """SELECT cluster_id, run_id, doc_type FROM session_clusters WHERE doc_type = 'reference_centroid' OR run_id IN
        (SELECT run_id FROM session_clusters GROUP BY 1 ORDER BY max(created_at) DESC, run_id DESC LIMIT 3)""",
    "predicate_signature": "SELECT cluster.id AS cluster_id, count(*) AS members, "
    + ", ".join(f"round(avg(CAST(predicates.{n} AS INTEGER)), 6) AS {n}" for n in ["has_uname_m", "has_c2_launch", "has_self_spread", "has_host_recon", "has_key_write", "has_immutability"])
    + ", coalesce(greatest(" + ", ".join(f"avg(CAST(predicates.{n} AS INTEGER))" for n in ["has_uname_m", "has_c2_launch", "has_self_spread", "has_host_recon", "has_key_write", "has_immutability"])
    + ") >= 0.5, false) AS modal FROM commands WHERE cluster.id IS NOT NULL AND cluster.id <> '-1' GROUP BY 1",
    "cluster_bag": f"""SELECT sensor, session_id, string_agg(coalesce(CASE WHEN cluster.id <> '-1' THEN cluster.id END, 'outlier'), ' ' ORDER BY coalesce(CASE WHEN cluster.id <> '-1' THEN cluster.id END, 'outlier')) AS bag FROM
        (SELECT sensor, session_id, unnest(list_distinct(list_filter(command_set, lambda x: x IS NOT NULL))) AS h FROM {SESS.replace('SELECT *', 'SELECT sensor, session_id, command_set')}) LEFT JOIN commands ON h = command_hash GROUP BY 1, 2""",
}
