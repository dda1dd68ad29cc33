"""How well groups and labels agree (survey K1-K15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.nearest import as_arrays, mean_vectors, nearest, usable
from ..session import table


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Commands with a stored cluster (outliers apart) and an intent as label."""
    c = table(spark, d, "commands").filter(F.col("intent").isNotNull())
    return c.select("command_hash", F.col("intent").alias("label"), F.when(F.col("cluster.id").isNull() | (F.col("cluster.id") == "-1"), "outlier").otherwise(F.col("cluster.id")).alias("cluster"), "embedding")


def partition_scores(pairs: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    """One row: ARI, NMI (arithmetic), homogeneity, completeness, V measure, purity and n of a labelled partition."""
    n = pairs.groupBy(label, cluster).agg(F.count(F.lit(1)).cast("double").alias("n"))
    a, b = n.groupBy(label).agg(F.sum("n").alias("n")), n.groupBy(cluster).agg(F.sum("n").alias("n"))

    def sums(x: DataFrame, p: str) -> DataFrame:
        return x.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(f"{p}pairs"), F.sum(F.col("n") * F.log("n")).alias(f"{p}nlogn"))

    best = n.groupBy(cluster).agg(F.max("n").alias("m")).agg(F.sum("m").alias("pure"))
    t = n.agg(F.sum("n").alias("N")).join(sums(n, "c")).join(sums(a, "a")).join(sums(b, "b")).join(best)  # one row each
    total = F.col("N")
    h_l, h_c, h_j = F.log(total) - F.col("anlogn") / total, F.log(total) - F.col("bnlogn") / total, F.log(total) - F.col("cnlogn") / total
    t = t.withColumn("hl", h_l).withColumn("hc", h_c).withColumn("mi", F.greatest(h_l + h_c - h_j, F.lit(0.0))).withColumn("exp", F.col("apairs") * F.col("bpairs") / F.greatest(total * (total - 1) / 2, F.lit(1.0)))
    ratio = lambda x, y: F.when(y > 1e-12, x / y).otherwise(1.0)
    hom, com = ratio(F.col("mi"), F.col("hl")), ratio(F.col("mi"), F.col("hc"))
    return t.select(
        F.round(ratio(F.col("cpairs") - F.col("exp"), (F.col("apairs") + F.col("bpairs")) / 2 - F.col("exp")), 6).alias("ari"), F.round(ratio(F.col("mi"), (F.col("hl") + F.col("hc")) / 2), 6).alias("nmi"),
        F.round(hom, 6).alias("homogeneity"), F.round(com, 6).alias("completeness"), F.round(F.when(hom + com > 0, 2 * hom * com / (hom + com)).otherwise(0.0), 6).alias("v_measure"), F.round(F.col("pure") / total, 6).alias("purity"), total.cast("long").alias("n"),
    )


def partition_metrics(spark: SparkSession, d: str) -> DataFrame:
    return partition_scores(_labelled(spark, d))


def cluster_purity(spark: SparkSession, d: str) -> DataFrame:
    """Per cluster: size, modal label (ties by name) and its share."""
    n = _labelled(spark, d).groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("cluster").agg(F.sum("n").alias("size"), F.min(F.struct(-F.col("n"), "label"))["label"].alias("modal"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


def outlier_rate(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("cluster") == "outlier").cast("int")), 6).alias("outliers"))


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    x = _labelled(spark, d).filter(usable(F.col("embedding"), 96))
    p = as_arrays(mean_vectors(x, "label", "embedding", unit=True), "label")
    return nearest(x, "embedding", p, "label", "vec").select("command_hash", "label", F.get("nearest", F.lit(0))["label"].alias("predicted"), F.get("nearest", F.lit(0))["cosine"].alias("cosine"))


def prototype_report(spark: SparkSession, d: str) -> DataFrame:
    """Per label: support, precision, recall and F1 of nearest-prototype classification."""
    n = _predicted(spark, d).groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    hit = n.filter("label = predicted").select("label", F.col("n").alias("tp"))
    sup = n.groupBy("label").agg(F.sum("n").alias("support"))
    pred = n.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    r = sup.join(hit, "label", "left").join(pred, "label", "left").na.fill(0)
    f1 = 2 * F.col("tp") / (F.col("support") + F.col("said"))
    return r.select("label", "support", F.round(F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0), 6).alias("precision"), F.round(F.col("tp") / F.col("support"), 6).alias("recall"), F.round(f1, 6).alias("f1"))


def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    r = prototype_report(spark, d)
    return r.agg(F.round(F.avg("f1"), 5).alias("macro_f1"), F.round(F.sum(F.col("recall") * F.col("support")) / F.sum("support"), 5).alias("accuracy"), F.count(F.lit(1)).alias("labels"))


def novelty_auc(spark: SparkSession, d: str) -> DataFrame:
    """Rank AUC of stored novelty for telling outliers from members, per intent (ordinal ranks, ties by hash)."""
    c = table(spark, d, "commands").filter("intent is not null and cluster.novelty_score is not null and cluster.is_outlier is not null")
    x = c.select("intent", F.col("cluster.is_outlier").alias("pos"), F.col("cluster.novelty_score").alias("s"), "command_hash")
    r = x.withColumn("r", F.row_number().over(Window.partitionBy("intent").orderBy("s", "command_hash")))
    g = r.groupBy("intent").agg(F.count_if("pos").alias("p"), F.count_if(~F.col("pos")).alias("q"), F.sum(F.when(F.col("pos"), F.col("r")).otherwise(0)).alias("sr")).filter("p > 0 and q > 0")
    return g.select("intent", F.round((F.col("sr") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q")), 6).alias("auc"))


def rater_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement, Cohen's kappa and PABAK of two raters: stored intent against the intent of the command's shape parent."""
    c = table(spark, d, "commands").select("intent", F.col("shape.hash").alias("sh"), F.col("shape.shape_role").alias("role"), "occurrence_count", "command_hash").filter("intent is not null and sh is not null")
    w = Window.partitionBy("sh").orderBy(F.desc("occurrence_count"), "command_hash")
    p = c.filter("role = 'parent'").withColumn("r", F.row_number().over(w)).filter("r = 1").select("sh", F.col("intent").alias("other"))
    n = c.join(p, "sh").groupBy("intent", "other").agg(F.count(F.lit(1)).cast("double").alias("n"))
    a, b = n.groupBy("intent").agg(F.sum("n").alias("x")), n.groupBy(F.col("other").alias("intent")).agg(F.sum("n").alias("y"))
    chance = a.join(b, "intent", "full").agg(F.sum(F.coalesce(F.col("x") * F.col("y"), F.lit(0.0))).alias("e"), F.count(F.lit(1)).alias("k"))
    t = n.agg(F.sum("n").alias("N"), F.sum(F.when(F.col("intent") == F.col("other"), F.col("n")).otherwise(0.0)).alias("o")).join(chance)  # one row each
    po, pe = F.col("o") / F.col("N"), F.col("e") / (F.col("N") * F.col("N"))
    return t.select(F.round(po, 6).alias("agreement"), F.round((po - pe) / (1 - pe), 6).alias("kappa"), F.round((F.col("k") * po - 1) / (F.col("k") - 1), 6).alias("pabak"), F.col("N").cast("long").alias("n"))


def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    """Fold 0..4 of each command, dealt within its label in hash order, and each label's fold sizes."""
    w = Window.partitionBy("label").orderBy(F.sha2("command_hash", 256))
    f = _labelled(spark, d).select("label", ((F.row_number().over(w) - 1) % 5).alias("fold"))
    return f.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


def tau_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Share assigned and precision of nearest prototypes at several thresholds."""
    p = _predicted(spark, d).select(F.round("cosine", 6).alias("c"), (F.col("label") == F.col("predicted")).alias("ok"))
    taus = F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8, 0.9)])
    x = p.select("c", "ok", F.explode(taus).alias("tau")).groupBy("tau").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") >= F.col("tau")).alias("assigned"), F.count_if((F.col("c") >= F.col("tau")) & F.col("ok")).alias("right"))
    return x.select("tau", F.round(F.col("assigned") / F.col("n"), 6).alias("rate"), F.round(F.coalesce(F.col("right") / F.expr("nullif(assigned, 0)"), F.lit(0.0)), 6).alias("precision"))


def growth_stall(spark: SparkSession, d: str) -> DataFrame:
    """Runs in which clusters were added but no new playbook appeared, against the oldest of the three runs before."""
    c = table(spark, d, "session_clusters").select("run_id", "playbook_id", "cluster_id")
    g = c.groupBy("run_id").agg(F.count(F.lit(1)).alias("clusters"), F.count_distinct("playbook_id").alias("playbooks"))
    w = Window.orderBy("run_id")  # one row per run, a few dozen
    x = g.withColumn("c0", F.first("clusters").over(w.rowsBetween(-3, -1))).withColumn("p0", F.first("playbooks").over(w.rowsBetween(-3, -1)))
    state = F.when(F.col("c0").isNull(), "insufficient").when((F.col("clusters") > F.col("c0")) & (F.col("playbooks") <= F.col("p0")), "stalled").otherwise("moving")
    return x.select("run_id", "clusters", "playbooks", state.alias("state"))


def eval_sample(spark: SparkSession, d: str) -> DataFrame:
    """A varied evaluation set: up to five sessions of each playbook in hash order, addresses defanged."""
    from .common import slim_sessions

    s = slim_sessions(spark, d, "playbook_id", "source.ip", "command_count").filter("command_count > 0")
    w = Window.partitionBy(F.coalesce("playbook_id", F.lit("none"))).orderBy(F.sha2(F.concat_ws(":", "sensor", "session_id"), 256))
    x = s.withColumn("r", F.row_number().over(w)).filter("r <= 5")
    return x.select("sensor", "session_id", F.coalesce("playbook_id", F.lit("none")).alias("bucket"), F.regexp_replace("source_ip", r"\.", "[.]").alias("address"))


QUERIES = {f.__name__: f for f in (partition_metrics, cluster_purity, outlier_rate, prototype_report, macro_f1, novelty_auc, rater_agreement, stratified_folds, tau_sweep, growth_stall, eval_sample)}

_LAB = "lab AS (SELECT command_hash, intent AS label, CASE WHEN cluster.id IS NULL OR cluster.id = '-1' THEN 'outlier' ELSE cluster.id END AS cluster, embedding FROM commands WHERE intent IS NOT NULL)"
_PRED = f"""{_LAB}, u AS (SELECT command_hash, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM lab
    WHERE embedding IS NOT NULL AND len(embedding) = 96 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0), m AS (SELECT label, i, avg(u[i + 1]) AS v FROM u, range(96) t(i) GROUP BY 1, 2), pr AS (SELECT label AS predicted, list(v ORDER BY i) AS v FROM m GROUP BY 1),
    pred AS (SELECT command_hash, label, predicted, list_cosine_similarity(u, v) AS cos FROM u, pr QUALIFY row_number() OVER (PARTITION BY command_hash ORDER BY round(list_cosine_similarity(u, v), 12) DESC, predicted) = 1)"""
_REP = f"""{_PRED}, rep AS (SELECT l.label, l.support, coalesce(s.said, 0) AS said, coalesce(h.tp, 0) AS tp FROM (SELECT label, count(*) AS support FROM pred GROUP BY 1) l LEFT JOIN (SELECT predicted, count(*) AS said FROM pred GROUP BY 1) s ON s.predicted = l.label
    LEFT JOIN (SELECT label, count(*) AS tp FROM pred WHERE label = predicted GROUP BY 1) h ON h.label = l.label),
    r AS (SELECT label, support, round(CASE WHEN said > 0 THEN tp / said ELSE 0 END, 6) AS precision, round(tp / support, 6) AS recall, round(2 * tp / (support + said), 6) AS f1 FROM rep)"""
SQL = {
    "partition_metrics": f"""WITH {_LAB}, c AS (SELECT label, cluster, count(*)::DOUBLE AS n FROM lab GROUP BY 1, 2), a AS (SELECT sum(n)::DOUBLE AS n FROM c GROUP BY label), b AS (SELECT sum(n)::DOUBLE AS n, max(n) AS m FROM c GROUP BY cluster),
        t AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n * (n - 1) / 2) FROM c) AS cp, (SELECT sum(n * (n - 1) / 2) FROM a) AS ap, (SELECT sum(n * (n - 1) / 2) FROM b) AS bp,
        (SELECT sum(n * ln(n)) FROM c) AS cl, (SELECT sum(n * ln(n)) FROM a) AS al, (SELECT sum(n * ln(n)) FROM b) AS bl, (SELECT sum(m) FROM b) AS pure),
        h AS (SELECT *, ln(n) - al / n AS hl, ln(n) - bl / n AS hc, greatest(ln(n) - al / n - bl / n + cl / n, 0) AS mi, ap * bp / greatest(n * (n - 1) / 2, 1) AS ex FROM t), k AS (SELECT *, mi / hl AS hom, mi / hc AS com FROM h)
        SELECT round((cp - ex) / ((ap + bp) / 2 - ex), 6) AS ari, round(mi / ((hl + hc) / 2), 6) AS nmi, round(hom, 6) AS homogeneity, round(com, 6) AS completeness, round(2 * hom * com / (hom + com), 6) AS v_measure, round(pure / n, 6) AS purity, CAST(n AS BIGINT) AS n FROM k""",
    "cluster_purity": f"""WITH {_LAB}, c AS (SELECT cluster, label, count(*) AS n FROM lab GROUP BY 1, 2) SELECT cluster, CAST(sum(n) AS BIGINT) AS size, first(label ORDER BY n DESC, label) AS modal, round(max(n) / sum(n), 6) AS share FROM c GROUP BY 1""",
    "outlier_rate": f"WITH {_LAB} SELECT label, count(*) AS n, round(avg(CAST(cluster = 'outlier' AS INTEGER)), 6) AS outliers FROM lab GROUP BY 1",
    "prototype_report": f"WITH {_REP} SELECT * FROM r",
    "macro_f1": f"WITH {_REP} SELECT round(avg(f1), 5) AS macro_f1, round(sum(recall * support) / sum(support), 5) AS accuracy, count(*) AS labels FROM r",
    "novelty_auc": """WITH r AS (SELECT intent, cluster.is_outlier AS pos, row_number() OVER (PARTITION BY intent ORDER BY cluster.novelty_score, command_hash) AS r FROM commands WHERE intent IS NOT NULL AND cluster.novelty_score IS NOT NULL AND cluster.is_outlier IS NOT NULL),
        g AS (SELECT intent, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q, sum(r) FILTER (pos) AS sr FROM r GROUP BY 1) SELECT intent, round((sr - p * (p + 1) / 2) / (p * q), 6) AS auc FROM g WHERE p > 0 AND q > 0""",
    "rater_agreement": """WITH c AS (SELECT * FROM commands WHERE intent IS NOT NULL AND shape.hash IS NOT NULL), p AS (SELECT shape.hash AS sh, intent AS other FROM c WHERE shape.shape_role = 'parent' QUALIFY row_number() OVER (PARTITION BY shape.hash ORDER BY occurrence_count DESC, command_hash) = 1),
        n AS (SELECT intent, other, count(*)::DOUBLE AS n FROM c JOIN p ON c.shape.hash = p.sh GROUP BY 1, 2), a AS (SELECT intent, sum(n) AS x FROM n GROUP BY 1), b AS (SELECT other AS intent, sum(n) AS y FROM n GROUP BY 1),
        e AS (SELECT sum(coalesce(x * y, 0)) AS e, count(*) AS k FROM a FULL JOIN b ON a.intent = b.intent), t AS (SELECT sum(n) AS n, sum(n) FILTER (intent = other) AS o FROM n)
        SELECT round(o / n, 6) AS agreement, round((o / n - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa, round((k * o / n - 1) / (k - 1), 6) AS pabak, CAST(n AS BIGINT) AS n FROM e, t""",
    "stratified_folds": f"WITH {_LAB}, f AS (SELECT label, CAST((row_number() OVER (PARTITION BY label ORDER BY sha256(command_hash)) - 1) % 5 AS INTEGER) AS fold FROM lab) SELECT label, fold, count(*) AS n FROM f GROUP BY 1, 2",
    "tau_sweep": f"""WITH {_PRED}, t AS (SELECT unnest([0.2, 0.4, 0.6, 0.8, 0.9]::DOUBLE[]) AS tau) SELECT tau, round(count(*) FILTER (round(cos, 6) >= tau) / count(*), 6) AS rate,
        round(coalesce(count(*) FILTER (round(cos, 6) >= tau AND label = predicted) / nullif(count(*) FILTER (round(cos, 6) >= tau), 0), 0), 6) AS precision FROM pred, t GROUP BY 1""",
    "growth_stall": """WITH g AS (SELECT run_id, count(*) AS clusters, count(DISTINCT playbook_id) AS playbooks FROM session_clusters GROUP BY 1), x AS (SELECT *, first_value(clusters) OVER w AS c0, first_value(playbooks) OVER w AS p0 FROM g WINDOW w AS (ORDER BY run_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
        SELECT run_id, clusters, playbooks, CASE WHEN c0 IS NULL THEN 'insufficient' WHEN clusters > c0 AND playbooks <= p0 THEN 'stalled' ELSE 'moving' END AS state FROM x""",
    "eval_sample": """SELECT sensor, session_id, bucket, replace(ip, '.', '[.]') AS address FROM (SELECT sensor, session_id, coalesce(playbook_id, 'none') AS bucket, source.ip AS ip, command_count FROM sessions_rollup
        QUALIFY row_number() OVER (PARTITION BY sensor, session_id ORDER BY rolled_up_at DESC, login_fail_count DESC) = 1) WHERE command_count > 0 QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY sha256(sensor || ':' || session_id)) <= 5""",
}
