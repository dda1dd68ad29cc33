"""Sessions assigned to playbooks by a cascade over their anchors (survey D20-D23, D26, D27).

Anchors of a session are walked by falling cosine.  A sure one is taken; one in the band is
taken if the session's bag of command clusters is like the anchor's (TF-IDF cosine) or the anchor has too few
bags to tell; one below the band is taken only if a predicate of the session is usual for the anchor.  A rejected
anchor lets the next one have its turn.  Without a winner the session is novel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators.nearest import as_arrays, mean_vectors, nearest, usable
from ..session import table
from .commands import PREDICATE_SQL
from .common import SESS, slim_sessions

SURE, TAU, RESCUE, TFIDF, MODAL, MIN_BAGS = 0.98, 0.94, 0.85, 0.50, 0.5, 50
#: Anchors taken inside the band without asking for their bags; a parameter of the job.
BYPASS: tuple[str, ...] = ()
NAMES = ["multi_arch", "c2_launch", "self_spread", "menu_only", "host_info", "key_write_immutability", "hetero_fallback"]


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    s = slim_sessions(spark, d, "playbook_id", "embedding", "command_set").filter(usable(F.col("embedding"), 96))
    return s.select(F.concat_ws(":", "sensor", "session_id").alias("uid"), "playbook_id", "embedding", F.array_distinct(F.array_compact("command_set")).alias("hs"))


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    return as_arrays(mean_vectors(_sessions(spark, d).filter("playbook_id is not null"), "playbook_id", "embedding", unit=True), "playbook_id")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """(uid, playbook_id, term, w): a session's bag of command clusters, (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), unit length."""
    c = table(spark, d, "commands").select(F.col("command_hash").alias("h"), F.when(F.col("cluster.id") == "-1", None).otherwise(F.col("cluster.id")).alias("cid"))
    s = _sessions(spark, d)
    tf = s.select("uid", "playbook_id", F.explode("hs").alias("h")).join(c, "h", "left").groupBy("uid", "playbook_id", F.coalesce("cid", F.lit("outlier")).alias("term")).agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = s.filter(F.size("hs") > 0).agg(F.count(F.lit(1)).alias("n"))
    w = tf.join(df, "term").join(F.broadcast(n)).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))  # n is one row
    return w.select("uid", "playbook_id", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("uid")))).alias("w"))


def anchor_bags(spark: SparkSession, d: str) -> DataFrame:
    """(playbook_id, term, w): unit mean of the bags of anchors with at least MIN_BAGS sessions."""
    t = _terms(spark, d).filter("playbook_id is not null")
    enough = t.groupBy("playbook_id").agg(F.count_distinct("uid").alias("bags")).filter(F.col("bags") >= MIN_BAGS)
    m = t.groupBy("playbook_id", "term").agg(F.sum("w").alias("w")).join(enough, "playbook_id")
    unit = F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("playbook_id")))
    return m.select("playbook_id", "term", "bags", F.round(unit, 9).alias("w"))


def _folded(spark: SparkSession, d: str) -> DataFrame:
    """(uid, playbook_id, NAMES): predicates of a session's commands; any for most, all for menu-only, pooled architectures."""
    c = F.col("command_line")
    per = table(spark, d, "commands").select(F.col("command_hash").alias("h"), *[X.predicate(c, k).alias(k) for k in X.PREDICATES], X.appliance_word(c).alias("menu"), X.architectures(c).alias("arch"))
    s = _sessions(spark, d).select("uid", "playbook_id", F.explode("hs").alias("h")).join(per, "h")
    g = s.groupBy("uid", "playbook_id").agg(*[F.bool_or(k).alias(k) for k in X.PREDICATES], F.bool_and("menu").alias("menu_only"), F.size(F.array_distinct(F.flatten(F.collect_set("arch")))).alias("a"))
    return g.select(
        "uid", "playbook_id", (F.col("has_uname_m") | (F.col("has_case_word") & (F.col("a") >= 1)) | (F.col("a") >= 2)).alias("multi_arch"), F.col("has_c2_launch").alias("c2_launch"), F.col("has_self_spread").alias("self_spread"), "menu_only",
        F.col("has_host_info").alias("host_info"), (F.col("has_key_write") & F.col("has_immutability")).alias("key_write_immutability"), (F.col("has_directory_chain") & F.col("has_tool_fallback")).alias("hetero_fallback"),
    )


def anchor_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Per playbook the share of its sessions in which each predicate fires, and which are usual (at least half)."""
    g = _folded(spark, d).filter("playbook_id is not null").groupBy("playbook_id").agg(F.count(F.lit(1)).alias("sessions"), *[F.avg(F.col(n).cast("int")).alias(n) for n in NAMES])
    usual = F.array_compact(F.array(*[F.when(F.col(n) >= MODAL, F.lit(n)) for n in NAMES]))
    return g.select("playbook_id", "sessions", *[F.round(n, 6).alias(n) for n in NAMES], F.array_join(usual, ",").alias("usual"))


def assign_sessions(spark: SparkSession, d: str, defer: bool = False) -> DataFrame:
    """Every session with a usable vector: playbook, cosine (four places), status, rank of the winner, band checks and rejections before it, rescued or not.

    `defer`: a pass without bags; the nearest band anchor is kept as provisional (status band).
    """
    anchors = _anchors(spark, d)
    s = nearest(_sessions(spark, d).select("uid", "playbook_id", "embedding"), "embedding", anchors, "playbook_id", "vec", "first")
    s = nearest(s, "embedding", anchors, "playbook_id", "vec", "anchors", ordered=None, floor=RESCUE).drop("embedding")
    cand = s.select("uid", F.posexplode("anchors").alias("rank", "c")).select("uid", "rank", F.col("c.label").alias("anchor"), F.col("c.cosine").alias("cos"))
    band = (F.col("cos") >= TAU) & (F.col("cos") < SURE)
    if defer:
        told = cand.withColumn("tf", F.lit(None).cast("double")).withColumn("usual", F.lit(False))
    else:
        bags = anchor_bags(spark, d)
        has = bags.select(F.col("playbook_id").alias("anchor"), F.lit(True).alias("has")).distinct()
        terms = _terms(spark, d).select("uid", "term", F.col("w").alias("x"))
        alike = cand.filter(band).select("uid", "anchor").join(terms, "uid").join(bags.select(F.col("playbook_id").alias("anchor"), "term", F.col("w").alias("y")), ["anchor", "term"]).groupBy("uid", "anchor").agg(F.sum(F.col("x") * F.col("y")).alias("tf"))
        fires = _folded(spark, d).select("uid", F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in NAMES])).alias("fires"))
        sig = anchor_signatures(spark, d).select(F.col("playbook_id").alias("anchor"), F.split("usual", ",").alias("modal"))
        told = (
            cand.join(alike, ["uid", "anchor"], "left").join(has, "anchor", "left").join(fires, "uid", "left").join(sig, "anchor", "left")
            .select("uid", "rank", "anchor", "cos", F.when(F.col("has"), F.coalesce("tf", F.lit(0.0))).alias("tf"), F.coalesce(F.arrays_overlap("fires", "modal"), F.lit(False)).alias("usual"))
        )
    by_bypass = F.col("anchor").isin(list(BYPASS)) if BYPASS and not defer else F.lit(False)
    checked = band & ~by_bypass & F.col("tf").isNotNull()
    decision = (
        F.when(F.col("cos") >= SURE, "assigned").when(band & by_bypass, "assigned").when(checked, F.when(F.round("tf", 9) >= TFIDF, "assigned").otherwise("rejected"))
        .when(band, "band" if defer else "assigned").when(F.col("usual"), "rescued").otherwise("passed")
    )
    w = Window.partitionBy("uid").orderBy("rank")
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = told.withColumn("decision", decision).withColumn("checks", F.sum(checked.cast("int")).over(before)).withColumn("rejections", F.sum((F.col("decision") == "rejected").cast("int")).over(before))
    won = steps.filter(F.col("decision").isin("assigned", "rescued", "band")).groupBy("uid").agg(F.min(F.struct("rank", "anchor", "cos", "decision", "checks", "rejections")).alias("x"))
    lost = steps.groupBy("uid").agg(F.max("checks").alias("c"), F.max("rejections").alias("r"))
    first = F.get("first", F.lit(0))["cosine"]
    j = s.join(won, "uid", "left").join(lost, "uid", "left")
    status = F.when(F.col("x").isNull(), "novel").when(F.col("x.decision") == "band", "band").otherwise("assigned")
    return j.select(
        "uid", F.col("x.anchor").alias("anchor"), F.round(F.coalesce("x.cos", first, F.lit(0.0)), 4).alias("cosine"), status.alias("status"), F.col("x.rank").alias("cascade_rank"),
        F.coalesce("x.checks", "c", F.lit(0)).cast("int").alias("band_checks"), F.coalesce("x.rejections", "r", F.lit(0)).cast("int").alias("band_rejections"),
        F.coalesce(F.col("x.decision") == "rescued", F.lit(False)).alias("rescued"), F.col("playbook_id").eqNullSafe(F.col("x.anchor")).alias("agrees"),
    )


def assign_forward(spark: SparkSession, d: str) -> DataFrame:
    """The pass without bags: band anchors stay provisional."""
    return assign_sessions(spark, d, defer=True)


def assign_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sessions per status, with how many keep their stored playbook and how many a predicate rescued; the novel ones are what is clustered next."""
    a = assign_sessions(spark, d)
    return a.groupBy("status").agg(F.count(F.lit(1)).alias("sessions"), F.count_if("agrees").alias("agree"), F.count_if("rescued").alias("rescued"), F.count_if(F.col("band_rejections") > 0).alias("rejected_first"))


QUERIES = {f.__name__: f for f in (anchor_bags, anchor_signatures, assign_sessions, assign_forward, assign_summary)}

_ARCH = "list_filter([" + ", ".join(rf"CASE WHEN regexp_matches(lower(command_line), '\b{a}\b') THEN '{a}' END" for a in X.ARCHITECTURES) + "], lambda x: x IS NOT NULL)"
_S = f"""s AS (SELECT sensor || ':' || session_id AS uid, playbook_id, list_distinct(list_filter(command_set, lambda x: x IS NOT NULL)) AS hs, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u
    FROM {SESS} WHERE embedding IS NOT NULL AND len(embedding) = 96 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0)"""
_T = """cl AS (SELECT command_hash AS h, CASE WHEN cluster.id <> '-1' THEN cluster.id END AS cid FROM commands), sh AS (SELECT uid, playbook_id, unnest(hs) AS h FROM s),
    tf AS (SELECT uid, playbook_id, coalesce(cid, 'outlier') AS term, count(*) AS tf FROM sh LEFT JOIN cl USING (h) GROUP BY 1, 2, 3), dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    nn AS (SELECT count(*) AS n FROM s WHERE len(hs) > 0), w0 AS (SELECT uid, playbook_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN dfq USING (term), nn),
    t AS (SELECT uid, playbook_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY uid)) AS w FROM w0),
    en AS (SELECT playbook_id, count(DISTINCT uid) AS bags FROM t WHERE playbook_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT uid) >= 50), am AS (SELECT playbook_id, term, bags, sum(w) AS w FROM t JOIN en USING (playbook_id) GROUP BY 1, 2, 3),
    ab AS (SELECT playbook_id, term, bags, round(w / sqrt(sum(w * w) OVER (PARTITION BY playbook_id)), 9) AS w FROM am)"""
_F = f"""p AS (SELECT command_hash AS h, {', '.join(f'coalesce({v}, false) AS {k}' for k, v in PREDICATE_SQL.items())}, coalesce(lower(trim(command_line)) IN ('sh', 'shell', 'enable', 'system', 'linuxshell', 'help', 'busybox'), false) AS menu, {_ARCH} AS arch FROM commands),
    f0 AS (SELECT uid, playbook_id, {', '.join(f'bool_or({k}) AS {k}' for k in PREDICATE_SQL)}, bool_and(menu) AS menu_only, len(list_distinct(flatten(list(arch)))) AS a FROM (SELECT uid, playbook_id, unnest(hs) AS h FROM s) JOIN p USING (h) GROUP BY 1, 2),
    f AS (SELECT uid, playbook_id, has_uname_m OR (has_case_word AND a >= 1) OR a >= 2 AS multi_arch, has_c2_launch AS c2_launch, has_self_spread AS self_spread, menu_only, has_host_info AS host_info, has_key_write AND has_immutability AS key_write_immutability,
    has_directory_chain AND has_tool_fallback AS hetero_fallback FROM f0),
    sg AS (SELECT playbook_id, count(*) AS sessions, {', '.join(f'avg({n}::INT) AS {n}' for n in NAMES)} FROM f WHERE playbook_id IS NOT NULL GROUP BY 1)"""
_CAND = """m AS (SELECT playbook_id, i, avg(u[i + 1]) AS v FROM s, range(96) r(i) WHERE playbook_id IS NOT NULL GROUP BY 1, 2), an AS (SELECT playbook_id AS anchor, list(v ORDER BY i) AS v FROM m GROUP BY 1),
    k AS (SELECT uid, anchor, list_cosine_similarity(u, v) AS cos, row_number() OVER (PARTITION BY uid ORDER BY round(list_cosine_similarity(u, v), 12) DESC, anchor) - 1 AS rank FROM s, an)"""


def _cascade(steps: str, extra: str) -> str:
    return f"""WITH {_S}, {extra} {_CAND}, {steps},
        st AS (SELECT *, sum(CASE WHEN checked THEN 1 ELSE 0 END) OVER x AS checks, sum(CASE WHEN decision = 'rejected' THEN 1 ELSE 0 END) OVER x AS rejections FROM dc WINDOW x AS (PARTITION BY uid ORDER BY rank)),
        wn AS (SELECT * FROM st WHERE decision IN ('assigned', 'rescued', 'band') QUALIFY row_number() OVER (PARTITION BY uid ORDER BY rank) = 1), ls AS (SELECT uid, max(checks) AS c, max(rejections) AS r FROM st GROUP BY 1)
        SELECT s.uid, wn.anchor, round(coalesce(wn.cos, k0.cos, 0), 4) AS cosine, CASE WHEN wn.uid IS NULL THEN 'novel' WHEN decision = 'band' THEN 'band' ELSE 'assigned' END AS status, CAST(wn.rank AS INTEGER) AS cascade_rank,
        CAST(coalesce(checks, c, 0) AS INTEGER) AS band_checks, CAST(coalesce(rejections, r, 0) AS INTEGER) AS band_rejections, coalesce(decision = 'rescued', false) AS rescued, s.playbook_id IS NOT DISTINCT FROM wn.anchor AS agrees
        FROM s LEFT JOIN wn USING (uid) LEFT JOIN ls USING (uid) LEFT JOIN (SELECT uid, cos FROM k WHERE rank = 0) k0 USING (uid)"""


_FULL = _cascade(
    f"""sm AS (SELECT uid, anchor, sum(t.w * ab.w) AS tf FROM k JOIN t USING (uid) JOIN ab ON ab.playbook_id = anchor AND ab.term = t.term WHERE cos >= {TAU} AND cos < {SURE} GROUP BY 1, 2),
    q AS (SELECT k.*, CASE WHEN anchor IN (SELECT playbook_id FROM ab) THEN coalesce(tf, 0) END AS tf, {' OR '.join(f'(f.{n} AND sg.{n} >= 0.5)' for n in NAMES)} AS usual FROM k LEFT JOIN sm USING (uid, anchor) LEFT JOIN f USING (uid)
    LEFT JOIN sg ON sg.playbook_id = anchor WHERE cos >= {RESCUE}),
    dc AS (SELECT *, cos >= {TAU} AND cos < {SURE} AND tf IS NOT NULL AS checked, CASE WHEN cos >= {SURE} THEN 'assigned' WHEN cos >= {TAU} AND tf IS NULL THEN 'assigned' WHEN cos >= {TAU} AND round(tf, 9) >= {TFIDF} THEN 'assigned'
    WHEN cos >= {TAU} THEN 'rejected' WHEN usual THEN 'rescued' ELSE 'passed' END AS decision FROM q)""",
    f"{_T}, {_F},",
)
SQL = {
    "anchor_bags": f"WITH {_S}, {_T} SELECT playbook_id, term, bags, w FROM ab",
    "anchor_signatures": f"""WITH {_S}, {_F} SELECT playbook_id, sessions, {', '.join(f'round({n}, 6) AS {n}' for n in NAMES)},
        concat_ws(',', {', '.join(f"CASE WHEN {n} >= 0.5 THEN '{n}' END" for n in NAMES)}) AS usual FROM sg""",
    "assign_sessions": _FULL,
    "assign_forward": _cascade(f"dc AS (SELECT *, false AS checked, CASE WHEN cos >= {SURE} THEN 'assigned' WHEN cos >= {TAU} THEN 'band' ELSE 'passed' END AS decision FROM k WHERE cos >= {RESCUE})", ""),
    "assign_summary": f"SELECT status, count(*) AS sessions, count(*) FILTER (agrees) AS agree, count(*) FILTER (rescued) AS rescued, count(*) FILTER (band_rejections > 0) AS rejected_first FROM ({_FULL}) GROUP BY 1",
}
