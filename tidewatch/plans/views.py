"""Further reads of the tables: resumable scans, nested filters, phrases, high-water marks, command rows, references, neighbourhoods, details
(survey Q1, Q8, Q11, S9, S21, A9-A13, A17, A26, A28, D13, D15, D16, E2, E10, F5, F12-F16, H9, H28, H33, H35, I1, J5, J9, J13, K3, K5, L30)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dist as D
from ..functions import text as X
from ..operators.nearest import as_arrays, mean_vectors, nearest, usable, weighted_sums
from ..session import table
from .campaigns import _EDGES, _UID, graph_edges, uid
from .commands import _DIGITS, _QUAD, PREDICATE_SQL, _lit
from .common import CMD, EV, SESS, command_events, events, slim_sessions
from .tracking import SQL as TRACK
from .tracking import artifact_burst, behaviour_shift, campaign_convergence, new_entities, operation_emergence

#: Distinct sets of a playbook that a task compares with as many, and how many of them at a time.
SETS_IN_BLOCK = 16_384
_TILE = 1_024


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def scan_after(spark: SparkSession, d: str, after: tuple[str, int] = ("2026-01-10 00:00:00", 0), size: int = 500) -> DataFrame:
    """The next page of all events in (time, id) order behind a key; its last row is the next key, so a scan can stop and go on."""
    e = events(spark, d).select("ts", "event_id", "event_action", "sensor", "session_id")
    ts = F.to_timestamp(F.lit(after[0]))
    behind = (F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("event_id") > after[1]))
    return e.filter((F.col("ts") >= ts) & behind).orderBy("ts", "event_id").limit(size)


def nested_filter(spark: SparkSession, d: str) -> DataFrame:
    """Commands with one indicator that is a URL and ends in .sh: both tests on the same element."""
    hit = F.exists("indicators", lambda i: (i["ioc_kind"] == "url") & F.endswith(i["ioc_value"], F.lit(".sh")))
    return table(spark, d, "commands").filter(hit).select("command_hash", "intent", F.size(F.filter("indicators", lambda i: i["ioc_kind"] == "url")).alias("urls"))


PHRASE = ["the", "session"]


def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the words of a phrase in order, scored by BM25 of the words (k1 1.2, b 0.75) plus 1 for each occurrence of the phrase."""
    low = F.lower("text")
    word = lambda x: rf"(?<![\p{{L}}\p{{N}}_]){x}(?![\p{{L}}\p{{N}}_])"
    gap = r"[^\p{L}\p{N}_]+"
    t = table(spark, d, "documents").filter(F.col("text").isNotNull()).select(
        "doc_id", F.regexp_count(low, F.lit(r"[\p{L}\p{N}_]+")).alias("z"), F.regexp_count(low, F.lit(word(gap.join(PHRASE)))).alias("phrases"), *[F.regexp_count(low, F.lit(word(x))).alias(f"tf{i}") for i, x in enumerate(PHRASE)]
    )
    t = t.filter("z > 0")
    n = t.agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(PHRASE))])  # one row
    score = F.col("phrases").cast("double")
    for i in range(len(PHRASE)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("z") / F.col("mean")))
    return t.filter("phrases > 0").join(F.broadcast(n)).select("doc_id", "phrases", F.round(score, 6).alias("score"))


def watermarks(spark: SparkSession, d: str) -> DataFrame:
    """Named high-water marks: how far each table has been filled, and by how many rows since seven days before."""
    cols = {"raw_events": "ingested_at", "sessions_rollup": "rolled_up_at", "ips_rollup": "last_seen", "commands": "last_seen", "enrichment_cache": "enriched_at", "documents": "loaded_at"}
    parts = []
    for name, col in cols.items():
        t = table(spark, d, name).select(F.col(col).alias("t"))
        top = t.agg(F.max("t").alias("mark"))  # one row
        parts.append(t.join(F.broadcast(top)).groupBy("mark").agg(F.count_if(F.col("t") > F.col("mark") - F.expr("INTERVAL 7 DAYS")).alias("recent")).select(F.lit(name).alias("name"), "mark", "recent"))
    return _all(parts)


def command_events_since(spark: SparkSession, d: str) -> DataFrame:
    """Commands of events that arrived in the last seven days (by arrival, since events come late): count and sessions by hash."""
    c = command_events(spark, d)
    mark = table(spark, d, "raw_events").agg((F.max("ingested_at") - F.expr("INTERVAL 7 DAYS")).alias("mark"))  # one row
    return c.join(F.broadcast(mark)).filter("ingested_at > mark").groupBy(F.col("h").alias("command_hash")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct(F.struct("sensor", "session_id")).alias("sessions"), F.max("ts").alias("last_seen"))


def shape_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Per shape the row others inherit from: a parent or standalone command of known intent and confidence 5 at least; the most confident, most frequent, least hash."""
    c = table(spark, d, "commands").filter(F.col("shape.hash").isNotNull() & F.col("shape.shape_role").isin("canonical", "parent", "standalone") & (F.col("confidence") >= 5) & (F.col("intent") != "unknown"))
    best = c.groupBy(F.col("shape.hash").alias("shape_hash")).agg(F.min(F.struct(-F.col("confidence"), -F.col("occurrence_count"), "command_hash", "intent")).alias("x"), F.count(F.lit(1)).alias("candidates"))
    return best.select("shape_hash", F.col("x.command_hash").alias("command_hash"), F.col("x.intent").alias("intent"), "candidates")


def _indicators(c: Column) -> Column:
    """Typed indicators of a line, in the order addresses, domains, URLs, digests, files; each once."""
    kinds = [("ip", X.ipv4s(c)), ("domain", X.domains(c)), ("url", X.urls(c)), ("hash", X.hashes(c)), ("file", X.paths(c))]

    def typed(kind: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("ioc_kind"), x.alias("ioc_value")))

    return F.concat(*[typed(k, v) for k, v in kinds])


def command_document(spark: SparkSession, d: str) -> DataFrame:
    """The whole row of a command: counters from the events, stored judgement, built indicators, shape, predicates, sticky classification."""
    e = command_events(spark, d).groupBy(F.col("h").alias("command_hash")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("sensor", "session_id")).alias("sessions"), F.count_distinct("source.ip").alias("addresses"), F.min("ts").alias("a"), F.max("ts").alias("b"),
        X.most_restrictive(F.col("classification")).alias("classification"), F.when(F.count_distinct("sensor") == 1, F.min("sensor")).alias("sensor"),
    )
    c, line = table(spark, d, "commands"), F.col("command_line")
    ind = _indicators(line)
    fires = F.array_compact(F.array(*[F.when(X.predicate(line, k), F.lit(k)) for k in X.PREDICATES]))
    return c.join(e, "command_hash", "left").select(
        "command_hash", F.sha2(X.normalize(line), 256).alias("full_hash"), F.coalesce("intent", F.lit("unknown")).alias("intent"), F.coalesce(F.col("confidence").cast("int"), F.lit(5)).alias("confidence"),
        F.greatest("occurrence_count", F.coalesce("n", F.lit(0))).alias("occurrence_count"), F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("addresses", F.lit(0)).alias("addresses"),
        F.least("first_seen", "a").alias("first_seen"), F.greatest("last_seen", "b").alias("last_seen"), F.coalesce(F.size(ind), F.lit(0)).alias("indicators"), F.array_join(fires, ",").alias("fires"), F.col("shape.hash").alias("shape_hash"), "classification", "sensor",
    )


def embed_layouts(spark: SparkSession, d: str) -> DataFrame:
    """The three layouts of the text a command is embedded as: facts first, command first, or with the commands it most often occurs with."""
    from .commands import cooccurrence_tfidf

    c = table(spark, d, "commands").filter(F.col("command_line").isNotNull())
    facts = F.concat_ws(" | ", F.concat(F.lit("intent: "), "intent"), F.concat(F.lit("confidence: "), F.col("confidence").cast("string")))
    sib = cooccurrence_tfidf(spark, d).groupBy("command_hash").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sibling"))), lambda x: x["sibling"]), " ").alias("with"))  # three at most
    j = c.select("command_hash", "command_line", facts.alias("facts")).join(sib, "command_hash", "left")
    lines = lambda *x: F.concat_ws("\n", *[F.expr(f"nullif({v}, '')") for v in x])
    return j.select(
        "command_hash", F.sha2(lines("facts", "command_line"), 256).alias("facts_first"), F.sha2(lines("command_line", "facts"), 256).alias("command_first"),
        F.sha2(F.concat_ws("\n", lines("facts", "command_line"), F.concat(F.lit("with: "), "with")), 256).alias("with_siblings"),
    )


PRIVATE = ["10.", "127.", "192.168.", "169.254.", "0."]


def ioc_validity(spark: SparkSession, d: str) -> DataFrame:
    """Stored indicators by kind that pass their kind's test: public addresses, digests of a known length, domains with a dot and letters, URLs with a scheme and host, absolute files."""
    i = table(spark, d, "commands").select(F.explode("indicators").alias("i")).select(F.col("i.ioc_kind").alias("kind"), F.col("i.ioc_value").alias("v")).distinct()
    octets = F.split("v", r"\.")
    public = F.col("v").rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(octets, lambda o: o.try_cast("int") <= 255) & ~reduce(lambda a, b: a | b, [F.startswith("v", F.lit(p)) for p in PRIVATE])
    good = (
        F.when(F.col("kind") == "ip", public).when(F.col("kind") == "hash", F.col("v").rlike("^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"))
        .when(F.col("kind") == "domain", F.col("v").rlike(r"^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$")).when(F.col("kind") == "url", F.col("v").rlike("^[a-z]+://[^/]+")).otherwise(F.startswith("v", F.lit("/")))
    )
    return i.groupBy("kind").agg(F.count(F.lit(1)).alias("values"), F.count_if(F.coalesce(good, F.lit(False))).alias("valid"))


STORED = {"has_uname_m": "has_uname_m", "has_c2_launch": "has_c2_launch", "has_self_spread": "has_self_spread", "has_host_recon": "has_host_info", "has_key_write": "has_key_write", "has_immutability": "has_immutability"}


def predicates_backfill(spark: SparkSession, d: str) -> DataFrame:
    """All predicates of a command: the stored value where there is one, else computed; with the architectures."""
    c, line = table(spark, d, "commands"), F.col("command_line")
    held = set(c.schema["predicates"].dataType.names)
    cols = []
    for k in X.PREDICATES:
        stored = next((s for s, own in STORED.items() if own == k and s in held), None)
        cols.append((F.coalesce(F.col(f"predicates.{stored}"), X.predicate(line, k)) if stored else X.predicate(line, k)).alias(k))
    arch = F.coalesce(F.col("predicates.arch_tokens"), X.architectures(line))
    return c.select("command_hash", *cols, F.array_join(F.array_sort(F.array_compact(arch)), ",").alias("architectures"), (F.col("predicates").isNull()).alias("was_missing"))


def cache_state(spark: SparkSession, d: str) -> DataFrame:
    """Per command and model whether it is cached under that model's newest pair of settings, fully (both hashes agree) or for its text only."""
    e = table(spark, d, "enrichment_cache")
    now = e.groupBy("model").agg(F.max(F.struct("enriched_at", "llm_config_hash", "embed_config_hash")).alias("x")).select("model", F.col("x.llm_config_hash").alias("l"), F.col("x.embed_config_hash").alias("m"))
    have = e.join(now, "model").groupBy("command_hash", "model").agg(F.bool_or(F.col("llm_config_hash").eqNullSafe(F.col("l"))).alias("text"), F.bool_or(F.col("llm_config_hash").eqNullSafe(F.col("l")) & F.col("embed_config_hash").eqNullSafe(F.col("m"))).alias("full"))
    c = table(spark, d, "commands").select("command_hash").join(F.broadcast(now.select("model")))  # a row per model
    s = c.join(have, ["command_hash", "model"], "left")
    state = F.when(F.col("full"), "cached").when(F.col("text"), "embed").otherwise("enrich")
    return s.groupBy("model", state.alias("todo")).agg(F.count(F.lit(1)).alias("commands"))


def reference_centroids(spark: SparkSession, d: str) -> DataFrame:
    """The newest generation of reference centroids per document type, with how many are usable (96 numbers); a run is a generation."""
    c = table(spark, d, "session_clusters")
    gen = c.groupBy("doc_type", "run_id").agg(F.max("created_at").alias("t"), F.count(F.lit(1)).alias("centroids"), F.count_if(usable(F.col("centroid"), 96)).alias("usable"))
    return gen.groupBy("doc_type").agg(F.max(F.struct("t", "run_id", "centroids", "usable")).alias("x")).select("doc_type", "x.run_id", "x.centroids", "x.usable")


def prune_runs(spark: SparkSession, d: str, keep: int = 5) -> DataFrame:
    """Clusters of runs older than the `keep` newest, which go; reference rows never do, and nothing goes where no runs are complete."""
    c = table(spark, d, "session_clusters")
    runs = c.filter("doc_type <> 'reference_centroid' and run_id is not null").groupBy("run_id").agg(F.max("created_at").alias("t")).orderBy(F.desc("t"), F.desc("run_id")).limit(keep).select("run_id")
    return c.filter("doc_type <> 'reference_centroid' and run_id is not null").join(F.broadcast(runs), "run_id", "left_anti").select("cluster_id", "run_id")


def external_match(spark: SparkSession, d: str) -> DataFrame:
    """Second novelty of a session against centroids of another source (the named playbooks' newest clusters): nearest id and cosine; outliers get none."""
    s = slim_sessions(spark, d, "embedding", "cluster.is_outlier").filter(usable(F.col("embedding"), 96) & ~F.coalesce("cluster_is_outlier", F.lit(False))).select(uid().alias("uid"), "embedding")
    c = table(spark, d, "session_clusters").filter(usable(F.col("centroid"), 96) & F.col("playbook_name").isNotNull())
    best = F.get("nearest", F.lit(0))
    return nearest(s, "embedding", c.select("cluster_id", "centroid"), "cluster_id", "centroid").select("uid", best["label"].alias("external_id"), F.round(best["cosine"], 5).alias("cosine"), F.round(1 - F.greatest(best["cosine"], F.lit(0.0)), 5).alias("novelty"))


def playbook_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Size-weighted unit centroid of each playbook's clusters, one row per dimension."""
    c = table(spark, d, "session_clusters").filter(usable(F.col("centroid"), 96) & F.col("playbook_id").isNotNull()).withColumn("w", F.greatest(F.coalesce("n_sessions", F.lit(1)), F.lit(1)).cast("double"))
    return weighted_sums(c, ["playbook_id"], "w", "centroid").select("playbook_id", F.posexplode("vec").alias("pos", "x")).select("playbook_id", "pos", (F.round("x", 5) + 0.0).alias("value"))


def indicator_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Indicators by the share of a playbook's sessions that show them: the five widest of each playbook."""
    s = slim_sessions(spark, d, "playbook_id", "command_set").filter("playbook_id is not null").withColumn("uid", uid())
    size = s.groupBy("playbook_id").agg(F.count(F.lit(1)).alias("n"))
    i = table(spark, d, "commands").select(F.col("command_hash").alias("h"), F.explode("indicators").alias("i")).select("h", F.concat_ws(":", "i.ioc_kind", "i.ioc_value").alias("indicator"))
    use = s.select("uid", "playbook_id", F.explode(F.array_compact("command_set")).alias("h")).join(i, "h").select("uid", "playbook_id", "indicator").distinct()
    n = use.groupBy("playbook_id", "indicator").agg(F.count(F.lit(1)).alias("sessions"))
    r = n.withColumn("rank", F.row_number().over(Window.partitionBy("playbook_id").orderBy(F.desc("sessions"), "indicator"))).filter("rank <= 5").join(size, "playbook_id")
    return r.select("playbook_id", "indicator", "sessions", "rank", F.round(F.col("sessions") / F.col("n"), 6).alias("coverage"))


def text_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts in command lines that tie sessions together: http(s) URLs, SSH keys (type and first 32 characters), digests named or made in the line; commands with each."""
    line = F.col("command_line")
    keys = F.transform(F.regexp_extract_all(line, F.lit(r"((?:ssh-(?:rsa|dss|ed25519)|ecdsa-[a-z0-9-]+)\s+[A-Za-z0-9+/]{40,}=*)"), 1), lambda k: F.concat(F.regexp_extract(k, r"^(\S+)", 1), F.lit(" "), F.substring(F.regexp_extract(k, r"\s+(\S+)$", 1), 1, 32)))
    urls = F.filter(X.urls(line), lambda u: F.startswith(u, F.lit("http")))

    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.concat(F.lit(kind), x))

    parts = F.concat(named("url:", urls), named("ssh_key:", F.array_distinct(keys)), named("hash:", X.hashes(line)))
    return table(spark, d, "commands").filter(line.isNotNull()).select("command_hash", F.explode(parts).alias("artifact")).groupBy("artifact").agg(F.count_distinct("command_hash").alias("commands"), F.min("command_hash").alias("first"))


def neighbourhood(spark: SparkSession, d: str, limit: int = 50) -> DataFrame:
    """Two hops around the address with most sessions: its edges, then those of what they reach; each step takes the `limit` heaviest edges of each kind (a drawing's size)."""
    e = graph_edges(spark, d)
    start = slim_sessions(spark, d, "source.ip").filter("source_ip is not null").groupBy("source_ip").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source_ip").limit(1).select(F.col("source_ip").alias("node"))
    w = Window.partitionBy("kind").orderBy(F.desc("weight"), "src", "dst")
    one = e.join(F.broadcast(start), e.src == F.col("node")).drop("node").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit).drop("r")
    reached = one.select(F.col("dst").alias("node")).distinct()
    two = e.join(reached, e.src == F.col("node")).drop("node").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit).drop("r")
    return one.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2))).groupBy("kind", "src", "dst", "weight").agg(F.min("hop").alias("hop")).withColumn("edge_id", F.concat_ws("->", "src", "dst"))


def distinctive_commands(spark: SparkSession, d: str) -> DataFrame:
    """Per playbook its three most specific commands (ln(C / df) / ln(C)), by sessions where equally specific."""
    s = slim_sessions(spark, d, "playbook_id", "command_set").filter("playbook_id is not null").withColumn("uid", uid())
    p = s.select("playbook_id", "uid", F.explode(F.array_compact("command_set")).alias("command_hash")).distinct().groupBy("playbook_id", "command_hash").agg(F.count(F.lit(1)).alias("sessions"))
    total = s.agg(F.count_distinct("playbook_id").alias("c"))  # one row
    df = p.groupBy("command_hash").agg(F.count(F.lit(1)).alias("df"))
    v = F.when(F.col("c") <= 1, 0.0).otherwise(F.greatest(F.least(F.log(F.col("c") / F.col("df")) / F.log("c"), F.lit(1.0)), F.lit(0.0)))
    x = p.join(df, "command_hash").join(F.broadcast(total)).withColumn("specificity", F.round(v, 3))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("playbook_id").orderBy(F.desc("specificity"), F.desc("sessions"), "command_hash"))).filter("rank <= 3").select("playbook_id", "command_hash", "sessions", "specificity", "rank")


def discovery(spark: SparkSession, d: str) -> DataFrame:
    """Findings of all miners in one table."""
    return _all([
        new_entities(spark, d).select(F.lit("new_entity").alias("kind"), F.concat_ws(":", "entity", "id").alias("value"), "score"),
        behaviour_shift(spark, d).select(F.lit("behaviour_shift").alias("kind"), F.col("source_ip").alias("value"), F.round("js", 5).alias("score")),
        artifact_burst(spark, d).select(F.lit("outlier_burst").alias("kind"), F.col("artifact").alias("value"), "score"),
        campaign_convergence(spark, d).select(F.lit("campaign_convergence").alias("kind"), F.concat_ws("|", "a", "b").alias("value"), "score"),
        operation_emergence(spark, d).select(F.lit("operation_emergence").alias("kind"), F.concat_ws(":", "operation_id", "event").alias("value"), F.round(F.log1p("shared_addresses"), 6).alias("score")),
    ]).withColumn("finding_id", F.concat(F.lit("find-"), X.short_hash(F.concat_ws(":", "kind", "value"))))


def hunt_preview(spark: SparkSession, d: str) -> DataFrame:
    """What a hunt would find: the true total beside the first ten sessions; nothing is written."""
    s = slim_sessions(spark, d, "started_at", "login_fail_count", "command_count").filter("login_fail_count >= 2 and command_count >= 5")
    total = s.agg(F.count(F.lit(1)).alias("total"))  # one row
    return s.orderBy(F.desc("started_at"), "sensor", "session_id").limit(10).join(F.broadcast(total)).select("sensor", "session_id", "started_at", "total")


FACETS = {"kind": "brute", "sensor": "edge-01", "band": None, "age": None, "size": None}


def five_facets(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all five facets of the inbox (kind, sensor, score band, age band, band of the address's sessions), each under the others' filters only."""
    from .findings import _findings

    f = _findings(spark, d)
    newest = f.agg(F.max("started_at").alias("t"))  # one row
    n = slim_sessions(spark, d, "source.ip").filter("source_ip is not null").groupBy("source_ip").agg(F.count(F.lit(1)).alias("n"))
    days = F.datediff("t", "started_at")
    f = f.join(F.broadcast(newest)).join(n, "source_ip", "left").select(
        "kind", "sensor", F.when(F.col("score") < 0.5, "low").when(F.col("score") < 1.5, "mid").otherwise("high").alias("band"),
        F.when(days <= 1, "day").when(days <= 7, "week").otherwise("older").alias("age"), F.when(F.coalesce("n", F.lit(0)) < 5, "few").when(F.col("n") < 25, "some").otherwise("many").alias("size"),
    )
    parts = []
    for facet in FACETS:
        cond = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in FACETS.items() if v is not None and k != facet], F.lit(True))
        parts.append(f.filter(cond).groupBy(F.col(facet).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(facet).alias("facet"), "value", "n"))
    return _all(parts)


def finding_detail(spark: SparkSession, d: str) -> DataFrame:
    """Beside each playbook's finding: its five commonest commands and three busiest addresses."""
    s = slim_sessions(spark, d, "playbook_id", "source.ip", "command_set").filter("playbook_id is not null")

    def top(n: DataFrame, what: str, k: int) -> DataFrame:
        r = n.withColumn("r", F.row_number().over(Window.partitionBy("playbook_id").orderBy(F.desc("n"), "v"))).filter(F.col("r") <= k)
        return r.groupBy("playbook_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "v", "n"))), lambda x: F.concat_ws("=", x["v"], x["n"].cast("string"))), ",").alias(what))

    commands = s.select("playbook_id", F.explode(F.array_distinct(F.array_compact("command_set"))).alias("v")).groupBy("playbook_id", "v").agg(F.count(F.lit(1)).alias("n"))
    addresses = s.filter("source_ip is not null").groupBy("playbook_id", F.col("source_ip").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("playbook_id").agg(F.count(F.lit(1)).alias("sessions")).join(top(commands, "commands", 5), "playbook_id", "left").join(top(addresses, "addresses", 3), "playbook_id", "left")


def asn_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of every network with their sessions and commonest playbook; the ten busiest of each."""
    s = slim_sessions(spark, d, "source.ip", "source.asn.number", "playbook_id").filter("source_ip is not null and source_asn_number is not null")
    n = s.groupBy(F.col("source_asn_number").alias("asn"), "source_ip").agg(F.count(F.lit(1)).alias("sessions"))
    m = s.filter("playbook_id is not null").groupBy(F.col("source_asn_number").alias("asn"), "source_ip", "playbook_id").agg(F.count(F.lit(1)).alias("k")).groupBy("asn", "source_ip").agg(F.min(F.struct(-F.col("k"), "playbook_id"))["playbook_id"].alias("playbook_id"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("asn").orderBy(F.desc("sessions"), "source_ip"))).filter("rank <= 10").join(m, ["asn", "source_ip"], "left")


def playbook_names(spark: SparkSession, d: str) -> DataFrame:
    """The name of each playbook: that of its newest named cluster; its id where none is named."""
    c = table(spark, d, "session_clusters").filter(F.col("playbook_id").isNotNull())
    return c.groupBy("playbook_id").agg(F.coalesce(F.max_by("playbook_name", F.when(F.col("playbook_name").isNotNull(), F.struct("created_at", "cluster_id"))), F.col("playbook_id")).alias("name"), F.count(F.lit(1)).alias("clusters"))


def pairwise_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Mean Jaccard similarity of the command sets of a playbook's sessions over all its pairs, from pairs of distinct sets and their weights.

    Sets meet in blocks, and a pair of blocks comes out as one number: pairs are never written down.
    """
    s = slim_sessions(spark, d, "playbook_id", "command_set").filter("playbook_id is not null")
    b = s.withColumn("hs", F.array_sort(F.array_distinct(F.array_compact("command_set")))).filter(F.size("hs") > 0).groupBy("playbook_id", "hs").agg(F.count(F.lit(1)).alias("w"))
    g = b.groupBy("playbook_id").agg(F.sum("w").alias("sessions"), F.sum(F.col("w") * (F.col("w") - 1) / 2).alias("same"), F.ceil(F.count(F.lit(1)) / SETS_IN_BLOCK).alias("blocks"))
    mine = b.join(g.select("playbook_id", "blocks"), "playbook_id").withColumn("mine", F.pmod(F.xxhash64("hs"), F.col("blocks")))
    met = mine.withColumn("rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("playbook_id", F.least("mine", "rest").alias("x"), F.greatest("mine", "rest").alias("y"), (F.col("mine") < F.col("rest")).alias("left"), "hs", "w")
    across = met.groupBy("playbook_id", "x", "y").applyInArrow(_jaccard_sums, "playbook_id string, sum double").groupBy("playbook_id").agg(F.sum("sum").alias("sum"))
    pairs = F.col("sessions") * (F.col("sessions") - 1) / 2
    return g.join(across, "playbook_id", "left").select("playbook_id", "sessions", F.round(F.when(pairs > 0, (F.col("same") + F.coalesce("sum", F.lit(0.0))) / pairs), 6).alias("mean_jaccard"))


def _jaccard_sums(t: pa.Table) -> pa.Table:
    """Sum of weighted Jaccard similarities of all pairs of different sets in a block (x = y), or between two (x < y)."""
    inside = t["x"][0] == t["y"][0]
    sets = t["hs"].combine_chunks()
    codes = sets.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    size = sets.value_lengths().to_numpy().astype(np.int64)
    w = t["w"].to_numpy().astype(np.float64)
    row = np.repeat(np.arange(len(size)), size)
    held = np.bincount(codes, minlength=1)
    # Commands in many sets are multiplied as a matrix; pairs of sets that share a rarer one are listed.
    often = held >= max(2, len(size) // 32)
    column = np.cumsum(often) - 1
    x = np.zeros((len(size), int(often.sum())), np.float32)
    at = often[codes]
    x[row[at], column[codes[at]]] = 1
    rare = ~at & (held[codes] > 1)
    order = np.lexsort((row[rare], codes[rare]))
    rare_row, rare_code = row[rare][order], codes[rare][order]
    left = np.arange(len(size)) if inside else np.flatnonzero(t["left"].to_numpy(zero_copy_only=False))
    right = left if inside else np.flatnonzero(~t["left"].to_numpy(zero_copy_only=False))
    # Of the sets that hold a rare command, each pairs with all of its run.
    first = np.searchsorted(rare_code, rare_code, "left")
    last = np.searchsorted(rare_code, rare_code, "right")
    where = np.full(len(size), -1)
    where[right] = np.arange(len(right))
    total = 0.0
    for i in range(0, len(left), _TILE):
        some = left[i : i + _TILE]
        tile = np.full(len(size), -1)
        tile[some] = np.arange(len(some))
        mine = np.flatnonzero(tile[rare_row] >= 0)
        n = last[mine] - first[mine]
        a = np.repeat(tile[rare_row[mine]], n)
        b = where[rare_row[np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())]]
        a, b = a[b >= 0], b[b >= 0]
        ordered = np.argsort(b // _TILE, kind="stable")
        a, b = a[ordered], b[ordered]
        for j in range(i if inside else 0, len(right), _TILE):
            others = right[j : j + _TILE]
            c = (x[some] @ x[others].T).astype(np.float64)
            lo, hi = np.searchsorted(b // _TILE, [j // _TILE, j // _TILE + 1])
            if hi > lo:
                c += np.bincount(a[lo:hi] * len(others) + b[lo:hi] - j, minlength=c.size).reshape(c.shape)
            if inside and i == j:
                np.fill_diagonal(c, 0)
            c /= size[some][:, None] + size[others][None, :] - c
            total += (w[some] @ c @ w[others]) * (2 if inside and j > i else 1)
    # Inside a block each pair was counted twice.
    return pa.table({"playbook_id": t["playbook_id"].slice(0, 1), "sum": pa.array([total / 2 if inside else total])})


def novelty_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Leave one label out: how well novelty against the other labels' centroids tells a label's vectors from the rest (rank AUC, ties at their mean rank)."""
    e = table(spark, d, "embeddings").filter(F.col("embedding").isNotNull())
    cents = as_arrays(mean_vectors(e, "label", "embedding", unit=True), "label")
    s = nearest(e.select("vec_id", "label", "embedding"), "embedding", cents, "label", "vec", "two", ordered=2)
    best, second = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    # For the label held out: its own vectors are judged by their best other centroid; so are the others whose best one is held out.
    labels = cents.select(F.col("label").cast("string").alias("held"))  # a row per label
    x = s.join(F.broadcast(labels))
    cos = F.when(best["label"] == F.col("held"), second["cosine"]).otherwise(best["cosine"])
    x = x.select("held", (F.col("label").cast("string") == F.col("held")).alias("own"), F.round(1 - F.greatest(F.coalesce(cos, F.lit(0.0)), F.lit(0.0)), 6).alias("nov"))
    n = x.groupBy("held", "nov").agg(F.count_if("own").alias("p"), F.count_if(~F.col("own")).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy("held").orderBy("nov").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    a = n.withColumn("below", below).groupBy("held").agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return a.select(F.col("held").cast("int").alias("label"), F.round(F.col("u") / (F.col("p") * F.col("q")), 5).alias("auc"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_after, nested_filter, phrase_search, watermarks, command_events_since, shape_canonical, command_document, embed_layouts, ioc_validity, predicates_backfill, cache_state, reference_centroids, prune_runs, external_match,
        playbook_centroids, indicator_coverage, text_artifacts, neighbourhood, distinctive_commands, discovery, hunt_preview, five_facets, finding_detail, asn_addresses, playbook_names, pairwise_jaccard, novelty_holdout,
    )
}

_U96 = "embedding IS NOT NULL AND len(embedding) = 96 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0"
_C96 = "centroid IS NOT NULL AND len(centroid) = 96 AND list_dot_product(centroid::DOUBLE[], centroid::DOUBLE[]) > 0"
_MARKS = {"raw_events": "ingested_at", "sessions_rollup": "rolled_up_at", "ips_rollup": "last_seen", "commands": "last_seen", "enrichment_cache": "enriched_at", "documents": "loaded_at"}
_EX = {
    "ip": f"list_distinct(list_filter(regexp_extract_all({_DIGITS}, {_QUAD}), lambda v: len(list_filter(string_split(v, '.'), lambda o: CAST(o AS INTEGER) > 255)) = 0))",
    "url": f"list_distinct(list_transform(regexp_extract_all(command_line, {_lit(X.URL)}), lambda u: regexp_replace(u, '[.,;:]+$', '')))",
    "hash": r"""list_distinct(list_concat(regexp_extract_all(lower(command_line), '(?:sha256|sha1|md5)[:=]([0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})\b', 1), CASE WHEN len(list_intersect(regexp_extract_all(lower(command_line), '[\pL\pN_]+'), [""" + ", ".join(map(_lit, X.DIGEST_WORDS))
    + r"""])) > 0 OR regexp_matches(lower(command_line), 'openssl\s+dgst|gpg\s+--print-md') THEN regexp_extract_all(lower(command_line), '\b([0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})\b', 1) ELSE [] END))""",
    "file": r"list_distinct(list_filter(regexp_extract_all(command_line, '(?:^|[\s|;&`(])(/[A-Za-z0-9._/+-]+)', 1), lambda v: length(v) >= 3))",
}
_DOMAINS = rf"list_distinct(list_filter(list_transform({_EX['url']}, lambda v: lower(string_split(string_split(string_split(v, '://')[2], '/')[1], ':')[1])), lambda h: contains(h, '.') AND NOT regexp_full_match(h, '\d{{1,3}}(\.\d{{1,3}}){{3}}')))"
_W = r"list_filter(regexp_split_to_array(lower(text), '[^\pL\pN_]+'), lambda x: x <> '')"
_PRED = {k: f"coalesce({v}, false)" for k, v in PREDICATE_SQL.items()}
_TOPS = """(SELECT playbook_id, string_agg(v || '=' || n, ',' ORDER BY r) AS {what} FROM (SELECT playbook_id, v, n, row_number() OVER (PARTITION BY playbook_id ORDER BY n DESC, v) AS r FROM ({n})) WHERE r <= {k} GROUP BY 1)"""
SQL = {
    "scan_after": f"SELECT ts, event_id, event_action, sensor, session_id FROM {EV} WHERE ts > TIMESTAMPTZ '2026-01-10 00:00:00+00' OR (ts = TIMESTAMPTZ '2026-01-10 00:00:00+00' AND event_id > 0) ORDER BY ts, event_id LIMIT 500",
    "nested_filter": "SELECT command_hash, intent, CAST(len(list_filter(indicators, lambda i: i.ioc_kind = 'url')) AS INTEGER) AS urls FROM commands WHERE len(list_filter(indicators, lambda i: i.ioc_kind = 'url' AND i.ioc_value LIKE '%.sh')) > 0",
    "phrase_search": f"""WITH t AS (SELECT doc_id, {_W} AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS n, avg(len(w)) AS mean, count(*) FILTER (list_contains(w, 'the')) AS d0, count(*) FILTER (list_contains(w, 'session')) AS d1 FROM t WHERE len(w) > 0),
        h AS (SELECT doc_id, len(w) AS z, len(list_filter(range(1, len(w)), lambda i: w[i] = 'the' AND w[i + 1] = 'session')) AS phrases, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'session')) AS b FROM t WHERE len(w) > 0)
        SELECT doc_id, CAST(phrases AS INTEGER) AS phrases, round(phrases + ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * z / mean)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * z / mean)), 6) AS score FROM h, n WHERE phrases > 0""",
    "watermarks": " UNION ALL ".join(f"SELECT '{t}' AS name, max({c}) AS mark, (SELECT count(*) FROM {t} WHERE {c} > (SELECT max({c}) FROM {t}) - INTERVAL 7 DAY) AS recent FROM {t}" for t, c in _MARKS.items()),
    "command_events_since": f"SELECT h AS command_hash, count(*) AS events, count(DISTINCT (sensor, session_id)) AS sessions, max(ts) AS last_seen FROM {CMD} WHERE ingested_at > (SELECT max(ingested_at) FROM raw_events) - INTERVAL 7 DAY GROUP BY 1",
    "shape_canonical": """SELECT shape.hash AS shape_hash, command_hash, intent, count(*) OVER (PARTITION BY shape.hash) AS candidates FROM commands WHERE shape.hash IS NOT NULL AND shape.shape_role IN ('canonical', 'parent', 'standalone') AND confidence >= 5 AND intent <> 'unknown'
        QUALIFY row_number() OVER (PARTITION BY shape.hash ORDER BY confidence DESC, occurrence_count DESC, command_hash) = 1""",
    "command_document": rf"""WITH e AS (SELECT h AS command_hash, count(*) AS n, count(DISTINCT (sensor, session_id)) AS sessions, count(DISTINCT source.ip) AS addresses, min(ts) AS a, max(ts) AS b, CASE WHEN count(*) FILTER (classification = 'confidential') > 0 THEN 'confidential' WHEN count(*) FILTER (classification = 'public') = count(*) THEN 'public' END AS classification,
        CASE WHEN count(DISTINCT sensor) = 1 THEN min(sensor) END AS sensor FROM {CMD} GROUP BY 1)
        SELECT c.command_hash, sha256(trim(regexp_replace(command_line, '\s+', ' ', 'g'))) AS full_hash, coalesce(intent, 'unknown') AS intent, CAST(coalesce(confidence, 5) AS INTEGER) AS confidence, greatest(occurrence_count, coalesce(n, 0)) AS occurrence_count, coalesce(sessions, 0) AS sessions, coalesce(addresses, 0) AS addresses,
        least(first_seen, a) AS first_seen, greatest(last_seen, b) AS last_seen, CAST(coalesce(len({_EX['ip']}), 0) + coalesce(len({_DOMAINS}), 0) + coalesce(len({_EX['url']}), 0) + coalesce(len({_EX['hash']}), 0) + coalesce(len({_EX['file']}), 0) AS INTEGER) AS indicators,
        concat_ws(',', {', '.join(f"CASE WHEN {v} THEN '{k}' END" for k, v in _PRED.items())}) AS fires, shape.hash AS shape_hash, e.classification, e.sensor FROM commands c LEFT JOIN e USING (command_hash)""",
    "ioc_validity": r"""SELECT kind, count(*) AS values, count(*) FILTER (CASE kind WHEN 'ip' THEN regexp_full_match(v, '\d{1,3}(\.\d{1,3}){3}') AND len(list_filter(string_split(v, '.'), lambda o: TRY_CAST(o AS INTEGER) > 255)) = 0 AND NOT regexp_matches(v, '^(10|127|192\.168|169\.254|0)\.')
        WHEN 'hash' THEN regexp_full_match(v, '[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}') WHEN 'domain' THEN regexp_full_match(v, '[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}') WHEN 'url' THEN regexp_matches(v, '^[a-z]+://[^/]+') ELSE v LIKE '/%' END) AS valid
        FROM (SELECT DISTINCT i.ioc_kind AS kind, i.ioc_value AS v FROM (SELECT unnest(indicators) AS i FROM commands)) GROUP BY 1""",
    "predicates_backfill": "SELECT command_hash, " + ", ".join(f"coalesce(predicates.{next(s for s, o in STORED.items() if o == k)}, {v}) AS {k}" if k in STORED.values() else f"{v} AS {k}" for k, v in _PRED.items())
    + ", array_to_string(list_sort(coalesce(list_filter(predicates.arch_tokens, lambda x: x IS NOT NULL), list_filter([" + ", ".join(rf"CASE WHEN regexp_matches(lower(command_line), '\b{a}\b') THEN '{a}' END" for a in X.ARCHITECTURES) + "], lambda x: x IS NOT NULL))), ',') AS architectures, predicates IS NULL AS was_missing FROM commands",
    "cache_state": """WITH n AS (SELECT model, llm_config_hash AS l, embed_config_hash AS m FROM enrichment_cache QUALIFY row_number() OVER (PARTITION BY model ORDER BY enriched_at DESC, llm_config_hash DESC NULLS LAST, embed_config_hash DESC NULLS LAST) = 1),
        h AS (SELECT command_hash, model, bool_or(llm_config_hash IS NOT DISTINCT FROM l) AS text, bool_or(llm_config_hash IS NOT DISTINCT FROM l AND embed_config_hash IS NOT DISTINCT FROM m) AS ok FROM enrichment_cache JOIN n USING (model) GROUP BY 1, 2)
        SELECT model, CASE WHEN ok THEN 'cached' WHEN text THEN 'embed' ELSE 'enrich' END AS todo, count(*) AS commands FROM (SELECT command_hash, model FROM commands, n) LEFT JOIN h USING (command_hash, model) GROUP BY 1, 2""",
    "reference_centroids": f"""SELECT doc_type, run_id, centroids, usable FROM (SELECT doc_type, run_id, max(created_at) AS t, count(*) AS centroids, count(*) FILTER ({_C96}) AS usable FROM session_clusters GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY doc_type ORDER BY t DESC, run_id DESC) = 1""",
    "prune_runs": """WITH c AS (SELECT * FROM session_clusters WHERE doc_type <> 'reference_centroid' AND run_id IS NOT NULL), k AS (SELECT run_id FROM c GROUP BY 1 ORDER BY max(created_at) DESC, run_id DESC LIMIT 5) SELECT cluster_id, run_id FROM c WHERE run_id NOT IN (SELECT run_id FROM k)""",
    "external_match": f"""WITH s AS (SELECT {_UID} AS uid, embedding::DOUBLE[] AS e FROM {SESS} WHERE {_U96} AND NOT coalesce(cluster.is_outlier, false)), c AS (SELECT cluster_id, centroid::DOUBLE[] AS v FROM session_clusters WHERE {_C96} AND playbook_name IS NOT NULL),
        b AS (SELECT uid, cluster_id, list_cosine_similarity(e, v) AS cos FROM s, c QUALIFY row_number() OVER (PARTITION BY uid ORDER BY round(list_cosine_similarity(e, v), 12) DESC, cluster_id) = 1)
        SELECT uid, cluster_id AS external_id, round(cos, 5) AS cosine, round(1 - greatest(cos, 0), 5) AS novelty FROM b""",
    "playbook_centroids": f"""WITH c AS (SELECT playbook_id, greatest(coalesce(n_sessions, 1), 1)::DOUBLE AS w, list_transform(centroid, lambda x: x::DOUBLE / sqrt(list_dot_product(centroid::DOUBLE[], centroid::DOUBLE[]))) AS u FROM session_clusters WHERE {_C96} AND playbook_id IS NOT NULL),
        s AS (SELECT playbook_id, p AS pos, sum(w * u[p + 1]) AS v FROM c, range(96) r(p) GROUP BY 1, 2) SELECT playbook_id, CAST(pos AS INTEGER) AS pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY playbook_id)), 5) + 0 AS value FROM s""",
    "indicator_coverage": f"""WITH s AS (SELECT {_UID} AS uid, playbook_id, command_set FROM {SESS} WHERE playbook_id IS NOT NULL), z AS (SELECT playbook_id, count(*) AS z FROM s GROUP BY 1), i AS (SELECT command_hash AS h, i.ioc_kind || ':' || i.ioc_value AS indicator FROM (SELECT command_hash, unnest(indicators) AS i FROM commands)),
        u AS (SELECT DISTINCT uid, playbook_id, indicator FROM (SELECT uid, playbook_id, unnest(command_set) AS h FROM s) JOIN i USING (h)), n AS (SELECT playbook_id, indicator, count(*) AS sessions FROM u GROUP BY 1, 2)
        SELECT playbook_id, indicator, sessions, CAST(row_number() OVER (PARTITION BY playbook_id ORDER BY sessions DESC, indicator) AS INTEGER) AS rank, round(sessions / z, 6) AS coverage FROM n JOIN z USING (playbook_id) QUALIFY rank <= 5""",
    "text_artifacts": rf"""WITH a AS (SELECT command_hash, unnest(list_concat(list_transform(list_filter({_EX['url']}, lambda u: u LIKE 'http%'), lambda u: 'url:' || u),
        list_transform(list_distinct(list_transform(regexp_extract_all(command_line, '((?:ssh-(?:rsa|dss|ed25519)|ecdsa-[a-z0-9-]+)\s+[A-Za-z0-9+/]{{40,}}=*)', 1), lambda k: regexp_extract(k, '^(\S+)', 1) || ' ' || substr(regexp_extract(k, '\s+(\S+)$', 1), 1, 32))), lambda k: 'ssh_key:' || k),
        list_transform({_EX['hash']}, lambda x: 'hash:' || x))) AS artifact FROM commands WHERE command_line IS NOT NULL) SELECT artifact, count(DISTINCT command_hash) AS commands, min(command_hash) AS first FROM a GROUP BY 1""",
    "neighbourhood": f"""WITH e AS MATERIALIZED (SELECT * FROM {_EDGES}), st AS (SELECT source.ip AS node FROM {SESS} WHERE source.ip IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
        o AS (SELECT e.* FROM e JOIN st ON src = node QUALIFY row_number() OVER (PARTITION BY kind ORDER BY weight DESC, src, dst) <= 50), t AS (SELECT e.* FROM e WHERE src IN (SELECT dst FROM o) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY weight DESC, src, dst) <= 50)
        SELECT kind, src, dst, weight, CAST(min(hop) AS INTEGER) AS hop, src || '->' || dst AS edge_id FROM (SELECT *, 1 AS hop FROM o UNION ALL SELECT *, 2 FROM t) GROUP BY 1, 2, 3, 4""",
    "distinctive_commands": f"""WITH s AS (SELECT {_UID} AS uid, playbook_id, command_set FROM {SESS} WHERE playbook_id IS NOT NULL), p AS (SELECT playbook_id, h AS command_hash, count(DISTINCT uid) AS sessions FROM (SELECT uid, playbook_id, unnest(command_set) AS h FROM s) WHERE h IS NOT NULL GROUP BY 1, 2),
        t AS (SELECT count(DISTINCT playbook_id) AS c FROM s), d AS (SELECT command_hash, count(*) AS df FROM p GROUP BY 1), x AS (SELECT p.*, round(CASE WHEN c <= 1 THEN 0 ELSE greatest(least(ln(c / df) / ln(c), 1), 0) END, 3) AS specificity FROM p JOIN d USING (command_hash), t)
        SELECT playbook_id, command_hash, sessions, specificity, CAST(row_number() OVER (PARTITION BY playbook_id ORDER BY specificity DESC, sessions DESC, command_hash) AS INTEGER) AS rank FROM x QUALIFY rank <= 3""",
    "discovery": f"""SELECT *, 'find-' || substr(sha256(kind || ':' || value), 1, 16) AS finding_id FROM (SELECT 'new_entity' AS kind, entity || ':' || id AS value, score FROM ({TRACK['new_entities']}) UNION ALL SELECT 'behaviour_shift', source_ip, round(js, 5) FROM ({TRACK['behaviour_shift']})
        UNION ALL SELECT 'outlier_burst', artifact, score FROM ({TRACK['artifact_burst']}) UNION ALL SELECT 'campaign_convergence', a || '|' || b, score FROM ({TRACK['campaign_convergence']})
        UNION ALL SELECT 'operation_emergence', operation_id || ':' || event, round(ln(1 + shared_addresses), 6) FROM ({TRACK['operation_emergence']}))""",
    "hunt_preview": f"SELECT sensor, session_id, started_at, count(*) OVER () AS total FROM {SESS} WHERE login_fail_count >= 2 AND command_count >= 5 ORDER BY started_at DESC, sensor, session_id LIMIT 10",
    "finding_detail": f"""WITH s AS (SELECT * FROM {SESS} WHERE playbook_id IS NOT NULL) SELECT playbook_id, n.sessions, c.commands, a.addresses FROM (SELECT playbook_id, count(*) AS sessions FROM s GROUP BY 1) n
        LEFT JOIN {_TOPS.format(what='commands', k=5, n="SELECT playbook_id, v, count(*) AS n FROM (SELECT playbook_id, unnest(list_distinct(command_set)) AS v FROM s) WHERE v IS NOT NULL GROUP BY 1, 2")} c USING (playbook_id)
        LEFT JOIN {_TOPS.format(what='addresses', k=3, n="SELECT playbook_id, source.ip AS v, count(*) AS n FROM s WHERE source.ip IS NOT NULL GROUP BY 1, 2")} a USING (playbook_id)""",
    "asn_addresses": f"""WITH s AS (SELECT source.ip AS source_ip, source.asn.number AS asn, playbook_id FROM {SESS} WHERE source.ip IS NOT NULL AND source.asn.number IS NOT NULL), n AS (SELECT asn, source_ip, count(*) AS sessions, CAST(row_number() OVER (PARTITION BY asn ORDER BY count(*) DESC, source_ip) AS INTEGER) AS rank FROM s GROUP BY 1, 2 QUALIFY rank <= 10),
        m AS (SELECT asn, source_ip, playbook_id FROM s WHERE playbook_id IS NOT NULL GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY asn, source_ip ORDER BY count(*) DESC, playbook_id) = 1) SELECT n.*, playbook_id FROM n LEFT JOIN m USING (asn, source_ip)""",
    "playbook_names": "SELECT playbook_id, coalesce(first(playbook_name ORDER BY created_at DESC, cluster_id DESC) FILTER (playbook_name IS NOT NULL), playbook_id) AS name, count(*) AS clusters FROM session_clusters WHERE playbook_id IS NOT NULL GROUP BY 1",
    "pairwise_jaccard": f"""WITH s AS (SELECT {_UID} AS uid, playbook_id, list_distinct(list_filter(command_set, lambda x: x IS NOT NULL)) AS hs FROM {SESS} WHERE playbook_id IS NOT NULL), k AS (SELECT * FROM s WHERE len(hs) > 0), n AS (SELECT playbook_id, count(*) AS sessions FROM k GROUP BY 1),
        j AS (SELECT x.playbook_id, avg(len(list_intersect(x.hs, y.hs)) / (len(x.hs) + len(y.hs) - len(list_intersect(x.hs, y.hs)))) AS m FROM k x JOIN k y ON x.playbook_id = y.playbook_id AND x.uid < y.uid GROUP BY 1) SELECT playbook_id, sessions, round(m, 6) AS mean_jaccard FROM n LEFT JOIN j USING (playbook_id)""",
    "novelty_holdout": """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings WHERE embedding IS NOT NULL), c AS (SELECT label, list(v ORDER BY p) AS v FROM (SELECT label, p, avg(u[p + 1]) AS v FROM e, range(64) r(p) GROUP BY 1, 2) GROUP BY 1),
        k AS (SELECT vec_id, e.label AS own, c.label AS other, list_cosine_similarity(u, v) AS cos FROM e, c), h AS (SELECT held.label AS held, vec_id, own, round(1 - greatest(max(cos), 0), 6) AS nov FROM k JOIN (SELECT label FROM c) held ON other <> held.label GROUP BY 1, 2, 3),
        r AS (SELECT held, own = held AS mine, rank() OVER (PARTITION BY held ORDER BY nov) + (count(*) OVER (PARTITION BY held, nov) - 1) / 2 AS r FROM h)
        SELECT held AS label, round((sum(r) FILTER (mine) - count(*) FILTER (mine) * (count(*) FILTER (mine) + 1) / 2) / (count(*) FILTER (mine) * count(*) FILTER (NOT mine)), 5) AS auc FROM r GROUP BY 1""",
}


def _facet_sql() -> str:
    parts = []
    for facet in FACETS:
        cond = " AND ".join(["true", *[f"{k} = '{v}'" for k, v in FACETS.items() if v is not None and k != facet]])
        parts.append(f"SELECT '{facet}' AS facet, {facet} AS value, count(*) AS n FROM b WHERE {cond} GROUP BY 2")
    return " UNION ALL ".join(parts)


def _layouts_sql() -> str:
    from .commands import SQL as COMMANDS

    return f"""WITH sib AS (SELECT command_hash, string_agg(sibling, ' ' ORDER BY rank) AS w FROM ({COMMANDS['cooccurrence_tfidf']}) GROUP BY 1), f AS (SELECT command_hash, nullif(command_line, '') AS c, nullif(concat_ws(' | ', 'intent: ' || intent, 'confidence: ' || CAST(confidence AS VARCHAR)), '') AS f, w FROM commands LEFT JOIN sib USING (command_hash) WHERE command_line IS NOT NULL)
        SELECT command_hash, sha256(concat_ws(chr(10), f, c)) AS facts_first, sha256(concat_ws(chr(10), c, f)) AS command_first, sha256(concat_ws(chr(10), concat_ws(chr(10), f, c), 'with: ' || w)) AS with_siblings FROM f"""


def _five_sql() -> str:
    from .findings import _F

    return f"""WITH {_F}, n AS (SELECT source.ip AS source_ip, count(*) AS n FROM {SESS} WHERE source.ip IS NOT NULL GROUP BY 1), b AS (SELECT kind, sensor, CASE WHEN score < 0.5 THEN 'low' WHEN score < 1.5 THEN 'mid' ELSE 'high' END AS band,
        CASE WHEN date_diff('day', started_at::DATE, (SELECT max(started_at) FROM f)::DATE) <= 1 THEN 'day' WHEN date_diff('day', started_at::DATE, (SELECT max(started_at) FROM f)::DATE) <= 7 THEN 'week' ELSE 'older' END AS age,
        CASE WHEN coalesce(n, 0) < 5 THEN 'few' WHEN n < 25 THEN 'some' ELSE 'many' END AS size FROM f LEFT JOIN n USING (source_ip)) {_facet_sql()}"""


SQL |= {"five_facets": _five_sql(), "embed_layouts": _layouts_sql()}
