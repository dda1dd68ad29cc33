"""Command layer: normalise, hash, aggregate, annotate, triage and rules (survey A1-A35)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.shell import segments_column, shape_column
from ..session import table
from .common import CMD, SESS, command_events, slim_sessions

PUBLIC_SQL = "CASE WHEN count(*) FILTER (classification = 'confidential') > 0 THEN 'confidential' WHEN count(*) FILTER (classification = 'public') = count(*) THEN 'public' END"


def command_normalize(spark: SparkSession, d: str) -> DataFrame:
    """The stored text (at most COMMAND_CHARS characters), whether it was cut, and the whole command's hash."""
    c = F.col("command_line")
    return table(spark, d, "commands").select("command_hash", X.normalize(c, X.COMMAND_CHARS).alias("normalized"), X.is_cut(c).alias("truncated"), F.sha2(X.normalize(c), 256).alias("full_hash"))


def command_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Per command: events, distinct sessions and addresses, first and last time, classification, the only sensor."""
    return (
        command_events(spark, d)
        .groupBy(F.col("h").alias("command_hash"))
        .agg(
            F.count(F.lit(1)).alias("occurrence_count"),
            F.count_distinct(F.struct("sensor", "session_id")).alias("unique_sessions"),
            F.count_distinct("source.ip").alias("unique_source_ips"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            X.most_restrictive(F.col("classification")).alias("classification"),
            F.when(F.count_distinct("sensor") == 1, F.min("sensor")).alias("sensor"),
        )
    )


def command_merge(spark: SparkSession, d: str) -> DataFrame:
    """Stored counters merged with a batch of events: counts add, times widen."""
    old = table(spark, d, "commands").select("command_hash", F.col("occurrence_count").alias("n0"), F.col("first_seen").alias("f0"), F.col("last_seen").alias("l0"))
    new = command_events(spark, d).groupBy(F.col("h").alias("command_hash")).agg(F.count(F.lit(1)).alias("n1"), F.min("ts").alias("f1"), F.max("ts").alias("l1"))
    return old.join(new, "command_hash", "full").select(
        "command_hash", (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("occurrence_count"), F.least("f0", "f1").alias("first_seen"), F.greatest("l0", "l1").alias("last_seen")
    )


def command_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Commands per shape (values replaced by placeholders), with the shape's hash; empty shapes are left out."""
    s = table(spark, d, "commands").select("command_hash", shape_column(F.col("command_line")).alias("shape"))
    return s.filter(F.col("shape") != "").groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.min("command_hash").alias("example")).withColumn("shape_hash", X.short_hash(F.col("shape")))


def shell_segments(spark: SparkSession, d: str) -> DataFrame:
    """How often each command starts a segment, weighted by occurrences, and its distinct flags."""
    s = table(spark, d, "commands").select("occurrence_count", F.explode(segments_column(F.col("command_line"))).alias("s"))
    return s.groupBy(F.col("s.command").alias("command")).agg(F.sum("occurrence_count").alias("occurrences"), F.count(F.lit(1)).alias("segments"))


def command_iocs(spark: SparkSession, d: str) -> DataFrame:
    """Addresses, domains, URLs, file digests and absolute paths in command lines, one row each."""
    c = F.col("command_line")
    kinds = [("ip", X.ipv4s(c)), ("domain", X.domains(c)), ("url", X.urls(c)), ("hash", X.hashes(c)), ("file", X.paths(c))]

    def typed(kind: str, values: F.Column) -> F.Column:
        return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))

    both = F.concat(*[typed(k, v) for k, v in kinds])
    return table(spark, d, "commands").select("command_hash", F.explode(both).alias("i")).select("command_hash", "i.kind", "i.value")


def indicator_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commands").select("command_hash", F.explode("indicators").alias("i"))
    return c.groupBy(F.col("i.ioc_kind").alias("kind"), F.col("i.ioc_value").alias("value")).agg(F.count_distinct("command_hash").alias("commands"))


def shape_inherit(spark: SparkSession, d: str) -> DataFrame:
    """Intent and confidence of the best parent of each command's shape: most confident, then most frequent."""
    c = table(spark, d, "commands").select("command_hash", "intent", "confidence", "occurrence_count", F.col("shape.hash").alias("sh"), F.col("shape.shape_role").alias("role"))
    w = Window.partitionBy("sh").orderBy(F.desc("confidence"), F.desc("occurrence_count"), "command_hash")
    parent = (
        c.filter((F.col("role") == "parent") & (F.col("confidence") >= 5) & (F.col("intent") != "unknown"))
        .withColumn("r", F.row_number().over(w)).filter("r = 1")
        .select("sh", F.col("command_hash").alias("parent_hash"), F.col("intent").alias("parent_intent"), F.col("confidence").alias("parent_confidence"))
    )
    return c.join(parent, "sh", "left").select("command_hash", "parent_hash", F.coalesce("parent_intent", "intent").alias("intent"), F.coalesce("parent_confidence", "confidence").alias("confidence"))


def shape_siblings(spark: SparkSession, d: str) -> DataFrame:
    """Commands that share a shape with others, and how many others."""
    c = table(spark, d, "commands").select("command_hash", F.col("shape.hash").alias("sh")).filter(F.col("sh").isNotNull())
    n = c.groupBy("sh").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return c.join(n, "sh").select("command_hash", F.col("sh").alias("shape_hash"), (F.col("n") - 1).alias("siblings"))


def embed_text(spark: SparkSession, d: str) -> DataFrame:
    """The text a command is embedded as: known facts first, then the command."""
    c = table(spark, d, "commands")
    prelude = F.concat_ws(" | ", F.concat(F.lit("intent: "), "intent"), F.concat(F.lit("confidence: "), F.col("confidence").cast("string")))
    return c.select("command_hash", F.when(prelude == "", F.col("command_line")).otherwise(F.concat_ws("\n", prelude, "command_line")).alias("embed_text"))


def cooccurrence_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """Per command the three siblings with the highest common sessions * (ln(N + 1) - ln(df + 1))."""
    s = slim_sessions(spark, d, "command_set").select(F.array_sort(F.array_distinct(F.array_compact("command_set"))).alias("cs")).filter(F.size("cs") > 0)
    s = s.groupBy("cs").agg(F.count(F.lit(1)).alias("w"))  # equal sessions are paired once
    n = s.agg(F.sum("w").alias("N"))
    df = s.select("w", F.explode("cs").alias("b")).groupBy("b").agg(F.sum("w").alias("df"))
    tf = s.select("w", "cs", F.explode("cs").alias("a")).select("w", "a", F.explode("cs").alias("b")).filter("a <> b").groupBy("a", "b").agg(F.sum("w").alias("tf"))
    scored = tf.join(df, "b").join(F.broadcast(n)).withColumn("score", F.round(F.col("tf") * (F.log(F.col("N") + 1) - F.log(F.col("df") + 1)), 6))
    w = Window.partitionBy("a").orderBy(F.desc("score"), F.desc("tf"), "b")
    return scored.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select(F.col("a").alias("command_hash"), F.col("b").alias("sibling"), "tf", "df", "score", "rank")


def command_predicates(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("command_line")
    return table(spark, d, "commands").select("command_hash", *[X.predicate(c, k).alias(k) for k in X.PREDICATES], X.appliance_word(c).alias("is_appliance_word"), F.array_join(X.architectures(c), ",").alias("architectures"))


def command_triage(spark: SparkSession, d: str) -> DataFrame:
    """Reasons to look again, in fixed order: enrichment missing, low confidence, long base64 run, address literal, rare domain, novel."""
    c = F.col("command_line")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("intent").isNull(), F.lit("local_failed")),
            F.when(F.col("confidence") <= 4, F.lit("low_confidence<=4")),
            F.when(X.base64_run(c) >= 200, F.lit("base64_blob")),
            F.when(c.rlike(X.IPV4), F.lit("ip_literal")),
            F.when(X.rare_domain(c), F.lit("rare_tld")),
            F.when((F.col("cluster.novelty_score") >= 0.5) & (F.col("confidence") >= 4), F.lit("novel_embedding")),
        )
    )
    return table(spark, d, "commands").select("command_hash", F.array_join(reasons, ",").alias("reasons"), F.size(reasons).alias("n_reasons"))


ESCALATION_BUDGET = 20_000
ESCALATION_RANGES = 64


def escalation_queue(spark: SparkSession, d: str) -> DataFrame:
    """Novel commands of middling confidence, most novel first, while the summed cost stays inside one budget.

    The running sum is global without a global window: ranges of novelty (a score between 0 and 1) are summed
    first, and each range starts from the sum of those before it.
    """
    c = table(spark, d, "commands").filter((F.col("cluster.novelty_score") >= 0.3) & F.col("confidence").between(4, 8))
    cost = c.select("command_hash", "intent", F.col("cluster.novelty_score").alias("novelty"), (10 + F.length("command_line")).cast("long").alias("cost"))
    cost = cost.withColumn("part", F.floor(-F.col("novelty").cast("double") * ESCALATION_RANGES))
    sums = cost.groupBy("part").agg(F.sum("cost").alias("n"))  # a row per range
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"))
    w = Window.partitionBy("part").orderBy(F.desc("novelty"), "command_hash").rowsBetween(Window.unboundedPreceding, 0)
    open_ = before.filter(F.col("before") <= ESCALATION_BUDGET)
    spent = cost.join(open_, "part").withColumn("spent", F.col("before") + F.sum("cost").over(w))
    return spent.filter(F.col("spent") <= ESCALATION_BUDGET).select("command_hash", "intent", "cost", "spent")


def cache_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest enrichment of each hash, and whether its settings are the most recent settings of all."""
    e = table(spark, d, "enrichment_cache")
    last = e.groupBy("command_hash").agg(F.max(F.struct("enriched_at", "config_hash", "model", "llm_config_hash", "embed_config_hash")).alias("x")).select("command_hash", "x.*")
    now = e.filter(F.col("config_hash") != "").agg(F.max(F.struct("enriched_at", "config_hash"))["config_hash"].alias("current"))
    return last.join(F.broadcast(now)).select("command_hash", "model", "enriched_at", (F.coalesce("config_hash", F.lit("")) != F.col("current")).alias("stale"))


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Commands never enriched by the small local model with non-empty settings."""
    hit = table(spark, d, "enrichment_cache").filter((F.col("model") == "local-small") & (F.col("config_hash") != ""))
    return table(spark, d, "commands").select("command_hash").join(hit, "command_hash", "left_anti")


def predicate_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Stored predicate where there is one, else computed."""
    p = F.coalesce(F.col("predicates.has_key_write"), X.predicate(F.col("command_line"), "has_key_write"))
    a = F.coalesce(F.col("predicates.has_c2_launch"), X.predicate(F.col("command_line"), "has_c2_launch"))
    return table(spark, d, "commands").select("command_hash", p.alias("key_write"), a.alias("c2_launch"))


def intent_coerce(spark: SparkSession, d: str) -> DataFrame:
    """Intent inside the closed set; confidence between 1 and 10 (5 if missing), also where it was given as a share: the stored one is checked once as it is and once divided by ten."""
    known = ["cryptomining", "credential_data_access", "ddos_botnet", "install_persistence", "benign_noise", "execute_payload", "download_ingress", "host_recon", "account_manipulation", "defense_evasion"]

    def between(v: F.Column) -> F.Column:
        x = F.coalesce(v.cast("double"), F.lit(5.0))
        return F.greatest(F.least(F.bround(F.when((x > 0) & (x < 1), x * 10).otherwise(x), 0).cast("int"), F.lit(10)), F.lit(1))

    share = F.when(F.col("confidence") < 10, F.col("confidence") / 10)
    return table(spark, d, "commands").select(
        "command_hash", F.when(F.col("intent").isin(known), F.col("intent")).otherwise("unknown").alias("intent"), between(F.col("confidence")).alias("confidence"), between(share).alias("from_share")
    )


RULES = [("r1", "literal", "busybox"), ("r2", "substring", "/dev/shm"), ("r3", "regex", r"authorized_keys|crontab"), ("r4", "literal", "iptables"), ("r5", "regex", r"wget\s+\S*http")]


def _rule(c: F.Column, kind: str, value: str) -> F.Column:
    if kind == "literal":
        return c.rlike(r"(?i)(?:^|\s)" + value + r"(?:\s|$)")
    return F.contains(F.lower(c), F.lit(value.lower())) if kind == "substring" else c.rlike("(?i)" + value)


def rule_hits(spark: SparkSession, d: str) -> DataFrame:
    """Literal (blank-bounded), substring and regex rules over all commands: sorted hits, and hits changed against an empty stamp."""
    c = F.col("command_line")
    hits = F.array_sort(F.array_compact(F.array(*[F.when(_rule(c, k, v), F.lit(i)) for i, k, v in RULES])))
    return table(spark, d, "commands").select("command_hash", F.array_join(hits, ",").alias("hits")).filter("hits <> ''")


def rule_probe(spark: SparkSession, d: str) -> DataFrame:
    """Share of the 500 newest commands each rule matches, and whether that is too many (more than half)."""
    newest = table(spark, d, "commands").orderBy(F.desc("last_seen"), "command_hash").limit(500)
    sums = newest.agg(*[F.avg(_rule(F.col("command_line"), k, v).cast("double")).alias(i) for i, k, v in RULES])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(i).alias("rule_id"), F.round(i, 6).alias("share")) for i, _, _ in RULES])).alias("x")).select("x.*", (F.col("x.share") > 0.5).alias("rejected"))


DICTIONARY = {"curated": ["wget", "curl", "cat", "ls", "rm", "ps", "iptables", "chmod"], "denied": ["echo", "cd"], "brief": ["uname", "free", "uptime", "find", "grep"]}


def grounding_coverage(spark: SparkSession, d: str) -> DataFrame:
    """First words weighted by occurrences: denied before undefined before curated before brief."""
    name = F.regexp_extract(F.lower(F.trim("command_line")), r"^([a-z][a-z0-9_.+-]*)", 1)
    cls = F.when(name.isin(DICTIONARY["denied"]), "denied").when(name.isin(DICTIONARY["curated"]), "curated").when(name.isin(DICTIONARY["brief"]), "brief").otherwise("undefined")
    c = table(spark, d, "commands").select(name.alias("name"), cls.alias("coverage"), "occurrence_count").filter("name <> ''")
    return c.groupBy("coverage").agg(F.count_distinct("name").alias("names"), F.sum("occurrence_count").alias("occurrences"))


QUERIES = {
    f.__name__: f
    for f in (
        command_normalize, command_aggregate, command_merge, command_shapes, shell_segments, command_iocs, indicator_counts, shape_inherit, shape_siblings, embed_text,
        cooccurrence_tfidf, command_predicates, command_triage, escalation_queue, cache_latest, cache_misses, predicate_backfill, intent_coerce, rule_hits, rule_probe, grounding_coverage,
    )
}

_N = r"trim(regexp_replace(command_line, '\s+', ' ', 'g'))"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _match(kind: str, v: str) -> str:
    if kind == "literal":
        return rf"regexp_matches(command_line, '(?i)(?:^|\s){v}(?:\s|$)')"
    return f"contains(lower(command_line), {_lit(v.lower())})" if kind == "substring" else f"regexp_matches(command_line, {_lit('(?i)' + v)})"


_LOW = "lower(command_line)"
#: Digits and dots alone, so that a literal's neighbours are never digits.
_DIGITS, _QUAD = "regexp_replace(command_line, '[^0-9.]', ' ', 'g')", r"'\b(?:\d{1,3}\.){3}\d{1,3}\b'"
#: The predicates in SQL: regular expressions where the plans work on words and tokens.
PREDICATE_SQL = {
    "has_uname_m": rf"regexp_matches({_LOW}, 'uname\s+-m')",
    "has_case_word": f"list_contains(regexp_split_to_array({_LOW}, '[^a-z0-9_]+'), 'case')",
    "has_c2_launch": r"regexp_matches(translate(command_line, '[]', ''), '/\S+\s+\d{1,3}(\.\d{1,3}){3}[ :]\s*\d{2,5}\b')",
    "has_self_spread": rf"len(list_filter(string_split_regex({_LOW}, '[&\n]'), lambda x: regexp_matches(x, '(telnetd|\bnc)\s.*-l'))) > 0 OR regexp_matches({_LOW}, '\bsh\s+-s\s+(telnet|ssh)\b')",
    "has_host_info": rf"len(list_intersect(regexp_extract_all({_LOW}, '\w+'), [{', '.join(map(_lit, X.HOST_WORDS))}])) > 0 OR contains({_LOW}, '/proc/cpuinfo') OR regexp_matches({_LOW}, '\bls\s+/')",
    "has_key_write": f"contains({_LOW}, 'authorized_keys')",
    "has_immutability": rf"regexp_matches({_LOW}, 'chattr\s+[-+]?ia?\b|\blockr\s+-ia\b')",
    "has_directory_chain": rf"regexp_matches({_LOW}, 'cd\s+\S+\s*[|][|]\s*cd\s+\S+\s*[|][|]\s*cd\s+\S')",
    "has_tool_fallback": rf"regexp_matches({_LOW}, 'busybox\s+wget') OR regexp_matches({_LOW}, '(wget|curl)[^|]*[|][|]')",
}
RARE_SQL = (
    rf"len(list_intersect(regexp_extract_all({_LOW}, '://[a-z0-9-]+(?:\.[a-z0-9-]+)*\.([a-z]{{2,24}})\b', 1), [{', '.join(map(_lit, X.RARE_TLDS))}])) > 0 OR len(list_filter(string_split_regex({_LOW}, '[|;&\n]'), lambda s: "
    rf"len(list_intersect(regexp_extract_all(regexp_extract(s, '\b(?:{'|'.join(X.NETWORK_TOOLS)})\b(.*)$', 1), '\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.([a-z]{{2,24}})\b', 1), [{', '.join(map(_lit, X.RARE_TLDS))}])) > 0)) > 0"
)
SQL = {
    "command_normalize": f"SELECT command_hash, substr({_N}, 1, 4000) AS normalized, length({_N}) > 4000 AS truncated, sha256({_N}) AS full_hash FROM commands",
    "command_aggregate": f"""SELECT h AS command_hash, count(*) AS occurrence_count, count(DISTINCT (sensor, session_id)) AS unique_sessions, count(DISTINCT source.ip) AS unique_source_ips,
        min(ts) AS first_seen, max(ts) AS last_seen, {PUBLIC_SQL} AS classification, CASE WHEN count(DISTINCT sensor) = 1 THEN min(sensor) END AS sensor FROM {CMD} GROUP BY 1""",
    "command_merge": f"""SELECT coalesce(o.command_hash, n.command_hash) AS command_hash, coalesce(occurrence_count, 0) + coalesce(n1, 0) AS occurrence_count, least(first_seen, f1) AS first_seen,
        greatest(last_seen, l1) AS last_seen FROM commands o FULL JOIN (SELECT h AS command_hash, count(*) AS n1, min(ts) AS f1, max(ts) AS l1 FROM {CMD} GROUP BY 1) n ON o.command_hash = n.command_hash""",
    "command_iocs": rf"""WITH u AS (SELECT command_hash, regexp_replace(v, '[.,;:]+$', '') AS v FROM (SELECT command_hash, unnest(regexp_extract_all(command_line, {_lit(X.URL)})) AS v FROM commands)),
        h AS (SELECT command_hash, lower(command_line) AS low FROM commands),
        tool AS (SELECT * FROM h WHERE len(list_intersect(regexp_extract_all(low, '[\pL\pN_]+'), [{', '.join(map(_lit, X.DIGEST_WORDS))}])) > 0 OR regexp_matches(low, 'openssl\s+dgst|gpg\s+--print-md'))
        SELECT DISTINCT command_hash, 'ip' AS kind, v AS value FROM (SELECT command_hash, unnest(regexp_extract_all({_DIGITS}, {_QUAD})) AS v FROM commands)
        WHERE len(list_filter(string_split(v, '.'), lambda o: CAST(o AS INTEGER) > 255)) = 0
        UNION ALL SELECT DISTINCT command_hash, 'url', v FROM u
        UNION ALL SELECT DISTINCT command_hash, 'domain', host FROM (SELECT command_hash, lower(string_split(string_split(string_split(v, '://')[2], '/')[1], ':')[1]) AS host FROM u)
        WHERE contains(host, '.') AND NOT regexp_full_match(host, '\d{{1,3}}(\.\d{{1,3}}){{3}}')
        UNION ALL SELECT DISTINCT command_hash, 'file', v FROM (SELECT command_hash, unnest(regexp_extract_all(command_line, '(?:^|[\s|;&`(])(/[A-Za-z0-9._/+-]+)', 1)) AS v FROM commands) WHERE length(v) >= 3
        UNION ALL SELECT DISTINCT command_hash, 'hash', v FROM (SELECT command_hash, unnest(regexp_extract_all(low, '(?:sha256|sha1|md5)[:=]([0-9a-f]{{64}}|[0-9a-f]{{40}}|[0-9a-f]{{32}})\b', 1)) AS v FROM h
        UNION ALL SELECT command_hash, unnest(regexp_extract_all(low, '\b([0-9a-f]{{64}}|[0-9a-f]{{40}}|[0-9a-f]{{32}})\b', 1)) FROM tool)""",
    "indicator_counts": "SELECT i.ioc_kind AS kind, i.ioc_value AS value, count(DISTINCT command_hash) AS commands FROM (SELECT command_hash, unnest(indicators) AS i FROM commands) GROUP BY 1, 2",
    "shape_inherit": """WITH p AS (SELECT shape.hash AS sh, command_hash AS ph, intent AS pi, confidence AS pc FROM commands WHERE shape.shape_role = 'parent' AND confidence >= 5 AND intent <> 'unknown'
        QUALIFY row_number() OVER (PARTITION BY shape.hash ORDER BY confidence DESC, occurrence_count DESC, command_hash) = 1)
        SELECT command_hash, ph AS parent_hash, coalesce(pi, intent) AS intent, coalesce(pc, confidence) AS confidence FROM commands LEFT JOIN p ON shape.hash = sh""",
    "shape_siblings": "SELECT command_hash, shape.hash AS shape_hash, count(*) OVER (PARTITION BY shape.hash) - 1 AS siblings FROM commands WHERE shape.hash IS NOT NULL QUALIFY siblings > 0",
    "embed_text": """SELECT command_hash, CASE WHEN p = '' THEN command_line ELSE concat_ws(chr(10), p, command_line) END AS embed_text FROM
        (SELECT *, concat_ws(' | ', 'intent: ' || intent, 'confidence: ' || CAST(confidence AS VARCHAR)) AS p FROM commands)""",
    "cooccurrence_tfidf": f"""WITH s AS (SELECT row_number() OVER () AS s, list_distinct(list_filter(command_set, lambda x: x IS NOT NULL)) AS cs FROM {SESS} WHERE command_set IS NOT NULL),
        f AS (SELECT s, unnest(cs) AS h FROM s), n AS (SELECT count(DISTINCT s) AS n FROM f), df AS (SELECT h, count(*) AS df FROM f GROUP BY 1),
        tf AS (SELECT x.h AS command_hash, y.h AS sibling, count(*) AS tf FROM f x JOIN f y ON x.s = y.s AND x.h <> y.h GROUP BY 1, 2),
        sc AS (SELECT command_hash, sibling, tf, df, round(tf * (ln(n + 1) - ln(df + 1)), 6) AS score FROM tf JOIN df ON sibling = h, n)
        SELECT *, CAST(row_number() OVER (PARTITION BY command_hash ORDER BY score DESC, tf DESC, sibling) AS INTEGER) AS rank FROM sc QUALIFY rank <= 3""",
    "command_predicates": f"SELECT command_hash, {', '.join(f'coalesce({v}, false) AS {k}' for k, v in PREDICATE_SQL.items())}, "
    + "coalesce(lower(trim(command_line)) IN (" + ", ".join(map(_lit, X.APPLIANCE_WORDS)) + "), false) AS is_appliance_word, "
    + "array_to_string(list_sort(list_filter([" + ", ".join(rf"CASE WHEN regexp_matches(lower(command_line), '\b{a}\b') THEN '{a}' END" for a in X.ARCHITECTURES) + "], lambda x: x IS NOT NULL)), ',') AS architectures FROM commands",
    "command_triage": rf"""SELECT command_hash, array_to_string(r, ',') AS reasons, CAST(len(r) AS INTEGER) AS n_reasons FROM (SELECT command_hash, list_filter([CASE WHEN intent IS NULL THEN 'local_failed' END,
        CASE WHEN confidence <= 4 THEN 'low_confidence<=4' END,
        CASE WHEN list_max(list_transform(list_filter(regexp_extract_all(command_line, '[A-Za-z0-9+/=]{{40,}}'), lambda r: regexp_matches(r, '[A-Z]') AND regexp_matches(r, '[a-z]') AND regexp_matches(r, '[0-9]')), lambda r: length(r))) >= 200 THEN 'base64_blob' END,
        CASE WHEN len(regexp_extract_all({_DIGITS}, {_QUAD})) > 0 THEN 'ip_literal' END,
        CASE WHEN {RARE_SQL} THEN 'rare_tld' END,
        CASE WHEN cluster.novelty_score >= 0.5 AND confidence >= 4 THEN 'novel_embedding' END], lambda x: x IS NOT NULL) AS r FROM commands)""",
    "escalation_queue": """SELECT command_hash, intent, cost, spent FROM (SELECT command_hash, intent, CAST(10 + length(command_line) AS BIGINT) AS cost,
        CAST(sum(10 + length(command_line)) OVER (ORDER BY cluster.novelty_score DESC, command_hash ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent
        FROM commands WHERE cluster.novelty_score >= 0.3 AND confidence BETWEEN 4 AND 8) WHERE spent <= 20000""",
    "cache_latest": """WITH cur AS (SELECT config_hash AS c FROM enrichment_cache WHERE config_hash <> '' ORDER BY enriched_at DESC, config_hash DESC LIMIT 1)
        SELECT command_hash, model, enriched_at, coalesce(config_hash, '') <> c AS stale FROM (SELECT * FROM enrichment_cache
        QUALIFY row_number() OVER (PARTITION BY command_hash ORDER BY enriched_at DESC, config_hash DESC, model DESC) = 1), cur""",
    "cache_misses": "SELECT command_hash FROM commands c WHERE NOT EXISTS (SELECT 1 FROM enrichment_cache e WHERE e.command_hash = c.command_hash AND model = 'local-small' AND config_hash <> '')",
    "predicate_backfill": f"""SELECT command_hash, coalesce(predicates.has_key_write, {PREDICATE_SQL['has_key_write']}, false) AS key_write,
        coalesce(predicates.has_c2_launch, {PREDICATE_SQL['has_c2_launch']}, false) AS c2_launch FROM commands""",
    "intent_coerce": """SELECT command_hash, CASE WHEN intent IN ('cryptomining', 'credential_data_access', 'ddos_botnet', 'install_persistence', 'benign_noise', 'execute_payload', 'download_ingress',
        'host_recon', 'account_manipulation', 'defense_evasion') THEN intent ELSE 'unknown' END AS intent, CAST(greatest(least(coalesce(confidence, 5), 10), 1) AS INTEGER) AS confidence,
        CAST(CASE WHEN confidence IS NULL OR confidence >= 10 THEN 5 ELSE greatest(confidence, 1) END AS INTEGER) AS from_share FROM commands""",
    "rule_hits": "SELECT command_hash, hits FROM (SELECT command_hash, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {_match(k, v)} THEN '{i}' END" for i, k, v in RULES)
    + "], lambda x: x IS NOT NULL)), ',') AS hits FROM commands) WHERE hits <> ''",
    "rule_probe": "WITH n AS (SELECT * FROM commands ORDER BY last_seen DESC, command_hash LIMIT 500) "
    + " UNION ALL ".join(f"SELECT '{i}' AS rule_id, round(avg(CAST({_match(k, v)} AS INTEGER)), 6) AS share, avg(CAST({_match(k, v)} AS INTEGER)) > 0.5 AS rejected FROM n" for i, k, v in RULES),
    "grounding_coverage": r"""SELECT CASE WHEN name IN ('echo', 'cd') THEN 'denied' WHEN name IN ('wget', 'curl', 'cat', 'ls', 'rm', 'ps', 'iptables', 'chmod') THEN 'curated'
        WHEN name IN ('uname', 'free', 'uptime', 'find', 'grep') THEN 'brief' ELSE 'undefined' END AS coverage, count(DISTINCT name) AS names, CAST(sum(occurrence_count) AS BIGINT) AS occurrences
        FROM (SELECT regexp_extract(lower(trim(command_line)), '^([a-z][a-z0-9_.+-]*)', 1) AS name, occurrence_count FROM commands) WHERE name <> '' GROUP BY 1""",
}
