"""The relational algebra the rest is made of, on the star-schema tables (survey Q1-Q33, 2.14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.upsert import upsert
from ..session import table


def filter_project(spark: SparkSession, d: str) -> DataFrame:
    """Equality, list, range, null and boolean composition, pushed to the scan."""
    o = table(spark, d, "orders")
    c = F.col
    keep = c("o_orderstatus").isin("F", "O") & ((c("o_totalprice") >= 100000) | (c("o_orderpriority") == "1-URGENT")) & c("o_custkey").isNotNull() & ~(c("o_totalprice") < 1000)
    return o.filter(keep).select("o_orderkey", "o_custkey", "o_orderstatus")


def text_filters(spark: SparkSession, d: str) -> DataFrame:
    """Prefix, case-insensitive substring and token match over part names."""
    p = table(spark, d, "part")
    n = F.lower("p_name")
    toks = F.split(n, r"\s+")
    score = F.array_contains(toks, "green").cast("int") * 2 + F.array_contains(toks, "blue").cast("int") + n.startswith("s").cast("int")
    return p.filter(n.contains("e")).select("p_partkey", score.alias("score")).filter("score > 0")


def group_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Ten suppliers with the most line items (ties by key), with distinct orders and filtered counts."""
    li = table(spark, d, "lineitem")
    g = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("orders"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    return g.filter("n >= 2").orderBy(F.desc("n"), "l_suppkey").limit(10)


def nested_group(spark: SparkSession, d: str) -> DataFrame:
    """Three commonest ship months inside each return flag, groups of at least five."""
    li = table(spark, d, "lineitem").groupBy("l_returnflag", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("n"), "month")
    return li.withColumn("rank", F.row_number().over(w)).filter("rank <= 3")


def metrics(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.min("l_quantity").alias("min_q"), F.max("l_quantity").alias("max_q"), F.round(F.avg("l_quantity"), 6).alias("avg_q"), F.count("l_quantity").alias("n"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.percentile("l_extendedprice", 0.5), 4).alias("median_price"),
    )


def range_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Orders per price band; empty bands appear with 0."""
    bands = spark.createDataFrame([("low",), ("mid",), ("high",), ("huge",)], "band string")
    p = F.col("o_totalprice")
    n = table(spark, d, "orders").groupBy(F.when(p < 50000, "low").when(p < 200000, "mid").when(p < 1000000, "high").otherwise("huge").alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return bands.join(F.broadcast(n), "band", "left").select("band", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def date_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Events per type and day over the whole month, zeros filled."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    axis = e.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    grid = e.select("event_type").distinct().join(F.broadcast(axis))  # at most the days of the axis
    n = e.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["event_type", "day"], "left").select("event_type", "day", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def missing_bucket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.coalesce(F.lower("lang"), F.lit("missing")).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def top_hits(spark: SparkSession, d: str) -> DataFrame:
    """Two dearest orders of every customer."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(w)).filter("rank <= 2").select("o_custkey", "o_orderkey", "o_totalprice", "rank")


def latest_child(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("latest_order"), F.count(F.lit(1)).alias("orders"))


def nested_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Indicators exploded and grouped; parents counted once."""
    c = table(spark, d, "commands").select("command_hash", "intent", F.explode("indicators").alias("i"))
    return c.groupBy("i.ioc_kind", F.coalesce("intent", F.lit("none")).alias("intent")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("command_hash").alias("commands"))


def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders with customer, nation and region; sizes decide how the joins run."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """Customers with and without orders, per nation."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    with_, without = c.join(o, c.c_custkey == o.o_custkey, "left_semi"), c.join(o, c.c_custkey == o.o_custkey, "left_anti")
    return with_.select("c_nationkey", F.lit("with").alias("kind")).unionByName(without.select("c_nationkey", F.lit("without").alias("kind"))).groupBy("c_nationkey", "kind").agg(F.count(F.lit(1)).alias("n"))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Nations of customers only, of suppliers only, and of both."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).select(F.lit("both").alias("side"), "k").unionByName(c.exceptAll(c.intersectAll(s)).distinct().join(s, "k", "left_anti").select(F.lit("customer").alias("side"), "k")).unionByName(s.subtract(c).select(F.lit("supplier").alias("side"), "k"))


def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    """Old orders overwritten by later ones of the same key; the comment-like status survives."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    old = o.filter(F.col("o_orderdate") < "1998-01-01").withColumn("o_totalprice", F.lit(0.0)).withColumn("o_orderstatus", F.lit("X"))
    new = o.filter(F.col("o_orderdate") >= "1997-01-01")
    return upsert(old, new, ["o_orderkey"], ["o_orderstatus"])


def update_where(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.when(F.col("c_acctbal") < 0, 0.0).otherwise(F.col("c_acctbal")).alias("balance"))


def page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").orderBy("p_retailprice", "p_partkey").offset(40).limit(20).select("p_partkey", "p_retailprice")


def asof_last_error(spark: SparkSession, d: str) -> DataFrame:
    """Every purchase with the user's last error before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "error"))
    last = F.last(F.when(F.col("event_type") == "error", F.col("event_id")), ignorenulls=True).over(w)
    return e.select("event_id", "user_id", "event_type", last.alias("last_error")).filter("event_type = 'purchase'").drop("event_type")


def first_after(spark: SparkSession, d: str) -> DataFrame:
    """First purchase at or after the user's first signup."""
    e = table(spark, d, "events")
    s = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("signed"))
    p = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    f = s.join(p, "user_id").filter("ts >= signed").groupBy("user_id").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("purchase"))
    return s.join(f, "user_id", "left").select("user_id", "signed", "purchase")


def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events cut into sessions at gaps over 30 minutes per user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", F.col("ts").cast("timestamp").alias("t"))
    gap = (F.unix_micros("t") - F.unix_micros(F.lag("t").over(w)) > 30 * 60_000_000).cast("int")
    e = e.withColumn("new", F.coalesce(gap, F.lit(1))).withColumn("i", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "i").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))


def event_json(spark: SparkSession, d: str) -> DataFrame:
    """Typed JSON field; null where the JSON is bad."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").groupBy("event_type", (k % 10).alias("k10")).agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"))


def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("y", F.year("l_shipdate"))
    return li.rollup("l_returnflag", "y").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


def running_windows(spark: SparkSession, d: str) -> DataFrame:
    """Running count, three-row moving mean, rank and lag per user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events")
    return e.select("event_id", F.count(F.lit(1)).over(w).alias("seen"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("moving"), F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("value_rank"), F.lag("event_type").over(w).alias("before"))


def item_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Parts bought by one customer more than once, in distinct orders."""
    o, li = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return o.join(li, o.o_orderkey == li.l_orderkey).groupBy("o_custkey", "l_partkey").agg(F.count_distinct("o_orderkey").alias("orders")).filter("orders > 1")


QUERIES = {
    f.__name__: f
    for f in (
        filter_project, text_filters, group_top_k, nested_group, metrics, range_buckets, date_histogram, missing_bucket, top_hits, latest_child, nested_aggregate, lookup_join, semi_anti, set_operations, upsert_rows,
        update_where, page, asof_last_error, first_after, gap_sessions, event_json, grouping_sets, running_windows, item_cooccurrence,
    )
}

SQL = {
    "filter_project": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') AND (o_totalprice >= 100000 OR o_orderpriority = '1-URGENT') AND o_custkey IS NOT NULL AND NOT o_totalprice < 1000",
    "text_filters": r"""WITH t AS (SELECT p_partkey, lower(p_name) AS n, regexp_split_to_array(lower(p_name), '\s+') AS w FROM part WHERE contains(lower(p_name), 'e')),
        s AS (SELECT p_partkey, CAST(list_contains(w, 'green') AS INTEGER) * 2 + CAST(list_contains(w, 'blue') AS INTEGER) + CAST(starts_with(n, 's') AS INTEGER) AS score FROM t) SELECT * FROM s WHERE score > 0""",
    "group_top_k": "SELECT l_suppkey, count(*) AS n, count(DISTINCT l_orderkey) AS orders, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, l_suppkey LIMIT 10",
    "nested_group": """SELECT l_returnflag, month, n, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, month) AS INTEGER) AS rank FROM (SELECT l_returnflag, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 5) QUALIFY rank <= 3""",
    "metrics": """SELECT l_returnflag, l_linestatus, min(l_quantity) AS min_q, max(l_quantity) AS max_q, round(avg(l_quantity), 6) AS avg_q, count(l_quantity) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
        round(quantile_cont(l_extendedprice, 0.5), 4) AS median_price FROM lineitem GROUP BY 1, 2""",
    "range_buckets": """SELECT band, coalesce(n, 0) AS n FROM (SELECT unnest(['low', 'mid', 'high', 'huge']) AS band) LEFT JOIN (SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' WHEN o_totalprice < 1000000 THEN 'high' ELSE 'huge' END AS band, count(*) AS n FROM orders GROUP BY 1) USING (band)""",
    "date_histogram": """WITH a AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events), g AS (SELECT t.event_type, CAST(x.day AS DATE) AS day FROM (SELECT DISTINCT event_type FROM events) t, (SELECT unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM a) x)
        SELECT g.event_type, g.day, count(e.event_id) AS n FROM g LEFT JOIN events e ON e.event_type = g.event_type AND CAST(e.ts AS DATE) = g.day GROUP BY 1, 2""",
    "missing_bucket": "SELECT coalesce(lower(lang), 'missing') AS lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1",
    "top_hits": "SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 2",
    "latest_child": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_order, count(*) AS orders FROM orders GROUP BY 1",
    "nested_aggregate": "SELECT i.ioc_kind AS ioc_kind, coalesce(intent, 'none') AS intent, count(*) AS n, count(DISTINCT command_hash) AS commands FROM (SELECT command_hash, intent, unnest(indicators) AS i FROM commands) GROUP BY 1, 2",
    "lookup_join": "SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "semi_anti": "SELECT c_nationkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'with' ELSE 'without' END AS kind, count(*) AS n FROM customer GROUP BY 1, 2",
    "set_operations": """SELECT CASE WHEN c AND s THEN 'both' WHEN c THEN 'customer' ELSE 'supplier' END AS side, k FROM (SELECT k, bool_or(t = 'c') AS c, bool_or(t = 's') AS s FROM (SELECT c_nationkey AS k, 'c' AS t FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier) GROUP BY 1)""",
    "upsert_rows": """SELECT o_orderkey, CASE WHEN o_orderdate < '1998-01-01' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderdate >= '1997-01-01' THEN o_totalprice ELSE 0 END AS o_totalprice, o_orderdate FROM orders""",
    "update_where": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS balance FROM customer",
    "page": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 20 OFFSET 40",
    "asof_last_error": """SELECT event_id, user_id, last_error FROM (SELECT *, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_error
        FROM events WHERE event_type IN ('purchase', 'error')) WHERE event_type = 'purchase'""",
    "first_after": """WITH s AS (SELECT user_id, min(ts) AS signed FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT s.user_id, any_value(signed) AS signed, arg_min(event_id, (ts, event_id)) AS purchase FROM s
        LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON p.user_id = s.user_id AND ts >= signed GROUP BY 1""",
    "gap_sessions": """WITH g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events),
        s AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS i FROM g)
        SELECT user_id, i, count(*) AS events, min(ts) AS started, max(ts) AS ended, count(*) FILTER (event_type = 'purchase') AS purchases FROM s GROUP BY 1, 2""",
    "event_json": "SELECT event_type, k % 10 AS k10, count(*) AS n, CAST(sum(k) AS BIGINT) AS k_sum FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1, 2",
    "grouping_sets": "SELECT l_returnflag, y, CAST(grouping(l_returnflag, y) AS INTEGER) AS level, count(*) AS n, round(sum(l_quantity), 2) AS q FROM (SELECT *, CAST(year(l_shipdate) AS INTEGER) AS y FROM lineitem) GROUP BY ROLLUP (l_returnflag, y)",
    "running_windows": """SELECT event_id, count(*) OVER w AS seen, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving,
        CAST(rank() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS value_rank, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "item_cooccurrence": "SELECT o_custkey, l_partkey, count(DISTINCT o_orderkey) AS orders FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2 HAVING count(DISTINCT o_orderkey) > 1",
}
