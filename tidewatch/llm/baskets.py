"""Problem 3: how often two items occur in one basket, and how far that exceeds chance.

Baskets are deduplicated, sorted item arrays; equal baskets are collapsed into
one with a weight.  Pairs are enumerated once per distinct basket and weighted
counts summed with map-side combining, so a basket held by a third of all sessions costs
no more than a rare one.

Defined cases: null arrays, null elements and repeated elements are ignored; a
basket without items doesn't count in n; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

MIN_COUNT = 5
MIN_SUPPORT = 0.0015
MIN_LIFT = 3
#: Item counts are broadcast only up to this many frequent items; beyond it they are joined by shuffle.
BROADCAST_ITEMS = 20_000


def collapse_baskets(baskets: DataFrame, items: str) -> DataFrame:
    """(basket, weight): distinct sorted item sets with the number of rows that hold them."""
    clean = F.array_sort(F.array_distinct(F.array_compact(F.col(items))))
    return baskets.select(clean.alias("basket")).filter(F.size("basket") > 0).groupBy("basket").agg(F.count(F.lit(1)).alias("weight"))


def item_counts(collapsed: DataFrame) -> DataFrame:
    return collapsed.select(F.explode("basket").alias("item"), "weight").groupBy("item").agg(F.sum("weight").alias("n_item"))


def pair_counts(collapsed: DataFrame) -> DataFrame:
    """(a, b, n_ab) with a < b, each distinct basket enumerated once."""
    first = collapsed.filter(F.size("basket") > 1).select("basket", "weight", F.posexplode("basket").alias("i", "a"))
    rest = F.slice("basket", F.col("i") + 2, F.greatest(F.size("basket") - F.col("i") - 1, F.lit(0)))
    return first.select("a", "weight", F.explode(rest).alias("b")).groupBy("a", "b").agg(F.sum("weight").alias("n_ab"))


def keep_items(collapsed: DataFrame, items: DataFrame) -> DataFrame:
    """Baskets cut down to `items` and collapsed again; lossless for pairs of such items."""
    kept = (
        collapsed.withColumn("row", F.monotonically_increasing_id())
        .select("row", "weight", F.explode("basket").alias("item"))
        .join(items.select("item"), "item", "left_semi")
        .groupBy("row", "weight")
        .agg(F.array_sort(F.collect_list("item")).alias("basket"))
    )
    return kept.groupBy("basket").agg(F.sum("weight").alias("weight"))


def keep_few_items(collapsed: DataFrame, items: list[str]) -> DataFrame:
    """As keep_items, inside each row: for at most BROADCAST_ITEMS items, given to the tasks as one row."""
    spark = collapsed.sparkSession
    allowed = spark.createDataFrame([(sorted(items),)], "allowed array<string>")
    return (
        collapsed.join(F.broadcast(allowed))  # one row of bounded size
        .select(F.array_intersect("basket", "allowed").alias("basket"), "weight")
        .filter(F.size("basket") > 0)
        .groupBy("basket")
        .agg(F.sum("weight").alias("weight"))
    )


def score(pairs: DataFrame, counts: DataFrame, n: int, small: bool) -> DataFrame:
    """Adds n_a, n_b, lift and conviction (of a -> b; null where b always follows a)."""
    hint = F.broadcast if small else (lambda x: x)
    ca = counts.select(F.col("item").alias("a"), F.col("n_item").alias("n_a"))
    cb = counts.select(F.col("item").alias("b"), F.col("n_item").alias("n_b"))
    out = pairs.join(hint(ca), "a").join(hint(cb), "b").withColumn("n", F.lit(n).cast("long"))
    return out.withColumn("lift", F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).withColumn(
        "conviction", F.when(F.col("n_ab") < F.col("n_a"), (1 - F.col("n_b") / F.col("n")) / (1 - F.col("n_ab") / F.col("n_a")))
    )


def associated_pairs(baskets: DataFrame, items: str, min_count: int = 1, min_support: float = 0.0) -> DataFrame:
    """Pairs with n_ab >= min_count and >= min_support * n, with n_a, n_b, n, lift and conviction.

    An item of a qualifying pair itself has that count, so rarer items are left
    out before pairs are enumerated; nothing that qualifies is lost.
    """
    collapsed = collapse_baskets(baskets, items)
    n = collapsed.agg(F.sum("weight")).first()[0] or 0
    floor = max(min_count, min_support * n)
    counts = item_counts(collapsed).filter(F.col("n_item") >= floor)
    small = False
    if floor > 1:
        head = [(r.item, r.n_item) for r in counts.limit(BROADCAST_ITEMS + 1).collect()]
        small = len(head) <= BROADCAST_ITEMS
        if small:
            counts = baskets.sparkSession.createDataFrame(head, "item string, n_item bigint")
            collapsed = keep_few_items(collapsed, [x for x, _ in head])
        else:
            collapsed = keep_items(collapsed, counts)
    pairs = pair_counts(collapsed).filter(F.col("n_ab") >= floor)
    return score(pairs, counts, n, small)


def session_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command set of every distinct session, from its latest rollup."""
    return (
        table(spark, sf_dir, "sessions_rollup")
        .filter(F.col("command_set").isNotNull())
        .groupBy("sensor", "session_id")
        .agg(F.max(F.struct("rolled_up_at", "command_set"))["command_set"].alias("command_set"))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command pairs that are together often, and at least three times as often as chance."""
    pairs = associated_pairs(session_baskets(spark, sf_dir), "command_set", MIN_COUNT, MIN_SUPPORT)
    return pairs.filter(F.col("n_ab") * F.col("n") >= MIN_LIFT * F.col("n_a") * F.col("n_b")).select(F.col("a").alias("hash_a"), F.col("b").alias("hash_b"))


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of commands with its common sessions, lift and conviction."""
    out = associated_pairs(session_baskets(spark, sf_dir), "command_set")
    return out.select(F.col("a").alias("hash_a"), F.col("b").alias("hash_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("conviction", 6).alias("conviction"))


QUERIES = {"p3_found": p3_found, "p3_pairs": p3_pairs}

_PAIRS = """WITH latest AS (SELECT arg_max(command_set, rolled_up_at) AS cs FROM sessions_rollup WHERE command_set IS NOT NULL GROUP BY sensor, session_id),
  baskets AS (SELECT row_number() OVER () AS s, list_distinct(list_filter(cs, lambda x: x IS NOT NULL)) AS b FROM latest),
  flat AS (SELECT s, unnest(b) AS item FROM baskets WHERE len(b) > 0),
  total AS (SELECT count(DISTINCT s) AS n FROM flat),
  one AS (SELECT item, count(*) AS n_item FROM flat GROUP BY 1),
  two AS (SELECT x.item AS hash_a, y.item AS hash_b, count(*) AS n_ab FROM flat x JOIN flat y ON x.s = y.s AND x.item < y.item GROUP BY 1, 2),
  scored AS (SELECT hash_a, hash_b, n_ab, a.n_item AS n_a, b.n_item AS n_b, n FROM two JOIN one a ON a.item = hash_a JOIN one b ON b.item = hash_b, total)"""
SQL = {
    "p3_found": f"{_PAIRS} SELECT hash_a, hash_b FROM scored WHERE n_ab >= 5 AND n_ab >= 0.0015 * n AND n_ab * n >= 3 * n_a * n_b",
    "p3_pairs": f"""{_PAIRS} SELECT hash_a, hash_b, n_ab, n_a, n_b, round(n_ab * n / (n_a * n_b), 6) AS lift,
        CASE WHEN n_ab < n_a THEN round((1 - n_b / n) / (1 - n_ab / n_a), 6) END AS conviction FROM scored""",
}
