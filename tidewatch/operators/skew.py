"""Per-key results over unevenly filled keys: fragment and replicate by estimated load.

The load of every key is counted with map-side combining.  Keys that alone
exceed a fraction of one task's fair share are cut into shards in proportion to their
load; all other keys fall into hash bins.  Shards and bins are packed on tasks,
largest first.  Rows travel once, straight to their task; the matching side is
copied only to the tasks that hold shards of its key.

Size bounds: at most `tasks * HEAVY_PER_TASK` keys can be heavy, and there are
`tasks * BINS_PER_TASK` bins, so both placement tables are bounded by the number
of tasks, whatever the data.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_PER_TASK = 4
BINS_PER_TASK = 16


@dataclass(frozen=True)
class Placement:
    """Where rows go: `shards` maps a heavy key to its tasks, `bins` a hash bin to its task."""

    tasks: int
    total: int
    shards: dict
    bins: list[int]
    task_load: list[float]


def default_tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _bin(key: Column, bins: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bins)).cast("int")


def pack(loads: list[tuple[float, object]], tasks: int) -> tuple[list[tuple[object, int]], list[float]]:
    """Longest-processing-time packing; ties broken by position, so the result is fixed."""
    heap = [(0.0, t) for t in range(tasks)]
    out = []
    for load, item in sorted(loads, key=lambda x: -x[0]):
        held, t = heapq.heappop(heap)
        out.append((item, t))
        heapq.heappush(heap, (held + load, t))
    load = [0.0] * tasks
    for held, t in heap:
        load[t] = held
    return out, load


def plan_placement(df: DataFrame, key: str, tasks: int | None = None) -> Placement:
    """Estimate loads per key of `df` and place keys on tasks.

    Null keys count as one key.  An empty table gives a placement without heavy keys.
    """
    tasks = tasks or default_tasks(df)
    n_bins = tasks * BINS_PER_TASK
    counts = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("b", _bin(F.col("k"), n_bins))
    by_bin = {r.b: r.n for r in counts.groupBy("b").agg(F.sum("n").alias("n")).collect()}
    total = sum(by_bin.values())
    heavy = []
    if total:
        heavy = counts.filter(F.col("n") > total / (tasks * HEAVY_PER_TASK)).orderBy(F.desc("n"), "k").collect()
    pieces: list[tuple[float, object]] = []
    fair = max(total / tasks, 1.0)
    for r in heavy:
        by_bin[r.b] -= r.n
        shards = min(tasks, max(1, -(-int(r.n * 2) // int(fair))))
        pieces += [(r.n / shards, ("key", r.k, i)) for i in range(shards)]
    pieces += [(float(by_bin.get(b, 0)), ("bin", b, 0)) for b in range(n_bins)]
    placed, load = pack(pieces, tasks)
    shards: dict = {}
    bins = [0] * n_bins
    for (kind, item, i), t in placed:
        if kind == "bin":
            bins[item] = t
        else:
            shards.setdefault(item, {})[i] = t
    return Placement(tasks, total, {k: [x[i] for i in sorted(x)] for k, x in shards.items()}, bins, load)


def _placed(df: DataFrame, key: str, p: Placement) -> DataFrame:
    """Adds `__tasks` (tasks of a heavy key, else null) and `__bin_task`."""
    spark = df.sparkSession
    dtype = df.schema[key].dataType.simpleString()
    heavy = spark.createDataFrame([(k, t) for k, t in p.shards.items()], f"__k {dtype}, __tasks array<int>")
    bins = spark.createDataFrame(list(enumerate(p.bins)), "__b int, __bin_task int")
    return (
        df.withColumn("__b", _bin(F.col(key), len(p.bins)))
        .join(F.broadcast(bins), "__b", "left")
        .join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("__k")), "left")
        .drop("__b", "__k")
    )


def fragment(df: DataFrame, key: str, spread: list[str], p: Placement) -> DataFrame:
    """Send each row to its task.  Rows equal in `spread` stay together, also within a heavy key."""
    at = F.pmod(F.xxhash64(*spread), F.size("__tasks")).cast("int") + 1
    return (
        _placed(df, key, p)
        .withColumn("__task", F.when(F.col("__tasks").isNotNull(), F.element_at("__tasks", at)).otherwise(F.col("__bin_task")))
        .drop("__tasks", "__bin_task")
        .repartitionById(p.tasks, F.col("__task"))
    )


def replicate(df: DataFrame, key: str, p: Placement) -> DataFrame:
    """Copy each row to every task that holds a shard of its key, and nowhere else."""
    return (
        _placed(df, key, p)
        .withColumn("__task", F.explode(F.coalesce(F.array_distinct("__tasks"), F.array("__bin_task"))))
        .drop("__tasks", "__bin_task")
        .repartitionById(p.tasks, F.col("__task"))
    )


def balanced_distinct_counts(
    df: DataFrame, key: str, identity: list[str], aggs: dict[str, Column], merge: dict[str, str], tasks: int | None = None
) -> tuple[DataFrame, Placement]:
    """Per `key`: distinct `identity` tuples (column `n`) and aggregates over one row of each.

    `aggs` is evaluated per shard over the distinct rows, `merge` names how the
    shard values combine ("sum", "min", "max").  Repeated identities inside a key
    count once; their attributes are taken by max, so the result doesn't depend
    on row order.  Null keys form one group; an empty table gives no rows.
    """
    p = plan_placement(df, key, tasks)
    attrs = [c for c in df.columns if c not in (key, *identity)]
    rows = fragment(df, key, identity, p)
    distinct = rows.groupBy("__task", key, *identity).agg(F.count(F.lit(1)).alias("__copies"), *[F.max(c).alias(c) for c in attrs])
    partial = distinct.groupBy("__task", key).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in aggs.items()])
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    merged = partial.groupBy(key).agg(F.sum("n").alias("n"), *[how[merge[k]](k).alias(k) for k in aggs])
    return merged, p


def balanced_join(facts: DataFrame, side: DataFrame, key: str, spread: list[str], p: Placement, how: str = "inner") -> DataFrame:
    """Join a skewed `facts` with `side` on `key`, shard by shard (`how`: inner or left)."""
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    return fragment(facts, key, spread, p).join(replicate(side, key, p), ["__task", key], how).drop("__task")
