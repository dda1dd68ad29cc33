"""Connected components on edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


#: Links that one task may join up; counted before, and with more of them the work is distributed.
ONE_TASK = 500_000


def joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, m) from links (u, v): the least node of each node's component, by merging sets."""
    parent: dict = {}

    def root(x):  # noqa: ANN001, ANN202
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    schema = None
    for b in batches:
        schema = b.schema
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for x in (u, v):
                parent.setdefault(x, x)
            a, c = root(u), root(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    if schema is not None:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, schema.field(0).type), pa.array([root(x) for x in nodes], schema.field(0).type)], names=["u", "m"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50, one_task: int | None = None) -> DataFrame:
    """(node, component): component is the least node reachable.

    Alternates star contractions: every node is linked to its least neighbour, large
    stars first, then small ones, until nothing changes.  A hub's links are replaced by links to its least
    neighbour, so no round gathers a hub's neighbourhood into one row.  Each round is written
    to the checkpoint folder.  Up to `one_task` links (ONE_TASK if not given) are joined up in one task instead,
    with the same result.  Self loops give single nodes; null ends are ignored.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    nodes = cut_lineage(e.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    links = cut_lineage(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if links.count() <= (ONE_TASK if one_task is None else one_task):
        kind = links.schema["u"].dataType.simpleString()
        least = links.coalesce(1).mapInArrow(joined_up, f"u {kind}, m {kind}")
        return cut_lineage(nodes.join(least.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("m", "node").alias("component")))
    before = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        down = large.filter("v < u").groupBy("u").agg(F.min("v").alias("m"))
        small = large.filter("v < u").join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("v < u")
        links = cut_lineage(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
