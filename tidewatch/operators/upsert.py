"""Table upkeep without a merge statement: upsert, preserve, tombstone.  Each gives the new table; the caller swaps it in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = (), insert_defaults: dict | None = None) -> DataFrame:
    """Rows of `new` replace rows of `old` with the same key; columns in `keep` stay as `old` has them.

    Key columns must not be null.  Where `old` has no value for a kept column, `new`'s (or the default) is taken.
    """
    o = old.select(*[F.col(c).alias(f"__o_{c}") for c in old.columns])
    cond = [F.col(k) == F.col(f"__o_{k}") for k in keys]
    defaults = insert_defaults or {}
    have = set(new.columns)
    both = new.join(o, cond, "left")
    cols = []
    for c in old.columns:
        fresh = F.col(c) if c in have else F.lit(defaults.get(c)).cast(old.schema[c].dataType)
        cols.append((F.coalesce(F.col(f"__o_{c}"), fresh) if c in keep else fresh).alias(c))
    return both.select(*cols).unionByName(old.join(new.select(*keys), keys, "left_anti").select(*old.columns))


def tombstone(rows: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is alive; everything stays if nothing is alive, which rather means that the producer failed."""
    some = live.select(F.lit(True).alias("__some")).limit(1)
    marked = rows.join(live.select(*keys).distinct().withColumn("__live", F.lit(True)), keys, "left").join(F.broadcast(some), how="left")  # at most one row
    return marked.filter(F.col("__live") | F.col("__some").isNull()).drop("__live", "__some")
