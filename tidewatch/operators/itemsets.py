"""Frequent and closed itemsets, level by level over distinct (owner, item) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

#: Items per word of a bit field, and words a row may have: more frequent items than fit are an error.
WORD, WORDS = 62, 128


def _bit(no: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (no % WORD).cast("int"))


def _has(words: list[str], no: Column) -> Column:
    word = F.get(F.array(*words), F.floor(no / WORD).cast("int"))
    return F.call_function("shiftright", word, (no % WORD).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def frequent_itemsets(pairs: DataFrame, owner: str, item: str, min_count: int, max_size: int = 6) -> DataFrame:
    """(items, size, support, first_owner, closed) of sets of two to max_size items that at least min_count owners hold.

    Owners and sets are bit fields over the frequent items, so rows stay small.  Owners with the same frequent items are
    collapsed to one weighted basket first.  Every level extends the baskets' frequent sets by a later item, so only
    sets whose beginnings are frequent are ever counted.  A set is closed if its owners have no other item in
    common: their baskets are intersected while they are counted, so closedness doesn't depend on max_size.
    Null owners or items are ignored.  More than WORD * WORDS frequent items are an error: min_count is too low then.
    """
    p = pairs.select(F.col(owner).alias("o"), F.col(item).alias("i")).filter("o is not null and i is not null").distinct()
    often = p.groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count).select("i")
    # Numbered in order; at most WORD * WORDS rows, or an error follows.
    numbered = cut_lineage(often.select("i", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("i")) - 1).alias("no")))
    n = numbered.count()
    if n > WORD * WORDS:
        raise ValueError(f"{n} frequent items; at most {WORD * WORDS} are mined together")
    k = max(1, -(-n // WORD))
    held, chosen = [f"b{x}" for x in range(k)], [f"s{x}" for x in range(k)]

    def only(no: Column, x: int, otherwise: Column) -> Column:
        return F.when(F.floor(no / WORD) == x, _bit(no)).otherwise(otherwise)

    zero = F.lit(0).cast("long")
    fields = p.join(F.broadcast(numbered), "i").groupBy("o").agg(F.count(F.lit(1)).alias("z"), *[F.sum(only(F.col("no"), x, zero)).alias(b) for x, b in enumerate(held)]).filter("z > 1")
    baskets = cut_lineage(fields.groupBy(*held).agg(F.count(F.lit(1)).alias("w"), F.min("o").alias("first")))
    every = F.sequence(F.lit(0), F.lit(max(n - 1, 0)))
    level = baskets.select("*", F.explode(F.filter(every, lambda j: _has(held, j))).alias("last"))
    level = level.select(*held, "w", "first", "last", *[only(F.col("last"), x, zero).alias(s) for x, s in enumerate(chosen)])
    out = None
    for size in range(2, max_size + 1):
        later = F.when(F.col("last") < n - 1, F.filter(F.sequence(F.col("last") + 1, F.lit(max(n - 1, 0))), lambda j: _has(held, j)))
        wider = level.select(*held, "w", "first", *chosen, F.explode(later).alias("last"))
        wider = wider.select(*held, "w", "first", "last", *[F.col(s).bitwiseOR(only(F.col("last"), x, zero)).alias(s) for x, s in enumerate(chosen)])
        kept = wider.groupBy(*chosen).agg(F.sum("w").alias("support"), F.min("first").alias("first_owner"), *[F.bit_and(b).alias(b) for b in held]).filter(F.col("support") >= min_count)
        shared = sum((F.bit_count(b) for b in held), F.lit(0))
        found = cut_lineage(kept.select(*chosen, F.lit(size).alias("size"), "support", "first_owner", (shared == size).alias("closed")))
        out = found if out is None else out.unionByName(found)
        if size < max_size:
            if not found.take(1):
                break
            level = wider.join(found.select(*chosen), chosen, "left_semi").select(*held, "w", "first", "last", *chosen)
    names = numbered.agg(F.array_sort(F.collect_list(F.struct("no", "i"))).alias("x")).select(F.col("x.i").alias("names"))  # one row
    items = F.transform(F.filter(every, lambda j: _has(chosen, j)), lambda j: F.get(F.col("names"), j))
    return out.join(F.broadcast(names)).select(items.alias("items"), "size", "support", "first_owner", "closed")


def closed_itemsets(sets: DataFrame) -> DataFrame:
    """Itemsets of frequent_itemsets() whose owners share no further item."""
    return sets.filter("closed").drop("closed")
