"""Distances and weights between sets, distributions and vectors, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity; two empty sets are equal (1)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """Unit vector of doubles; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts; 0 for an empty one."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(-F.aggregate(counts, F.lit(0.0), lambda s, x: s + F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0)), F.lit(0.0))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance (base 2, square root) of two maps of counts: both empty 0, one empty 1."""
    def total(m: Column) -> Column:
        return F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)

    tp, tq = total(p), total(q)

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    both = F.map_zip_with(p, q, lambda k, x, y: F.struct((F.coalesce(x, F.lit(0)) / tp).alias("x"), (F.coalesce(y, F.lit(0)) / tq).alias("y")))
    js = F.aggregate(F.map_values(both), F.lit(0.0), lambda s, v: s + part(v["x"], (v["x"] + v["y"]) / 2) / 2 + part(v["y"], (v["x"] + v["y"]) / 2) / 2)
    return F.when((tp == 0) & (tq == 0), 0.0).when((tp == 0) | (tq == 0), 1.0).otherwise(F.sqrt(F.greatest(js, F.lit(0.0))))


def idf(n: Column, df: Column) -> Column:
    return F.log(n + 1) - F.log(df + 1)


def pool_weight(occurrences: Column) -> Column:
    """Rarity weight of a command: ln(100001 / (clamp(occurrences, 1, 1e5) + 1)), at least 1e-4."""
    clamped = F.greatest(F.least(F.coalesce(occurrences.cast("double"), F.lit(1.0)), F.lit(1e5)), F.lit(1.0))
    return F.greatest(F.log(F.lit(100001.0) / (clamped + 1)), F.lit(1e-4))


def log_scaled(x: Column, top: float) -> Column:
    return F.least(F.greatest(F.log1p(F.coalesce(x.cast("double"), F.lit(0.0))) / F.log1p(F.lit(float(top))), F.lit(0.0)), F.lit(1.0))


def min_max(x: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.5))
