"""Nearest prototype of every vector, for prototype tables of bounded size, and means of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prototypes held by a task at once; a larger table takes several passes over the vectors.
BLOCK = 20_000


def usable(vec: Column, dim: int) -> Column:
    """Not null, `dim` finite numbers and not all zero."""
    v = F.when(F.size(vec) == dim, vec)
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def mean_vectors(df: DataFrame, key: str, vec: str, unit: bool = False) -> DataFrame:
    """(key, pos, value): mean of each key's vectors (of unit vectors if `unit`).

    Each Arrow batch is summed per key first, so what moves is one row per key and batch.  Vectors
    must be of one length and usable; null keys form a group of their own.
    """
    ktype = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"))
            if unit:
                n = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(n > 0, n, 1)
            coded = b.column("k").dictionary_encode(null_encoding="encode")
            at = coded.indices.to_numpy()
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            sums = np.add.reduceat(x[order], starts, axis=0)
            counts = np.diff(np.append(starts, len(order)))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(at[order][starts])), pa.array(list(sums), pa.list_(pa.float64())), pa.array(counts, pa.int64())], names=["k", "s", "n"])

    part = df.select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v")).mapInArrow(run, f"k {ktype}, s array<double>, n bigint")
    flat = part.select("k", "n", F.posexplode("s").alias("pos", "x")).groupBy("k", "pos").agg((F.sum("x") / F.sum("n")).alias("value"))
    return flat.select(F.col("k").alias(key), "pos", "value")


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long number lists as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit_distance(a: Column, b: Column) -> Column:
    """Distance of the unit vector of `a` to `b`, row by row."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        p, q = np.stack(x.to_list()).astype(float), np.stack(y.to_list()).astype(float)
        n = np.linalg.norm(p, axis=1, keepdims=True)
        return pd.Series(np.linalg.norm(p / np.where(n > 0, n, 1) - q, axis=1), index=x.index)

    return run(a, b)


def weighted_sums(df: DataFrame, keys: list[str], weight: str, vec: str) -> DataFrame:
    """(keys..., vec): unit vector of the weighted sum of each key's unit vectors.  Keys are strings.

    Rows are brought together by key and sorted, then summed run by run, carrying a run over a batch's end.
    """
    schema = ", ".join(f"`{k}` string" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(ks: list, xs: list) -> pa.RecordBatch:
            x = np.stack(xs)
            n = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(n > 0, n, 1)
            return pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in ks], pa.string()) for i in range(len(keys))], pa.array(list(x), pa.list_(pa.float64()))], names=[*keys, "vec"])

        held, total = None, None
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"))
            n = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(n > 0, n, 1) * b.column("w").to_numpy()[:, None]
            ks = list(zip(*[b.column(k).to_pylist() for k in keys], strict=True))
            starts = [i for i in range(len(ks)) if i == 0 or ks[i] != ks[i - 1]]
            sums = np.add.reduceat(x, starts, axis=0)
            out_k, out_x = [], []
            for i, s in zip(starts, sums, strict=True):
                if ks[i] == held:
                    total = total + s
                    continue
                if held is not None:
                    out_k.append(held)
                    out_x.append(total)
                held, total = ks[i], s
            if out_k:
                yield emit(out_k, out_x)
        if held is not None:
            yield emit([held], [total])

    rows = df.select(*keys, F.col(weight).alias("w"), F.col(vec).cast("array<double>").alias("v")).repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, f"{schema}, vec array<double>")


def as_arrays(means: DataFrame, key: str) -> DataFrame:
    """(key, vec) from (key, pos, value): the positions are the vector's dimensions, so a row is bounded."""
    return means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("p")).select(key, F.col("p.value").alias("vec"))


def similar_pairs(df: DataFrame, key: str, vec: str, least: float, digits: int = 6, block: int = 4_096) -> DataFrame:
    """(src, dst) of all ordered pairs, a row with itself too, whose cosine rounded to `digits` is at least `least`.

    Every block of rows meets every other, so no row has a limit on its partners.  Vectors must be of one length and usable.
    """
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(vec).cast("array<double>").alias("v")).filter("k is not null")
    blocks = max(1, -(-rows.count() // block))
    mine = rows.withColumn("mine", F.pmod(F.xxhash64("k"), F.lit(blocks)))
    every = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = every.select(F.col("mine").alias("x"), F.col("other").alias("y"), F.lit(True).alias("left"), "k", "v").unionByName(every.select(F.col("other").alias("x"), F.col("mine").alias("y"), F.lit(False).alias("left"), "k", "v"))

    def run(t: pa.Table) -> pa.Table:
        x = matrix(t["v"].combine_chunks())
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(n > 0, n, 1)
        names, left = np.asarray(t["k"].to_pylist(), object), t["left"].to_numpy()
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        src, dst = [names[:0]], [names[:0]]
        for i in range(0, len(a), 1024):
            at, to = np.nonzero(np.round(x[a[i : i + 1024]] @ x[b].T, digits) >= least)
            src.append(names[a[i + at]])
            dst.append(names[b[to]])
        return pa.table({"src": pa.array(np.concatenate(src), pa.string()), "dst": pa.array(np.concatenate(dst), pa.string())})

    return met.groupBy("x", "y").applyInArrow(run, "src string, dst string")


def nearest(df: DataFrame, vec: str, prototypes: DataFrame, key: str, pvec: str, out: str = "nearest", ordered: int | None = 1, floor: float = -2.0) -> DataFrame:
    """Adds `out`: array of the `ordered` best (label, cosine) by descending cosine, ties to the smaller label; empty without prototypes.

    Cosines are at least `floor`; `ordered=None` gives all of these.  A zero vector has cosine 0 with
    everything.  Prototypes are held BLOCK at a time; more of them take more passes, whose lists are merged.
    """
    schema = "array<struct<label:string,cosine:double>>"
    protos = prototypes.select(F.col(key).cast("string").alias("k"), F.col(pvec).cast("array<double>").alias("v")).filter("k is not null and v is not null")
    head = protos.limit(BLOCK + 1).toPandas()
    blocks = 1 if len(head) <= BLOCK else -(-protos.count() // BLOCK) * 2  # by hash, so some are larger than others
    lists = []
    for i in range(blocks):
        rows = head if blocks == 1 else protos.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == i).toPandas()
        if len(rows):
            lists.append(_best(df, vec, rows.sort_values("k"), schema, ordered, floor))
    if not lists:
        return df.withColumn(out, F.array().cast(schema))
    if len(lists) == 1:
        return df.withColumn(out, lists[0])

    def before(a: Column, b: Column) -> Column:
        x, y = F.round(a["cosine"], 12), F.round(b["cosine"], 12)
        return F.when(x > y, -1).when(x < y, 1).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0)

    merged = F.array_sort(F.concat(*lists), before)
    return df.withColumn(out, F.slice(merged, 1, ordered) if ordered else merged)


def _best(df: DataFrame, vec: str, rows: pd.DataFrame, schema: str, ordered: int | None, floor: float) -> Column:
    names = rows["k"].to_numpy()
    p = np.stack([np.asarray(v, float) for v in rows["v"]])
    n = np.linalg.norm(p, axis=1, keepdims=True)
    shared = df.sparkSession.sparkContext.broadcast((names, p / np.where(n > 0, n, 1)))  # at most a block

    @F.pandas_udf(schema)
    def run(v: pd.Series) -> pd.Series:
        names, p = shared.value
        x = np.stack([np.asarray(a, float) for a in v]) if len(v) else np.empty((0, p.shape[1]))
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(n > 0, n, 1)
        out = []
        for i in range(0, len(x), 256):
            s = x[i : i + 256] @ p.T
            key = -np.round(s, 12)
            if ordered == 1:
                out += [[{"label": names[j], "cosine": float(row[j])}] if row[j] >= floor else [] for row, j in zip(s, key.argmin(axis=1), strict=True)]
                continue
            for row, k in zip(s, key, strict=True):
                at = np.flatnonzero(row >= floor)
                if ordered and ordered < len(at):  # all that reach the last place, then in order
                    at = at[k[at] <= np.partition(k[at], ordered - 1)[ordered - 1]]
                out.append([{"label": names[j], "cosine": float(row[j])} for j in at[np.argsort(k[at], kind="stable")][: ordered or None]])
        return pd.Series(out, index=v.index, dtype=object)

    return run(F.col(vec))
