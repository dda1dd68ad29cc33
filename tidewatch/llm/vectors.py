"""Problem 5: the k most similar vectors for every vector, by randomly rotated one-bit codes.

Vectors are normalised, rotated at random (seeded) and put into the cells of a
coarse k-means, which is fitted on a bounded sample; every vector is indexed.
Relative to its cell's centre a vector is stored as one sign bit per dimension
with two correction scalars (distance to the centre, and how well the code fits).
A query looks at all codes of its own cell, in which each vector is also entered
from its next nearest cells.  Inner products are estimated from the packed bits
and a query quantised to four bits; the estimate's error bound decides which
candidates are reranked with exact similarities.  Cells hold the neighbours of at least SURE;
records with fewer than k of these are compared with all records, in blocks.

Skew: cells are fitted in proportion to density; a cell expected to exceed
SHARD_ROWS is cut into query and data shards, and the shards' best lists merged.  Exact
copies of a vector are indexed once and answer for each other.

Defined cases: a vector is usable if it is not null, has DIM numbers, all finite,
and is not all zero; others are left out.  Ties go to the smaller
key.  Fewer than k usable records give shorter lists; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, table

DIM = 96
K = 5
#: The coarse cells are fitted on at most this many vectors.
FIT_ROWS = 65_536
FIT_ROWS_PER_CELL = 48
MAX_CELLS = 8_192
PROBES = 3
SHARD_ROWS = 8_192
#: Width of the estimate's error bound, in standard deviations.
EPSILON = 1.9
SEED = 5
QUERY_BITS = 4
#: Similarity from which cells are relied upon to hold the neighbours.
SURE = 0.8
COPIES_IN_MEMORY = 20_000


def usable(vec: Column, dim: int = DIM) -> Column:
    v = F.when(F.size(vec) == dim, vec)
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def vector_table(df: DataFrame, kind: str, key: str, vec: str) -> DataFrame:
    """(kind, key, vec) of the usable vectors."""
    return df.filter(F.col(key).isNotNull() & usable(F.col(vec))).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(vec).cast("array<float>").alias("vec"))


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """An Arrow column of float lists, as unit rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)
    # Scaling by the largest entry first keeps tiny or huge vectors from vanishing or overflowing.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed(x: np.ndarray) -> pa.Array:
    """Rows of fixed width as an Arrow binary column."""
    x = np.ascontiguousarray(x)
    width = x.nbytes // len(x) if len(x) else 0
    offsets = (np.arange(len(x) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def unpacked(column: pa.ChunkedArray | pa.Array, dtype: type, width: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [np.frombuffer(b"".join(c.to_pylist()), dtype=dtype).reshape(-1, width) for c in chunks]
    return np.concatenate(parts) if parts else np.empty((0, width), dtype)


def rotation(dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def kmeans(x: np.ndarray, cells: int, rounds: int = 6, seed: int = SEED) -> np.ndarray:
    """Plain k-means from random rows, so dense regions get cells in proportion; an emptied cell keeps its centre."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(cells, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        full = n > 0
        sums = np.add.reduceat(x[order], starts[full], axis=0) if len(x) else c[:0]
        c[full] = sums / n[full, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, m: int) -> np.ndarray:
    """Indices of the m nearest centres, nearest first."""
    m = min(m, len(c))
    half = (c * c).sum(axis=1) / 2
    out = np.empty((len(x), m), np.int32)
    step = max(1, 4_000_000 // max(1, len(c)))
    for i in range(0, len(x), step):
        d = half - x[i : i + step] @ c.T
        if m == 1:
            out[i : i + step, 0] = d.argmin(axis=1)
        else:
            p = np.argpartition(d, m - 1, axis=1)[:, :m] if m < len(c) else np.tile(np.arange(len(c)), (len(d), 1))
            out[i : i + step] = np.take_along_axis(p, np.take_along_axis(d, p, 1).argsort(axis=1, kind="stable"), 1)
    return out


@dataclass
class Cells:
    """Coarse cells of one kind of record: centres (rotated space) and the shards a cell is cut into."""

    centres: np.ndarray
    shards: np.ndarray
    first_group: np.ndarray

    @property
    def split(self) -> bool:
        return bool((self.shards > 1).any())


def fit_cells(vectors: DataFrame, kinds: list[str], rot: np.ndarray) -> dict[str, Cells]:
    """Cells per kind, on a bounded sample chosen by hash; expected cell sizes come from the same sample."""
    n_of = {r.kind: r.n for r in vectors.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {}
    for kind in kinds:
        n = n_of.get(kind, 0)
        if not n:
            continue
        cells = int(min(MAX_CELLS, max(1, n**0.5))) if n > 2_000 else 1
        want = min(FIT_ROWS, max(cells * FIT_ROWS_PER_CELL, 1))
        # The least hashes, so the sample doesn't depend on how rows are partitioned.
        h = F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1 << 30))
        rows = vectors.filter(F.col("kind") == kind)
        some = rows.filter(h < int((1 << 30) * min(1.0, 2 * want / n + 1e-3)))

        def fit(batches: Iterator[pa.RecordBatch], cells: int = cells) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                x = unit_rows(pa.Table.from_batches(held)["vec"]) @ rot
                centres = kmeans(x, cells)
                # A cell holds its own vectors and those entered from the cells next to it.
                share = np.bincount(nearest(x, centres, PROBES).ravel(), minlength=len(centres)) / len(x)
                yield pa.RecordBatch.from_arrays([packed(centres.astype(np.float32)), pa.array(share)], names=["centre", "share"])

        # In a task, so the driver gets the centres alone.
        for source in (some, rows):
            got = source.orderBy(h, "key").limit(want).select("vec").mapInArrow(fit, "centre binary, share double").toArrow()
            if len(got):
                break
        centres, share = unpacked(got["centre"], np.float32, DIM), got["share"].to_numpy()
        shards = np.maximum(1, np.ceil(share * n / SHARD_ROWS)).astype(np.int64)
        groups = shards * shards
        out[kind] = Cells(centres, shards, np.concatenate([[0], np.cumsum(groups)[:-1]]))
    return out


def codes_of(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits (two 64-bit words), distance to the centre, and the code's fit to the residual's direction."""
    norm = np.linalg.norm(residual, axis=1)
    unit = residual / np.maximum(norm, 1e-12)[:, None]
    bits = np.zeros((len(unit), 128), bool)
    bits[:, : unit.shape[1]] = unit > 0
    fit = np.abs(unit).sum(axis=1) / np.sqrt(unit.shape[1])
    return np.packbits(bits, axis=1).view(np.uint64), norm.astype(np.float32), np.maximum(fit, 1e-3).astype(np.float32)


@dataclass
class CodeSet:
    words: np.ndarray
    norm: np.ndarray
    fit: np.ndarray

    def bounds(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosine of each query (row) with each stored vector, and the estimate's error bound."""
        dim = residual.shape[1]
        qn = np.linalg.norm(residual, axis=1)
        q = residual / np.maximum(qn, 1e-12)[:, None]
        lo = q.min(axis=1)
        step = np.maximum((q.max(axis=1) - lo) / (2**QUERY_BITS - 1), 1e-12)
        u = np.rint((q - lo[:, None]) / step[:, None]).astype(np.uint8)
        acc = np.zeros((len(q), len(self.words)), np.uint16)
        for j in range(QUERY_BITS):
            plane = np.zeros((len(q), 128), bool)
            plane[:, :dim] = (u >> j) & 1
            w = np.packbits(plane, axis=1).view(np.uint64)
            for k in range(2):
                acc += np.bitwise_count(w[:, k, None] & self.words[None, :, k]).astype(np.uint16) << j
        ones = np.bitwise_count(self.words).sum(axis=1).astype(np.float32)
        total = (lo * dim + step * u.sum(axis=1))[:, None]
        dot = (2 * (lo[:, None] * ones[None, :] + step[:, None] * acc) - total) / np.sqrt(dim)
        est = dot / self.fit[None, :]
        rr = qn[:, None] * self.norm[None, :]
        cos = 1 - (qn[:, None] ** 2 + self.norm[None, :] ** 2) / 2 + rr * est
        err = rr * (EPSILON / np.sqrt(dim - 1) * np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit)[None, :] + 1e-5
        return cos.astype(np.float32), err.astype(np.float32)


def best_of(queries: np.ndarray, q_keys: np.ndarray, data: np.ndarray, d_keys: np.ndarray, codes: CodeSet, centre: np.ndarray, k: int, floor: float) -> tuple[list, list, list]:
    """Top k of `data` for each query: bounds pick the candidates, exact similarities rank them."""
    order = np.argsort(d_keys, kind="stable")
    data, d_keys = data[order], d_keys[order]
    codes = CodeSet(codes.words[order], codes.norm[order], codes.fit[order])
    at = np.searchsorted(d_keys, q_keys)
    own = (at < len(d_keys)) & (d_keys[np.minimum(at, len(d_keys) - 1)] == q_keys)
    qs, ds, sims = [], [], []
    block = max(1, 1_000_000 // max(1, len(data)))
    for i in range(0, len(queries), block):
        q = queries[i : i + block]
        cos, err = codes.bounds(q - centre)
        rows = np.arange(len(q))
        mine = own[i : i + block]
        low = cos - err
        low[rows[mine], at[i : i + block][mine]] = -2
        need = np.full(len(q), floor, np.float32)
        if len(data) > k:
            need = np.maximum(need, -np.partition(-low, k - 1, axis=1)[:, k - 1])
        keep = cos + err >= need[:, None]
        keep[rows[mine], at[i : i + block][mine]] = False
        if keep.mean() > 0.05:
            exact = q @ data.T
        else:
            exact = np.full(keep.shape, -2, np.float32)
            a, b = np.nonzero(keep)
            for s in range(0, len(a), 50_000):
                x, y = a[s : s + 50_000], b[s : s + 50_000]
                exact[x, y] = np.einsum("ij,ij->i", q[x], data[y])
        exact[~keep | (exact < floor)] = -2
        m = min(k, len(data))
        # Columns are in key order, so a tiny step per column breaks exact ties towards the smaller key.
        ranked = exact.astype(np.float64) - np.arange(len(data)) * 1e-13
        top = np.argpartition(-ranked, m - 1, axis=1)[:, :m] if m < len(data) else np.tile(np.arange(len(data)), (len(q), 1))
        a, j = np.nonzero(np.take_along_axis(exact, top, 1) > -1.5)
        b = top[a, j]
        qs.append(a + i)
        ds.append(order[b])
        sims.append(exact[a, b])
    return (np.concatenate(x) if x else np.empty(0, int) for x in (qs, ds, sims))


def place(vectors: DataFrame, cells: dict[str, Cells], rot: np.ndarray, probes: int) -> DataFrame:
    """Index rows: (kind, grp, cell, key, query, data, vec, code, norm, fit), one for each cell and shard a vector belongs to."""
    model = vectors.sparkSession.sparkContext.broadcast((cells, rot))  # bounded by MAX_CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, rot = model.value
        for b in batches:
            kinds = np.asarray(b.column("kind").to_pylist(), object)
            for kind in dict.fromkeys(kinds):
                rows = np.flatnonzero(kinds == kind)
                if kind not in cells:
                    continue
                m = cells[kind]
                sub = b.take(pa.array(rows))
                x = unit_rows(sub.column("vec")) @ rot
                near = nearest(x, m.centres, probes)
                who = np.repeat(np.arange(len(x)), near.shape[1])
                cell = near.ravel()
                home = np.tile(np.arange(near.shape[1]) == 0, len(x))
                shard = m.shards[cell]
                part = sub.column("s").to_numpy()[who] % shard  # by key, so a repeated task places its rows alike
                whole = shard == 1
                # One group for an uncut cell; else queries meet all data shards and data all query shards.
                out_w, out_g, out_q, out_d = [who[whole]], [m.first_group[cell[whole]]], [home[whole]], [np.ones(whole.sum(), bool)]
                cut = np.flatnonzero(~whole)
                if len(cut):
                    s = shard[cut]
                    rep = np.repeat(cut, s)
                    other = np.arange(len(rep)) - np.repeat(np.cumsum(s) - s, s)
                    base = m.first_group[cell[rep]]
                    hq = home[rep]
                    out_w += [who[rep[hq]], who[rep]]
                    out_g += [(base + part[rep] * shard[rep] + other)[hq], base + other * shard[rep] + part[rep]]
                    out_q += [np.ones(hq.sum(), bool), np.zeros(len(rep), bool)]
                    out_d += [np.zeros(hq.sum(), bool), np.ones(len(rep), bool)]
                w, g, q, d = map(np.concatenate, (out_w, out_g, out_q, out_d))
                c = np.searchsorted(m.first_group, g, side="right") - 1
                code, norm, fit = codes_of(x[w] - m.centres[c])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(w)), pa.array(g, pa.int64()), pa.array(c, pa.int32()), sub.column("key").take(pa.array(w)), pa.array(q), pa.array(d), packed(x[w]), packed(code), pa.array(norm), pa.array(fit)],
                    names=["kind", "grp", "cell", "key", "query", "data", "vec", "code", "norm", "fit"],
                )

    return vectors.select("kind", "key", "vec", F.shiftright(F.xxhash64("key"), 1).alias("s")).mapInArrow(
        run, "kind string, grp bigint, cell int, key string, query boolean, data boolean, vec binary, code binary, norm float, fit float"
    )


def search(placed: DataFrame, cells: dict[str, Cells], k: int, floor: float) -> DataFrame:
    """(kind, a, b, similarity): up to k best b for each a."""
    model = placed.sparkSession.sparkContext.broadcast({kind: m.centres for kind, m in cells.items()})

    def run(t: pa.Table) -> pa.Table:
        kind, cell = t["kind"][0].as_py(), t["cell"][0].as_py()
        query, data = t["query"].to_numpy(), t["data"].to_numpy()
        keys = np.asarray(t["key"].to_pylist(), object)
        x = unpacked(t["vec"], np.float32, DIM)
        codes = CodeSet(unpacked(t["code"], np.uint64, 2)[data], t["norm"].to_numpy()[data], t["fit"].to_numpy()[data])
        a = b = np.empty(0, int)
        sims = np.empty(0, np.float32)
        if query.any() and data.any():
            a, b, sims = best_of(x[query], keys[query], x[data], keys[data], codes, model.value[kind][cell], k, floor)
        return pa.table({"kind": pa.array([kind] * len(a), pa.string()), "a": pa.array(keys[query][a], pa.string()), "b": pa.array(keys[data][b], pa.string()), "similarity": pa.array(sims, pa.float32())})

    found = placed.groupBy("kind", "grp").applyInArrow(run, "kind string, a string, b string, similarity float")
    if any(m.split for m in cells.values()):
        w = Window.partitionBy("kind", "a").orderBy(F.desc("similarity"), "b")
        found = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")
    return found


def completed(vectors: DataFrame, found: DataFrame, k: int, floor: float) -> DataFrame:
    """`found` with the exact lists of those records that have fewer than k neighbours of at least SURE."""
    found = cut_lineage(found)
    held = found.groupBy("kind", F.col("a").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("kth"))
    sure = held.filter((F.col("n") >= k) & (F.col("kth") >= SURE)).select("kind", "key")
    # The list found so far says what a neighbour has to reach.
    least = F.when(F.col("n") >= k, F.col("kth") - 1e-5).otherwise(F.lit(-2.0)).cast("float")
    open_ = cut_lineage(vectors.join(sure, ["kind", "key"], "left_anti").join(held, ["kind", "key"], "left").select("kind", "key", "vec", least.alias("least")))
    n_open = open_.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).alias("qs"))
    plan = n_open.join(vectors.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).alias("ds")), "kind")  # a row per kind

    def shard(df: DataFrame, own: str, other: str) -> DataFrame:
        return df.join(F.broadcast(plan), "kind").withColumn("mine", F.pmod(F.xxhash64("key"), F.col(own))).withColumn("rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))

    q = shard(open_, "qs", "ds").select("kind", F.col("mine").alias("x"), F.col("rest").alias("y"), "key", "vec", "least")
    d = shard(vectors, "ds", "qs").select("kind", F.col("rest").alias("x"), F.col("mine").alias("y"), "key", "vec", F.lit(None).cast("float").alias("least"))

    def run(t: pa.Table) -> pa.Table:
        is_q = np.asarray(t["least"].is_valid())
        x, keys = unit_rows(t["vec"]), np.asarray(t["key"].to_pylist(), object)
        qv, qk, dv, dk = x[is_q], keys[is_q], x[~is_q], keys[~is_q]
        need = np.maximum(t["least"].to_numpy()[is_q].astype(np.float32), np.float32(floor))
        out: tuple[list, list, list] = ([], [], [])
        for i in range(0, len(qv) if len(dv) else 0, 512):
            s = qv[i : i + 512] @ dv.T
            low = need[i : i + 512]
            many = np.flatnonzero((s >= low[:, None]).sum(axis=1) > 4 * k)
            if len(many) and len(dv) > k + 1:  # one more, as a record may meet itself
                low[many] = np.maximum(low[many], -np.partition(-s[many], k, axis=1)[:, k])
            a, b = np.nonzero(s >= low[:, None])
            other = qk[i + a] != dk[b]
            for o, v in zip(out, (qk[i + a[other]], dk[b[other]], s[a[other], b[other]]), strict=True):
                o.append(v)
        a, b, s = (np.concatenate(o) if o else np.empty(0) for o in out)
        return pa.table({"kind": pa.array([t["kind"][0].as_py()] * len(a), pa.string()), "a": pa.array(a.astype(object), pa.string()), "b": pa.array(b.astype(object), pa.string()), "similarity": pa.array(s.astype(np.float32), pa.float32())})

    exact = q.unionByName(d).groupBy("kind", "x", "y").applyInArrow(run, "kind string, a string, b string, similarity float")
    w = Window.partitionBy("kind", "a").orderBy(F.desc("similarity"), "b")
    best = exact.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")
    return found.join(sure.withColumnRenamed("key", "a"), ["kind", "a"], "left_semi").select("kind", "a", "b", "similarity").unionByName(best)


def copy_groups(vectors: DataFrame, k: int) -> DataFrame:
    """(kind, h, members): up to k + 1 least keys of each vector that occurs several times."""
    w = Window.partitionBy("kind", "h").orderBy("key")
    few = vectors.select("kind", "h", "key").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    return few.groupBy("kind", "h").agg(F.array_sort(F.collect_list("key")).alias("members")).filter(F.size("members") > 1)


def nearest_neighbours(vectors: DataFrame, kinds: list[str], k: int = K, floor: float = -1.0, probes: int = PROBES) -> DataFrame:
    """(kind, a, b, similarity): for each record up to k most similar others with at least `floor`.

    Keys are unique within a kind.  Copies (equal vectors) come first, by key.
    """
    spark = vectors.sparkSession
    # Copies are told by a hash of the numbers; two different vectors share one with probability n^2 / 2^65.
    hashed = vectors.withColumn("h", F.xxhash64("vec"))
    copies = copy_groups(hashed, k)
    head = copies.limit(COPIES_IN_MEMORY + 1).collect()
    none, small = not head, len(head) <= COPIES_IN_MEMORY
    if small:
        copies = F.broadcast(spark.createDataFrame(head, copies.schema)) if head else copies
    single = vectors if none else hashed.join(copies, ["kind", "h"], "left").filter(F.col("members").isNull() | (F.col("key") == F.col("members")[0])).select("kind", "key", "vec")
    rot = rotation()
    cells = fit_cells(single, kinds, rot)
    if not cells:
        return spark.createDataFrame([], "kind string, a string, b string, similarity float")
    found = search(place(single, cells, rot, probes), cells, k, floor)
    if floor < SURE and any(len(m.centres) > 1 for m in cells.values()):
        found = completed(single, found, k, floor)
    if none:
        return found
    # A representative's neighbours stand for their copies; copies of one vector are each other's nearest.
    reps = copies.select("kind", F.col("members")[0].alias("rep"), "members")
    as_b = found.join(reps.withColumnRenamed("rep", "b"), ["kind", "b"], "left").select("kind", "a", F.explode(F.coalesce("members", F.array("b"))).alias("b"), "similarity")
    each = hashed.join(copies, ["kind", "h"]).select("kind", "key", F.col("members")[0].alias("a"), "members")
    own = each.select("kind", F.col("key").alias("a"), F.explode("members").alias("b"), F.lit(1.0).cast("float").alias("similarity")).filter(F.col("a") != F.col("b"))
    theirs = each.filter(F.size("members") <= k).select("kind", "key", "a").join(as_b, ["kind", "a"]).select("kind", F.col("key").alias("a"), "b", "similarity")
    alone = as_b.join(reps.select("kind", F.col("rep").alias("a")), ["kind", "a"], "left_anti").select("kind", "a", "b", "similarity")
    w = Window.partitionBy("kind", "a").orderBy(F.desc("similarity"), "b")
    return own.unionByName(theirs).unionByName(alone).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vector_table(table(spark, sf_dir, "commands"), "command", "command_hash", "embedding")
    return c.unionByName(vector_table(table(spark, sf_dir, "session_clusters"), "cluster", "cluster_id", "centroid"))


KINDS = ["command", "cluster"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one is among the other's five most similar, at a similarity of at least 0.80."""
    found = nearest_neighbours(_vectors(spark, sf_dir), KINDS, floor=0.8)
    return found.select(F.col("kind").alias("record_kind"), F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar records of every record, with their similarity."""
    return nearest_neighbours(_vectors(spark, sf_dir), KINDS).select(F.col("kind").alias("record_kind"), F.col("a").alias("key"), F.col("b").alias("neighbour"), "similarity")


QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours}
SQL: dict[str, str] = {}
