"""Problem 4: groups of mutually similar vectors, by Markov clustering.

1. Collapse: every task covers its own vectors greedily with leaders (a vector
   joins a leader it reaches TAU with), so a group that holds a third of all rows
   becomes a few leaders before anything is shuffled.
2. Graph: leaders are placed in coarse cells, each in its own and, as a neighbour, in
   the next nearest ones.  Inside a cell the leaders are covered once more, and
   every leader, the cell's own too, is linked to all remaining nodes it reaches TAU with;
   so two nodes are joined by any leader they share, in one cell as in many.
3. Markov clustering of all nodes: square the sparse column-stochastic matrix,
   inflate, prune small entries, until it stands still (an error if it doesn't).  Attractors are the rows with return
   flow; attractors that feed each other are one system, and a node belongs to the system that gets most of its flow.
   These clusters are the candidates of step 4; a node the walk doesn't place is in no cluster.
4. Exact check: clusters below MIN_SIZE are first joined where they touch (one record
   of each against one of each other; the members of a true cluster are all similar, so any will do).
   Then clusters of at least MIN_SIZE records are verified against all records.  With angles to a pivot p, two vectors x, y can only miss TAU if
   angle(x, p) + angle(y, p) > acos(TAU), and can only reach it if
   |angle(x, p) - angle(y, p)| <= acos(TAU); only pairs these bounds leave open are computed.

A record only ever joins a leader it is similar to, so a true cluster (all pairs
similar, nobody else) is never mixed with others by steps 1 to 3, only cut into pieces.  Clusters the
check finds touching are merged and checked once more.  Once is enough: any two pieces of a true cluster
touch, so after one merge it is whole, and what then touches something or misses TAU inside is no cluster.

Defined cases: vectors that aren't usable are left out; exact repeats of a
record count once; a key with several different vectors is one record if they fall in
one cluster; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, table
from .vectors import DIM, Cells, fit_cells, nearest, packed, unit_rows, unpacked, vector_table

TAU = 0.80
MIN_SIZE = 5
#: Vectors a task covers at a time.
CHUNK = 16_384
PROBES = 3
INFLATION = 1.5
PRUNE = 1e-3
#: The walk is an error if it hasn't come to stand still after so many rounds.
ROUNDS = 100
#: An entry counts as real flow from this part of its column's largest on; so a large even group is read like a small one.
REAL = 0.1
#: Rounds in a row without a change of where any flow goes, after which the walk stands still.
STILL = 3
#: Nodes of a component that walks in one task, and pairs of names connected in one task.
WIDE = 512
LINKS_IN_TASK = 1_000_000
#: Pivots held in memory by one pass over all records; more pivots take more passes.
PIVOT_BLOCK = 20_000
LEADERS_IN_MEMORY = 200_000
SHARD_ROWS = 8_192
TYPICAL = 3
#: Letters of the digest in a leader's name.
DIGEST = 16
SLACK = 1e-4


def cover(x: np.ndarray, tau: float = TAU) -> np.ndarray:
    """For each row the index of its leader: the first rows that nobody before covers, each row with its most similar leader."""
    lead = np.empty(0, np.int64)
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 1024):
        b = x[i : i + 1024]
        best = np.full(len(b), -2, np.float32)
        who = np.zeros(len(b), np.int64)
        if len(lead):
            s = b @ x[lead].T
            at = s.argmax(axis=1)
            best, who = s[np.arange(len(b)), at], lead[at]
        open_ = np.flatnonzero(best < tau)
        if len(open_):
            s = b[open_] @ b[open_].T
            free = np.ones(len(open_), bool)
            new = []
            for j in range(len(open_)):
                if free[j]:
                    new.append(j)
                    free &= s[j] < tau
            at = s[:, new].argmax(axis=1)
            who[open_] = i + open_[np.asarray(new)[at]]
            lead = np.concatenate([lead, i + open_[new]])
        out[i : i + 1024] = who
    return out


def collapse(vectors: DataFrame) -> DataFrame:
    """(kind, key, leader, leads, vec): each record with its leader inside the task's chunk; vec as packed unit row.

    A leader is named by its key and a digest of its vector, since a key with several vectors may lead with each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            kinds = np.asarray(t["kind"].to_pylist(), object)
            for kind in dict.fromkeys(kinds):
                sub = t.take(pa.array(np.flatnonzero(kinds == kind)))
                x = unit_rows(sub["vec"])
                lead = cover(x)
                keys = sub["key"].combine_chunks()
                own = {i: f"{keys[i].as_py()}:{hashlib.blake2b(x[i].tobytes(), digest_size=DIGEST // 2).hexdigest()}" for i in np.unique(lead).tolist()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(x)), keys, pa.array([own[i] for i in lead.tolist()]), pa.array(lead == np.arange(len(x))), packed(x)], names=["kind", "key", "leader", "leads", "vec"]
                )

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return vectors.select("kind", "key", "vec").mapInArrow(run, "kind string, key string, leader string, leads boolean, vec binary")


def graph(leaders: DataFrame, cells: dict[str, Cells]) -> DataFrame:
    """(kind, key, node, sim, home): each leader's node (home), and all other nodes it reaches TAU with."""
    model = leaders.sparkSession.sparkContext.broadcast({k: c.centres for k, c in cells.items()})
    spread = leaders.sparkSession.sparkContext.broadcast({k: c.shards for k, c in cells.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = np.asarray(b.column("kind").to_pylist(), object)
            for kind in dict.fromkeys(kinds):
                if kind not in model.value:
                    continue
                sub = b.take(pa.array(np.flatnonzero(kinds == kind)))
                x = unpacked(sub.column("vec"), np.float32, DIM)
                near = nearest(x, model.value[kind], PROBES)
                home = np.tile(np.arange(near.shape[1]) == 0, len(x))
                who = np.repeat(np.arange(len(x)), near.shape[1])
                cell = near.ravel().astype(np.int64)
                s = spread.value[kind][cell]
                # Homes of a crowded cell are spread over its shards by key; every shard sees all leaders of the cell as neighbours.
                part = sub.column("s").to_numpy()[who] % s
                rep = np.repeat(np.arange(len(who)), s)
                shard = np.arange(len(rep)) - np.repeat(np.cumsum(s) - s, s)
                is_home = home[rep] & (part[rep] == shard)
                grp = cell[rep] * 65536 + shard
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(rep)), pa.array(grp), sub.column("key").take(pa.array(who[rep])), pa.array(is_home), packed(x[who[rep]])], names=["kind", "grp", "key", "home", "vec"]
                )

    def link(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")  # the same nodes whatever order the rows arrive in
        home = t["home"].to_numpy()
        keys = np.asarray(t["key"].to_pylist(), object)
        x = unpacked(t["vec"], np.float32, DIM)
        h, hk = x[home], keys[home]
        lead = cover(h)
        sim = (h * h[lead]).sum(axis=1) if len(h) else np.empty(0, np.float32)
        out = [(hk, hk[lead], sim, np.ones(len(h), bool))]
        nodes = np.unique(lead)
        own = np.full(len(x), -1)
        own[home] = lead
        for i in range(0, len(x), 4096):
            if not len(nodes):
                break
            s = x[i : i + 4096] @ h[nodes].T
            a, b = np.nonzero((s >= TAU) & (own[i : i + 4096, None] != nodes))
            out.append((keys[i : i + 4096][a], hk[nodes[b]], s[a, b], np.zeros(len(a), bool)))
        key, node, s, hm = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"kind": pa.array([t["kind"][0].as_py()] * len(key), pa.string()), "key": pa.array(key, pa.string()), "node": pa.array(node, pa.string()), "sim": pa.array(s, pa.float32()), "home": pa.array(hm)})

    placed = leaders.select("kind", "key", "vec", F.shiftright(F.xxhash64("key"), 1).alias("s")).mapInArrow(place, "kind string, grp bigint, key string, home boolean, vec binary")
    return placed.groupBy("kind", "grp").applyInArrow(link, "kind string, key string, node string, sim float, home boolean")


def both_ways(df: DataFrame, a: str, b: str) -> DataFrame:
    """Each row also with `a` and `b` changed over; one row made two, as a union of both readings lost rows, see `stacked`."""
    ways = F.explode(F.array(F.struct(F.col(a).alias(a), F.col(b).alias(b)), F.struct(F.col(b).alias(a), F.col(a).alias(b))))
    rest = [c for c in df.columns if c not in (a, b)]
    return df.select(*rest, ways.alias("way")).select(*[f"way.{c}" if c in (a, b) else c for c in df.columns])


def stacked(x: DataFrame, y: DataFrame) -> DataFrame:
    """Union that makes no claim on partitioning: with Spark 4.1's spark.sql.unionOutputPartitioning, a union of tables partitioned alike lost rows (tested)."""
    return x.unionByName(y.withColumn("kind", F.concat("kind", F.lit(""))))


def markov_clusters(edges: DataFrame, nodes: DataFrame | None = None, inflation: float = INFLATION, prune: float = PRUNE, rounds: int = ROUNDS) -> DataFrame:
    """(kind, node, cluster, flow) of all `nodes` (kind, node), or of those with an edge; `edges` is (kind, a, b, w), one row per unordered pair.

    No flow passes between components, so each walks by itself: in one task up to WIDE nodes, by joins beyond.  A node without edges
    keeps its flow to itself and is its own cluster.
    """
    both = cut_lineage(both_ways(edges.withColumnsRenamed({"a": "i", "b": "j"}), "i", "j"))
    part = merge_names(both.filter("i < j").select("kind", F.col("i").alias("about"), F.col("j").alias("other")))
    size = F.count(F.lit(1)).over(Window.partitionBy("kind", "root"))
    both = cut_lineage(both.join(part.select("kind", F.col("cluster").alias("i"), "root", size.alias("n")), ["kind", "i"]))

    def walk(t: pa.Table) -> pa.Table:
        names, i = np.unique(np.asarray(t["i"].to_pylist(), object), return_inverse=True)
        w = np.zeros((len(names), len(names)))
        w[i, np.searchsorted(names, np.asarray(t["j"].to_pylist(), object))] = t["w"].to_numpy()
        cluster, flow, rest = walked(w, inflation, prune, rounds)
        at = cluster >= 0
        return pa.table({"kind": pa.array([t["kind"][0].as_py()] * int(at.sum())), "node": pa.array(names[at], pa.string()), "cluster": pa.array(names[cluster[at]], pa.string()), "flow": pa.array(flow[at]), "rest": pa.array([rest] * int(at.sum()))})

    out = cut_lineage(both.filter(F.col("n") <= WIDE).groupBy("kind", "root").applyInArrow(walk, "kind string, node string, cluster string, flow double, rest boolean"))
    if out.filter("not rest").take(1):
        raise RuntimeError(f"the walk did not stand still within {rounds} rounds")
    out = out.drop("rest")
    wide = both.filter(F.col("n") > WIDE).select("kind", "i", "j", "w")
    if wide.take(1):
        out = stacked(out, wide_walk(wide, inflation, prune, rounds))
    if nodes is None:
        return out
    alone = nodes.select("kind", "node").distinct().join(both.select("kind", F.col("i").alias("node")).distinct(), ["kind", "node"], "left_anti")
    return stacked(out, alone.select("kind", "node", F.col("node").alias("cluster"), F.lit(1.0).alias("flow")))


def walked(w: np.ndarray, inflation: float, prune: float, rounds: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """For each node of one component its cluster, as index of the system's least node (-1: none), its flow, and whether the walk came to rest."""
    m = w + np.eye(len(w))
    m /= m.sum(axis=0)
    before, same = None, 0
    for _ in range(rounds):
        m = (m @ m) ** inflation
        m /= m.sum(axis=0)
        top = m.max(axis=0)
        m[(m < prune) & (m < (1 - 1e-9) * top)] = 0
        real = (m > 0) & (m >= REAL * top)
        m /= m.sum(axis=0)
        same = same + 1 if before is not None and (real == before).all() else 0
        before = real
        if same >= STILL:
            break
    else:
        return np.arange(len(w)), m.sum(axis=1), False
    at = np.flatnonzero(real.diagonal())
    a, b = np.nonzero(real[np.ix_(at, at)])
    system, which = np.unique(least_of(len(at), a, b), return_inverse=True)
    share = np.zeros((len(system), len(m)))
    np.add.at(share, which, np.where(real[at], m[at], 0))
    cluster = at[system[share.argmax(axis=0)]] if len(at) else np.full(len(m), -1)
    return np.where(share.max(axis=0, initial=0) > 0, cluster, -1), m.sum(axis=1), True


def least_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one that the links (a, b) connect it with."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        low = np.minimum(low, low[root])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def wide_walk(both: DataFrame, inflation: float, prune: float, rounds: int) -> DataFrame:
    """(kind, node, cluster, flow) of components of any size, by joins; `both` is (kind, i, j, w), each edge both ways.

    Columns of the matrix are sources of flow: entry (i, j) is the flow from j to i.
    """
    joined = both.select("kind", "i").distinct()
    loops = joined.select("kind", "i", F.col("i").alias("j"), F.lit(1.0).alias("w"))

    column = Window.partitionBy("kind", "j")

    def scaled(m: DataFrame) -> DataFrame:
        return m.withColumn("v", F.col("v") / F.sum("v").over(column))

    m = cut_lineage(scaled(stacked(both, loops).withColumnRenamed("w", "v")).withColumn("real", F.lit(True)))
    before, same = None, 0
    for _ in range(rounds):
        left = m.select("kind", "i", F.col("j").alias("k"), F.col("v").alias("x"))
        right = m.select("kind", F.col("i").alias("k"), "j", F.col("v").alias("y"))
        squared = left.join(right, ["kind", "k"]).groupBy("kind", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
        # Inflation and pruning work on columns, all over one partitioning.
        inflated = scaled(squared.withColumn("v", F.pow("v", F.lit(inflation)))).withColumn("top", F.max("v").over(column))
        kept = inflated.filter((F.col("v") >= prune) | (F.col("v") >= (1 - 1e-9) * F.col("top"))).withColumn("real", F.col("v") >= REAL * F.col("top"))
        m = cut_lineage(scaled(kept).select("kind", "i", "j", "v", "real"))
        # Where flow goes: the rows that get a real share of each column.
        now = m.filter("real").agg(F.count(F.lit(1)), F.sum(F.xxhash64("kind", "i", "j").cast("decimal(38,0)"))).first()
        same = same + 1 if now == before else 0
        before = now
        if same >= STILL:
            break
    else:
        raise RuntimeError(f"the walk did not stand still within {rounds} rounds")
    return clusters_of(m)


def clusters_of(m: DataFrame) -> DataFrame:
    """(kind, node, cluster, flow) read off a matrix at rest: systems of attractors, named by their least node, and the nodes whose flow they get."""
    flow = m.filter("real")
    attractors = flow.filter("i = j").select("kind", "i")
    fed = flow.join(attractors, ["kind", "i"])
    among = fed.filter("i <> j").join(attractors.withColumnRenamed("i", "j"), ["kind", "j"]).select("kind", F.col("i").alias("about"), F.col("j").alias("other"))
    systems = merge_names(stacked(among, attractors.select("kind", F.col("i").alias("about"), F.col("i").alias("other"))))
    system = systems.select("kind", F.col("cluster").alias("i"), F.col("root").alias("cluster"))
    share = fed.join(system, ["kind", "i"]).groupBy("kind", F.col("j").alias("node"), "cluster").agg(F.sum("v").alias("v"))
    placed = share.groupBy("kind", "node").agg(F.min_by("cluster", F.struct(-F.col("v"), F.col("cluster"))).alias("cluster"))
    into = m.groupBy("kind", F.col("i").alias("node")).agg(F.sum("v").alias("flow"))
    return placed.join(into, ["kind", "node"], "left").select("kind", "node", "cluster", F.coalesce("flow", F.lit(0.0)).alias("flow"))


def clustered(vectors: DataFrame, kinds: list[str], whole: bool = False) -> tuple[DataFrame, DataFrame] | None:
    """(records, groups): records (kind, key, leader, leads, vec) and groups (kind, leader, cluster, flow).

    Whole: nodes are linked wherever any of their records reach TAU, not only through leaders.  For groups that are verified
    afterwards the leaders' links are enough.
    """
    records = cut_lineage(collapse(vectors))
    leaders = records.filter("leads").select("kind", F.col("leader").alias("key"), "vec")
    # The cells are fitted in the plain space: distances don't depend on a rotation.
    cells = fit_cells(leaders.select("kind", "key", as_floats("vec").alias("vec")), kinds, np.eye(DIM, dtype=np.float32))
    if not cells:
        return None
    linked = cut_lineage(graph(leaders, cells))
    home = linked.filter("home").select("kind", "key", "node").distinct()
    edges = record_links(records, home) if whole else (
        linked.filter(~F.col("home"))
        .select("kind", "key", F.col("node").alias("other"), "sim")
        .join(home, ["kind", "key"])
        .filter(F.col("node") != F.col("other"))
        .groupBy("kind", F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
        .agg(F.max("sim").cast("double").alias("w"))
    )
    named = markov_clusters(edges, home.select("kind", "node"))
    groups = home.join(named, ["kind", "node"]).select("kind", F.col("key").alias("leader"), "cluster", "flow")
    groups = cut_lineage(groups.groupBy("kind", "leader").agg(F.min("cluster").alias("cluster"), F.max("flow").alias("flow")))
    let_go(groups)
    return records, groups


def let_go(df: DataFrame) -> None:
    """Lets the driver collect garbage, upon which Spark's cleaner removes the shuffles, broadcasts and checkpoints of finished steps from the cluster."""
    df.sparkSession.sparkContext._jvm.System.gc()


def as_floats(col: str) -> F.Column:
    """A packed unit row back as an array of floats (Arrow-batched)."""

    @F.pandas_udf("array<float>")
    def run(v):  # noqa: ANN001, ANN202
        return v.map(lambda b: np.frombuffer(b, np.float32))

    return run(F.col(col))


def sent(df: DataFrame) -> DataFrame:
    """A written table, sent to the tasks if it is small, so that a join with it doesn't move the records."""
    return F.broadcast(df) if df.count() <= LEADERS_IN_MEMORY else df


def label(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Records with their cluster; small leader tables are sent to the tasks, large ones joined by shuffle."""
    n = groups.count()
    side = groups.select("kind", "leader", "cluster", "flow")
    return records.join(F.broadcast(side) if n <= LEADERS_IN_MEMORY else side, ["kind", "leader"])


def pivots(labelled: DataFrame) -> DataFrame:
    """(kind, cluster, pivot): the mean direction of a cluster's leaders, added up batch by batch before anything moves."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                first: dict = {}
                of = np.array([first.setdefault(k, len(first)) for k in zip(b.column("kind").to_pylist(), b.column("cluster").to_pylist(), strict=True)])
                sums = np.zeros((len(first), DIM))
                np.add.at(sums, of, unpacked(b.column("vec"), np.float32, DIM))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in first]), pa.array([c for _, c in first]), packed(sums)], names=["kind", "cluster", "sum"])

    def mean(t: pa.Table) -> pa.Table:
        x = unpacked(t["sum"], np.float64, DIM).sum(axis=0)
        x = (x / max(np.linalg.norm(x), 1e-12)).astype(np.float32)
        return pa.table({"kind": pa.array([t["kind"][0].as_py()]), "cluster": pa.array([t["cluster"][0].as_py()]), "pivot": pa.array([x.tobytes()], pa.binary())})

    parts = labelled.filter("leads").select("kind", "cluster", "vec").mapInArrow(part, "kind string, cluster string, sum binary")
    return parts.groupBy("kind", "cluster").applyInArrow(mean, "kind string, cluster string, pivot binary")


def open_rows(labelled: DataFrame, block: list, limit: float, inside: bool = True) -> DataFrame:
    """(kind, about, cluster, key, vec, own): records against the pivots of `block` that the bounds leave open.

    `block` holds (kind, cluster, pivot, radius).  Own: the record is a member and may be too far from another member.
    Otherwise it is no member and may reach one.  Without `inside` own records are left out.
    """
    model = labelled.sparkSession.sparkContext.broadcast(
        {
            kind: ([r.cluster for r in block if r.kind == kind], np.stack([np.frombuffer(r.pivot, np.float32) for r in block if r.kind == kind]), np.array([r.radius for r in block if r.kind == kind]))
            for kind in {r.kind for r in block}
        }
    )  # at most PIVOT_BLOCK rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = np.asarray(b.column("kind").to_pylist(), object)
            for kind in dict.fromkeys(kinds):
                if kind not in model.value:
                    continue
                names, p, radius = model.value[kind]
                sub = b.take(pa.array(np.flatnonzero(kinds == kind)))
                x = unpacked(sub.column("vec"), np.float32, DIM)
                own = np.asarray(sub.column("cluster").to_pylist(), object)
                where = {c: i for i, c in enumerate(names)}
                mine = np.array([where.get(c, -1) for c in own])
                reach = np.cos(np.minimum(radius + limit + SLACK, np.pi)).astype(np.float32)
                far = np.cos(np.maximum(limit - radius - SLACK, 0)).astype(np.float32)
                for i in range(0, len(x), 2048):
                    s = x[i : i + 2048] @ p.T
                    at = mine[i : i + 2048]
                    rows = np.flatnonzero(at >= 0)
                    is_far = (s[rows, at[rows]] < far[at[rows]]) & inside
                    s[rows, at[rows]] = -2
                    a, c = np.nonzero(s >= reach[None, :])
                    a, c = np.concatenate([a, rows[is_far]]), np.concatenate([c, at[rows[is_far]]])
                    if len(a):
                        take = pa.array(a + i)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([kind] * len(a)), pa.array([names[j] for j in c]), sub.column("cluster").take(take), sub.column("key").take(take), sub.column("vec").take(take)],
                            names=["kind", "about", "cluster", "key", "vec"],
                        )

    return labelled.select("kind", "cluster", "key", "vec").mapInArrow(run, "kind string, about string, cluster string, key string, vec binary")


def check_open(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(kind, about, other, sim): what speaks against a cluster: another that it touches, with the highest similarity, or itself if a pair inside is too far."""
    sizes = rows.groupBy("kind", "about").agg(F.count(F.lit(1)).alias("nq"))
    held = members.join(sizes, (members.kind == sizes.kind) & (members.cluster == sizes.about), "left_semi").groupBy("kind", F.col("cluster").alias("about")).agg(F.count(F.lit(1)).alias("nm"))
    plan = cut_lineage(sizes.join(held, ["kind", "about"]).select("kind", "about", F.ceil(F.col("nq") / SHARD_ROWS).alias("sq"), F.ceil(F.col("nm") / SHARD_ROWS).alias("sm")))

    plan = sent(plan)

    def shard(df: DataFrame, own: str, other: str) -> DataFrame:
        return df.withColumn("mine", F.pmod(F.xxhash64("key"), F.col(own))).withColumn("rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))

    q = shard(rows.join(plan, ["kind", "about"]), "sq", "sm").select("kind", "about", F.col("mine").alias("x"), F.col("rest").alias("y"), "cluster", "key", "vec")
    m = shard(members.select("kind", F.col("cluster").alias("about"), "key", "vec").join(plan, ["kind", "about"]), "sm", "sq").select("kind", "about", F.col("rest").alias("x"), F.col("mine").alias("y"), F.lit(None).cast("string").alias("cluster"), "key", "vec")

    def run(t: pa.Table) -> pa.Table:
        is_q = np.asarray(t["cluster"].is_valid())
        x = unpacked(t["vec"], np.float32, DIM)
        about = t["about"][0].as_py()
        names = np.asarray(t["cluster"].to_pylist(), object)[is_q]
        qv, mv = x[is_q], x[~is_q]
        bad: dict = {}
        for i in range(0, len(qv), 1024):
            if not len(mv):
                break
            s = qv[i : i + 1024] @ mv.T
            inside = names[i : i + 1024] == about
            if inside.any() and (s[inside] < TAU).any():
                bad[about] = 0.0
            best = s[~inside].max(axis=1)
            for name, sim in zip(names[i : i + 1024][~inside][best >= TAU].tolist(), best[best >= TAU].tolist(), strict=True):
                bad[name] = max(sim, bad.get(name, 0.0))
        return pa.table(
            {"kind": pa.array([t["kind"][0].as_py()] * len(bad), pa.string()), "about": pa.array([about] * len(bad), pa.string()), "other": pa.array(list(bad), pa.string()), "sim": pa.array(list(bad.values()), pa.float64())}
        )

    found = stacked(q, m).groupBy("kind", "about", "x", "y").applyInArrow(run, "kind string, about string, other string, sim double")
    return found.groupBy("kind", "about", "other").agg(F.max("sim").alias("sim"))


def record_links(records: DataFrame, home: DataFrame) -> DataFrame:
    """(kind, a, b, w): all pairs of nodes of which any two records reach TAU, with their highest similarity.

    Exact: every record is compared with every node's pivot, and with a node's records where the bound leaves it open.
    """
    node = home.select("kind", F.col("key").alias("leader"), F.col("node").alias("cluster"), F.lit(0.0).alias("flow"))
    labelled = cut_lineage(label(records, node).select("kind", "key", "cluster", "leads", "vec"))
    _, found = compared(labelled, labelled.select("kind", "cluster").distinct(), inside=False)
    if found is None:
        return home.select("kind", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("w")).limit(0)
    pairs = check_open(found, labelled.select("kind", "cluster", "key", "vec"))
    return pairs.groupBy("kind", F.least("about", "other").alias("a"), F.greatest("about", "other").alias("b")).agg(F.max("sim").alias("w"))


def joined_fragments(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups in which clusters below MIN_SIZE that touch are one.

    A true cluster in pieces that are all below MIN_SIZE is put together here: its members are all
    similar, so one leader of each piece tells, and all pieces are compared in blocks.
    """
    small = label(records, groups).groupBy("kind", "cluster").agg(F.count_distinct("key").alias("n")).filter(F.col("n") < MIN_SIZE)
    some = label(records.filter("leads"), groups).groupBy("kind", "cluster").agg(F.min_by("vec", "key").alias("vec"))
    pieces = cut_lineage(some.join(small.select("kind", "cluster"), ["kind", "cluster"]))
    sizes = {r.kind: r.n for r in pieces.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return groups
    blocks = F.create_map(*[F.lit(v) for kind, n in sizes.items() for v in (kind, -(-n // SHARD_ROWS))])
    mine = pieces.withColumn("blocks", blocks[F.col("kind")].cast("long")).withColumn("mine", F.pmod(F.xxhash64("cluster"), F.col("blocks")))
    # Each pair of blocks x <= y meets once.
    met = mine.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("kind", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "cluster", "vec")

    def run(t: pa.Table) -> pa.Table:
        v = unpacked(t["vec"], np.float32, DIM)
        names = np.asarray(t["cluster"].to_pylist(), object)
        first = t["mine"].to_numpy() == t["x"][0].as_py()
        left, right = np.flatnonzero(first), np.flatnonzero(~first) if t["x"][0] != t["y"][0] else np.arange(len(v))
        a, b = [], []
        for i in range(0, len(left), 1024):
            at, to = np.nonzero(v[left[i : i + 1024]] @ v[right].T >= TAU)
            at, to = left[i + at], right[to]
            a.append(names[at[at != to]])
            b.append(names[to[at != to]])
        a, b = (np.concatenate(z) if z else np.empty(0, object) for z in (a, b))
        return pa.table({"kind": pa.array([t["kind"][0].as_py()] * len(a), pa.string()), "about": pa.array(a, pa.string()), "other": pa.array(b, pa.string())})

    touching = cut_lineage(met.groupBy("kind", "x", "y").applyInArrow(run, "kind string, about string, other string"))
    if not touching.take(1):
        return groups
    return cut_lineage(groups.join(merge_names(touching), ["kind", "cluster"], "left").select("kind", "leader", F.coalesce("root", "cluster").alias("cluster"), "flow"))


def checked(labelled: DataFrame, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, failed): clusters (kind, cluster) of at least MIN_SIZE records, of `only` if given, and what speaks against them (kind, about, other)."""
    sized = labelled.groupBy("kind", "cluster").agg(F.count_distinct("key").alias("n")).filter(F.col("n") >= MIN_SIZE).select("kind", "cluster")
    if only is not None:
        sized = sized.join(only, ["kind", "cluster"], "left_semi")
    candidates, found = compared(labelled, sized)
    if found is None:
        return candidates, labelled.sparkSession.createDataFrame([], "kind string, about string, other string")
    failed = cut_lineage(check_open(found, labelled.select("kind", "cluster", "key", "vec")).drop("sim"))
    let_go(labelled)
    return candidates, failed


def compared(labelled: DataFrame, sized: DataFrame, inside: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(candidates, open): the clusters (kind, cluster) of `sized`, and all records that their bounds leave open, see `open_rows`; None if there are no clusters."""
    limit = float(np.arccos(TAU))
    candidates = cut_lineage(pivots(labelled).join(sized, ["kind", "cluster"]))
    few = candidates.count() <= PIVOT_BLOCK
    let_go(labelled)
    members = labelled.join(F.broadcast(candidates.select("kind", "cluster", "pivot")) if few else candidates, ["kind", "cluster"])

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = (unpacked(b.column("vec"), np.float32, DIM) * unpacked(b.column("pivot"), np.float32, DIM)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("cluster"), pa.array(np.arccos(np.clip(s, -1, 1)).astype(np.float64))], names=["kind", "cluster", "angle"])

    radius = members.select("kind", "cluster", "vec", "pivot").mapInArrow(angles, "kind string, cluster string, angle double").groupBy("kind", "cluster").agg(F.max("angle").alias("radius"))
    w = Window.partitionBy(F.pmod(F.xxhash64("cluster"), F.lit(64))).orderBy("kind", "cluster")
    bounded = cut_lineage(candidates.join(radius, ["kind", "cluster"]).withColumn("part", F.floor((F.row_number().over(w) - 1) / (PIVOT_BLOCK // 64))))
    last = bounded.agg(F.max("part")).first()[0]
    if last is None:
        return candidates.select("kind", "cluster"), None
    open_ = None
    for part in range(last + 1):
        rows = open_rows(labelled, bounded.filter(F.col("part") == part).collect(), limit, inside)
        open_ = rows if open_ is None else stacked(open_, rows)
    found = cut_lineage(open_)
    let_go(labelled)
    return candidates.select("kind", "cluster"), found


def passed(candidates: DataFrame, failed: DataFrame) -> DataFrame:
    against = failed.select("kind", F.explode(F.array("about", "other")).alias("cluster"))
    return candidates.join(against, ["kind", "cluster"], "left_anti")


def verified(records: DataFrame, groups: DataFrame) -> DataFrame:
    """(kind, key, cluster): members of clusters that meet the definition exactly."""
    groups = joined_fragments(records, groups)
    # Written once: everything below reads it several times.
    labelled = cut_lineage(label(records, groups).select("kind", "key", "cluster", "leads", "vec"))
    let_go(labelled)
    candidates, failed = checked(labelled)
    good = passed(candidates, failed)
    touching = failed.filter(F.col("about") != F.col("other"))
    if touching.take(1):
        # Clusters that passed touch nobody and stay as they are; only merged ones are checked again.
        merged = cut_lineage(merge_names(touching))
        labelled = cut_lineage(labelled.join(sent(merged), ["kind", "cluster"], "left").select("kind", "key", F.coalesce("root", "cluster").alias("cluster"), "leads", "vec"))
        good = stacked(good, passed(*checked(labelled, merged.select("kind", F.col("root").alias("cluster")).distinct())))
    return labelled.join(cut_lineage(good), ["kind", "cluster"]).select("kind", "key", "cluster").distinct()


def merge_names(pairs: DataFrame) -> DataFrame:
    """(kind, cluster, root): least name of each connected set of clusters.

    Up to LINKS_IN_TASK pairs, a task for each kind.  Beyond, every round takes the least name among a cluster and its neighbours, then the name that one has by now, so
    distances halve; a written table each round.  Names only fall, so it ends.
    """
    if pairs.count() <= LINKS_IN_TASK:

        def run(t: pa.Table) -> pa.Table:
            names = pa.concat_arrays([*t["about"].chunks, *t["other"].chunks]).dictionary_encode()
            order = pa.compute.sort_indices(names.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            code = rank[names.indices.to_numpy()]
            root = least_of(len(order), code[: len(t)], code[len(t) :])
            name = names.dictionary.take(pa.array(order))
            return pa.table({"kind": pa.array([t["kind"][0].as_py()] * len(name)), "cluster": name, "root": name.take(pa.array(root))})

        return pairs.select("kind", "about", "other").groupBy("kind").applyInArrow(run, "kind string, cluster string, root string")
    both = cut_lineage(both_ways(pairs.select("kind", F.col("about").alias("a"), F.col("other").alias("b")), "a", "b").distinct())
    root = both.select("kind", F.col("a").alias("cluster")).distinct().withColumn("root", F.col("cluster"))
    while True:
        seen = both.join(root.select("kind", F.col("cluster").alias("b"), "root"), ["kind", "b"]).groupBy("kind", F.col("a").alias("cluster")).agg(F.min("root").alias("least"))
        low = root.join(seen, ["kind", "cluster"]).select("kind", "cluster", "root", F.least("root", "least").alias("low"))
        far = root.select("kind", F.col("cluster").alias("low"), F.col("root").alias("further"))
        new = cut_lineage(low.join(far, ["kind", "low"]).select("kind", "cluster", F.least("low", "further").alias("root"), (F.least("low", "further") < F.col("root")).alias("moved")))
        root = new.select("kind", "cluster", "root")
        if not new.filter("moved").take(1):
            return root


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vector_table(table(spark, sf_dir, "commands"), "command", "command_hash", "embedding")
    return c.unionByName(vector_table(table(spark, sf_dir, "ips_rollup"), "ip", "source_ip", "embedding"))


KINDS = ["command", "ip"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of clusters in which all are similar to all and to nobody else."""
    parts = clustered(_vectors(spark, sf_dir), KINDS)
    if parts is None:
        return spark.createDataFrame([], "record_kind string, cluster_key string, record_key string")
    members = cut_lineage(verified(*parts))
    let_go(members)
    least = members.groupBy("kind", "cluster").agg(F.min("key").alias("cluster_key"))
    return members.join(least, ["kind", "cluster"]).select(F.col("kind").alias("record_kind"), "cluster_key", F.col("key").alias("record_key")).distinct()


def with_short_names(groups: DataFrame) -> DataFrame:
    """Clusters named by the key of their first node, without its digest unless several of a kind have that key."""
    names = groups.select("kind", "cluster").distinct().withColumn("short", F.expr(f"left(cluster, length(cluster) - {DIGEST + 1})"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("kind", "short")) > 1
    names = names.select("kind", "cluster", F.when(shared, F.col("cluster")).otherwise(F.col("short")).alias("name"))
    return groups.join(names, ["kind", "cluster"]).select("kind", "leader", F.col("name").alias("cluster"), "flow")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's Markov cluster, named by its first node."""
    parts = clustered(_vectors(spark, sf_dir), KINDS, whole=True)
    if parts is None:
        return spark.createDataFrame([], "record_kind string, record_key string, cluster string")
    return label(parts[0], with_short_names(parts[1])).select(F.col("kind").alias("record_kind"), F.col("key").alias("record_key"), "cluster").distinct()


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical members of each cluster of at least MIN_SIZE: strongest flow first, then nearest the pivot."""
    parts = clustered(_vectors(spark, sf_dir), KINDS, whole=True)
    if parts is None:
        return spark.createDataFrame([], "record_kind string, cluster string, n bigint, typical array<string>")
    labelled = label(parts[0], with_short_names(parts[1]))
    sized = labelled.groupBy("kind", "cluster").agg(F.count_distinct("key").alias("n")).filter(F.col("n") >= MIN_SIZE)
    pivot = pivots(labelled)

    def closeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = (unpacked(b.column("vec"), np.float32, DIM) * unpacked(b.column("pivot"), np.float32, DIM)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("cluster"), b.column("key"), b.column("flow"), pa.array(s)], names=["kind", "cluster", "key", "flow", "near"])

    ranked = (
        labelled.join(sized, ["kind", "cluster"]).join(pivot, ["kind", "cluster"]).select("kind", "cluster", "key", "flow", "vec", "pivot")
        .mapInArrow(closeness, "kind string, cluster string, key string, flow double, near float")
        .groupBy("kind", "cluster", "key").agg(F.max("flow").alias("flow"), F.max("near").alias("near"))
    )
    w = Window.partitionBy("kind", "cluster").orderBy(F.desc(F.round("flow", 4)), F.desc("near"), "key")
    best = ranked.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= TYPICAL)
    typical = best.groupBy("kind", "cluster").agg(F.array_sort(F.collect_list(F.struct("r", "key"))).alias("t"))
    return sized.join(typical, ["kind", "cluster"]).select(F.col("kind").alias("record_kind"), "cluster", "n", F.col("t.key").alias("typical"))


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups, "p4_clusters": p4_clusters}
SQL: dict[str, str] = {}
