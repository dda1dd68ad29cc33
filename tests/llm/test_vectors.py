from __future__ import annotations

import os

import numpy as np
import pytest

from tidewatch.llm import clusters as C
from tidewatch.llm import vectors as V

SCHEMA = "kind string, key string, vec array<float>"


def groups(n_groups, size, noise, spread=0.25, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n_groups, V.DIM))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.repeat(centres, size, axis=0)
    e = rng.standard_normal(x.shape)
    x = x + spread * e / np.linalg.norm(e, axis=1, keepdims=True)
    return np.concatenate([x, rng.standard_normal((noise, V.DIM))]).astype(np.float32)


def frame(spark, x, kind="k"):
    return spark.createDataFrame([(kind, f"r{i:05}", v.tolist()) for i, v in enumerate(x)], SCHEMA)


def exact(x, k, floor):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(f"r{i:05}", f"r{j:05}") for i in range(len(x)) for j in top[i] if s[i, j] >= floor}


def test_codes_bound_the_similarity():
    x = groups(5, 60, 200)
    u = x / np.linalg.norm(x, axis=1, keepdims=True) @ V.rotation()
    c = u[:50].mean(axis=0)
    codes = V.CodeSet(*V.codes_of(u - c))
    est, err = codes.bounds(u - c)
    true = u @ u.T
    assert (np.abs(est - true) <= err).mean() > 0.93
    assert np.abs(est - true).mean() < V.DIM**-0.5


def test_recall_in_many_cells(spark):
    x = groups(30, 60, 1500)
    got = {(r.a, r.b) for r in V.nearest_neighbours(frame(spark, x), ["k"], 5, 0.8).collect()}
    want = exact(x, 5, 0.8)
    assert len(got & want) / len(want) >= 0.9


def test_recall_without_floor(spark, monkeypatch):
    x = groups(30, 40, 1500)
    want = exact(x, 5, -1)
    for rows in (V.SHARD_ROWS, 1000):
        monkeypatch.setattr(V, "SHARD_ROWS", rows)
        got = {(r.a, r.b) for r in V.nearest_neighbours(frame(spark, x), ["k"], 5).collect()}
        assert len(got) == 5 * len(x)
        assert len(got & want) / len(want) >= 0.98


def test_cut_cells_find_what_whole_cells_find(spark, monkeypatch):
    x = groups(4, 50, 100)
    plain = {(r.a, r.b) for r in V.nearest_neighbours(frame(spark, x), ["k"], 5).collect()}
    monkeypatch.setattr(V, "SHARD_ROWS", 60)
    cut = {(r.a, r.b) for r in V.nearest_neighbours(frame(spark, x), ["k"], 5).collect()}
    assert len(plain & cut) / len(plain) > 0.97
    assert len(cut) == len(plain) == 5 * len(x)


def test_copies_answer_for_each_other(spark):
    x = groups(3, 10, 20)
    x = np.concatenate([x, np.repeat(x[:1], 40, axis=0), np.repeat(x[11:12], 2, axis=0)])
    rows = V.nearest_neighbours(frame(spark, x), ["k"], 5).collect()
    by = {}
    for r in rows:
        by.setdefault(r.a, []).append((r.similarity, r.b))
    assert all(len(v) == 5 for v in by.values())
    copies = {"r00000", *(f"r{i:05}" for i in range(50, 90))}
    for a in copies:
        assert {b for _, b in by[a]} <= copies
    assert {"r00090", "r00091"} <= {b for _, b in by["r00011"]}


def test_unusable_and_few(spark, write):
    ok = groups(1, 3, 0)
    rows = [("a", ok[0].tolist()), ("b", ok[1].tolist()), ("c", None), ("d", [0.0] * 96), ("e", [1.0] * 48), ("f", [float("nan")] + [1.0] * 95), ("g", [None] + [1.0] * 95), ("h", [float("inf")] + [1.0] * 95), (None, ok[2].tolist())]
    d = write(commands=(rows, "command_hash string, embedding array<float>"), session_clusters=([], "cluster_id string, centroid array<float>"))
    assert [tuple(r) for r in V.p5_found(spark, d).collect()] == [("command", "a", "b")]
    assert {(r.key, r.neighbour) for r in V.p5_neighbours(spark, d).collect()} == {("a", "b"), ("b", "a")}


def test_empty(spark, write):
    d = write(commands=([], "command_hash string, embedding array<float>"), session_clusters=([], "cluster_id string, centroid array<float>"), ips_rollup=([], "source_ip string, embedding array<float>"))
    for q in [*V.QUERIES.values(), *C.QUERIES.values()]:
        assert q(spark, d).count() == 0


def all_lead(vectors):
    """As collapse(), but every record is its own leader, as if each lay on a task of its own."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            key, x = b.column("key"), V.unit_rows(b.column("vec"))
            yield pa.RecordBatch.from_arrays([b.column("kind"), key, key, pa.array([True] * len(x)), V.packed(x)], names=["kind", "key", "leader", "leads", "vec"])

    return vectors.mapInArrow(run, "kind string, key string, leader string, leads boolean, vec binary")


def cliques(x, keys):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    adj = u @ u.T >= C.TAU
    out = set()
    for i in range(len(x)):
        m = np.flatnonzero(adj[i])
        if len(m) >= C.MIN_SIZE and all((adj[j] == adj[i]).all() for j in m):
            out |= {(min(keys[j] for j in m), keys[j]) for j in m}
    return out


@pytest.mark.parametrize("chunk", [16_384, 64])
def test_clusters_against_brute_force(spark, monkeypatch, write, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    x = groups(12, 30, 60, spread=0.3, seed=4)
    rng = np.random.default_rng(1)
    tail = groups(1, 3, 0, seed=9)  # too few
    chain = x[:1] + 0.75 * rng.standard_normal((1, V.DIM)).astype(np.float32) / 10  # may touch one group only in part
    x = np.concatenate([x, tail, chain])
    keys = [f"r{i:05}" for i in range(len(x))]
    rows = [(k, v.tolist()) for k, v in zip(keys, x, strict=True)]
    d = write(commands=(rows, "command_hash string, embedding array<float>"), ips_rollup=(rows[:200] + rows[:40], "source_ip string, embedding array<float>"))
    got = {tuple(r) for r in C.p4_found(spark, d).collect()}
    assert {(a, b) for k, a, b in got if k == "command"} == cliques(x, keys)
    assert {(a, b) for k, a, b in got if k == "ip"} == cliques(x[:200], keys[:200])
    sizes = {r.n for r in C.p4_clusters(spark, d).collect()}
    assert 30 in sizes
    assert C.p4_groups(spark, d).count() == len(x) + 200


def test_half_similar_group_is_no_cluster(spark, write):
    """A path of vectors, each similar to the next but not to all: no cluster, whatever the pieces are."""
    a, b = np.eye(V.DIM)[0], np.eye(V.DIM)[1]
    x = np.array([np.cos(t) * a + np.sin(t) * b for t in np.linspace(0, 1.5, 12)], np.float32)
    rows = [(f"r{i}", v.tolist()) for i, v in enumerate(x)]
    d = write(commands=(rows, "command_hash string, embedding array<float>"), ips_rollup=([], "source_ip string, embedding array<float>"))
    assert C.p4_found(spark, d).count() == 0


def test_copies_form_a_cluster(spark, write):
    x = groups(1, 1, 3)
    rows = [(f"c{i:03}", x[0].tolist()) for i in range(300)] + [(f"n{i}", v.tolist()) for i, v in enumerate(x[1:])]
    d = write(commands=(rows, "command_hash string, embedding array<float>"), ips_rollup=([], "source_ip string, embedding array<float>"))
    got = C.p4_found(spark, d).collect()
    assert len(got) == 300
    assert {r.cluster_key for r in got} == {"c000"}


def test_markov_clusters_split_a_weak_bridge(spark):
    k = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(5) for j in range(i + 1, 5)]
    edges = spark.createDataFrame([("x", a, b, 1.0) for a, b in k] + [("x", "a0", "b0", 0.05)], "kind string, a string, b string, w double")
    got = {r.node: r.cluster for r in C.markov_clusters(edges, inflation=2.0).collect()}
    assert len({got[f"a{i}"] for i in range(5)}) == 1
    assert len({got[f"b{i}"] for i in range(5)}) == 1
    assert got["a1"] != got["b1"]


@pytest.mark.parametrize("centres", [1, 4])
def test_nodes_of_a_cell_are_linked(spark, monkeypatch, centres):
    """An arc too wide for one leader: its nodes share members, so the walk joins them, in one cell as in several."""
    e = np.eye(V.DIM)
    arc = [np.cos(t) * e[0] + np.sin(t) * e[1] for t in np.linspace(0, 0.8, 9)]
    far = [np.cos(t) * e[2] + np.sin(t) * e[3] for t in np.linspace(0, 0.3, 4)]
    x = np.array(arc + far, np.float32)
    some = x[[0, 8, 4, 10]][:centres]
    monkeypatch.setattr(C, "fit_cells", lambda *_: {"k": V.Cells(some, np.ones(centres, np.int64), np.arange(centres))})
    monkeypatch.setattr(C, "collapse", all_lead)
    _, groups = C.clustered(frame(spark, x), ["k"])
    got = {r.leader: r.cluster for r in groups.collect()}
    assert len({got[f"r{i:05}"] for i in range(9)}) == 1
    assert len({got[f"r{i:05}"] for i in range(9, 13)}) == 1
    assert got["r00000"] != got["r00009"]


def test_small_fragments_of_a_cluster_are_joined(spark, monkeypatch):
    """A cluster in pieces below MIN_SIZE, on tasks and in cells of their own, is put together before small pieces are dropped."""
    x = groups(1, 6, 20, seed=3)
    monkeypatch.setattr(C, "PROBES", 1)
    monkeypatch.setattr(C, "CHUNK", 1)
    monkeypatch.setattr(C, "SHARD_ROWS", 7)
    u = V.unit_rows(frame(spark, x).select("vec").toArrow()["vec"])
    monkeypatch.setattr(C, "fit_cells", lambda *_: {"k": V.Cells(u, np.ones(len(u), np.int64), np.arange(len(u)))})
    monkeypatch.setattr(C, "collapse", all_lead)
    records, parts = C.clustered(frame(spark, x), ["k"])
    assert parts.select("cluster").distinct().count() == len(x)
    got = {(r.key, r.cluster) for r in C.verified(records, parts).collect()}
    assert {k for k, _ in got} == {f"r{i:05}" for i in range(6)}
    assert len({c for _, c in got}) == 1


def test_the_walk_decides_what_is_checked(spark, monkeypatch, write):
    """Without the walk's clusters there are no candidates; with other clusters there are others."""
    x = groups(6, 10, 20, seed=8)
    rows = [(f"r{i:03}", v.tolist()) for i, v in enumerate(x)]
    d = write(commands=(rows, "command_hash string, embedding array<float>"), ips_rollup=([], "source_ip string, embedding array<float>"))
    assert C.p4_found(spark, d).count() == 60
    real = C.markov_clusters
    monkeypatch.setattr(C, "markov_clusters", lambda *a, **k: real(*a, **k).limit(0))
    assert C.p4_found(spark, d).count() == 0
    monkeypatch.setattr(C, "markov_clusters", lambda *a, **k: real(*a, **k).filter("cluster > 'r03'"))
    assert 0 < C.p4_found(spark, d).count() < 60


def test_an_even_group_is_one_cluster(spark):
    """Many nodes all linked alike keep small, equal entries, and are still one system."""
    n = 150
    edges = spark.createDataFrame([("x", f"n{i:03}", f"n{j:03}", 0.9) for i in range(n) for j in range(i + 1, n)], "kind string, a string, b string, w double")
    nodes = spark.createDataFrame([("x", f"n{i:03}") for i in range(n + 2)], "kind string, node string")
    got = {r.node: r.cluster for r in C.markov_clusters(edges, nodes).collect()}
    assert len(got) == n + 2
    assert {got[f"n{i:03}"] for i in range(n)} == {"n000"}
    assert got["n151"] == "n151"


def test_walk_without_rest_is_an_error(spark):
    edges = spark.createDataFrame([("x", "a", "b", 1.0), ("x", "b", "c", 1.0)], "kind string, a string, b string, w double")
    with pytest.raises(RuntimeError, match="stand still"):
        C.markov_clusters(edges, rounds=2)


def test_long_chain_of_names(spark):
    pairs = spark.createDataFrame([("x", f"n{i:03}", f"n{i + 1:03}") for i in range(120)] + [("x", "z1", "z2")], "kind string, about string, other string")
    got = {r.cluster: r.root for r in C.merge_names(pairs).collect()}
    assert set(got.values()) == {"n000", "z1"}


def test_records_link_nodes_whose_leaders_are_apart(spark, write):
    """Two leaders 72 degrees apart share out a narrow group between them, of which nobody reaches both: its records are one Markov cluster."""
    a, b, c = np.eye(V.DIM)[:3]
    arc = [np.cos(t) * a + np.sin(t) * b for t in np.deg2rad([0, 72, *range(31, 36), *range(37, 41)])]
    rows = [(f"r{i:02}", v.tolist()) for i, v in enumerate([*arc, c])]
    d = write(commands=(rows, "command_hash string, embedding array<float>"), ips_rollup=([], "source_ip string, embedding array<float>"))
    got = {r.record_key: r.cluster for r in C.p4_groups(spark, d).collect()}
    assert {got[f"r{i:02}"] for i in range(11)} == {"r00"}
    assert got["r11"] == "r11"
    assert {(r.cluster, r.n) for r in C.p4_clusters(spark, d).collect()} == {("r00", 11)}


def test_a_key_that_leads_two_groups(spark, write):
    """One key with two vectors that don't resemble each other, each first in a group of its own: both groups are found."""
    x = groups(2, 6, 0, seed=7)
    keys = ["k", *(f"a{i}" for i in range(5)), "k", *(f"b{i}" for i in range(5))]
    rows = [(k, v.tolist()) for k, v in zip(keys, x, strict=True)]
    d = write(commands=(rows, "command_hash string, embedding array<float>"), ips_rollup=([], "source_ip string, embedding array<float>"))
    got = {(r.cluster_key, r.record_key) for r in C.p4_found(spark, d).collect()}
    assert got == {("a0", k) for k in keys[:6]} | {("b0", k) for k in keys[6:]}
    assert len({r.cluster for r in C.p4_groups(spark, d).collect()}) == 2


def test_components_walk_alike_in_a_task_and_by_joins(spark, monkeypatch):
    """A bridge, a path, an even group and a pair, each walked in one task and by joins; names connected both ways too."""
    k = [(f"{g}{i}", f"{g}{j}", 0.9) for g in "abe" for i in range(5) for j in range(i + 1, 5)]
    edges = spark.createDataFrame([("x", *e) for e in [*k, ("a0", "b0", 0.05), ("p1", "p2", 0.8), ("p2", "p3", 0.85), ("q1", "q2", 0.99)]], "kind string, a string, b string, w double")
    nodes = spark.createDataFrame([("x", "z"), ("x", "a0")], "kind string, node string")
    got = {r.node: (r.cluster, round(r.flow, 6)) for r in C.markov_clusters(edges, nodes).collect()}
    assert {v[0] for v in got.values()} >= {"a0", "b0", "e0", "q1", "z"}
    monkeypatch.setattr(C, "WIDE", 1)
    monkeypatch.setattr(C, "LINKS_IN_TASK", 0)
    assert {r.node: (r.cluster, round(r.flow, 6)) for r in C.markov_clusters(edges, nodes).collect()} == got


def test_the_driver_gets_centres_only(spark, monkeypatch):
    """Cells are fitted in a task: the driver neither gets the sample nor works on it."""
    x = groups(10, 40, 100)
    here, real = os.getpid(), V.kmeans

    def elsewhere(x, cells):
        assert os.getpid() != here
        return real(x, cells)

    monkeypatch.setattr(V, "kmeans", elsewhere)
    cells = V.fit_cells(frame(spark, x), ["k"], V.rotation())["k"]
    assert cells.centres.shape == (1, V.DIM)
    assert cells.shards.tolist() == [1]
