from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import dist as D
from tidewatch.functions import net as N
from tidewatch.functions import shell
from tidewatch.functions import text as X
from tidewatch.operators import clustering as C
from tidewatch.operators.graph import connected_components
from tidewatch.operators.hunts import load_hunts, run_hunts
from tidewatch.operators.itemsets import closed_itemsets, frequent_itemsets
from tidewatch.operators.nearest import nearest, similar_pairs
from tidewatch.operators.upsert import tombstone, upsert




@pytest.mark.parametrize("one_task", [None, 0])
def test_components_chain_star_single(spark, one_task):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    random.Random(1).shuffle(chain)
    star = [("s000", f"s{i:03}") for i in range(1, 80)]
    edges = spark.createDataFrame([*chain, *star, ("z", "z"), (None, "q"), *chain[:3]], "src string, dst string")
    got = {r.node: r.component for r in connected_components(edges, one_task=one_task).collect()}
    assert {got[f"c{i:03}"] for i in range(61)} == {"c000"}
    assert {got[f"s{i:03}"] for i in range(80)} == {"s000"}
    assert got["z"] == "z"
    assert "q" not in got


@pytest.mark.parametrize("one_task", [None, 0])
def test_components_random_against_union_find(spark, one_task):
    rng = random.Random(7)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    parent = list(range(120))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src int, dst int"), one_task=one_task).collect()}
    assert got == {a: find(a) for p in pairs for a in p}


def test_components_empty(spark):
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0
    assert connected_components(spark.createDataFrame([], "src string, dst string"), one_task=0).count() == 0


def brute_sets(baskets, k, size):
    items = sorted({i for b in baskets for i in b})
    out = {}
    for n in range(2, size + 1):
        for c in itertools.combinations(items, n):
            s = sum(set(c) <= b for b in baskets)
            if s >= k:
                out[c] = s
    return out


def test_itemsets_against_brute_force(spark):
    rng = random.Random(3)
    baskets = [{rng.choice("abcdefg") for _ in range(rng.randrange(6))} for _ in range(80)]
    rows = [(o, i) for o, b in enumerate(baskets) for i in b] + [(None, "a"), (1, None)]
    sets = frequent_itemsets(spark.createDataFrame(rows, "o int, i string"), "o", "i", 6, 4)
    got = {tuple(r["items"]): r.support for r in sets.collect()}
    want = brute_sets(baskets, 6, 4)
    assert got == want
    closed = {tuple(r["items"]) for r in closed_itemsets(sets).collect()}
    assert closed == {c for c, s in want.items() if not any(set(c) < set(x) and want[x] == s for x in want)}


def blobs():
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 0.05, (30, 2)), rng.normal(0, 0.05, (25, 2)) + 5
    far = np.array([[2.5, -9.0], [-8.0, 7.0]])
    return np.concatenate([a, b, far])


def test_hdbscan_blobs():
    labels = C.hdbscan(blobs(), 5, 2)
    assert set(labels[:30]) == {0}
    assert set(labels[30:55]) == {1}
    assert set(labels[55:]) == {-1}


def test_hdbscan_small_and_equal():
    assert C.hdbscan(np.zeros((3, 2)), 5, 2).tolist() == [-1] * 3
    assert len(C.hdbscan(np.zeros((12, 2)), 5, 2)) == 12


def test_linkage():
    x = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.05, 1]])
    assert C.complete_linkage(x, 0.94).tolist() == [0, 0, 1, 1]
    d = C.disagreement(np.array([0, 0, 1, -1]), np.array([0, 0, 1, 1]))
    assert d[0, 1] == 0
    assert d[2, 3] == 0.5
    assert C.average_linkage(d, 2).tolist() == [0, 0, 1, 1]


def test_svd_keeps_angles_of_low_rank_data():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 20))
    u = C.unit_rows(x)
    r = C.svd_reduce(u, 3)
    assert np.allclose(u @ u.T, r @ r.T, atol=1e-8)


def test_label_matrix_refuses_large_tables(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "id int, v array<double>")
    with pytest.raises(ValueError, match="more than one task"):
        C.label_matrix(df, "id", "v", lambda x: np.zeros(len(x), int), limit=4)


def test_shapes():
    assert shell.shape("/bin/busybox wget http://a.b/c -O /tmp/x; X=1 ./run.sh 10.0.0.1 12") == "busybox wget URL -O PATH ; ENV run.sh IP INT"
    assert shell.shape("") == ""
    assert shell.shape('"unclosed quote') == ""
    assert shell.segments("ls -la|grep 'a;b' && id") == [{"command": "ls", "flags": ["-la"]}, {"command": "grep", "flags": []}, {"command": "id", "flags": []}]
    assert [shell.value_class(v) for v in ("A=b", "http://x", "1.2.3.4", "fe80::1", "./a", "42", "deadbeef", "QUJDREVGR0hJSktM1a", "word")] == ["ENV", "URL", "IP", "IP6", "PATH", "INT", "HEX", "B64", "ARG"]


def test_shape_column_with_nulls(spark):
    df = spark.createDataFrame([("ls -l /tmp",), (None,), ("",)], "c string")
    assert [r[0] for r in df.select(shell.shape_column(F.col("c"))).collect()] == ["ls -l PATH", None, ""]


def test_text_edges(spark):
    df = spark.createDataFrame([("  a \t b\n",), ("",), (None,), ("x" * 50,)], "c string")
    got = [tuple(r) for r in df.select(X.normalize(F.col("c"), 10), X.is_cut(F.col("c"), 10)).collect()]
    assert got == [("a b", False), ("", False), (None, None), ("x" * 10, True)]
    ips = spark.createDataFrame([("1.2.3.4 999.1.1.1 1.2.3.4 8.8.8.8",)], "c string").select(X.ipv4s(F.col("c"))).first()[0]
    assert ips == ["1.2.3.4", "8.8.8.8"]


def test_most_restrictive(spark):
    df = spark.createDataFrame([("a", "public"), ("a", None), ("b", "public"), ("c", "confidential"), ("c", None), ("d", None)], "g string, c string")
    got = {r.g: r.v for r in df.groupBy("g").agg(X.most_restrictive(F.col("c")).alias("v")).collect()}
    assert got == {"a": None, "b": "public", "c": "confidential", "d": None}


def test_distances(spark):
    one = spark.range(1)
    arr = lambda *v: F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")
    get = lambda e: one.select(e).first()[0]
    assert get(D.jaccard(arr(), arr())) == 1
    assert get(D.jaccard(arr("a"), arr("a", "b"))) == 0.5
    assert get(D.cosine(arr(0.0, 0.0), arr(1.0, 0.0))) == 0
    assert get(D.entropy(F.array().cast("array<double>"))) == 0
    assert get(D.entropy(arr(1.0, 1.0))) == 1
    m = lambda **v: F.create_map(*[F.lit(x) for kv in v.items() for x in kv]).cast("map<string,double>") if v else F.create_map().cast("map<string,double>")
    assert get(D.jensen_shannon(m(), m())) == 0
    assert get(D.jensen_shannon(m(a=1.0), m())) == 1
    assert get(D.jensen_shannon(m(a=1.0), m(b=1.0))) == pytest.approx(1)
    assert get(D.min_max(F.lit(3), F.lit(3), F.lit(3))) == 0.5


def test_addresses_and_urls(spark):
    df = spark.createDataFrame([("10.1.2.3",), ("8.8.8.8",), ("300.1.1.1",), ("x",), (None,), ("198.18.46.7",)], "ip string")
    assert [r[0] for r in df.select(N.address_class(F.col("ip"))).collect()] == ["private", "public", "invalid", "invalid", "invalid", "benchmark"]
    nets = N.networks(spark, [("10.0.0.0/8", "a"), ("10.1.0.0/16", "b"), ("0.0.0.0/0", "all")])
    got = {r.ip: r.network for r in N.match_networks(df, "ip", nets).collect()}
    assert got == {"10.1.2.3": "b", "8.8.8.8": "all", "300.1.1.1": None, "x": None, None: None, "198.18.46.7": "all"}
    u = spark.createDataFrame([("HTTP://User@A.Example:80/x?q=1#f",), ("https://a.b:8443",), ("ftp://nohost",), ("junk",), (None,)], "u string")
    assert [r[0] for r in u.select(N.canonical_url(F.col("u"))).collect()] == ["http://a.example/x", "https://a.b:8443/", None, None, None]


def test_nearest_ties_zero_and_empty(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id int, v array<double>")
    p = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0])], "k string, v array<double>")
    got = {r.id: (r.nearest[0].label, r.nearest[0].cosine) for r in nearest(v, "v", p, "k", "v").collect()}
    assert got == {1: ("a", 1.0), 2: ("a", 0.0)}
    assert nearest(v, "v", p.limit(0), "k", "v").filter(F.size("nearest") == 0).count() == 2


def test_upsert_and_tombstone(spark):
    old = spark.createDataFrame([("a", 1, "kept"), ("b", 2, None)], "k string, v int, s string")
    new = spark.createDataFrame([("a", 9), ("b", 8), ("c", 7)], "k string, v int")
    got = {tuple(r) for r in upsert(old, new, ["k"], ["s"], {"s": "new"}).collect()}
    assert got == {("a", 9, "kept"), ("b", 8, "new"), ("c", 7, "new")}
    live = spark.createDataFrame([("a",)], "k string")
    assert [r.k for r in tombstone(old, live, ["k"]).collect()] == ["a"]
    assert tombstone(old, live.limit(0), ["k"]).count() == 2


def test_hunts_are_strict(spark):
    for bad in ([{"id": "x", "where": {}}], [{"id": "x", "where": {"nope": 1}}], [{"id": "x", "where": {"intent_in": []}}], [{"id": "x", "where": {"login_fail_gte": "3"}}], [{"where": {"login_fail_gte": 3}}], [{"id": "x", "where": {"login_fail_gte": 3}}] * 2, [{"id": "x", "where": {"login_fail_gte": 3}, "enabled": "yes"}]):
        with pytest.raises(ValueError, match="hunt"):
            load_hunts(bad)
    s = spark.createDataFrame([("1", ["a", "b"], 5, None), ("2", None, None, "x"), ("3", ["b"], 2, "x")], "sid string, artifacts array<string>, command_count int, dominant_intent string")
    h = load_hunts([{"id": "all", "where": {"artifact_all": ["a", "b"]}}, {"id": "any", "where": {"artifact_any": ["b"]}, "cap": 1}, {"id": "off", "where": {"intent_in": ["x"]}, "enabled": False}])
    got = {(r.hunt_id, r.sid) for r in run_hunts(s, h, F.current_timestamp(), [F.desc("sid")]).collect()}
    assert got == {("all", "1"), ("any", "3")}


def test_no_prototypes_means_novel(spark, tmp_path):
    from tidewatch.plans.vectors import command_novelty

    row = [("a", [1.0] * 96, ("c1", True)), ("b", [2.0] * 96, None), ("z", None, None)]
    df = spark.createDataFrame(row, "command_hash string, embedding array<float>, cluster struct<id:string,is_outlier:boolean>")
    df.write.parquet(f"{tmp_path}/commands.parquet")
    assert {(r.command_hash, r.novelty) for r in command_novelty(spark, str(tmp_path)).collect()} == {("a", 1.0), ("b", 1.0)}


def test_prototype_components_have_no_limit_on_partners(spark, tmp_path):
    """Two groups of 60 playbooks at two angles, joined by one pair: more than 50 partners are nearer than the bridge."""
    from tidewatch.plans.entities import prototype_components

    def at(t, i):
        v = np.zeros(96)
        v[:2], v[2 + i] = (np.cos(t), np.sin(t)), 0.02
        return v.tolist()

    near = [(f"c{i}", f"p{i:03}", at(0.0005 * i, i)) for i in range(60)]
    far = [(f"d{i}", f"q{i:03}", at(0.46 + 0.0005 * i, i)) for i in range(60)]
    spark.createDataFrame([*near, *far], "cluster_id string, playbook_id string, centroid array<double>").write.parquet(f"{tmp_path}/session_clusters.parquet")
    got = prototype_components(spark, str(tmp_path)).collect()
    assert len(got) == 120
    assert {r.canonical for r in got} == {"p000"}


def test_similar_pairs_in_blocks(spark):
    x = np.random.default_rng(2).standard_normal((40, 4))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(f"k{i}", f"k{j}") for i, j in zip(*np.nonzero(np.round(u @ u.T, 6) >= 0.5), strict=True)}
    df = spark.createDataFrame([(f"k{i}", v.tolist()) for i, v in enumerate(x)], "k string, v array<double>")
    for block in (4_096, 7):
        rows = [tuple(r) for r in similar_pairs(df, "k", "v", 0.5, block=block).collect()]
        assert len(rows) == len(want)
        assert set(rows) == want


def test_prototypes_in_blocks(spark, monkeypatch):
    from tidewatch.operators import nearest as N

    rng = np.random.default_rng(3)
    p, x = rng.standard_normal((60, 8)), rng.standard_normal((40, 8))
    protos = spark.createDataFrame([(f"p{i:02}", v.tolist()) for i, v in enumerate(p)] + [("null", None)], "k string, v array<double>")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, [0.0] * 8)], "id int, e array<double>")

    def run(**kw):
        return {r.id: [(n.label, round(n.cosine, 9)) for n in r.nearest] for r in N.nearest(rows, "e", protos, "k", "v", **kw).collect()}

    whole = {"one": run(), "three": run(ordered=3), "all": run(ordered=None, floor=0.3)}
    monkeypatch.setattr(N, "BLOCK", 7)
    assert whole == {"one": run(), "three": run(ordered=3), "all": run(ordered=None, floor=0.3)}
    cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (p / np.linalg.norm(p, axis=1, keepdims=True)).T
    assert [n for n, _ in whole["three"][0]] == [f"p{j:02}" for j in np.argsort(-cos[0])[:3]]
    assert {len(v) for k, v in whole["all"].items() if k != 99} == {int(n) for n in (cos >= 0.3).sum(axis=1)}
    assert whole["one"][99] == [("p00", 0.0)]


def test_closed_sets_of_long_baskets(spark):
    """A set of the longest size isn't closed if its owners have one more item in common; more items than one word of bits holds."""
    rows = [(o, f"i{j:03}") for o in range(6) for j in range(4)] + [(o, f"j{j:03}") for o in range(9) for j in range(70) if o < 3 or j < 2]
    sets = frequent_itemsets(spark.createDataFrame(rows, "o int, i string").filter("i < 'j002' or o < 0"), "o", "i", 6, 3)
    closed = {tuple(r["items"]): r.support for r in closed_itemsets(sets).collect()}
    assert closed == {("j000", "j001"): 9}
    wide = frequent_itemsets(spark.createDataFrame([(o, f"i{j:03}") for o in range(3) for j in range(65)] + [(9, "i000"), (9, "i001")], "o int, i string"), "o", "i", 3, 2)
    assert {tuple(r["items"]) for r in closed_itemsets(wide).collect()} == {("i000", "i001")}
