from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import baskets as B


def fixture(spark):
    rng = random.Random(2)
    rows = [[rng.choice("abcdefgh") for _ in range(rng.randrange(6))] for _ in range(200)]
    rows += [["a", "b", None]] * 100 + [None, [], [None], ["a", "a"]]
    df = spark.createDataFrame([(r,) for r in rows], "items array<string>").withColumn("weight", F.lit("clash")).withColumn("basket", F.lit(1))
    return rows, df


def brute(rows, low):
    sets = [s for r in rows if (s := {x for x in (r or []) if x is not None})]
    one = Counter(x for s in sets for x in s)
    two = Counter(p for s in sets for p in combinations(sorted(s), 2))
    return len(sets), {(a, b): (n, one[a], one[b]) for (a, b), n in two.items() if n >= low(len(sets))}


@pytest.mark.parametrize(("count", "support"), [(1, 0.0), (20, 0.0), (2, 0.15)])
@pytest.mark.parametrize("limit", [20_000, 2])
def test_against_brute_force(spark, monkeypatch, count, support, limit):
    monkeypatch.setattr(B, "BROADCAST_ITEMS", limit)
    rows, df = fixture(spark)
    n, want = brute(rows, lambda n: max(count, support * n))
    out = B.associated_pairs(df, "items", count, support).collect()
    assert {(r.a, r.b): (r.n_ab, r.n_a, r.n_b) for r in out} == want
    for r in out:
        assert r.n == n
        assert r.lift == pytest.approx(r.n_ab * n / (r.n_a * r.n_b))
        if r.n_ab == r.n_a:
            assert r.conviction is None
        else:
            assert r.conviction == pytest.approx((1 - r.n_b / n) / (1 - r.n_ab / r.n_a))


def test_hot_basket_is_one_row(spark):
    df = spark.createDataFrame([(["x", "y"],)] * 500 + [(["y", "z"],)], "items array<string>")
    got = {tuple(r.basket): r.weight for r in B.collapse_baskets(df, "items").collect()}
    assert got == {("x", "y"): 500, ("y", "z"): 1}


def test_empty(spark):
    df = spark.createDataFrame([], "items array<string>")
    assert B.associated_pairs(df, "items").count() == 0
    assert B.associated_pairs(df, "items", 5, 0.1).count() == 0


def test_sessions_count_once(spark, write):
    s = "sensor string, session_id string, rolled_up_at timestamp, command_set array<string>"
    import datetime as dt

    t = [dt.datetime(2026, 1, 1 + i, tzinfo=dt.UTC) for i in range(3)]
    rows = [("e1", str(i), t[0], ["a", "b"]) for i in range(6)] + [("e1", "0", t[1], ["a", "b"]), ("e1", "0", t[1], ["a", "b"]), ("e2", "0", t[0], ["c"])]
    rows += [("e3", str(i), t[0], [f"x{i}"]) for i in range(20)] + [("e4", "0", t[2], None), ("e4", "1", t[2], [None])]
    d = write(sessions_rollup=(rows, s))
    assert [tuple(r) for r in B.p3_found(spark, d).collect()] == [("a", "b")]
    assert [(r.hash_a, r.hash_b, r.n_ab, r.n_a) for r in B.p3_pairs(spark, d).collect()] == [("a", "b", 6, 6)]
