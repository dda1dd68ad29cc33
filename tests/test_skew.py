from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.skew import balanced_distinct_counts, balanced_join, fragment, pack, plan_placement


@pytest.fixture(scope="module")
def facts(spark):
    """Key "hot" holds a third of the rows, one key is null, rows repeat."""
    rows = [("hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{i % 400}", i // 2, f"s{i}") for i in range(6000)]
    return spark.createDataFrame(rows + rows[:500], "ip string, sid long, __note string")


def test_counts_match_plain(facts):
    got, p = balanced_distinct_counts(facts, "ip", ["sid"], {}, {}, tasks=8)
    want = facts.groupBy("ip").agg(F.count_distinct("sid").alias("n"))
    assert {(r.ip, r.n) for r in got.collect()} == {(r.ip, r.n) for r in want.collect()}
    assert len(p.shards["hot"]) >= 3


def test_load_is_even(facts):
    p = plan_placement(facts, "ip", 8)
    assert max(p.task_load) < 1.3 * p.total / 8
    sizes = fragment(facts, "ip", ["sid"], p).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 1.6 * p.total / 8


def test_repeats_meet_inside_a_shard(facts):
    p = plan_placement(facts, "ip", 8)
    parts = fragment(facts, "ip", ["sid"], p).groupBy("ip", "sid").agg(F.count_distinct("__task").alias("t"))
    assert parts.filter("t > 1").count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join(spark, facts, how):
    side = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4)], "ip string, v int")
    p = plan_placement(facts, "ip", 8)
    got = balanced_join(facts, side, "ip", ["sid"], p, how).select("ip", "sid", "v")
    want = facts.join(side, "ip", how).select("ip", "sid", "v")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_empty(spark):
    df = spark.createDataFrame([], "ip string, sid long")
    got, p = balanced_distinct_counts(df, "ip", ["sid"], {}, {})
    assert got.count() == 0
    assert p.total == 0


def test_bad_join_kind(spark, facts):
    with pytest.raises(ValueError, match="inner or left"):
        balanced_join(facts, facts, "ip", ["sid"], plan_placement(facts, "ip", 2), "full")


def test_pack_is_longest_first():
    placed, load = pack([(5, "a"), (3, "b"), (3, "c"), (1, "d")], 2)
    assert sorted(load) == [6, 6]
    assert len(placed) == 4
