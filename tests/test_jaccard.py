"""Mean pairwise Jaccard similarity against brute force, in one block and in several, without writing pairs down."""

from __future__ import annotations

import itertools
import random

import pytest

from tidewatch.plans import views as W

SCHEMA = "sensor string, session_id string, playbook_id string, command_set array<string>, rolled_up_at bigint, login_fail_count bigint"


@pytest.fixture
def sets(spark, tmp_path):
    rng = random.Random(3)
    names = [f"h{i}" for i in range(60)]
    out = {p: [[None, *{rng.choice(names[: rng.choice([4, 20, 60])]) for _ in range(rng.randint(1, 9))}] for _ in range(n)] for p, n in (("a", 120), ("b", 40), ("c", 1), ("d", 2))}
    rows = [(p, f"{i}", p, hs, 0, 0) for p, all_ in out.items() for i, hs in enumerate(all_)] + [("e", "0", "a", [None], 0, 0), ("e", "1", "a", None, 0, 0), ("e", "2", "f", [], 0, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/sessions_rollup.parquet")
    return str(tmp_path), {p: [frozenset(hs) - {None} for hs in all_] for p, all_ in out.items()}


@pytest.mark.parametrize(("block", "tile"), [(16_384, 1_024), (16_384, 16), (25, 8), (3, 1_024)])
def test_mean_over_all_pairs(spark, monkeypatch, sets, block, tile):
    monkeypatch.setattr(W, "SETS_IN_BLOCK", block)
    monkeypatch.setattr(W, "_TILE", tile)
    d, of = sets
    got = {r.playbook_id: (r.sessions, r.mean_jaccard) for r in W.pairwise_jaccard(spark, d).collect()}
    assert set(got) == set(of)
    for p, all_ in of.items():
        each = [len(x & y) / len(x | y) for x, y in itertools.combinations(all_, 2)]
        assert got[p][0] == len(all_)
        assert got[p][1] == (pytest.approx(sum(each) / len(each), abs=1.1e-6) if each else None)


def test_sums_of_many_sets_with_rare_and_common_commands():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    sets = sorted({tuple(sorted({f"c{k}" for k in np.minimum(rng.zipf(1.4, rng.integers(1, 9)), 400)})) for _ in range(600)})
    w = rng.integers(1, 4, len(sets))
    left = rng.random(len(sets)) < 0.4
    make = lambda x, y: pa.table({"playbook_id": ["p"] * len(sets), "x": [x] * len(sets), "y": [y] * len(sets), "left": left, "hs": [list(s) for s in sets], "w": w})
    f = lambda i, j: w[i] * w[j] * len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]})
    n = range(len(sets))
    assert W._jaccard_sums(make(0, 0))["sum"][0].as_py() == pytest.approx(sum(f(i, j) for i, j in itertools.combinations(n, 2)))
    assert W._jaccard_sums(make(0, 1))["sum"][0].as_py() == pytest.approx(sum(f(i, j) for i in n for j in n if left[i] and not left[j]))


def test_no_pairs_are_shuffled(spark, sets):
    plan = W.pairwise_jaccard(spark, sets[0])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
    assert ", h#" not in plan
