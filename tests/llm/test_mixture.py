from __future__ import annotations

import os
import random

import pytest

from tidewatch.llm import mixture as M

pytestmark = pytest.mark.skipif(not os.path.isdir(M.TOKENIZER_DIR), reason="no tokenizers")


def sainte_lague(seats, share, cap):
    got = dict.fromkeys(share, 0)
    for _ in range(min(seats, sum(cap[k] for k, s in share.items() if s > 0))):
        k = max((k for k in share if got[k] < cap[k] and share[k] > 0), key=lambda k: (share[k] / (2 * got[k] + 1), [-ord(c) for c in k]))
        got[k] += 1
    return got


def test_apportion_against_one_seat_at_a_time():
    rng = random.Random(4)
    for _ in range(40):
        share = {f"s{i:02}": rng.choice([0, 0.1, 0.25, rng.random()]) for i in range(rng.randrange(1, 9))}
        cap = {k: rng.choice([0, 3, 50, 10**6]) for k in share}
        seats = rng.randrange(120)
        assert M.apportion(seats, share, cap) == sainte_lague(seats, share, cap)


def test_apportion_edges():
    assert M.apportion(5, {}, {}) == {}
    assert M.apportion(0, {"a": 1.0}, {"a": 9}) == {"a": 0}
    assert M.apportion(10**9, {"a": 0.5, "b": 0.5}, {"a": 10**12, "b": 3}) == {"a": 10**9 - 3, "b": 3}


def documents(rng, sources):
    rows, n = [], 0
    for s, k, words in sources:
        for _ in range(k):
            rows.append((n, s, " ".join(f"word{rng.randrange(999)}" for _ in range(words))))
            n += 1
    return rows


@pytest.fixture
def folder(write):
    rows = documents(random.Random(0), [("big", 300, 60), ("mid", 100, 60), ("small", 10, 40), ("unwanted", 20, 50)])
    rows += [(900 + i, "small", rows[-25][2]) for i in range(30)] + [(950, "big", None), (951, "big", ""), (952, None, "no source")]
    goals = [("big", 0.5, 2), ("mid", 0.25, 3), ("small", 0.2, 2), ("none", 0.05, 4)]
    return rows, goals, write(documents=(rows, "doc_id long, source string, text string"), mix_targets=(goals, "source string, target_share double, max_repeats int"))


def test_found(spark, folder):
    _, _, d = folder
    assert {r.source for r in M.p7_found(spark, d).collect()} == {"small", "none"}


def test_mixture_respects_caps_and_shares(spark, folder):
    rows, goals, d = folder
    text = {i: t for i, _, t in rows}
    cap = {s: r for s, _, r in goals}
    taken = M.p7_mixture(spark, d).collect()
    assert len({(r.source, text[r.doc_id]) for r in taken}) == len(taken)
    assert all(1 <= r.repeats <= cap[r.source] for r in taken)
    assert M.p7_mixture(spark, d).orderBy("doc_id").collect() == sorted(taken, key=lambda r: r.doc_id)
    shares = {r.source: r for r in M.p7_shares(spark, d).collect()}
    assert set(shares) == set(cap)
    assert shares["none"].tokens == 0
    assert abs(shares["big"].actual_share / shares["mid"].actual_share - 2) < 0.1
    assert sum(r.actual_share for r in shares.values()) == pytest.approx(1, abs=1e-4)


def test_long_text_is_counted_in_pieces(spark):
    df = spark.createDataFrame([(1, "ab " * 150_000), (2, None)], "id int, text string")
    got = {r.id: r.tokens for r in M.count_tokens(df, "text").collect()}
    assert 150_000 <= got[1] <= 300_010
    assert got[2] == 0


def test_long_texts_are_cut_where_tokens_break():
    rng = random.Random(2)
    parts = ["word", "it's", "  two", "tab\tstop", "x=1,y=2", "été", "12345", "\n\nline", "日本語", "don't!", "a"]
    text = " ".join(rng.choice(parts) for _ in range(3000))
    enc = M._encoding(M.TOKENIZER_DIR, M.VOCABULARY)
    whole = len(enc.encode_ordinary(text))
    old, M.PIECE = M.PIECE, 50
    try:
        pieces = M._pieces(text)
    finally:
        M.PIECE = old
    assert len(pieces) > 100
    assert "".join(pieces) == text
    assert sum(len(enc.encode_ordinary(p)) for p in pieces) == whole


def plan_of(texts, goals, blocks, total=None):
    have, copies = {}, 0
    for s, n in texts:
        have[s] = have.get(s, 0) + n
        copies += n
    total = total or copies
    size = max(1, total // blocks)
    cap = {s: have.get(s, 0) * r for s, _, r in goals}
    q = M.apportion(total // size, {s: t for s, t, _ in goals}, {s: -(-n // size) for s, n in cap.items()})
    return {s: {"target_share": t, "tokens": have.get(s, 0), "max_repeats": r, "capacity": cap[s], "total": total, "size": size, "blocks": q[s], "wanted": min(q[s] * size, cap[s])} for s, t, r in goals}


@pytest.mark.parametrize("times", [0.01, 0.1, 1, 10, 100])
def test_delivery_at_any_block_size(spark, times):
    """Blocks of a hundredth of a bucket of texts to a hundred of them: each source delivers its quota to within a block or a text."""
    rng = random.Random(7)
    rows = [(i, s, f"t{i}", n) for i, (s, n) in enumerate((s, rng.choice([3, 20, 60, 150])) for s, k in [("big", 1500), ("mid", 700), ("small", 60), ("tiny", 2)] for _ in range(k))]
    goals = [("big", 0.4, 2), ("mid", 0.4, 3), ("small", 0.15, 4), ("tiny", 0.04, 2), ("none", 0.01, 2)]
    bucket = 2_000
    total = sum(r[3] for r in rows)
    plan = plan_of([(r[1], r[3]) for r in rows], goals, max(1, int(total / (bucket * times))))
    df = spark.createDataFrame([(i, s, t, n, n) for i, s, t, n in rows], "doc_id long, source string, text_id string, tokens long, copy_tokens long")
    got = M.mixture(df, plan, bucket_tokens=bucket).collect()
    assert len({r.doc_id for r in got}) == len(got)
    for s, p in plan.items():
        mine = [r for r in got if r.source == s]
        assert all(1 <= r.repeats <= p["max_repeats"] for r in mine)
        assert abs(sum(r.tokens * r.repeats for r in mine) - p["wanted"]) <= max(p["size"], 150), (s, p)
    # Nothing of the wanted size is lost but the part of a block that a full source leaves open, and the rest of the division into blocks.
    assert sum(p["wanted"] for p in plan.values()) >= min(total, sum(p["capacity"] for p in plan.values())) - (len(plan) + 1) * p["size"]


def test_blocks_keep_the_seeded_order(spark):
    """Blocks are runs of the seeded order, however many buckets it is put together from."""
    texts = [(i, "s", f"t{i}", 1 + i % 7, 1) for i in range(500)]
    df = spark.createDataFrame(texts, "doc_id long, source string, text_id string, tokens long, copy_tokens long")
    plan = plan_of([("s", t[3]) for t in texts], [("s", 1.0, 1)], 40)
    one = {r.doc_id: r.block for r in M.in_blocks(df, plan, bucket_tokens=10**9).collect()}
    old, M.BUCKETS_TOGETHER = M.BUCKETS_TOGETHER, 4
    try:
        many = {r.doc_id: r.block for r in M.in_blocks(df, plan, bucket_tokens=60).collect()}
    finally:
        M.BUCKETS_TOGETHER = old
    assert one == many
    assert len(set(one.values())) == 40 or len(set(one.values())) == 41


def test_quotas_decide_short_sources(monkeypatch):
    goals = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 1), ("d", 0.0, 3)]
    plan = plan_of([("a", 6000), ("b", 1000), ("c", 3000), ("d", 10)], goals, 20_000)
    assert M.short_sources(plan) == ["b"]
    monkeypatch.setattr(M, "apportion", lambda seats, share, cap: dict.fromkeys(share, 0))
    assert M.short_sources(plan) == []


def test_shares_against_plain_counting(spark, folder):
    rows, goals, d = folder
    enc = M._encoding(M.TOKENIZER_DIR, M.VOCABULARY)
    once = {(s, t): len(enc.encode_ordinary(t)) for _, s, t in rows if t}
    text = {i: t for i, _, t in rows}
    used = {}
    for r in M.p7_mixture(spark, d).collect():
        used[r.source] = used.get(r.source, 0) + r.repeats * once[r.source, text[r.doc_id]]
    whole = sum(used.values())
    got = {r.source: (r.tokens, r.actual_share) for r in M.p7_shares(spark, d).collect()}
    assert got == {s: (used.get(s, 0), round(used.get(s, 0) / whole, 6)) for s, _, _ in goals}


def test_empty(spark, write):
    d = write(documents=([], "doc_id long, source string, text string"), mix_targets=([("a", 1.0, 2)], "source string, target_share double, max_repeats int"))
    assert M.p7_mixture(spark, d).count() == 0
    assert [r.tokens for r in M.p7_shares(spark, d).collect()] == [0]
