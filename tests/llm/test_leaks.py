from __future__ import annotations

import random
import unicodedata

import numpy as np
import pytest

from tidewatch.llm import leaks as L

VOCAB = [f"w{i}" for i in range(60)] + ["größer", "écart", "naïve"]


def passage(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


def brute(docs, items, w=12):
    out = set()
    grams = {}
    for i, p in items:
        t = L.words(p or "")
        for k in range(len(t) - w + 1):
            grams.setdefault(tuple(t[k : k + w]), set()).add(i)
    for d, x in docs:
        t = L.words(x or "")
        for k in range(len(t) - w + 1):
            out |= {(d, i) for i in grams.get(tuple(t[k : k + w]), ())}
    return out


def fixture():
    rng = random.Random(1)
    items = [(i, " ".join(passage(rng, 30))) for i in range(25)] + [(90, None), (91, ""), (92, "too short"), (93, " ".join(VOCAB[:11]))]
    docs = []
    for d in range(120):
        filler = [f"f{rng.randrange(500)}" for _ in range(40)]
        words = items[d % 25][1].split()
        cut = rng.randrange(8, 20)
        at = rng.randrange(len(words) - cut)
        part = words[at : at + cut]
        text = " ".join([*filler[:20], *part, *filler[20:]])
        if d % 3 == 0:
            text = unicodedata.normalize("NFD", text.upper())
        if d % 5 == 0:
            text = text.replace(" ", " ... ", 30)
        docs.append((d, text))
    return docs + [(500, None), (501, ""), (502, "x"), (503, "y " * 200_000), (504, docs[0][1])], items


def test_found_against_brute_force(spark, write):
    docs, items = fixture()
    d = write(documents=([*docs, docs[1]], "doc_id long, text string"), eval_items=([(i, "s", p) for i, p in items], "item_id long, suite string, passage string"))
    got = [tuple(r) for r in L.p6_found(spark, d).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(docs, items)
    per_item = {r.item_id: r.documents for r in L.p6_items(spark, d).collect()}
    assert per_item[90] == 0
    assert sum(per_item.values()) == len(set(got))


def test_full_bit_fields_lose_nothing(spark, write, monkeypatch):
    """Where the fields sent to the tasks are full, everything goes through the join."""
    monkeypatch.setattr(L, "KEY_BITS", L.BITMAP)
    monkeypatch.setattr(L, "WORD_BITS", L.BITMAP)
    monkeypatch.setattr(L, "bit_field", lambda values, col, bits: np.full(bits // 8, 255, np.uint8))
    docs, items = fixture()
    docs = [d for d in docs if d[0] != 503]
    d = write(documents=(docs, "doc_id long, text string"), eval_items=([(i, "s", p) for i, p in items], "item_id long, suite string, passage string"))
    assert {tuple(r) for r in L.p6_found(spark, d).collect()} == brute(docs, items)


def test_sketches_never_drop_a_match():
    """A window within k edits lacks at most k of the other's words, so at most k bits of its sketch."""
    rng = np.random.default_rng(6)
    win = rng.integers(1, 1 << 62, (400, 12), dtype=np.uint64)
    low, high = L.sketches(win)
    for k in (1, 2):
        for way in ("random", "change", "insert", "delete"):
            x, _ = L._edited(win, way, k, rng)
            wide = np.concatenate([x, win[:, :1]], axis=1)  # more words only add bits
            a, b = L.sketches(wide)
            lack = np.bitwise_count(low & ~a) + np.bitwise_count(high & ~b)
            assert (lack <= k).all(), (k, way)


def test_bit_field(spark):
    values = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 3000)
    field = L.bit_field(spark.createDataFrame([(int(v),) for v in values], "v long"), "v", 1 << 20)
    assert L.has_bit(field, values.view(np.uint64)).all()
    assert L.has_bit(field, np.arange(1 << 20, dtype=np.uint64)).sum() == len({int(v) & ((1 << 20) - 1) for v in values})


def test_passage_in_a_third_of_the_documents(spark, write):
    docs, items = fixture()
    hot = [(1000 + i, f"start{i} {items[3][1]} end{i}") for i in range(150)]
    d = write(documents=([*docs, *hot], "doc_id long, text string"), eval_items=([(i, "s", p) for i, p in items], "item_id long, suite string, passage string"))
    assert {tuple(r) for r in L.p6_found(spark, d).collect()} == brute([*docs, *hot], items)


def test_without_tables_nothing_is_found(spark, write, monkeypatch):
    """The rows come through the sampled keys: keys that never agree leave none."""
    real = L.Walks.keys
    monkeypatch.setattr(L, "tables_for", lambda *a: 2)
    docs, items = fixture()
    seen = []

    def spoiled(wins, col, length, walks, window, side=None):
        seen.append(side)
        out = real_keyed(wins, col, length, walks, window, side)
        return out if side else out.withColumn("key", out["key"] + 1)

    real_keyed = L.keyed
    monkeypatch.setattr(L, "keyed", spoiled)
    d = write(documents=(docs, "doc_id long, text string"), eval_items=([(i, "s", p) for i, p in items], "item_id long, suite string, passage string"))
    assert L.p6_found(spark, d).count() == 0
    assert len(seen) == 2
    assert L.Walks.keys is real


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row


def test_edit_distance():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4, (50, 6)), rng.integers(0, 4, (50, 8))
    a, b = a + 1, b + 1
    assert L.edit_distance(a, b).tolist() == [min(levenshtein(list(x), list(y))) for x, y in zip(a, b, strict=True)]


def matches(spark, items, docs, edits):
    i = spark.createDataFrame(items, "item_id long, passage string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r.doc_id, r.item_id): r.edits for r in L.leaked_items(d, i, max_edits=edits, sought=edits).collect()}


def test_too_many_edits_do_not_match(spark):
    w = VOCAB[:12]
    docs = [(1, " ".join([*w[:5], "x", *w[6:]])), (2, " ".join([*w[:3], "x", *w[4:8], "y", *w[9:]])), (3, " ".join(w))]
    assert matches(spark, [(1, " ".join(w))], docs, 1) == {(1, 1): 1, (3, 1): 0}


@pytest.mark.parametrize("empty", ["documents", "eval_items"])
def test_empty(spark, write, empty):
    docs, items = fixture()
    tables = {"documents": (docs, "doc_id long, text string"), "eval_items": ([(i, "s", p) for i, p in items], "item_id long, suite string, passage string")}
    tables[empty] = ([], tables[empty][1])
    assert L.p6_found(spark, write(**tables)).count() == 0


def test_recall_of_fresh_edits(spark):
    """The share of edited windows found is at least the one aimed at, less what chance takes from 400, wherever the edits are."""
    rng = random.Random(5)
    items = [(i, " ".join(f"t{rng.randrange(3000)}" for _ in range(12))) for i in range(400)]
    places = {"any": lambda n: rng.randrange(n), "early": lambda n: rng.randrange(1, 4), "late": lambda n: n - rng.randrange(1, 4), "middle": lambda n: n // 2}
    docs, wanted = [], {}
    for k, (where, place) in enumerate(places.items()):
        for i, p in items:
            w = p.split()
            for _ in range(2):
                at = place(len(w))
                rng.choice([lambda: w.insert(at, "more"), lambda: w.pop(at), lambda: w.__setitem__(at, "other")])()  # noqa: B023
            docs.append((k * 1000 + i, "before " + " ".join(w) + " after"))
            wanted.setdefault(where, set()).add((k * 1000 + i, i))
    got = matches(spark, items, docs, 2)
    for where, pairs in wanted.items():
        assert len(pairs & set(got)) / len(pairs) >= 0.96, where
    assert max(got.values()) <= 2


def test_hopeless_recall_is_an_error(monkeypatch):
    monkeypatch.setattr(L, "HOPELESS", 3)
    monkeypatch.setattr(L, "SAMPLED", 36)
    L.tables_for.cache_clear()
    with pytest.raises(RuntimeError, match="tables find"):
        L.tables_for(12, 2)
    L.tables_for.cache_clear()
    with pytest.raises(ValueError, match="too short"):
        L.tables_for(3, 2)
    assert L.tables_for(12, 0) == 1


