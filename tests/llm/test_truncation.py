from __future__ import annotations

import random

import numpy as np
import pytest

from tidewatch.llm import truncation as T

SCHEMA = "doc_id long, source string, kind string, text string"
NOUN, VERB = ["sensor", "archive", "cluster", "banner", "operator", "baseline"], ["moved", "retried", "opened", "checked", "compared"]


def sentence(rng):
    return f"The {rng.choice(NOUN)} {rng.choice(VERB)} the {rng.choice(NOUN)} after run {rng.randrange(200)}."


def corpus(n=700, seed=0):
    rng = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        if i % 4 == 3:
            t = "\n".join(rng.choice(["uptime", "ls -la /tmp", "cat /proc/version", f"ping -c 3 10.0.0.{rng.randrange(99)}"]) for _ in range(12)) + "\nexit"
            kind, source = "stream", "tape"
        else:
            t = " ".join(sentence(rng) for _ in range(rng.randrange(4, 12)))
            if i % 9 == 0:
                t += "\n-- day desk"
            kind, source = "prose", "limited" if i % 3 == 0 else "free"
        if i % 10 == 0:
            cut.add(i)
            at = len(t) // 2
            while not (t[at - 1].isalnum() and t[at].isalnum()):
                at += 1
            t = t[:at] + ("…" if i % 40 == 0 else "")
        rows.append((i, source, kind, t))
    rows += [(n, "free", "prose", None), (n + 1, "free", None, ""), (n + 2, None, None, "  "), (n + 3, "free", "prose", rows[0][3]), (n + 4, "free", "prose", "word " * 100_000 + "end.")]
    return rows, cut | {n + 3}


def test_finds_cut_texts(spark, write):
    rows, cut = corpus()
    d = write(documents=(rows, SCHEMA))
    got = {r.doc_id for r in T.p8_found(spark, d).collect()}
    assert len(got & cut) / len(cut) >= 0.95
    assert len(got & cut) / len(got) >= 0.95
    assert not got & {700, 701, 702}
    rates = {r.source: r for r in T.p8_rates(spark, d).collect()}
    assert sum(r.documents for r in rates.values()) == len(rows)
    assert sum(r.cut for r in rates.values()) == len(got)


def test_held_out_cuts(spark):
    """Texts cut artificially, none of which the fit saw."""
    rows, _ = corpus(500, 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    counts = T.inner_word_counts(docs)
    w = T.train(T.with_limit(docs, T.source_limits(docs)), counts)
    rng = np.random.default_rng(3)
    fresh, cut = corpus(200, 2)
    held = []
    for i, s, k, t in fresh:
        if i not in cut and t and t.strip() and len(t) < 10_000:
            held.append((2 * i, s, k, t))
            held += [(2 * i + 1, s, k, c) for c in T.cut_places(t, rng, 1)]
    df = T.with_limit(spark.createDataFrame(held, SCHEMA), T.source_limits(docs))
    said = {r.doc_id: r.score >= T.THRESHOLD for r in T.score_all(df, counts, w).collect()}
    right = np.mean([v == (k % 2 == 1) for k, v in said.items()])
    assert right >= 0.95


def test_cut_places_avoid_ends():
    rng = np.random.default_rng(0)
    text = "One two three four. Five six seven eight nine ten. Eleven twelve."
    for _ in range(200):
        for c in T.cut_places(text, rng, 2):
            assert text.startswith(c)
            assert not c.rstrip().endswith(".")
    assert T.cut_places("short", rng, 2) == []


@pytest.mark.parametrize("rows", [[], [(1, "a", "prose", None)], [(1, "a", "prose", "x"), (2, None, None, "")]])
def test_nothing_to_learn_from(spark, write, rows):
    d = write(documents=(rows, SCHEMA))
    assert T.p8_found(spark, d).count() == 0
    assert T.p8_rates(spark, d).count() == len({r[1] for r in rows})
