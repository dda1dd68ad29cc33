from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import records as R

SAME = [
    ["wget --tries=3 --user=ab http://x/y.tgz", "WGET  --user=AB '--tries=3' http://x//y.tgz;", "$ wget “--tries=3” --user=ab http://x/./y.tgz |"],
    ["mount -o uid=1,gid=2,label=z /a /b", "mount -o gid=2,label=z,uid=1 /a /b", "MOUNT -O LABEL=Z,UID=1,GID=2 /A//B"],
    ["curl -d 'user=a&mark=b&port=3' http://h/up", "curl -d 'port=3&user=a&mark=b' http://h/up"],
    ["A=1 B=2 run", "b=2  a=1 RUN"],
    ["curl http://h/get?id=7&arch=arm | sh", "curl http://h/get?arch=arm&id=7 | sh"],
    ["échelle à côté", "ÉCHELLE  À CÔTÉ!"],
]
APART = [
    ("run a=1 b=2", "run a=2 b=1"),
    ("run a=1 x b=2", "run b=2 x a=1"),
    ("free -m", "-m free"),
    ("run --threads=76", "run --threads=7 6"),
    ("rm x", "rm x y"),
    ("cp a b", "cp b a"),
]


def key(spark, *lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    return [r.k for r in df.select("i", R.canonical_key(F.col("line")).alias("k")).orderBy("i").collect()]


@pytest.mark.parametrize("lines", SAME)
def test_spellings_of_one_record(spark, lines):
    assert len(set(key(spark, *lines))) == 1


@pytest.mark.parametrize(("a", "b"), APART)
def test_look_alikes(spark, a, b):
    x, y = key(spark, a, b)
    assert x != y


def test_null_empty_long(spark):
    fields = " ".join(f"k{i}=v{i}" for i in range(20000))
    turned = " ".join(f"k{i}=v{i}" for i in reversed(range(20000)))
    word = "a" * 300_000
    got = key(spark, None, "", " ;; ", fields, turned, word, "\u0001a=1\u0002b=2\u0003")
    assert got[:3] == [None, "", ""]
    assert got[3] == got[4]
    assert got[5] == word
    assert got[6] == "a 1 b 2"


def brute(line):
    """Independent reading of the rule: words, with maximal runs of adjacent fields sorted."""
    out, run = [], []
    for chunk in re.split(r"[\s,;&|<>()?]+", line.lower()):
        words = re.findall(r"[^\W_]+", chunk)
        if not words:
            continue
        name, eq, val = chunk.partition("=")
        if eq and re.search(r"[^\W_]", name) and re.search(r"[^\W_]", val):
            run.append(" ".join(re.findall(r"[^\W_]+", name) + re.findall(r"[^\W_]+", val)))
        else:
            out += [*sorted(run), *words]
            run = []
    return " ".join([*out, *sorted(run)])


def test_random_lines_against_brute_force(spark):
    rng = random.Random(5)
    parts = ["ls", "-l", "a=1", "b=2", "c=x/y", "/tmp/z", ";", "d=4", "|", "echo"]
    lines = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 8))) for _ in range(300)]
    assert key(spark, *lines) == [brute(x) for x in lines]


def test_hot_key_counts(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 70}") for i in range(3000)] + [(-1, None)]
    df = spark.createDataFrame(rows, "id int, key string").withColumn("copies", F.lit("clash"))
    got = {r.key: (r.copies, r.representative) for r in R.sorted_runs(df, "key", "id").collect()}
    assert got["hot"] == (1000, 0)
    assert sum(c for c, _ in got.values()) == 3000
    assert None not in got


def test_all_pairs_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(R, "PAIR_BLOCK", 7)
    rows = [("big", f"m{i:03}") for i in range(40)] + [("small", "a"), ("small", "b"), ("alone", "x"), (None, "y"), (None, "z"), ("big", None), ("small", "a")]
    lists = R.run_lists(spark.createDataFrame(rows, "k string, m string").withColumn("key", F.lit("clash")), "k", "m")
    got = [(r.a, r.b) for r in R.list_pairs(lists).collect()]
    want = set(itertools.combinations([f"m{i:03}" for i in range(40)], 2)) | {("a", "b")}
    assert len(got) == len(want)
    assert set(got) == want
    assert all(len(r.members) <= 7 for r in lists.collect())


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("parts", ["1", "5", "23"])
def test_runs_over_partitions_and_batches(spark, monkeypatch, parts, adaptive):
    """A third of all rows in one run, cut by partition borders and Arrow batches."""
    monkeypatch.setattr(R, "PAIR_BLOCK", 8)
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(150)}", f"m{i:04}", 1 + i % 3) for i in range(420)]
    conf = {"spark.sql.shuffle.partitions": parts, "spark.sql.adaptive.enabled": adaptive, "spark.sql.execution.arrow.maxRecordsPerBatch": "11"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(rows, "key string, m string, w long")
        got = sorted((r.a, r.b) for r in R.list_pairs(R.run_lists(df, "key", "m")).collect())
        runs = {r.key: (r.representative, r.copies, r["rows"]) for r in R.sorted_runs(df, "key", "m", "w").collect()}
        n = R.sorted_runs(df, "key", "m", "w").count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    groups = {}
    for k, m, w in rows:
        groups.setdefault(k, []).append((m, w))
    assert got == sorted(p for g in groups.values() for p in itertools.combinations(sorted(m for m, _ in g), 2))
    assert runs == {k: (min(m for m, _ in g), sum(w for _, w in g), len(g)) for k, g in groups.items()}
    assert n == len(groups)


def test_the_scan_is_in_the_plan(spark, write):
    """Keys are sorted and scanned side by side; no aggregate by key stands in for it."""
    d = write(commands=([("a", "x y"), ("b", "X  y")], "command_hash string, command_line string"))
    seen = []
    real = R.cut_lineage
    R.cut_lineage = lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1]
    try:
        assert R.p1_found(spark, d).count() == 1
    finally:
        R.cut_lineage = real
    scan = next(p for p in seen if "MapInArrow" in p)
    assert "Sort" in scan
    assert "rangepartitioning" in scan
    assert not any("HashAggregate" in p for p in seen)


def test_queries(spark, write):
    lines = [x for g in SAME for x in g] + [x for p in APART for x in p] + ["", None, None]
    d = write(
        commands=([(f"h{i:02}", x) for i, x in enumerate(lines)], "command_hash string, command_line string"),
        raw_events=([(1, "A=1 B=2 run"), (1, "A=1 B=2 run"), (2, "b=2 a=1 run"), (3, None), (4, "other")], "event_id long, command_line string"),
        enrichment_cache=([("h00",), ("h00",), ("h01",), ("gone",)], "command_hash string"),
    )
    got = {(r.hash_a, r.hash_b) for r in R.p1_found(spark, d).collect()}
    want, i = set(), 0
    for g in SAME:
        want |= set(itertools.combinations([f"h{j:02}" for j in range(i, i + len(g))], 2))
        i += len(g)
    assert got == want
    events = {r.command_line: r.events for r in R.p1_records(spark, d).collect()}
    assert events["A=1 B=2 run"] == 2
    assert events["other"] == 1
    cache = {r.command_hash: (r.cache_rows, r.cached_hashes) for r in R.p1_cache_records(spark, d).collect()}
    assert cache == {"h00": (3, 2), "gone": (1, 1)}


def test_empty_tables(spark, write):
    d = write(commands=([], "command_hash string, command_line string"), raw_events=([], "event_id long, command_line string"), enrichment_cache=([], "command_hash string"))
    for q in R.QUERIES.values():
        assert q(spark, d).count() == 0
