"""Problem 1: records that differ only in formatting, collapsed to one with an exact copy count.

Every record gets a canonical key (its words in order, lower case; runs of
adjacent name=value fields put in name order).  Records are range-partitioned on
(key, tie-breaker) and externally sorted, so equal keys lie side by side; a scan
compares the full keys of neighbours and emits each run's representative, copies
and members.  The tie-breaker lets a run of one key spread over several
partitions, so a hot key isn't one task's work; only each partition's first and last
run can go on in the next, and these few are merged afterwards.  Members come out in
order, in lists of at most PAIR_BLOCK, and pairs are listed list against list.

Defined cases: a null line has a null key and is left out; a line without any
letter or digit has the empty key; exact repeats count as copies; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, table

QUOTES = "\"'`‘’“”«»"
NAME = r"[\p{L}\p{N}_.\-]"
FIELD = rf"(?<!{NAME}){NAME}++[{QUOTES}\\]*+=[{QUOTES}\\]*+[^\s,;&|<>()?\x01-\x03]+"
#: Members of one group are paired list against list; this is a list's longest.
PAIR_BLOCK = 512


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def canonical_key(line: Column) -> Column:
    """The words of `line`, with adjacent name=value fields in order.  Linear in the line's length."""
    marked = F.regexp_replace(F.regexp_replace(line, r"[\x01-\x03]", " "), FIELD, "\u0001$0\u0002")
    joined = F.regexp_replace(marked, "\u0002[^\\p{L}\\p{N}\u0001]*+\u0001", "\u0003")
    parts = F.transform(
        F.split(joined, "[\u0001\u0002]"),
        lambda s, i: F.when(i % 2 == 1, F.array_join(F.array_sort(F.transform(F.split(s, "\u0003"), _words)), " ")).otherwise(_words(s)),
    )
    return F.array_join(F.filter(parts, lambda s: s != ""), " ")


def _laid(df: DataFrame, key: str, tie: str, *more: str) -> DataFrame:
    """Rows with a key, range-partitioned and sorted; the key is worked out once, into a written table."""
    rows = cut_lineage(df.select(F.col(key).alias("key"), F.col(tie).alias("tie"), *more).filter(F.col("key").isNotNull()))
    order = [F.col("key").asc(), F.col("tie").asc_nulls_last()]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def _starts(keys: pa.Array) -> np.ndarray:
    """Indices at which a row's full key differs from the row before; the first row starts a run."""
    if len(keys) < 2:
        return np.arange(len(keys))
    differs = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(differs) + 1])


def sorted_runs(df: DataFrame, key: str, tie: str, weight: str | None = None) -> DataFrame:
    """One row per `key`: `key`, `representative` (least `tie`), `copies`, and `rows`.

    `weight` is the number of copies a row stands for (1 if not given).  Null keys are dropped.
    """
    w = (F.col(weight) if weight else F.lit(1)).cast("long").alias("w")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: pa.Array, tie: pa.Array, copies: np.ndarray, rows: np.ndarray, edge: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([key, tie, pa.array(copies), pa.array(rows), pa.array(np.full(len(rows), edge))], names=["key", "representative", "copies", "rows", "edge"])

        held, first = None, True  # the run still open: key, tie, copies, rows
        for b in batches:
            if not b.num_rows:
                continue
            keys, ties = b.column("key"), b.column("tie")
            at = _starts(keys)
            copies = np.add.reduceat(b.column("w").to_numpy(), at)
            rows = np.diff(np.concatenate([at, [b.num_rows]]))
            k, t = keys.take(pa.array(at)), ties.take(pa.array(at))
            if held and held[0].equals(k.slice(0, 1)):
                copies[0] += held[2]
                rows[0] += held[3]
                t = pa.concat_arrays([held[1], t.slice(1)])
            elif held:
                k, t = pa.concat_arrays([held[0], k]), pa.concat_arrays([held[1], t])
                copies, rows = np.concatenate([[held[2]], copies]), np.concatenate([[held[3]], rows])
            done = len(rows) - 1
            if done and first:
                yield out(k.slice(0, 1), t.slice(0, 1), copies[:1], rows[:1], True)
            if done > first:
                yield out(k.slice(int(first), done - first), t.slice(int(first), done - first), copies[first:done], rows[first:done], False)
            first = first and not done
            held = (k.slice(done, 1), t.slice(done, 1), int(copies[done]), int(rows[done]))
        if held:
            yield out(held[0], held[1], np.array([held[2]]), np.array([held[3]]), True)

    runs = _laid(df, key, tie, w).mapInArrow(scan, f"key string, representative {df.schema[tie].dataType.simpleString()}, copies bigint, rows bigint, edge boolean")
    runs = cut_lineage(runs)
    cut = runs.filter("edge").groupBy("key").agg(F.min("representative").alias("representative"), F.sum("copies").alias("copies"), F.sum("rows").alias("rows"))
    return runs.filter("not edge").drop("edge").unionByName(cut)


def run_lists(df: DataFrame, key: str, tie: str) -> DataFrame:
    """(grp, list, lists, members): the different members of each key that has several, in lists of at most PAIR_BLOCK, in order.

    Null members are left out.  `list` numbers a group's lists from 0, `lists` is how many there are.
    """
    size = PAIR_BLOCK

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        names = ["run", "list", "members", "key", "lists"]

        def lists(run: np.ndarray, no: np.ndarray, ties: pa.Array, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            """Member lists: `ties` from `at` on, `n` of them."""
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            take = np.repeat(at - offsets[:-1], n) + np.arange(offsets[-1])
            values = pa.ListArray.from_arrays(pa.array(offsets), ties.take(pa.array(take)))
            return pa.RecordBatch.from_arrays([pa.array(part + run), pa.array(no), values, pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.int64())], names=names)

        def told(runs: list[int], keys: list, lists: list[int]) -> pa.RecordBatch:
            none = pa.nulls(len(runs), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array([part + r for r in runs], pa.int64()), pa.nulls(len(runs), pa.int64()), none, pa.array(keys, pa.string()), pa.array(lists, pa.int64())], names=names)

        held, run, no = None, 0, 0  # the open run's last list, its run and its number in the run
        for b in batches:
            if not b.num_rows:
                continue
            keys, ties = b.column("key"), b.column("tie")
            if held:
                keys, ties = pa.concat_arrays([held[0], keys]), pa.concat_arrays([held[1], ties])
            fresh = np.zeros(len(keys), bool)
            fresh[_starts(keys)] = True
            fresh[_starts(ties)] = True
            keys, ties = keys.filter(pa.array(fresh)), ties.filter(pa.array(fresh))
            at = _starts(keys)
            n = np.diff(np.concatenate([at, [len(keys)]]))
            per = -(-n // size)
            of = np.repeat(np.arange(len(n)), per)  # the run of each list
            nth = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
            begin, count = at[of] + nth * size, np.minimum(n[of] - nth * size, size)
            number = nth + np.where(of == 0, no, 0)
            # All lists but the last are complete.  A run of one row has no pairs, unless it may go on in another partition.
            show = ((n[of] > 1) | (number > 0) | (of + run == 0))[:-1]
            if show.any():
                yield lists(of[:-1][show] + run, number[:-1][show], ties, begin[:-1][show], count[:-1][show])
            ended = np.flatnonzero((np.diff(of) > 0) & ((number[:-1] > 0) | (of[:-1] + run == 0)))
            if len(ended):
                edge = of[ended] + run == 0
                yield told((of[ended] + run).tolist(), [keys[int(at[of[i]])].as_py() if e else None for i, e in zip(ended, edge, strict=True)], (number[ended] + 1).tolist())
            last = int(begin[-1])
            held, run, no = (keys.slice(last), ties.slice(last)), run + int(of[-1]), int(number[-1])
        if held:
            yield lists(np.array([run]), np.array([no]), held[1], np.array([0]), np.array([len(held[1])]))
            yield told([run], [held[0][0].as_py()], [no + 1])

    members = df.select(F.col(key).alias("key"), F.col(tie).cast("string").alias("tie")).filter(F.col("tie").isNotNull())
    found = cut_lineage(_laid(members, "key", "tie").mapInArrow(scan, "run bigint, list bigint, members array<string>, key string, lists bigint"))
    told = found.filter("members is null").select("run", "key", "lists")
    # First and last runs of partitions, at most two per partition: those with one key are one group.
    w = Window.partitionBy("key").orderBy("run")
    edges = told.filter("key is not null").select(
        "run", F.min("run").over(w).alias("grp"), F.coalesce(F.sum("lists").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"),
        F.sum("lists").over(Window.partitionBy("key")).alias("all"),
    )
    long = told.filter("key is null").select("run", F.col("run").alias("grp"), F.lit(0).cast("long").alias("before"), F.col("lists").alias("all"))
    return (
        found.filter("members is not null")
        .select("run", "list", "members")
        .join(edges.unionByName(long), "run", "left")
        .select(F.coalesce("grp", "run").alias("grp"), (F.col("list") + F.coalesce("before", F.lit(0))).alias("list"), F.coalesce("all", F.lit(1)).alias("lists"), "members")
    )


def list_pairs(lists: DataFrame) -> DataFrame:
    """(grp, a, b): all pairs of a group's members, in their order, list against list; a pair of lists meets in one place."""
    inside = (
        lists.select("grp", "members", F.posexplode("members").alias("i", "a"))
        .select("grp", "a", F.explode(F.slice("members", F.col("i") + 2, F.size("members"))).alias("b"))
    )
    cells = lists.filter("lists > 1").select("grp", "list", "members", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lists") - 1)).alias("other")).filter(F.col("list") != F.col("other"))
    x = cells.filter("list < other").select("grp", F.col("list").alias("x"), F.col("other").alias("y"), F.col("members").alias("left"))
    y = cells.filter("list > other").select("grp", F.col("other").alias("x"), F.col("list").alias("y"), F.col("members").alias("right"))
    across = x.join(y, ["grp", "x", "y"]).select("grp", F.explode("left").alias("a"), "right").select("grp", "a", F.explode("right").alias("b"))
    return inside.unionByName(across)


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "commands").filter(F.col("command_line").isNotNull() & F.col("command_hash").isNotNull())
    return c.select("command_hash", canonical_key(F.col("command_line")).alias("key"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of command hashes whose lines are the same record."""
    pairs = list_pairs(run_lists(_commands(spark, sf_dir), "key", "command_hash"))
    return pairs.select(F.col("a").alias("hash_a"), F.col("b").alias("hash_b"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record over commands and raw_events: representative line, stored spellings, events.

    An event counts once however often it was delivered (event_id); a stored
    command without events counts no copy.  Each spelling is canonicalised once.
    """
    events = (
        table(spark, sf_dir, "raw_events")
        .filter(F.col("command_line").isNotNull())
        .groupBy("event_id")
        .agg(F.min("command_line").alias("line"))
        .groupBy("line")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    stored = table(spark, sf_dir, "commands").filter(F.col("command_line").isNotNull()).select(F.col("command_line").alias("line"), F.lit(0).cast("long").alias("n"))
    spelled = events.unionByName(stored).withColumn("key", canonical_key(F.col("line")))
    runs = sorted_runs(spelled, "key", "line", "n")
    return runs.select(F.substring(F.sha2("key", 256), 1, 16).alias("record_id"), F.col("representative").alias("command_line"), F.col("copies").alias("events"))


def p1_cache_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment cache by record: how many cached hashes and cache rows one command has.

    Hashes without a stored command keep their own row, with the hash as record.
    """
    cache = table(spark, sf_dir, "enrichment_cache").groupBy("command_hash").agg(F.count(F.lit(1)).alias("n"))
    keyed = cache.join(_commands(spark, sf_dir), "command_hash", "left").withColumn("key", F.coalesce("key", F.concat(F.lit("\u0001"), F.col("command_hash"))))
    runs = sorted_runs(keyed, "key", "command_hash", "n")
    return runs.select(F.col("representative").alias("command_hash"), F.col("copies").alias("cache_rows"), F.col("rows").alias("cached_hashes"))


QUERIES = {"p1_found": p1_found, "p1_records": p1_records, "p1_cache_records": p1_cache_records}
SQL: dict[str, str] = {}
