"""Problem 7: mix sources to target shares of tokens, repeating small sources at most a capped number of times.

The wanted size is cut into BLOCKS blocks of equal tokens, whatever the volume.  Blocks are given to
sources by the Sainte-Lague rule (highest quotient share / (2 * blocks so far + 1)); a source leaves
when its capacity (distinct texts times max_repeats) is used up.  A source's texts lie side by side in
a seeded order; its shards are SHARD_BLOCKS blocks of that order, so a shard holds many blocks at every
volume.  The same rule gives a source's blocks to its shards, and inside a shard a seeded order of
blocks decides which are taken once more than others.  A text belongs to the block it starts in, so
blocks are uneven by a text; single blocks are then added or taken away until each source delivers its
quota to within one block (or its longest text, where that is longer).  If that fails, an error is raised.

The plan holds a row per block: at most BLOCKS and one more per source, whatever the volume.

Defined cases: null and empty texts hold no tokens and are left out; copies of a
text within a source count as one text (its least doc_id), so no text occurs more
than max_repeats times; sources missing from the targets get nothing; a target
without documents gets zero blocks and is reported; a null, zero or negative share or number of repeats gives nothing.
"""

from __future__ import annotations

import ast
import base64
import functools
import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, table

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Resolution of the mixture: one block is this part of the wanted size.
BLOCKS = 20_000
SHARD_BLOCKS = 64
#: Tokens one task puts into order at a time.
BUCKET_TOKENS = 2_000_000
#: Buckets whose sums one task adds up.
BUCKETS_TOGETHER = 4_096
SEED = 17
#: Texts longer than this are handed to the tokenizer in pieces, cut only where its pattern always breaks.
PIECE = 200_000
#: A single blank between two other characters always starts a new piece.
BREAK = re.compile(r"(?<=\S) (?=\S)")


@functools.lru_cache(maxsize=2)
def _encoding(folder: str, name: str):
    import tiktoken

    with open(os.path.join(folder, "__init__.py"), encoding="utf-8") as f:
        parsed = ast.parse(f.read())  # read as data, not run
    pattern = next(ast.literal_eval(n.value) for n in parsed.body if isinstance(n, ast.Assign) and getattr(n.targets[0], "id", "") == "PATTERN")
    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str) -> list[str]:
    """The text in pieces of about PIECE characters whose tokens add up to the text's; one piece where it has no break."""
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = BREAK.search(text, at + PIECE)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def count_tokens(df: DataFrame, text: str, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """Replaces column `text` by `tokens` and a 128-bit `text_id` (two hashes) of the whole text."""
    keep = [f for f in df.schema.fields if f.name != text]
    ided = df.withColumn("text_id", F.md5(F.col(text).cast("binary")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(folder, vocabulary)
        for b in batches:
            n = [0 if t is None else sum(len(enc.encode_ordinary(p)) for p in _pieces(t)) for t in b.pop(text)]
            yield b.assign(tokens=pd.Series(n, dtype="int64", index=b.index))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return ided.select(*[F.col(f"`{f.name}`") for f in keep], "text_id", text).mapInPandas(run, f"{schema}, text_id string, tokens bigint")


def apportion(seats: int, share: dict, cap: dict) -> dict:
    """Sainte-Lague with capacities: integer seats by highest quotient; ties go to the smaller key.

    Starts from a lower bound of every quota (a common divisor at which fewer
    seats than wanted are given), so the work doesn't grow with the seats.
    """
    live = {k: s for k, s in share.items() if s > 0 and cap.get(k, 0) > 0}
    got = dict.fromkeys(share, 0)
    if not live or seats <= 0:
        return got
    seats = min(seats, sum(cap[k] for k in live))

    def at(divisor: float) -> dict:
        return {k: min(cap[k], int(s / divisor + 0.5)) for k, s in live.items()}

    lo, hi = 0.0, 1.0  # at(hi) gives too few seats or just enough
    while sum(at(hi).values()) > seats:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid <= 0 or mid in (lo, hi):
            break
        if sum(at(mid).values()) <= seats:
            hi = mid
        else:
            lo = mid
    got |= at(hi)
    left = seats - sum(got.values())
    heap = [(-s / (2 * got[k] + 1), str(k), k) for k, s in live.items() if got[k] < cap[k]]
    heapq.heapify(heap)
    while left and heap:
        _, name, k = heapq.heappop(heap)
        got[k] += 1
        left -= 1
        if got[k] < cap[k]:
            heapq.heappush(heap, (-live[k] / (2 * got[k] + 1), name, k))
    return got


def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text").filter(F.col("text").isNotNull())
    return count_tokens(d, "text")


def distinct_texts(tokens: DataFrame) -> DataFrame:
    """One row per (source, text): least doc_id, tokens, and the tokens of all its copies."""
    return (
        tokens.groupBy("source", "text_id")
        .agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"), F.sum("tokens").alias("copy_tokens"))
        .filter("tokens > 0")
    )


def source_capacity(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: own tokens, capacity with repeats, and the mixture's wanted tokens."""
    have = texts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("copy_tokens").alias("copy_tokens"))
    total = have.agg(F.sum("copy_tokens").alias("total"))
    goals = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    return (
        goals.join(have, "source", "left")
        .join(F.broadcast(total))  # one row
        .select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"), F.coalesce("total", F.lit(0).cast("long")).alias("total"))
        .withColumn("capacity", F.col("tokens") * F.col("max_repeats"))
    )


def plan_mixture(texts: DataFrame, targets: DataFrame, blocks: int = BLOCKS) -> dict:
    """{source: {...}} with block size, capacity and quota of blocks; one entry per target source."""
    rows = source_capacity(texts, targets).collect()
    total = max((r.total for r in rows), default=0)
    size = max(1, total // blocks)
    share = {r.source: max(0.0, r.target_share or 0.0) for r in rows}
    capacity = {r.source: max(0, r.capacity or 0) for r in rows}
    # The last block of a full source may be a part of one.
    quota = apportion(total // size, share, {s: -(-n // size) for s, n in capacity.items()})
    return {
        r.source: {
            "target_share": share[r.source], "tokens": r.tokens, "max_repeats": r.max_repeats or 0, "capacity": capacity[r.source], "total": total, "size": size,
            "blocks": quota[r.source], "wanted": min(quota[r.source] * size, capacity[r.source]),
        }
        for r in rows
    }


def in_blocks(texts: DataFrame, plan: dict, seed: int = SEED, bucket_tokens: int | None = None) -> DataFrame:
    """(doc_id, source, tokens, block) of the target sources' texts; a written table.

    The seeded order is by hash, so a bucket is a range of hashes.  Texts are added up inside buckets,
    buckets inside groups of buckets, and groups inside a source.
    """
    bucket_tokens = bucket_tokens or BUCKET_TOKENS
    meta = texts.sparkSession.createDataFrame([(s, max(1, -(-p["tokens"] // bucket_tokens)), p["size"]) for s, p in plan.items()], "source string, buckets bigint, size bigint")
    # 40 bits of the hash tell the bucket, so that their product with the number of buckets fits 64 bits; the whole hash orders the bucket.
    ord_ = F.xxhash64(F.lit(seed), F.col("text_id"))
    top = F.shiftrightunsigned(ord_, 24)
    laid = cut_lineage(
        texts.join(F.broadcast(meta), "source")  # a row per target source
        .withColumn("ord", ord_)
        .withColumn("bucket", F.shiftright(top * F.col("buckets"), 40))
    )
    sums = laid.groupBy("source", "bucket").agg(F.sum("tokens").alias("n")).withColumn("high", F.floor(F.col("bucket") / BUCKETS_TOGETHER))
    def running(*by: str, order: str):
        w = Window.partitionBy(*by).orderBy(order)
        return F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))

    highs = sums.groupBy("source", "high").agg(F.sum("n").alias("n")).withColumn("far", running("source", order="high")).drop("n")
    starts = sums.withColumn("near", running("source", "high", order="bucket")).join(highs, ["source", "high"]).select("source", "bucket", (F.col("far") + F.col("near")).alias("start"))
    w = Window.partitionBy("source", "bucket").orderBy(top, "ord", "text_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.join(starts, ["source", "bucket"]).withColumn("at", F.col("start") + F.coalesce(F.sum("tokens").over(w), F.lit(0).cast("long")))
    return cut_lineage(placed.select("doc_id", "source", "tokens", F.floor(F.col("at") / F.col("size")).alias("block")))


def block_repeats(plan: dict, actual: dict, longest: dict, seed: int = SEED) -> list[tuple[str, int, int]]:
    """(source, block, repeats): how often each block is taken.

    `actual` is {source: {block: tokens of the texts that start in it}}, `longest` the longest text by source.
    """
    out = []
    for s, p in plan.items():
        n, size, most = -(-p["tokens"] // p["size"]), p["size"], p["max_repeats"]
        if not n or not p["blocks"]:
            continue
        held = np.zeros(n, np.int64)
        for b, t in actual.get(s, {}).items():
            held[b] = t
        rng = np.random.default_rng([seed, *s.encode()])
        rank = rng.permutation(n)
        shards = {i: min(SHARD_BLOCKS, n - i * SHARD_BLOCKS) for i in range(-(-n // SHARD_BLOCKS))}
        quota = apportion(min(p["blocks"], n * most), shards, {i: k * most for i, k in shards.items()})
        times = np.zeros(n, np.int64)
        for i, k in shards.items():
            at = np.arange(i * SHARD_BLOCKS, i * SHARD_BLOCKS + k)
            times[at] = quota[i] // k
            times[at[np.argsort(rank[at])[: quota[i] % k]]] += 1
        open_ = int(p["wanted"] - (times * held).sum())
        # Blocks differ by a text: blocks are added or taken away in seeded order as long as that doesn't go too far.
        moved = True
        while moved and open_:
            moved, way = False, 1 if open_ > 0 else -1
            for b in np.argsort(rank, kind="stable"):
                if 0 < held[b] <= abs(open_) and 0 <= times[b] + way <= most:
                    times[b] += way
                    open_ -= way * int(held[b])
                    moved = True
        # The last one may go past the quota where that ends nearer to it.
        way = 1 if open_ > 0 else -1
        free = np.flatnonzero((held > 0) & (times + way >= 0) & (times + way <= most))
        if open_ and len(free):
            b = free[np.abs(abs(open_) - held[free]).argmin()]
            if abs(abs(open_) - held[b]) < abs(open_):
                times[b] += way
                open_ -= way * int(held[b])
        if abs(open_) > max(size, longest.get(s, 0)):
            raise RuntimeError(f"mixture: {s} misses its {p['wanted']} tokens by {open_}, with blocks of {size}")
        out += [(s, int(b), int(times[b])) for b in np.flatnonzero(times)]
    return out


def mixture(texts: DataFrame, plan: dict, seed: int = SEED, bucket_tokens: int | None = None) -> DataFrame:
    """(doc_id, source, tokens, repeats): the mixture, one row per chosen text."""
    placed = in_blocks(texts, plan, seed, bucket_tokens)
    actual: dict = {}
    longest: dict = {}
    # A row per block, at most BLOCKS and one more per source.
    for r in placed.groupBy("source", "block").agg(F.sum("tokens").alias("n"), F.max("tokens").alias("top")).collect():
        actual.setdefault(r.source, {})[r.block] = r.n
        longest[r.source] = max(longest.get(r.source, 0), r.top)
    chosen = texts.sparkSession.createDataFrame(block_repeats(plan, actual, longest, seed), "source string, block bigint, repeats int")
    return placed.join(F.broadcast(chosen), ["source", "block"]).select("doc_id", "source", "tokens", "repeats")


def short_sources(plan: dict) -> list[str]:
    """Sources whose blocks, if none had a capacity, would be more than they can fill.

    The rule is run with blocks of one token, which tells quotas from capacities to within a rounding of
    seats (less than one seat per source); only where they lie that close, the exact numbers are compared.
    """
    if not plan:
        return []
    total = next(iter(plan.values()))["total"]
    claim = apportion(total, {s: p["target_share"] for s, p in plan.items()}, dict.fromkeys(plan, total))
    near = len(plan) + 1

    def short(s: str, p: dict) -> bool:
        if abs(claim[s] - p["capacity"]) > near:
            return claim[s] > p["capacity"]
        return p["capacity"] < p["target_share"] * total

    return [s for s, p in plan.items() if short(s, p)]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose quota of the mixture is beyond their capacity: below their share with every text repeated as often as allowed."""
    texts = cut_lineage(distinct_texts(token_table(spark, sf_dir)))
    return spark.createDataFrame([(s,) for s in short_sources(plan_mixture(texts, table(spark, sf_dir, "mix_targets")))], "source string")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: which text is taken how often."""
    texts = cut_lineage(distinct_texts(token_table(spark, sf_dir)))
    return mixture(texts, plan_mixture(texts, table(spark, sf_dir, "mix_targets")))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the wanted and the reached share, blocks, tokens and the most repeats used."""
    texts = cut_lineage(distinct_texts(token_table(spark, sf_dir)))
    plan = plan_mixture(texts, table(spark, sf_dir, "mix_targets"))
    used = mixture(texts, plan).groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used"), F.max("repeats").alias("most_repeats"))
    goals = spark.createDataFrame(
        [(s, float(p["target_share"]), p["blocks"], int(p["max_repeats"])) for s, p in plan.items()], "source string, target_share double, blocks bigint, max_repeats int"
    )
    whole = used.agg(F.sum("used").alias("whole"))
    return (
        goals.join(used, "source", "left")
        .join(F.broadcast(whole))  # one row
        .select(
            "source", "target_share", F.round(F.coalesce(F.col("used") / F.col("whole"), F.lit(0.0)), 6).alias("actual_share"), "blocks",
            F.coalesce("used", F.lit(0).cast("long")).alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats",
        )
    )


QUERIES = {"p7_found": p7_found, "p7_mixture": p7_mixture, "p7_shares": p7_shares}
SQL: dict[str, str] = {}
