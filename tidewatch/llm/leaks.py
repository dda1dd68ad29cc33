"""Problem 6: passages of held-out items inside a corpus, by edit-distance embedding and bit-sampling LSH.

Texts become words (composed, case-folded runs of letters and digits), words become 64-bit symbols.
Windows of WINDOW words of every item are embedded by CGK random walks, which map a small edit distance to a
small Hamming distance; each of several tables samples positions of one walk into a key.  Windows at every
position of every document are embedded alike; windows that share a key with an item's window
are verified by exact word edit distance.

A walk that meets an early edit goes astray for the rest of the window, so every window is embedded from its
end as well, where early edits are late ones.  Tables are added until they find RECALL of windows with
edits put in, for each way of placing the edits (at random, and side by side at any place); windows are counted one by one.

Both sides are tables, so neither the items nor the corpus has to fit anywhere:

1. The items' windows and their keys are written.  Two bit fields of fixed size (their words, their keys) go to the tasks.
2. One pass over the corpus: windows with fewer words of items than a match has can't match and
   aren't embedded; of the others those with a key in the bit field come out, with their document.
3. Equal windows are looked up once, however many documents hold them, so a passage in a third of all documents is no hot key.
   Keys are joined; a 128-bit sketch of each window's words drops pairs that lack too many of the item's words (never others);
   the rest is verified, and the windows that passed are joined back to their documents, salted.

A bit field that fills up lets more windows through to the join; it never loses one.

Defined cases: null and empty texts and passages match nothing; items of fewer than WINDOW words
match nothing; a document may match many items; repeated rows give one row; empty tables give no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, table

WINDOW = 12
#: Word edits within which p6_near reports a window, and within which candidates are sought for p6_found.
EDITS = 2
STRETCH = 3
SAMPLED = 6
RECALL = 0.98
TRIALS = 1_000
#: A walk that finds nothing new in so many tables won't reach the recall asked for.
HOPELESS = 256
#: Bits of the fields sent to the tasks: 16 MB for keys, 2 MB for words.
KEY_BITS = 1 << 27
WORD_BITS = 1 << 24
#: Bits of one row of Spark's bitmap aggregates.
BITMAP = 32_768
SALTS = 16
#: Words a task embeds at a time.
BATCH_WORDS = 200_000
SEED = 23
WORD = re.compile(r"[^\W_]+")
PAD = 0


def words(text: str) -> list[str]:
    return WORD.findall(unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold()))


class Symbols(dict):
    """Word to 64-bit symbol; never PAD.  Forgets all when it has held a million words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        s = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") or 1
        self[word] = s
        return s


def symbols_of(text: str, memo: Symbols) -> np.ndarray:
    w = words(text)
    return np.fromiter((memo[x] for x in w), np.uint64, len(w))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@dataclass
class Walks:
    """CGK walks: the top bit of symbol * step[t, j] says whether walk t moves on after output j; pick[t] are the sampled outputs."""

    step: np.ndarray
    pick: np.ndarray
    mult: np.ndarray

    @classmethod
    def make(cls, tables: int, window: int, seed: int = SEED) -> Walks:
        """The first tables of a longer set are those of a shorter one."""
        out, parts = window * STRETCH, []
        for t in range(tables):
            rng = np.random.default_rng([seed, t])
            odd = rng.integers(1, 1 << 62, out + SAMPLED + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            parts.append((odd[:out], np.sort(rng.choice(out, min(SAMPLED, out), replace=False)), odd[out:]))
        return cls(*(np.stack(p) for p in zip(*parts, strict=True)))

    @property
    def tables(self) -> int:
        return len(self.pick)

    def keys(self, win: np.ndarray, t: int, back: bool) -> np.ndarray:
        """The LSH key of each window in table t; windows read backwards have keys of their own."""
        n, w = win.shape
        padded = np.concatenate([win, np.full((n, 1), PAD, np.uint64)], axis=1).ravel()
        base, at = np.arange(n, dtype=np.int64) * (w + 1), np.zeros(n, np.int64)
        key = np.full(n, self.mult[t, -1], np.uint64) * np.uint64(2 + back)
        place = {int(j): k for k, j in enumerate(self.pick[t])}
        for j in range(int(self.pick[t][-1]) + 1):
            s = padded[base + at]
            if j in place:
                key = _mixed(key ^ (s + np.uint64(1)) * self.mult[t, place[j]])
            at = np.minimum(at + ((s * self.step[t, j]) >> np.uint64(63)).astype(np.int64), w)
        return key


def _edited(win: np.ndarray, way: str, edits: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Windows with edits, as read from their first word and as read backwards from their last; other words stand around them."""
    w, out, back = win.shape[1], [], []
    other = lambda: int(rng.integers(1, 1 << 62))
    for row in win:
        x = row.tolist()
        spot = int(rng.integers(1, w - edits))
        for _ in range(edits):
            what = int(rng.integers(3)) if way == "random" else way
            at = int(rng.integers(len(x))) if way == "random" else spot
            if what in (0, "change"):
                x[at] = other()
                spot += 1
            elif what in (1, "insert"):
                x.insert(at, other())
            else:
                x.pop(at)
        around = [other() for _ in range(w)]
        out.append((x + around)[:w])
        back.append((x[::-1] + around)[:w])
    return np.array(out, np.uint64), np.array(back, np.uint64)


@functools.lru_cache(maxsize=8)
def tables_for(window: int, edits: int, recall: float = RECALL) -> int:
    """The least number of tables that finds `recall` of edited windows, whichever way they are edited."""
    if edits == 0:
        return 1  # equal windows have equal keys
    if window <= edits + 1:
        raise ValueError("the window is too short for so many edits")
    rng = np.random.default_rng(SEED)
    win = rng.integers(1, 1 << 62, (TRIALS, window), dtype=np.uint64)
    rev = np.ascontiguousarray(win[:, ::-1])
    changed = [_edited(win, way, edits, rng) for way in ("random", "change", "insert", "delete")]
    seen, last, t = np.zeros((len(changed), TRIALS), bool), 0, 0
    while seen.mean(axis=1).min() < recall:
        walk, before = Walks.make(t + 1, window), seen.sum()
        a, b = walk.keys(win, t, False), walk.keys(rev, t, True)
        for i, (x, y) in enumerate(changed):
            seen[i] |= (walk.keys(x, t, False) == a) | (walk.keys(y, t, True) == b)
        t += 1
        last = t if seen.sum() > before else last
        if t - last > HOPELESS:
            raise RuntimeError(f"{t} tables find {seen.mean(axis=1).min():.3f} of the edited windows, not {recall}")
    return t


def edit_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row: least word edits that turn `a` into some prefix of `b` (PAD never matches)."""
    n, w = a.shape
    m = b.shape[1]
    row = np.tile(np.arange(m + 1, dtype=np.int16), (n, 1))
    for i in range(w):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        differs = (a[:, i, None] != b) | (b == PAD)
        for j in range(m):
            new[:, j + 1] = np.minimum(np.minimum(row[:, j] + differs[:, j], row[:, j + 1] + 1), new[:, j] + 1)
        row = new
    return row.min(axis=1)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows)])


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, width)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, win): every window of every item; a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Symbols()
        for b in batches:
            for item, text in zip(b.column("item_id"), b.column("passage").to_pylist(), strict=True):
                s = symbols_of(text, memo)
                if len(s) >= window:
                    win = np.unique(np.lib.stride_tricks.sliding_window_view(s, window), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(win), pa.int64()), _binary(win)], names=["item_id", "win"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "passage").filter(F.col("item_id").isNotNull() & F.col("passage").isNotNull())
    return cut_lineage(rows.mapInArrow(run, "item_id bigint, win binary").distinct())


def sketches(win: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits in two words: one bit for each symbol of the window."""
    at = win & np.uint64(127)
    bit = np.where(win == PAD, np.uint64(0), np.uint64(1) << (at & np.uint64(63)))
    low = np.bitwise_or.reduce(np.where(at < 64, bit, np.uint64(0)), axis=1)
    return low, np.bitwise_or.reduce(np.where(at < 64, np.uint64(0), bit), axis=1)


def keyed(wins: DataFrame, col: str, length: int, walks: Walks, window: int, side: str | None = None) -> DataFrame:
    """(key, id, low, high): all keys of each window, and the sketch of all its words; `side` names the column that says whether a window is read backwards, else both readings are keyed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = _rows(b.column(col), length)
            if not len(whole):
                continue
            win, (low, high) = whole[:, :window], sketches(whole)
            if side:
                back = b.column(side).to_numpy(zero_copy_only=False)
                readings = [(s, np.flatnonzero(back == s), win) for s in (False, True)]
            else:
                every = np.arange(len(win))
                readings = [(False, every, win), (True, every, np.ascontiguousarray(win[:, ::-1]))]
            for s, at, w in readings:
                if len(at):
                    ids = b.column("id").take(pa.array(at))
                    for t in range(walks.tables):
                        yield pa.RecordBatch.from_arrays([_signed(walks.keys(w[at], t, s)), ids, _signed(low[at]), _signed(high[at])], names=["key", "id", "low", "high"])

    return wins.select("id", col, *([side] if side else [])).mapInArrow(run, "key bigint, id string, low bigint, high bigint")


def bit_field(values: DataFrame, col: str, bits: int) -> np.ndarray:
    """Bits set at the values' low bits, as bytes; put together from at most bits / BITMAP rows."""
    at = F.col(col).bitwiseAND(F.lit(bits - 1))
    rows = values.select(F.floor(at / BITMAP).cast("int").alias("no"), (at % BITMAP).alias("bit")).groupBy("no").agg(F.bitmap_construct_agg("bit").alias("map")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r.no * (BITMAP // 8) : (r.no + 1) * (BITMAP // 8)] = np.frombuffer(bytes(r.map), np.uint8)
    return out


def has_bit(field: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & np.uint64(len(field) * 8 - 1)
    return ((field[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def corpus_windows(docs: DataFrame, known: np.ndarray, held: np.ndarray, walks: Walks, window: int, edits: int, both: bool) -> DataFrame:
    """(doc_id, win, back): windows of the documents that may share a key with an item's, each once per document; a written table.

    `win` has window + edits words, the last of them for the edit distance alone; `both`: read backwards as well.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known, held, walks))  # fixed size
    length = window + edits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, walks = shared.value
        memo, gap = Symbols(), np.full(length, PAD, np.uint64)

        def found(ids: list, texts: list) -> Iterator[pa.RecordBatch]:
            whole = np.concatenate([gap, *[p for t in texts for p in (t, gap)]])
            owner = np.concatenate([np.zeros(length, np.int64), *[np.full(len(t) + length, i, np.int64) for i, t in enumerate(texts)]])
            is_known = (has_bit(known, whole) & (whole != PAD)).astype(np.int32)
            for back in (False, True) if both else (False,):
                x, k, o = (whole[::-1], is_known[::-1], owner[::-1]) if back else (whole, is_known, owner)
                sums = np.concatenate([[0], np.cumsum(k)])
                n = len(x) - length + 1
                at = np.flatnonzero((sums[window : window + n] - sums[:n] >= window - edits) & (x[:n] != PAD))
                if not len(at):
                    continue
                all_ = np.lib.stride_tricks.sliding_window_view(x, length)
                for i in range(0, len(at), BATCH_WORDS):
                    here = at[i : i + BATCH_WORDS]
                    win = all_[here]
                    hit = np.zeros(len(here), bool)
                    for t in range(walks.tables):
                        rest = np.flatnonzero(~hit)
                        if len(rest):
                            hit[rest] = has_bit(held, walks.keys(win[rest, :window], t, back))
                    if hit.any():
                        # In reverse the gap behind a text comes first, but windows start at words, so the owner is the text's.
                        rows = np.unique(np.concatenate([o[here[hit]][:, None].astype(np.uint64), win[hit]], axis=1), axis=0)
                        who = [ids[int(j)] for j in rows[:, 0]]
                        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), _binary(rows[:, 1:]), pa.array(np.full(len(rows), back))], names=["doc_id", "win", "back"])

        for b in batches:
            ids, texts, n = [], [], 0
            for d, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = symbols_of(text, memo)
                if len(s) >= window - edits:
                    ids.append(d)
                    texts.append(s)
                    n += len(s)
                if n >= BATCH_WORDS:
                    yield from found(ids, texts)
                    ids, texts, n = [], [], 0
            if texts:
                yield from found(ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    return cut_lineage(rows.mapInArrow(run, "doc_id bigint, win binary, back boolean").withColumn("id", F.md5(F.concat("win", F.when(F.col("back"), F.lit(bytearray(b"b"))).otherwise(F.lit(bytearray(b"f")))))))


def verified(pairs: DataFrame, window: int, edits: int) -> DataFrame:
    """(id, item_win, edits) of the pairs (id, back, win, item_win) within `edits` word edits."""
    length = window + edits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            item, doc, back = _rows(b.column("item_win"), window), _rows(b.column("win"), length), b.column("back").to_numpy(zero_copy_only=False)
            d = edit_distance(np.where(back[:, None], item[:, ::-1], item), doc)
            good = pa.array(np.flatnonzero(d <= edits))
            yield pa.RecordBatch.from_arrays([b.column("id").take(good), b.column("item_id").take(good), pa.array(d.astype(np.int32)).take(good)], names=["id", "item_win_id", "edits"])

    return pairs.select("id", "back", "win", "item_id", "item_win").mapInArrow(run, "id string, item_win_id string, edits int")


def leaked_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_edits: int = EDITS, sought: int = EDITS) -> DataFrame:
    """(doc_id, item_id, edits): documents holding a window of an item within `max_edits` word edits.

    The tables are enough to find windows of up to `sought` edits, at least max_edits.
    """
    sought = max(sought, max_edits)
    walks = Walks.make(tables_for(window, sought), window)
    owners = item_windows(items, window).withColumn("id", F.md5("win"))
    wanted = owners.select("id", "win").distinct()
    item_keys = cut_lineage(keyed(wanted, "win", window, walks, window))

    def each_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([_signed(np.unique(_rows(b.column("win"), window)))], names=["word"])

    known = bit_field(wanted.select("win").mapInArrow(each_word, "word bigint"), "word", WORD_BITS)
    held = bit_field(item_keys, "key", KEY_BITS)
    seen = corpus_windows(docs, known, held, walks, window, max_edits, sought > 0)
    once = cut_lineage(seen.groupBy("id").agg(F.any_value("win").alias("win"), F.any_value("back").alias("back")))
    of_items = item_keys.select("key", F.col("id").alias("item_id"), F.col("low").alias("l"), F.col("high").alias("h"))
    lacking = F.bit_count(F.col("l").bitwiseAND(F.bitwise_not("low"))) + F.bit_count(F.col("h").bitwiseAND(F.bitwise_not("high")))
    pairs = (
        keyed(once, "win", window + max_edits, walks, window, "back")
        .join(of_items, "key").filter(lacking <= max_edits)
        .select("id", "item_id").distinct()
        .join(once, "id")
        .join(wanted.select(F.col("id").alias("item_id"), F.col("win").alias("item_win")), "item_id")
    )
    near = verified(pairs, window, max_edits)
    told = near.join(owners.select(F.col("id").alias("item_win_id"), "item_id"), "item_win_id").groupBy("id", "item_id").agg(F.min("edits").alias("edits"))
    # A window may stand in a third of all documents: its matches are copied to SALTS places, and its documents spread over them.
    salted = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    where = seen.select("doc_id", "id", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return where.join(salted, ["id", "salt"]).groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def _leaks(spark: SparkSession, sf_dir: str, max_edits: int) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), max_edits=max_edits)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least twelve consecutive words of an item's passage: found by the tables of p6_near, verified to differ by no word."""
    return _leaks(spark, sf_dir, 0).select("doc_id", "item_id")


def p6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p6_found, but with up to two words changed, added or missing in the window."""
    return _leaks(spark, sf_dir, EDITS)


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: documents that give it away; items nobody gives away have 0."""
    n = p6_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "eval_items").select("item_id", "suite").join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0).cast("long")).alias("documents"))


QUERIES = {"p6_found": p6_found, "p6_near": p6_near, "p6_items": p6_items}
SQL: dict[str, str] = {}
