"""Problem 8: texts that stop before their end, found by a model trained on artificial cuts.

Texts of a bounded sample are cut at random places inside a word, sentence or
command (positives) and set against their whole selves (negatives).  A logistic regression over hashed
features of the closing (last words and characters, punctuation, the shape of the
last line, open quotes and brackets, length against the source's usual limit, how
common the last word is elsewhere in the corpus) is fitted; since some of the
"whole" texts are cut ones, those the first fits call cut (each half judged by the model of the other
half, copies staying together) are left out of the final fit.  Every record is then scored.

Bounds: the fit uses at most FIT_DOCS texts; word counts and length statistics
cover all documents; all texts are scored.

Defined cases: null and blank texts aren't cut; exact copies score alike;
missing source, lang or kind count as a value of their own; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, table

FIT_DOCS = 12_000
FIT_PARTITIONS = 12
BUCKETS = 1 << 18
SEED = 31
EPOCHS = 6
RATE = 0.25
DECAY = 2e-6
THRESHOLD = 0.5
#: A whole text scored above this by the other half's model isn't trusted as a negative.
DISTRUST = 0.25
CLEANINGS = 3
CUTS = 2
#: Share of the artificial cuts that get a mark of omission, as some fields add one.
MARKED = 0.2
MARKS = ("…", "...")
#: A length counts as a source's limit if at least so many of its texts have exactly this length.
LIMIT_TEXTS = 3
LIMITS_IN_MEMORY = 20_000
TOKEN = re.compile(r"[^\W_]+")
OMISSION = re.compile(r"(?<=\w)(?:…|\.\.\.)$")
RARE_STEPS = (1, 2, 5, 20, 200)


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


def _shape(s: str) -> str:
    return "".join("a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else "_" if c.isspace() else c for c in s)


def _size(n: int) -> int:
    return int(n).bit_length()


def closing_features(text: str, kind: str | None, limit: str) -> tuple[list[int], str]:
    """Hashed features of a text's closing, and its last word (lower case; empty if it doesn't end in one).

    `limit` is "none", "under", "at" or "over": the length against the source's limit.
    """
    t = text.rstrip()
    # A mark of omission right behind a word says that something was left out; the closing before it is judged alike.
    omitted = OMISSION.search(t)
    t = t[: omitted.start()] if omitted else t
    lines = t.rsplit("\n", 1)
    line = lines[-1].strip()
    low = unicodedata.normalize("NFC", line.lower())
    toks = TOKEN.findall(low)
    ends_word = bool(t) and (t[-1].isalnum())
    last = toks[-1] if toks and ends_word else ""
    sent = re.split(r"[.!?…]+\s+", line)[-1]
    first = line.split(" ", 1)[0] if line else ""
    head = re.sub(r"\d", "9", first)[:24]
    label = re.match(r"[^\W\d][\w \-]{0,24}:(?=\s|$)", line)
    final = t[-1:] if not ends_word else _shape(t[-1:])
    opened = "".join(str(x) for x in (t.count("```") % 2, (line.count("`") % 2), line.count('"') % 2, int(line.count("(") > line.count(")")), line.count("'") % 2))
    k = kind or "-"
    hexed = re.search(r"(?<![0-9a-z])[0-9a-f]{12,}$", low)
    digest = "no" if not hexed else "full" if len(hexed[0]) in (32, 40, 64) else "part"
    names = [
        "bias", f"k:{k}", f"e1:{final}", f"e1k:{k}|{final}", f"e3:{_shape(t[-3:])}", f"e5:{_shape(t[-5:])}", f"c3:{low[-3:]}", f"c5:{low[-5:]}",
        f"w1:{' '.join(toks[-1:])}|{final}", f"w2:{' '.join(toks[-2:])}|{final}", f"w1k:{k}|{last}",
        f"h:{head}", f"hk:{k}|{head}|{int(ends_word)}", f"lab:{label[0] if label else '-'}|{int(ends_word)}",
        f"ll:{_size(len(line))}|{int(ends_word)}", f"ls:{_size(len(TOKEN.findall(sent)))}|{int(ends_word)}", f"lsk:{k}|{_size(len(TOKEN.findall(sent)))}|{final}",
        f"lt:{min(len(toks), 6)}|{k}|{int(ends_word)}", f"open:{opened}", f"wl:{min(len(last), 8)}|{int(ends_word)}",
        f"lim:{limit}|{int(ends_word)}", f"lim:{limit}", f"one:{int(len(lines) == 1)}|{k}",
        f"rep:{int('�' in t[-4:])}", f"hex:{digest}", f"omit:{int(bool(omitted))}|{k}", f"lone:{head}|{len(line.split())}" if len(line.split()) <= 4 else "long",
    ]
    return [_bucket(x) for x in names], last


def cut_places(text: str, rng: np.random.Generator, n: int) -> list[str]:
    """Up to `n` beginnings of `text` that end inside a word, sentence or command."""
    out = []
    whole = text.rstrip()
    if len(whole) < 40:
        return out
    for _ in range(n * 4):
        at = int(rng.integers(len(whole) // 5, len(whole) - 1))
        part, rest = whole[:at], whole[at:]
        shown = part.rstrip()
        # A line's or sentence's end isn't a cut one can see; nor is one that only takes closing marks away.
        if not shown or rest[0] == "\n" or shown != part.rstrip(" ") or (shown[-1] in ".!?…" and (part != shown or rest[0].isspace())) or not TOKEN.search(rest):
            continue
        if re.match(r"[^\w\n]*(\n|$)", rest):
            continue
        out.append(part)
        if len(out) == n:
            break
    return out


def source_limits(docs: DataFrame) -> DataFrame:
    """(source, lim): per source the length that most of its texts share exactly, if at least LIMIT_TEXTS do."""
    n = docs.filter(F.length("text") > 0).groupBy("source", F.length("text").alias("l")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LIMIT_TEXTS)
    w = Window.partitionBy("source").orderBy(F.desc("n"), F.desc("l"))
    return n.withColumn("r", F.row_number().over(w)).filter("r = 1").select(F.col("source").alias("s"), F.col("l").alias("lim"))


def with_limit(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds `place`: the text's length against its source's limit.

    Up to LIMITS_IN_MEMORY limits are sent to the tasks, so texts needn't move; more are joined by shuffle.
    """
    head = limits.limit(LIMITS_IN_MEMORY + 1).collect()
    if len(head) <= LIMITS_IN_MEMORY:
        limits = F.broadcast(docs.sparkSession.createDataFrame(head, limits.schema))
    d = docs.join(limits, docs["source"].eqNullSafe(F.col("s")), "left")
    n = F.length("text")
    return d.withColumn("place", F.when(F.col("lim").isNull(), "none").when(n == F.col("lim"), "at").when(n < F.col("lim"), "under").otherwise("over")).drop("s", "lim")


def inner_word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs before the last word of a text, over all documents."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"))
    return docs.filter(F.col("text").isNotNull()).select(F.explode(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def rarity(n: F.Column) -> F.Column:
    """Index 0..5 of how common a word is."""
    out = F.lit(0)
    for i, s in enumerate(RARE_STEPS):
        out = F.when(n >= s, i + 1).otherwise(out)
    return out


def rare_features(kind: str | None, ends_word: bool, rare: int) -> list[int]:
    r = rare if ends_word else -1
    return [_bucket(f"r:{r}"), _bucket(f"rk:{kind or '-'}|{r}")]


def training_rows(sample: DataFrame) -> DataFrame:
    """(fold, y, feats, last, kind): whole texts (y = 0) and cut ones (y = 1); copies of a text share a fold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, kind, place in zip(b["text"], b["kind"], b["place"], strict=True):
                h = zlib.crc32(text.encode("utf-8", "surrogatepass"))
                rng = np.random.default_rng(SEED + h)
                f, last = closing_features(text, kind, place)
                rows.append((h % 2, 0, f, last, kind))
                for c in cut_places(text, rng, CUTS):
                    if rng.random() < MARKED:
                        c = c.rstrip() + MARKS[int(rng.integers(len(MARKS)))]
                    where = place if place == "none" else ("at" if rng.random() < 0.6 else "under")
                    f, last = closing_features(c, kind, where)
                    rows.append((h % 2, 1, f, last, kind))
            yield pd.DataFrame(rows, columns=["fold", "y", "feats", "last", "kind"])

    return sample.select("text", "kind", "place").mapInPandas(run, "fold int, y int, feats array<int>, last string, kind string")


def fit(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Logistic regression by AdaGrad; both classes weigh alike.  Rows of `x` are feature indices."""
    w = np.zeros(BUCKETS)
    g2 = np.full(BUCKETS, 1e-6)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 256):
            at = order[i : i + 256]
            p = 1 / (1 + np.exp(-np.clip(w[x[at]].sum(axis=1), -30, 30)))
            err = ((p - y[at]) * weight[at])[:, None] / len(at) ** 0.5
            idx, inv = np.unique(x[at], return_inverse=True)
            grad = np.bincount(inv.ravel(), weights=np.broadcast_to(err, x[at].shape).ravel(), minlength=len(idx)) + DECAY * len(y) * w[idx] / 256
            g2[idx] += grad**2
            w[idx] -= RATE * grad / np.sqrt(g2[idx])
    return w


def scores(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))


def train(docs: DataFrame, counts: DataFrame) -> np.ndarray | None:
    """Weights, or None where nothing can be trained.  `docs` has place; the driver holds at most FIT_DOCS * (1 + CUTS) short rows."""
    whole = docs.filter(F.length(F.trim("text")) > 0).withColumn("h", F.xxhash64("doc_id", F.lit(SEED)))
    # The FIT_DOCS least hashes: the same sample however rows are partitioned.
    least = [r.h for r in whole.select("h").orderBy("h").limit(FIT_DOCS + 1).collect()]
    if not least:
        return None
    sample = (whole.filter(F.col("h") < least[-1]) if len(least) > FIT_DOCS else whole).repartition(FIT_PARTITIONS)
    rows = training_rows(sample).join(counts, F.col("last") == F.col("word"), "left").withColumn("rare", rarity(F.coalesce("n", F.lit(0))))
    got = rows.select("fold", "y", "feats", "last", "kind", "rare").toArrow()
    if not len(got):
        return None
    feats = np.array(got["feats"].to_pylist(), dtype=np.int64)
    extra = np.array([rare_features(k, bool(s), r) for k, s, r in zip(got["kind"].to_pylist(), got["last"].to_pylist(), got["rare"].to_pylist(), strict=True)], dtype=np.int64)
    x, y, fold = np.concatenate([feats, extra], axis=1), got["y"].to_numpy(), got["fold"].to_numpy()
    order = np.lexsort((*x.T[:6], y, fold))  # a fixed order, however rows arrive
    x, y, fold = x[order], y[order], fold[order]
    if y.min() == y.max():
        return None
    keep = np.ones(len(y), bool)
    for _ in range(CLEANINGS):
        clean = np.ones(len(y), bool)
        for f in (0, 1):
            a, b = (fold == f) & keep, fold != f
            if a.any() and b.any() and y[a].min() != y[a].max():
                clean[b] = (y[b] == 1) | (scores(fit(x[a], y[a]), x[b]) < DISTRUST)
        keep = clean
    return fit(x[keep], y[keep])


def score_all(docs: DataFrame, counts: DataFrame, w: np.ndarray) -> DataFrame:
    """(doc_id, source, score) of every document; null and blank texts score 0."""
    model = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            base, lasts = [], []
            for text, kind, place in zip(b["text"], b["kind"], b["place"], strict=True):
                if not text or not text.strip():
                    base.append(np.nan)
                    lasts.append("")
                    continue
                f, last = closing_features(text, kind, place)
                base.append(float(model.value[f].sum()))
                lasts.append(last)
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "kind": b["kind"], "base": base, "last": lasts})

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, kind string, base double, last string"
    scored = docs.select("doc_id", "source", "kind", "text", "place").mapInPandas(run, schema)
    # Closings that are no word match nothing; a key of its own for each keeps them from one task.
    look = F.when(F.col("last") == "", F.concat(F.lit("\u0001"), F.xxhash64("doc_id").cast("string"))).otherwise(F.col("last"))
    joined = scored.withColumn("look", look).join(counts, F.col("look") == F.col("word"), "left").withColumn("rare", F.when(F.col("last") == "", -1).otherwise(rarity(F.coalesce("n", F.lit(0)))))

    def add(rare: pd.Series, kind: pd.Series) -> pd.Series:
        memo: dict = {}
        out = []
        for r, k in zip(rare, kind, strict=True):
            if (r, k) not in memo:
                memo[r, k] = float(model.value[rare_features(k, r >= 0, int(r))].sum())
            out.append(memo[r, k])
        return pd.Series(out, dtype="float64")

    extra = F.pandas_udf(add, "double")(F.col("rare"), F.col("kind"))
    logit = F.col("base") + extra
    return joined.select("doc_id", "source", F.when(F.col("base").isNull() | F.isnan("base"), F.lit(0.0)).otherwise(1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))).alias("score"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "kind", "text")
    limits = source_limits(docs)
    placed = with_limit(docs, limits)
    counts = cut_lineage(inner_word_counts(docs))
    w = train(placed, counts)
    if w is None:
        return docs.select("doc_id", "source", F.lit(0.0).alias("score"))
    return score_all(placed, counts, w)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text stops before its end."""
    return _scored(spark, sf_dir).filter(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, cut documents and their share."""
    cut = (F.col("score") >= THRESHOLD).cast("long")
    out = _scored(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(cut).alias("cut"))
    return out.withColumn("share", F.round(F.col("cut") / F.col("documents"), 6))


QUERIES = {"p8_found": p8_found, "p8_rates": p8_rates}
SQL: dict[str, str] = {}
