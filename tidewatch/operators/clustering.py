"""Density clustering, linkage and dimension reduction on bounded matrices.

Spark has none of these.  They take at most `limit` rows in one task and raise beyond it.
Larger collections are reduced first: to centroids, prototypes or distinct vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 20_000


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=x.astype(np.float64).copy(), where=n > 0)


def _distances(x: np.ndarray, i: int) -> np.ndarray:
    return np.sqrt(((x - x[i]) ** 2).sum(axis=1))


def core_distances(x: np.ndarray, min_samples: int) -> np.ndarray:
    """Distance to the min_samples-th nearest row, the row itself counted."""
    k = min(max(min_samples, 1), len(x)) - 1
    out = np.empty(len(x))
    sq = (x * x).sum(axis=1)
    for i in range(0, len(x), 1024):
        d = np.maximum(sq[i : i + 1024, None] + sq[None, :] - 2 * x[i : i + 1024] @ x.T, 0)
        out[i : i + 1024] = np.sqrt(np.partition(d, k, axis=1)[:, k])
    return out


def mutual_reachability_tree(x: np.ndarray, min_samples: int) -> np.ndarray:
    """Minimum spanning tree (a, b, weight) of the mutual reachability distance, by Prim's algorithm."""
    n = len(x)
    core = core_distances(x, min_samples)
    best = np.full(n, np.inf)
    link = np.zeros(n, int)
    done = np.zeros(n, bool)
    out = np.empty((max(n - 1, 0), 3))
    at = 0
    for i in range(n - 1):
        done[at] = True
        d = np.maximum(np.maximum(_distances(x, at), core), core[at])
        closer = (d < best) & ~done
        best[closer], link[closer] = d[closer], at
        nxt = int(np.where(done, np.inf, best).argmin())
        out[i] = link[nxt], nxt, best[nxt]
        at = nxt
    return out[np.argsort(out[:, 2], kind="stable")]


def single_linkage(tree: np.ndarray, n: int) -> np.ndarray:
    """Merge table (left, right, distance, size) of sorted tree edges; new nodes are numbered from n."""
    parent = np.arange(2 * n)
    size = np.ones(2 * n, int)

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    out = np.empty((len(tree), 4))
    for i, (a, b, w) in enumerate(tree):
        ra, rb, new = find(int(a)), find(int(b)), n + i
        parent[ra] = parent[rb] = new
        size[new] = size[ra] + size[rb]
        out[i] = ra, rb, w, size[new]
    return out


def hdbscan(x: np.ndarray, min_cluster_size: int = 5, min_samples: int = 2) -> np.ndarray:
    """Cluster number of each row, -1 for noise; clusters are chosen by excess of mass, numbered by least member.

    Fewer than min_cluster_size rows are all noise; the root is never a cluster.
    """
    n = len(x)
    if n < max(min_cluster_size, 2):
        return np.full(n, -1)
    merges = single_linkage(mutual_reachability_tree(x, min_samples), n)

    def count(v: int) -> int:
        return 1 if v < n else int(merges[v - n, 3])

    def leaves(v: int) -> list[int]:
        out, todo = [], [v]
        while todo:
            u = todo.pop()
            if u < n:
                out.append(u)
            else:
                todo += [int(merges[u - n, 0]), int(merges[u - n, 1])]
        return out

    birth, stability, children, members, fell = {0: 0.0}, {0: 0.0}, {0: []}, {0: []}, {}
    todo = [(2 * n - 2, 0)]
    labels = 0
    while todo:
        v, c = todo.pop()
        while True:
            if v < n:
                members[c].append(v)
                stability[c] += 0.0
                break
            a, b, dist, _ = merges[v - n]
            a, b = int(a), int(b)
            lam = 1 / max(dist, 1e-12)
            big_a, big_b = count(a) >= min_cluster_size, count(b) >= min_cluster_size
            if big_a and big_b:
                stability[c] += (lam - birth[c]) * count(v)
                for w in (a, b):
                    labels += 1
                    birth[labels], stability[labels], children[labels], members[labels] = lam, 0.0, [], []
                    children[c].append(labels)
                    todo.append((w, labels))
                break
            for w, big in ((a, big_a), (b, big_b)):
                if not big:
                    lost = leaves(w)
                    members[c] += lost
                    stability[c] += (lam - birth[c]) * len(lost)
            if not big_a and not big_b:
                break
            v = a if big_a else b
    score, chosen = {}, {}
    for c in sorted(children, reverse=True):
        below = sum(score[k] for k in children[c])
        chosen[c] = c != 0 and (stability[c] >= below or not children[c])
        score[c] = stability[c] if chosen[c] else below
    out = np.full(n, -1)

    def gather(c: int) -> list[int]:
        return members[c] + [m for k in children[c] for m in gather(k)]

    todo, groups = list(children[0]), []
    while todo:
        c = todo.pop()
        if chosen[c]:
            groups.append(sorted(gather(c)))
        else:
            todo += children[c]
    for i, g in enumerate(sorted(groups)):
        out[g] = i
    return out


def complete_linkage(x: np.ndarray, threshold: float) -> np.ndarray:
    """Group number of each row: agglomerated while all members of the union keep cosine >= threshold; numbered by least member."""
    u = unit_rows(x)
    n = len(u)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    groups = {i: [i] for i in range(n)}
    while len(groups) > 1:
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if d[i, j] > 1 - threshold + 1e-12:
            break
        i, j = min(i, j), max(i, j)
        groups[i] += groups.pop(j)
        far = np.maximum(d[i], d[j])
        d[i], d[:, i] = far, far
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
    out = np.empty(n, int)
    for k, g in enumerate(sorted(sorted(g) for g in groups.values())):
        out[g] = k
    return out


def average_linkage(d: np.ndarray, groups: int) -> np.ndarray:
    """Group number of each row of a distance matrix after merging by mean distance down to `groups`."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    held = {i: [i] for i in range(n)}
    while len(held) > max(groups, 1):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if not np.isfinite(d[i, j]):
            break
        i, j = min(i, j), max(i, j)
        a, b = len(held[i]), len(held[j])
        mean = (a * d[i] + b * d[j]) / (a + b)
        held[i] += held.pop(j)
        d[i], d[:, i] = mean, mean
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
    out = np.empty(n, int)
    for k, g in enumerate(sorted(sorted(g) for g in held.values())):
        out[g] = k
    return out


def disagreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half the number of labelings that part a pair; noise (-1) never agrees."""
    same_a = (a[:, None] == a[None, :]) & (a[:, None] >= 0)
    same_b = (b[:, None] == b[None, :]) & (b[:, None] >= 0)
    return (2 - same_a.astype(float) - same_b) / 2


def svd_reduce(x: np.ndarray, dim: int) -> np.ndarray:
    """Projection on the `dim` strongest right singular vectors, unit rows; unchanged if there is nothing to reduce."""
    if dim >= min(x.shape):
        return unit_rows(x)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    return unit_rows(x @ vt[:dim].T)


def label_matrix(df: DataFrame, key: str, vec: str, fit, limit: int = LIMIT) -> DataFrame:  # noqa: ANN001
    """(key, cluster): rows of a bounded table labelled by `fit(matrix)`; rows are taken in key order."""
    n = df.count()
    if n > limit:
        raise ValueError(f"{n} rows are more than one task takes ({limit}); reduce them first")
    ktype = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        x = np.stack([np.asarray(v, float) for v in pdf["v"]])
        return pd.DataFrame({"k": pdf["k"], "cluster": fit(x)})

    return df.select(F.lit(0).alias("g"), F.col(key).alias("k"), F.col(vec).alias("v")).groupBy("g").applyInPandas(run, f"k {ktype}, cluster int").withColumnRenamed("k", key)
