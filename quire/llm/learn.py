"""Small learners in numpy: boosted trees, isotonic regression, lasso logistic; and a bounded sample of labelled rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(key: str, modulus: int) -> F.Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % modulus


def sample_of(labels: DataFrame, key: str, label: str, modulus: int, held_out: int, bound: int) -> DataFrame:
    """(key, label 0/1, part 0-99) of at most ``bound`` labelled rows that are not held out.

    The rows of the smallest hashes of the key.  Rows with a null key or label
    are left out; of a key with several labels the largest counts.
    """
    rows = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label")).where("key is not null and label is not null")
    rows = rows.where(remainder("key", modulus) != held_out).groupBy("key").agg(F.max("label").alias("label"))
    hashed = rows.select("key", "label", F.xxhash64("key").alias("h"))
    return hashed.orderBy("h", "key").limit(bound).select("key", "label", F.pmod("h", F.lit(100)).cast("int").alias("part"))


def one_a_key(rows: DataFrame) -> DataFrame:
    """Of the rows (key, text, ...) of one key the one of the least text hash.

    A labelled key may stand on any number of documents; this bounds the rows to
    learn from by the labels, with at most one row a key and task before the shuffle.
    """
    others = [c for c in rows.columns if c not in ("key", "text")]
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text", *others)).alias("row")
    return rows.groupBy("key").agg(least).select("key", "row.text", *[f"row.{c}" for c in others])


@dataclass(frozen=True)
class Tree:
    """A complete binary tree: node i has children 2i+1 and 2i+2; feature -1 marks a leaf; x <= threshold goes left."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1))):
            f = self.feature[node]
            inner = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.threshold[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return self.value[node]

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """The conditions (feature, greater, threshold) on the way to each node but the root."""
        found, waiting = [], [(0, ())]
        while waiting:
            node, so_far = waiting.pop()
            if so_far:
                found.append(so_far)
            if self.feature[node] >= 0:
                f, t = int(self.feature[node]), float(self.threshold[node])
                waiting += [(2 * node + 1, (*so_far, (f, False, t))), (2 * node + 2, (*so_far, (f, True, t)))]
        return found


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, leaf: int = 10, bins: int = 48, ridge: float = 1.0) -> tuple[float, list[Tree]]:
    """Gradient-boosted trees for log loss over binned features: the prior's log odds and the trees (their values already shrunk)."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    codes = [np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)]  # code k: cuts[k-1] < v <= cuts[k]
    score, trees = np.full(len(y), prior), []
    for _ in range(rounds if len(y) and 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        size = 2 ** (depth + 1) - 1
        feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        rows = {0: np.arange(len(y))}
        for node in range(size):
            if (at := rows.pop(node, None)) is None:
                continue
            total_g, total_h = g[at].sum(), h[at].sum()
            value[node] = rate * total_g / (total_h + ridge)
            if node >= 2**depth - 1 or len(at) < 2 * leaf:
                continue
            best = (1e-6, -1, 0)
            for f, (code, cut) in enumerate(zip(codes, cuts)):
                if not len(cut):
                    continue
                n_bins = len(cut) + 1
                mine = code[at]
                left_g, left_h, left_n = (np.cumsum(np.bincount(mine, w, n_bins))[:-1] for w in (g[at], h[at], None))
                gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
                gain[(left_n < leaf) | (len(at) - left_n < leaf)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            if best[1] >= 0:
                feature[node], threshold[node] = best[1], cuts[best[1]][best[2]]
                goes_left = codes[best[1]][at] <= best[2]
                rows[2 * node + 1], rows[2 * node + 2] = at[goes_left], at[~goes_left]
        trees.append(Tree(feature, threshold, value))
        score = score + trees[-1](x)
    return prior, trees


def raw_scores(model: tuple[float, list[Tree]], x: np.ndarray) -> np.ndarray:
    """Log odds by boosted trees."""
    prior, trees = model
    return prior + sum((t(x) for t in trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots and values of a non-decreasing step curve, each pool shrunk by ``weight`` rows of the mean.

    Between knots :func:`calibrated` interpolates, so that scores keep their order.
    """
    if not len(y):
        return np.zeros(1), np.zeros(1)
    by = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # sum of y, rows, sum of score
    for s, v in zip(score[by].tolist(), y[by].tolist()):
        pools.append([v, 1.0, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    mean = float(y.mean())
    knots = np.array([p[2] / p[1] for p in pools])
    return knots, np.maximum.accumulate(np.array([(p[0] + weight * mean) / (p[1] + weight) for p in pools]))


def calibrated(curve: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    return np.interp(score, *curve)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and L1-penalised weights of a logistic model, by accelerated proximal gradient."""
    n, d = x.shape
    if not n or not 0 < y.sum() < n:
        mean = (y.sum() + 0.5) / (n + 1)
        return float(np.log(mean / (1 - mean))), np.zeros(d)
    full = np.hstack((np.ones((n, 1)), x))
    norm = np.linalg.norm(full, 2) if d else np.sqrt(n)
    step = 4 * n / norm**2
    w = look = np.zeros(d + 1)
    momentum = 1.0
    for _ in range(steps):
        gradient = full.T @ (1 / (1 + np.exp(-full @ look)) - y) / n
        new = look - step * gradient
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    return float(w[0]), w[1:]
