"""Histogram gradient-boosted trees in numpy, flattened for vectorised traversal.

Features are cut into at most 64 quantile bins. Trees are complete binary trees of one
depth, grown a level at a time from histograms of gradients and hessians of the logistic
loss; a node that gains nothing sends everything left. A model is three arrays: a
feature and a threshold per inner node, a value per leaf. Traversal walks all rows
through one tree in ``depth`` array steps, with no branch per row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2**depth
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, l2: float = 1.0, least: int = 5) -> Trees:
    """Trees for labels y in [0, 1]. Without rows, or with one class, the base rate alone."""
    n = len(y)
    rate0 = (float(y.sum()) + 1) / (n + 2)
    base = float(np.log(rate0 / (1 - rate0)))
    inner, width = 2**depth - 1, x.shape[1]
    if n < 2 * least or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    slot = binned + np.arange(width) * bins
    margin = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins, np.int64)
        node = np.zeros(n, np.int64)
        for d in range(depth):
            first, count = 2**d - 1, 2**d
            at = ((node - first)[:, None] * (width * bins) + slot).ravel()
            shape = (count, width, bins)
            hist = [np.bincount(at, np.repeat(w, width), count * width * bins).reshape(shape) for w in (g, h, np.ones(n))]
            left = [np.cumsum(a, axis=2) for a in hist]
            total = [a[:, :, -1:] for a in left]
            right = [t - a for t, a in zip(total, left, strict=True)]
            gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - total[0] ** 2 / (total[1] + l2)
            gain[(left[2] < least) | (right[2] < least)] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[first + k], threshold[first + k], cut[first + k] = j, edges[j][b], b
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)
