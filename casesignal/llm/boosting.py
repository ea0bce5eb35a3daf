"""Histogram gradient-boosted trees in arrays, for two classes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Full binary trees of one depth, flattened: tree t, node i at [t, i].

    Node i's children are 2i + 1 and 2i + 2. A node that was not split sends
    every row left (threshold infinity).
    """

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """All rows walk down one level at a time, tree after tree."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = int(np.log2(inner + 1))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - inner]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        return 1 / (1 + np.exp(-self.margins(x)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; splits at bin edges.

    ``least`` is the smallest sum of second derivatives in a child. The result
    depends on the rows and their order alone.
    """
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    start = float(np.log(mean / (1 - mean)))
    margin = np.full(n, start)
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    offsets = np.arange(width) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            nodes = 1 << level
            first = nodes - 1
            cell = ((at - first)[:, None] * (width * bins) + offsets + binned).ravel()
            shape = (nodes, width, bins)
            sums = [np.bincount(cell, weights=np.repeat(v, width), minlength=nodes * width * bins).reshape(shape).cumsum(axis=2) for v in (g, h)]
            (gl, hl), (gt, ht) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain = np.where((hl >= least) & (ht - hl >= least), gain, -np.inf).reshape(nodes, -1)
            best = gain.argmax(axis=1)
            for node in range(nodes):
                j, b = divmod(int(best[node]), bins)
                if gain[node, best[node]] > 1e-9 and b < len(edges[j]):
                    feature[t, first + node] = j
                    threshold[t, first + node] = edges[j][b]
            f = feature[t, at]
            at = 2 * at + 1 + (x[np.arange(n), f] > threshold[t, at])
        end = at - inner
        value = -np.bincount(end, weights=g, minlength=leaves) / (np.bincount(end, weights=h, minlength=leaves) + l2)
        leaf[t] = rate * value
        margin += leaf[t][end]
    return Trees(feature, threshold, leaf, start)
