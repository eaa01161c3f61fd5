"""Gradient-boosted trees for two classes, for feature tables that fit one machine."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, trees of a fixed depth over quantile bins, second-order leaf values."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        weight = np.ones(len(y)) if weight is None else weight
        at = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(c, at)) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree, leaf = self._tree(binned, weight * (p - y), weight * p * (1 - p))
            self.trees.append(tree)
            margin += tree[2][leaf]
        return self

    def _tree(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, dtype=int), np.full(inner, self.bins)
        node = np.zeros(len(g), dtype=int)
        for level in range(self.depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                if len(rows):
                    feature[k], cut[k] = self._split(binned[rows], g[rows], h[rows])
            node = 2 * node + 1 + (binned[np.arange(len(g)), feature[node]] > cut[node])
        leaf = node - inner
        sums = [np.bincount(leaf, v, 2**self.depth) for v in (g, h)]
        return (feature, cut, -self.rate * sums[0] / (sums[1] + self.ridge)), leaf

    def _split(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        best, found = 1e-9, (0, self.bins)
        total_g, total_h = g.sum(), h.sum()
        for f in range(binned.shape[1]):
            left_g = np.cumsum(np.bincount(binned[:, f], g, self.bins))[:-1]
            left_h = np.cumsum(np.bincount(binned[:, f], h, self.bins))[:-1]
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g**2 / (left_h + self.ridge) + right_g**2 / (right_h + self.ridge)
            gain = gain - total_g**2 / (total_h + self.ridge)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], (f, k)
        return found

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        binned = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            margin += value[node - len(feature)]
        return 1 / (1 + np.exp(-margin))
