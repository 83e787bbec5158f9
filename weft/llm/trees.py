"""Gradient-boosted regression trees for a binary label, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Trees of a fixed depth on binned features, fitted to the gradient of the log loss."""

    def __init__(self, n_trees: int = 60, depth: int = 4, rate: float = 0.25, least: float = 1.0, ridge: float = 1.0):
        self.n_trees, self.depth, self.rate, self.least, self.ridge = n_trees, depth, rate, least, ridge

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._bin(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        f = np.full(len(y), self.base)
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.n_trees, inner), np.int64)
        self.cut = np.full((self.n_trees, inner), BINS, np.int64)
        self.value = np.zeros((self.n_trees, 1 << self.depth))
        for t in range(self.n_trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first = (1 << level) - 1
                for k in range(first, 2 * first + 1):
                    mine = np.flatnonzero(node == k)
                    if len(mine):
                        self.feature[t, k], self.cut[t, k] = self._split(b[mine], g[mine], h[mine])
                node = 2 * node + 1 + (b[np.arange(len(y)), self.feature[t, node]] > self.cut[t, node])
            leaf = node - inner
            self.value[t] = self.rate * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + self.ridge)
            f += self.value[t, leaf]
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        n = b.shape[1]
        cell = (b + np.arange(n) * (BINS + 1)).ravel()
        gs = np.bincount(cell, np.repeat(g, n), n * (BINS + 1)).reshape(n, -1).cumsum(axis=1)
        hs = np.bincount(cell, np.repeat(h, n), n * (BINS + 1)).reshape(n, -1).cumsum(axis=1)
        gt, ht = gs[:, -1:], hs[:, -1:]
        gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
        gain[(hs < self.least) | (ht - hs < self.least)] = 0
        j, c = np.unravel_index(int(gain.argmax()), gain.shape)
        return (int(j), int(c)) if gain[j, c] > 1e-6 else (0, BINS)

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self._bin(x)
        f = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), (1 << self.depth) - 1
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            f += value[node - inner]
        return f
