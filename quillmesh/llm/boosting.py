"""Gradient-boosted trees for binary labels on NumPy arrays: binned features, depth-wise growth, log loss."""

from __future__ import annotations

import numpy as np


class Boosted:
    """``fit`` on rows of features and 0/1 labels; ``margin`` gives log-odds."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, penalty: float = 1.0, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.penalty, self.least = trees, depth, rate, bins, penalty, least
        self.cuts: list[np.ndarray] = []
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, m = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        b = self._binned(x)
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(n, self.start)
        size = 1 << self.depth
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.ones(n, np.int64)  # heap numbering: children of i are 2i and 2i + 1
            feature, cut = np.full(size, -1), np.zeros(size, np.int64)
            for level in range(self.depth):
                first = 1 << level
                best = np.full(first, 1e-6)
                for j in range(m):
                    width = len(self.cuts[j]) + 1
                    key = (at - first) * width + b[:, j]
                    gs = np.bincount(key, g, first * width).reshape(first, width).cumsum(1)
                    hs = np.bincount(key, h, first * width).reshape(first, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.penalty) + (gt - gs) ** 2 / (ht - hs + self.penalty) - gt**2 / (ht + self.penalty)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    k = gain.argmax(1)
                    value = gain[np.arange(first), k]
                    better = np.flatnonzero(value > best)
                    best[better] = value[better]
                    feature[first + better], cut[first + better] = j, k[better]
                f = feature[at]
                right = (f >= 0) & (b[np.arange(n), np.maximum(f, 0)] > cut[at])
                at = 2 * at + right
            leaf_g, leaf_h = np.bincount(at - size, g, size), np.bincount(at - size, h, size)
            leaf = self.rate * leaf_g / (leaf_h + self.penalty)
            self.nodes.append((feature, cut, leaf))
            score += leaf[at - size]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        n = len(b)
        out, row = np.full(n, self.start), np.arange(n)
        for feature, cut, leaf in self.nodes:
            at = np.ones(n, np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = 2 * at + ((f >= 0) & (b[row, np.maximum(f, 0)] > cut[at]))
            out += leaf[at - len(leaf)]
        return out
