"""Gradient-boosted trees on small matrices: histogram splits, softmax loss, numpy only."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Multi-class boosting with trees of fixed depth over quantile bins.

    ``fit`` is deterministic. A tree is three arrays over its inner nodes (feature, bin) and
    its leaves (value); prediction walks all rows of a matrix at once.
    """

    def __init__(self, classes: int, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, min_rows: int = 3):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.l2, self.min_rows = classes, rounds, depth, rate, bins, l2, min_rows
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        self.base = np.zeros(classes)
        self.temperature = 1.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.int32) if x.size else np.zeros(x.shape, np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> "BoostedTrees":
        n, f = x.shape
        w = np.ones(n) if weights is None else weights
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        b = self._binned(x)
        share = np.array([w[y == k].sum() for k in range(self.classes)]) + 1.0
        self.base = np.log(share / share.sum())
        scores = np.tile(self.base, (n, 1))
        onehot = np.eye(self.classes)[y]
        for _ in range(self.rounds):
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            trees = []
            for k in range(self.classes):
                tree = self._grow(b, w * (p[:, k] - onehot[:, k]), w * np.maximum(p[:, k] * (1 - p[:, k]), 1e-6))
                scores[:, k] += self._apply(tree, b)
                trees.append(tree)
            self.trees.append(trees)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        n, f = b.shape
        inner = 2**self.depth - 1
        feature, split = np.zeros(inner, np.int32), np.full(inner, self.bins, np.int32)
        node = np.zeros(n, np.int64)
        for level in range(self.depth):
            first, width = 2**level - 1, 2**level
            key = ((node[:, None] - first) * f + np.arange(f)) * self.bins + b
            size = width * f * self.bins
            shape = (width, f, self.bins)
            gs = np.bincount(key.ravel(), np.repeat(g, f), size).reshape(shape).cumsum(axis=2)
            hs = np.bincount(key.ravel(), np.repeat(h, f), size).reshape(shape).cumsum(axis=2)
            cs = np.bincount(key.ravel(), minlength=size).reshape(shape).cumsum(axis=2)
            gt, ht, ct = gs[:, :, -1:], hs[:, :, -1:], cs[:, :, -1:]
            gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
            gain[(cs < self.min_rows) | (ct - cs < self.min_rows)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for i in range(width):
                if gain.reshape(width, -1)[i, best[i]] > 1e-9:
                    feature[first + i], split[first + i] = divmod(int(best[i]), self.bins)
            go = b[np.arange(n), feature[node]] > split[node]
            node = 2 * node + 1 + go
        leaf = node - inner
        gl, hl = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        return feature, split, -self.rate * gl / (hl + self.l2)

    def _apply(self, tree, b: np.ndarray) -> np.ndarray:
        feature, split, value = tree
        node = np.zeros(len(b), np.int64)
        rows = np.arange(len(b))
        for _ in range(self.depth):
            node = 2 * node + 1 + (b[rows, feature[node]] > split[node])
        return value[node - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        out = np.tile(self.base, (len(x), 1))
        for trees in self.trees:
            for k, tree in enumerate(trees):
                out[:, k] += self._apply(tree, b)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        """Sets the temperature that gives the holdout the least log loss."""
        z = self.raw(x)
        best = (np.inf, 1.0)
        for t in np.geomspace(0.25, 8, 61):
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            loss = -(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).mean()
            best = min(best, (loss, float(t)))
        self.temperature = best[1]
        return self
