"""Gradient-boosted trees on binned features: logistic loss, fitted on the driver from a bounded sample, applied in batches."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary classifier; ``predict`` gives log odds. Small, picklable and deterministic."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 8.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> BoostedTrees:
        n, k = x.shape
        w = np.ones(n) if w is None else w
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], q)) for f in range(k)]
        b = self._binned(x)
        p = float(np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(p / (1 - p)))
        score = np.full(n, self.base)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            g, h = w * (y - prob), w * np.maximum(prob * (1 - prob), 1e-6)
            feat = np.zeros(2**self.depth - 1, np.int64)
            cut = np.full(2**self.depth - 1, 255, np.int64)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                local = at - first
                for f in range(k):
                    key = local * self.bins + b[:, f]
                    gs = np.bincount(key, g, width * self.bins).reshape(width, -1).cumsum(1)
                    hs = np.bincount(key, h, width * self.bins).reshape(width, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    ok = (hs >= self.least / 4) & (ht - hs >= self.least / 4)
                    gain = np.where(ok, gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1), 0)
                    c = gain.argmax(1)
                    v = gain[np.arange(width), c]
                    better = v > best + 1e-9
                    best = np.where(better, v, best)
                    feat[first : first + width][better] = f
                    cut[first : first + width][better] = c[better]
                at = 2 * at + 1 + (b[np.arange(n), feat[at]] > cut[at])
            leaf = at - (2**self.depth - 1)
            gs, hs = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
            value = self.rate * gs / (hs + 1)
            self.nodes.append((feat, cut, value))
            score += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self._binned(x)
        rows = np.arange(len(x))
        score = np.full(len(x), self.base)
        for feat, cut, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feat[at]] > cut[at])
            score += value[at - (2**self.depth - 1)]
        return score
