"""Gradient-boosted regression trees for a logistic loss, on binned features (numpy only)."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Small additive tree model; fitted on the driver from a bounded sample and sent to workers."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.25, bins: int = 24) -> None:
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._bin(x)
        p = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            tree, at = self._grow(b, y - q, q * (1 - q))
            self.trees.append(tree)
            score = score + tree[2][at]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple, np.ndarray]:
        n = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n)
        node = np.zeros(len(g), dtype=np.int64)
        for k in range(n):
            mine = np.flatnonzero(node == k)
            if not len(mine):
                continue
            gs, hs = g[mine].sum(), h[mine].sum()
            value[k] = self.rate * gs / (hs + 1.0)
            if 2 * k + 2 >= n:
                continue
            best = (1e-6, -1, 0)
            for j in range(b.shape[1]):
                m = len(self.edges[j]) + 1
                cg, ch = np.cumsum(np.bincount(b[mine, j], g[mine], m))[:-1], np.cumsum(np.bincount(b[mine, j], h[mine], m))[:-1]
                if len(cg):
                    gain = cg**2 / (ch + 1.0) + (gs - cg) ** 2 / (hs - ch + 1.0) - gs**2 / (hs + 1.0)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (float(gain[i]), j, i)
            if best[1] >= 0:
                feature[k], cut[k] = best[1], best[2]
                node[mine] = np.where(b[mine, best[1]] <= best[2], 2 * k + 1, 2 * k + 2)
        return (feature, cut, value), node

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        score = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                go = f >= 0
                left = b[np.arange(len(x)), np.maximum(f, 0)] <= cut[node]
                node = np.where(go, np.where(left, 2 * node + 1, 2 * node + 2), node)
            score += value[node]
        return 1 / (1 + np.exp(-score))
