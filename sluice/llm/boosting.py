"""Gradient-boosted trees for two classes on binned features; fitted on a bounded sample, applied inside tasks."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth stored as arrays (feature, bin) by level order, with a value per leaf."""

    def __init__(self, rounds: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 1e-3):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.edges: list[np.ndarray] = []
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        rate = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.base = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.base)
        features = b.shape[1]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), dtype=np.int64)
            split_on, split_at = [], []
            for level in range(self.depth):
                width = 1 << level
                on, at = np.zeros(width, dtype=np.int64), np.full(width, self.bins, dtype=np.int64)
                best = np.full(width, self.least)
                for j in range(features):
                    key = node * self.bins + b[:, j]
                    sg = np.bincount(key, g, width * self.bins).reshape(width, self.bins)
                    sh = np.bincount(key, h, width * self.bins).reshape(width, self.bins)
                    lg, lh = np.cumsum(sg, axis=1), np.cumsum(sh, axis=1)
                    tg, th = lg[:, -1:], lh[:, -1:]
                    gain = lg ** 2 / (lh + self.ridge) + (tg - lg) ** 2 / (th - lh + self.ridge) - tg ** 2 / (th + self.ridge)
                    k = np.argmax(gain, axis=1)
                    better = gain[np.arange(width), k] > best
                    best = np.where(better, gain[np.arange(width), k], best)
                    on, at = np.where(better, j, on), np.where(better, k, at)
                split_on.append(on)
                split_at.append(at)
                node = 2 * node + (b[np.arange(len(y)), on[node]] > at[node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            self.trees.append((np.concatenate(split_on), np.concatenate(split_at), value))
            f += value[node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        b = self._binned(x)
        rows = np.arange(len(x))
        f = np.full(len(x), self.base)
        for on, at, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            first = 0
            for level in range(self.depth):
                node = 2 * node + (b[rows, on[first + node]] > at[first + node])
                first += 1 << level
            f += value[node]
        return f
