"""Gradient-boosted trees in numpy: softmax loss, histogram splits, trees of fixed depth kept as flat arrays."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, classes: int, rounds: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 48, ridge: float = 1.0, least: float = 1.0):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = classes, rounds, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rows, width = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        self.cuts = cuts
        code = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], 1)
        margin = np.zeros((rows, self.classes))
        leaves = 1 << self.depth
        inner = leaves - 1
        self.feature = np.zeros((self.rounds, self.classes, inner), np.int32)
        self.cut = np.full((self.rounds, self.classes, inner), np.inf)
        self.leaf = np.zeros((self.rounds, self.classes, leaves))
        hot = np.eye(self.classes)[y]
        bins = self.bins + 1
        for r in range(self.rounds):
            p = np.exp(margin - margin.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for k in range(self.classes):
                g, h = p[:, k] - hot[:, k], np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
                node = np.zeros(rows, np.int64)
                for level in range(self.depth):
                    many = 1 << level
                    best, feature, at = np.full(many, 1e-6), np.zeros(many, np.int32), np.full(many, bins)
                    for j in range(width):
                        key = node * bins + code[:, j]
                        sg = np.bincount(key, g, many * bins).reshape(many, bins).cumsum(1)
                        sh = np.bincount(key, h, many * bins).reshape(many, bins).cumsum(1)
                        tg, th = sg[:, -1:], sh[:, -1:]
                        gain = sg**2 / (sh + self.ridge) + (tg - sg) ** 2 / (th - sh + self.ridge) - tg**2 / (th + self.ridge)
                        gain[(sh < self.least) | (th - sh < self.least)] = 0
                        top = gain.argmax(1)
                        value = gain[np.arange(many), top]
                        better = value > best
                        best[better], feature[better], at[better] = value[better], j, top[better]
                    base = many - 1
                    self.feature[r, k, base : base + many] = feature
                    self.cut[r, k, base : base + many] = [cuts[f][b] if b < len(cuts[f]) else np.inf for f, b in zip(feature, at, strict=True)]
                    node = 2 * node + (code[np.arange(rows), feature[node]] > at[node])
                sg, sh = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
                self.leaf[r, k] = -self.rate * sg / (sh + self.ridge)
                margin[:, k] += self.leaf[r, k][node]
        return self

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        margin, at = np.zeros((len(x), self.classes)), np.arange(len(x))
        for r in range(self.rounds):
            for k in range(self.classes):
                node = np.zeros(len(x), np.int64)
                for level in range(self.depth):
                    place = (1 << level) - 1 + node
                    node = 2 * node + (x[at, self.feature[r, k][place]] >= self.cut[r, k][place])
                margin[:, k] += self.leaf[r, k][node]
        top = margin.max(1, keepdims=True)
        return margin - top - np.log(np.exp(margin - top).sum(1, keepdims=True))
