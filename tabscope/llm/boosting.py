"""Gradient-boosted trees of logistic loss over binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 24


@dataclass
class Tree:
    """A full tree of ``depth`` levels: feature and bin of every split (go right above the bin), values of the leaves."""

    feature: np.ndarray
    above: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range((len(self.value)).bit_length() - 1):
            node = 2 * node + 1 + (bins[rows, self.feature[node]] > self.above[node])
        return node - len(self.feature)


class Boosted:
    def __init__(self, trees: int = 50, depth: int = 5, rate: float = 0.25, least: float = 5.0):
        self.trees, self.depth, self.rate, self.least = trees, depth, rate, least
        self.edges: list[np.ndarray] = []
        self.fitted: list[Tree] = []
        self.start = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        for k, e in enumerate(self.edges):  # a rare flag has no quantile of its own
            self.edges[k] = np.unique(np.append(e, np.unique(x[:, k])[:1]))
        bins = self.bins(x)
        mean = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        z = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            tree = self._tree(bins, weight * (y - p), weight * p * (1 - p))
            z += tree.value[tree.leaves(bins)]
            self.fitted.append(tree)
        return self

    def _tree(self, bins: np.ndarray, gradient: np.ndarray, curve: np.ndarray) -> Tree:
        inner = (1 << self.depth) - 1
        feature, above = np.zeros(inner, np.int64), np.full(inner, 255)
        node = np.zeros(len(bins), np.int64)
        for level in range(self.depth):
            first, width = (1 << level) - 1, 1 << level
            gain = np.zeros(width)
            for k in range(bins.shape[1]):
                slot = (node - first) * (BINS + 2) + bins[:, k]
                g = np.bincount(slot, gradient, width * (BINS + 2)).reshape(width, -1).cumsum(axis=1)
                h = np.bincount(slot, curve, width * (BINS + 2)).reshape(width, -1).cumsum(axis=1)
                left, right = h, h[:, -1:] - h
                score = g**2 / (left + 1) + (g[:, -1:] - g) ** 2 / (right + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                score[(left < self.least) | (right < self.least)] = 0
                best = score.argmax(axis=1)
                better = score[np.arange(width), best] > gain + 1e-9
                gain = np.where(better, score[np.arange(width), best], gain)
                feature[first : first + width][better] = k
                above[first : first + width][better] = best[better]
            node = 2 * node + 1 + (bins[np.arange(len(bins)), feature[node]] > above[node])
        leaf = node - inner
        g = np.bincount(leaf, gradient, inner + 1)
        h = np.bincount(leaf, curve, inner + 1)
        return Tree(feature, above, self.rate * g / (h + 1))

    def logits(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        z = np.full(len(x), self.start)
        for tree in self.fitted:
            z += tree.value[tree.leaves(bins)]
        return z
