"""Gradient-boosted trees of small depth for log loss, in numpy."""

from __future__ import annotations

import numpy as np


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, bins: list[np.ndarray], l2: float, least: int):
    best = (1e-6, -1, 0.0)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    for f, cuts in enumerate(bins):
        column = x[rows, f]
        for cut in cuts:
            left = column <= cut
            n = left.sum()
            if least <= n <= len(rows) - least:
                gl, hl = g[rows][left].sum(), h[rows][left].sum()
                gain = gl**2 / (hl + l2) + (total_g - gl) ** 2 / (total_h - hl + l2) - total_g**2 / (total_h + l2)
                if gain > best[0]:
                    best = (gain, f, float(cut))
    return best


class Boosted:
    """Trees are arrays of (feature, cut, value) in heap order; feature -1 is a leaf."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, l2: float = 1.0, least: int = 5) -> None:
        self.rounds, self.depth, self.rate, self.l2, self.least = rounds, depth, rate, l2, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.slope, self.offset = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        bins = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 9)[:-1])) for f in range(x.shape[1])]
        score = np.zeros(len(y))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            members = {0: np.arange(len(y))}
            for node in range(size):
                rows = members.pop(node, None)
                if rows is None:
                    continue
                value[node] = self.rate * g[rows].sum() / (h[rows].sum() + self.l2)
                if node < 2**self.depth - 1:
                    gain, f, at = _split(x, g, h, rows, bins, self.l2, self.least)
                    if f >= 0:
                        feature[node], cut[node] = f, at
                        left = x[rows, f] <= at
                        members[2 * node + 1], members[2 * node + 2] = rows[left], rows[~left]
            self.trees.append((feature, cut, value))
            score += self._tree(self.trees[-1], x)
        return self

    def _tree(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(x), int)
        for _ in range(self.depth):
            f = feature[node]
            right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for tree in self.trees:
            out += self._tree(tree, x)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Platt scaling by Newton's method on rows the trees haven't seen."""
        s = self.raw(x)
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-(a * s + b)))
            w = np.maximum(p * (1 - p), 1e-6)
            grad = np.array([((y - p) * s).sum() - 1e-2 * (a - 1), (y - p).sum() - 1e-2 * b])
            hess = np.array([[(w * s * s).sum() + 1e-2, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-2]])
            a, b = np.array([a, b]) + np.clip(np.linalg.solve(hess, grad), -1, 1)
        self.slope, self.offset = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.offset)))
