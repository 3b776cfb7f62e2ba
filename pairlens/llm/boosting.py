"""Gradient-boosted trees in numpy, small enough to fit on the driver and to travel with a task."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class BoostedTrees:
    """Logistic loss, histogram splits, trees of fixed depth stored as arrays in heap order."""

    trees: int = 40
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    smooth: float = 1.0
    #: Rows on either side of a split: no leaf is made for a single odd row.
    least: int = 20
    base: float = 0.0
    edges: list = field(default_factory=list)
    nodes: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = sigmoid(score)
            tree = self._tree(binned, p - y, p * (1 - p))
            self.nodes.append(tree)
            score += self._walk(tree, x)
        return self

    def _tree(self, binned: np.ndarray, gradient: np.ndarray, curvature: np.ndarray):
        size = (1 << self.depth) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(2 * size + 1)
        rows = {0: np.arange(len(gradient))}
        for node in range(2 * size + 1):
            mine = rows.pop(node, None)
            if mine is None:
                continue
            g, h = gradient[mine], curvature[mine]
            best = (1e-6, -1, 0)
            if node < size:
                whole = g.sum() ** 2 / (h.sum() + self.smooth)
                for f, edges in enumerate(self.edges):
                    if len(edges):
                        gs = np.cumsum(np.bincount(binned[mine, f], g, len(edges) + 1))
                        hs = np.cumsum(np.bincount(binned[mine, f], h, len(edges) + 1))
                        gain = gs[:-1] ** 2 / (hs[:-1] + self.smooth) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + self.smooth) - whole
                        ns = np.cumsum(np.bincount(binned[mine, f], minlength=len(edges) + 1))
                        gain[(ns[:-1] < self.least) | (ns[-1] - ns[:-1] < self.least)] = 0.0
                        at = int(np.argmax(gain))
                        if gain[at] > best[0]:
                            best = (float(gain[at]), f, at)
            if best[1] < 0:
                value[node] = -self.rate * g.sum() / (h.sum() + self.smooth)
                continue
            feature[node], cut[node] = best[1], self.edges[best[1]][best[2]]
            left = binned[mine, best[1]] <= best[2]
            rows[2 * node + 1], rows[2 * node + 2] = mine[left], mine[~left]
        return feature, cut, value

    @staticmethod
    def _walk(tree, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at, every = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while True:
            inner = (at < len(feature)) & (feature[np.minimum(at, len(feature) - 1)] >= 0)
            if not inner.any():
                return value[at]
            f = feature[np.minimum(at, len(feature) - 1)]
            right = x[every, np.maximum(f, 0)] > cut[np.minimum(at, len(cut) - 1)]
            at = np.where(inner, 2 * at + 1 + right, at)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        out = np.full(len(x), self.base)
        for tree in self.nodes:
            out += self._walk(tree, x)
        return out


def platt(score: np.ndarray, y: np.ndarray, steps: int = 50, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset that make ``sigmoid(slope * score + offset)`` fit held-out labels, rows weighted if asked (Newton steps)."""
    w = np.array([1.0, 0.0])
    v = np.ones(len(score)) if weight is None else weight
    design = np.stack([score, np.ones(len(score))], axis=1)
    for _ in range(steps):
        p = sigmoid(design @ w)
        grad = design.T @ (v * (p - y)) + 1e-3 * (w - [1.0, 0.0])
        hess = (design * (v * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])
