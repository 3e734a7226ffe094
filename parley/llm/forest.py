"""A small random forest of axis-parallel trees in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees in arrays: feature (-1 at a leaf), threshold, children and share of positives of each node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray
    roots: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of positives over the leaves that each row falls into."""
        total = np.zeros(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            inner = self.feature[node] >= 0
            while inner.any():
                at = node[inner]
                below = x[inner, self.feature[at]] <= self.threshold[at]
                node[inner] = np.where(below, self.left[at], self.right[at])
                inner = self.feature[node] >= 0
            total += self.share[node]
        return total / max(1, len(self.roots))


def best_split(x: np.ndarray, y: np.ndarray, least: int) -> tuple[float, float]:
    """Gini impurity after the best cut of one feature, and the cut; infinite if there is none."""
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order].astype(float)
    n, positive = np.arange(1, len(xs)), np.cumsum(ys)[:-1]
    rest, total = len(xs) - n, ys.sum()
    impurity = positive * (1 - positive / n) + (total - positive) * (1 - (total - positive) / rest)
    impurity = np.where((xs[1:] > xs[:-1]) & (n >= least) & (rest >= least), impurity, np.inf)
    if not len(impurity) or not np.isfinite(impurity.min()):
        return np.inf, 0.0
    k = int(impurity.argmin())
    return float(impurity[k]), float((xs[k] + xs[k + 1]) / 2)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 17) -> Forest:
    """Each tree has a bootstrap sample; each node tries a random root of the features."""
    rng = np.random.default_rng(seed)
    tries = max(1, int(np.sqrt(x.shape[1])) + 1)
    feature: list[int] = []
    threshold: list[float] = []
    left: list[int] = []
    right: list[int] = []
    share: list[float] = []
    roots = []

    def node(rows: np.ndarray, level: int) -> int:
        own = len(feature)
        feature.append(-1)
        threshold.append(0.0)
        left.append(-1)
        right.append(-1)
        share.append(float(y[rows].mean()))
        if level < depth and 0 < share[own] < 1 and len(rows) >= 2 * least:
            options = [(*best_split(x[rows, f], y[rows], least), int(f)) for f in rng.permutation(x.shape[1])[:tries]]
            impurity, cut, f = min(options)
            if np.isfinite(impurity):
                below = x[rows, f] <= cut
                feature[own], threshold[own] = f, cut
                left[own] = node(rows[below], level + 1)
                right[own] = node(rows[~below], level + 1)
        return own

    for _ in range(trees):
        roots.append(node(rng.integers(0, len(x), len(x)), 0))
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(share), np.array(roots))
