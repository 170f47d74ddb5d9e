"""A small gradient-boosted tree classifier with calibrated probabilities, in numpy."""

from __future__ import annotations

import numpy as np

#: (feature, threshold, left, right, value) arrays of a tree; feature -1 marks a leaf.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int, ridge: float) -> Tree:
    feature, threshold, left, right, value = [], [], [], [], []

    def node(rows: np.ndarray, level: int) -> int:
        me = len(feature)
        for column in (feature, threshold, left, right, value):
            column.append(0)
        sg, sh = g[rows].sum(), h[rows].sum()
        value[me], feature[me] = sg / (sh + ridge), -1
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v = x[order, f]
                cg, ch = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
                gain = cg**2 / (ch + ridge) + (sg - cg) ** 2 / (sh - ch + ridge) - sg**2 / (sh + ridge)
                gain[(v[1:] <= v[:-1])] = -1
                gain[: least - 1], gain[len(gain) - least + 1 :] = -1, -1
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], (f, (v[i] + v[i + 1]) / 2))
        if best[1]:
            feature[me], threshold[me] = best[1]
            goes = x[rows, feature[me]] <= threshold[me]
            left[me], right[me] = node(rows[goes], level + 1), node(rows[~goes], level + 1)
        return me

    node(np.arange(len(x)), 0)
    return np.array(feature), np.array(threshold, float), np.array(left), np.array(right), np.array(value, float)


def _leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    feature, threshold, left, right, value = tree
    at = np.zeros(len(x), int)
    while (inner := feature[at] >= 0).any():
        f = feature[at[inner]]
        at[inner] = np.where(x[inner, f] <= threshold[at[inner]], left[at[inner]], right[at[inner]])
    return value[at]


class Boosted:
    """Logistic boosting; after fit, probability() is calibrated on the rows kept aside."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, least: int = 8, ridge: float = 1.0):
        self.size, self.depth, self.rate, self.least, self.ridge = trees, depth, rate, least, ridge
        self.trees: list[Tree] = []
        self.a, self.b = 1.0, 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return sum((self.rate * _leaves(t, x) for t in self.trees), np.zeros(len(x)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        aside = np.arange(len(x)) % 3 == 2
        own, want = x[~aside], y[~aside]
        score = np.zeros(len(own))
        for _ in range(self.size):
            p = 1 / (1 + np.exp(-score))
            self.trees.append(_grow(own, want - p, p * (1 - p), self.depth, self.least, self.ridge))
            score += self.rate * _leaves(self.trees[-1], own)
        m, t = self.margin(x[aside]), y[aside]
        for _ in range(200):  # Platt's scaling, a ridge keeps it finite where the classes part
            p = 1 / (1 + np.exp(-(self.a * m + self.b)))
            d = np.array([((p - t) * m).sum() + (self.a - 1), (p - t).sum() + self.b])
            w = p * (1 - p)
            hessian = np.array([[(w * m * m).sum() + 1, (w * m).sum()], [(w * m).sum(), w.sum() + 1]])
            step = np.linalg.solve(hessian, d)
            self.a, self.b = self.a - step[0], self.b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margin(x) + self.b, -35, 35)))
