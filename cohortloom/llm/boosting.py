"""Gradient-boosted trees in numpy: histogram splits, monotonic constraints, and flattened node arrays for scoring.

Training works on a bounded sample on the driver; scoring is array arithmetic inside tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in common node arrays; a leaf points to itself, so every row walks the same number of steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        for _ in range(self.depth):
            below = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(below, self.left[node], self.right[node])
        return self.bias + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of label 1, in blocks of rows so that the node matrix stays small."""
        out = [1 / (1 + np.exp(-np.clip(self.margin(x[i:i + 8192]), -30, 30))) for i in range(0, len(x), 8192)]
        return np.concatenate(out) if out else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64,
        ridge: float = 1.0, least: float = 5.0) -> Forest:
    """Logistic boosting. ``signs[j]`` of +1 (-1) forces the score to rise (fall) with feature j: a split that breaks the
    order is refused, and the values below both children are kept on their sides of the midpoint."""
    n, p = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(p)]
    codes = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(p)], axis=1) if n else np.zeros((0, p), int)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
    bias = float(np.log(share / (1 - share)))
    margin = np.full(n, bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def add(v: float) -> int:
        k = len(value)
        feature.append(0), threshold.append(np.inf), left.append(k), right.append(k), value.append(v)
        return k

    for _ in range(trees if n and 0 < y.mean() < 1 else 0):
        chance = 1 / (1 + np.exp(-margin))
        g, h = chance - y, chance * (1 - chance)
        step = np.zeros(n)

        def leaf(rows, low, high):
            return float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            node = add(rate * leaf(rows, low, high))
            step[rows] = value[node]
            total_g, total_h = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, 0, 0.0, 0.0)
            if level < depth:
                for j in range(p):
                    many = len(cuts[j]) + 1
                    gl = np.cumsum(np.bincount(codes[rows, j], weights=g[rows], minlength=many))[:-1]
                    hl = np.cumsum(np.bincount(codes[rows, j], weights=h[rows], minlength=many))[:-1]
                    if not len(gl):
                        continue
                    vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(total_g - gl) / (total_h - hl + ridge), low, high)
                    gain = gl**2 / (hl + ridge) + (total_g - gl)**2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
                    gain[(hl < least / 4) | (total_h - hl < least / 4)] = 0
                    if signs[j]:
                        gain[(vr - vl) * signs[j] < 0] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
            _, j, k, vl, vr = best
            if j >= 0:
                goes = codes[rows, j] <= k
                middle = (vl + vr) / 2
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(signs[j])]
                feature[node], threshold[node] = j, float(cuts[j][k])
                left[node] = grow(rows[goes], level + 1, *bounds[0])
                right[node] = grow(rows[~goes], level + 1, *bounds[1])
            return node

        roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
        margin = margin + step
    return Forest(np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(right, np.int64), np.array(value),
                  np.array(roots, np.int64), depth, bias)
