"""Gradient-boosted trees with monotonic constraints, as flat numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 48


@dataclass
class Forest:
    """Nodes of all trees in one set of arrays; a leaf points to itself.

    ``roots`` has the first node of each tree. A row goes left where its feature is
    at most the threshold.
    """

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``; all trees step at once."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            left = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(left, self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: dict[int, int],
    trees: int = 40,
    depth: int = 3,
    rate: float = 0.3,
    least: int = 20,
    ridge: float = 1.0,
) -> Forest:
    """Fit on a bounded sample. ``monotone`` gives 1 or -1 for constrained features.

    A split on a constrained feature is refused if its two values are in the wrong
    order; both sides are then bounded by their middle, so no deeper split can
    break the order. Without rows, or with one class only, the forest is constant.
    """
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1) if n else 0.5
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.empty(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if n else x
    margin = np.full(n, base)

    def add() -> int:
        for name, empty in (("feature", 0), ("threshold", 0.0), ("left", 0), ("right", 0), ("value", 0.0)):
            nodes[name].append(empty)
        at = len(nodes["value"]) - 1
        nodes["left"][at] = nodes["right"][at] = at
        return at

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = add()
        g_all, h_all = g[rows].sum(), h[rows].sum()
        weight = float(np.clip(-g_all / (h_all + ridge), low, high))
        best = (1e-6, None)
        for j in range(x.shape[1]) if level < depth and len(rows) >= 2 * least else ():
            if not len(cuts[j]):
                continue
            size = len(cuts[j]) + 1
            b = binned[rows, j]
            count = np.bincount(b, minlength=size).cumsum()[:-1]
            gl = np.bincount(b, g[rows], size).cumsum()[:-1]
            hl = np.bincount(b, h[rows], size).cumsum()[:-1]
            gr, hr = g_all - gl, h_all - hl
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - (gr * vr + 0.5 * (hr + ridge) * vr**2)
            gain += g_all * weight + 0.5 * (h_all + ridge) * weight**2
            fine = (count >= least) & (len(rows) - count >= least)
            if monotone.get(j):
                fine &= monotone[j] * (vr - vl) >= 0
            gain = np.where(fine, gain, -np.inf)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), (j, k, float(vl[k]), float(vr[k])))
        if best[1] is None:
            nodes["value"][at] = rate * weight
            margin[rows] += rate * weight
            return at
        j, k, vl, vr = best[1]
        bounds = [(low, high), (low, high)]
        if monotone.get(j):
            middle = (vl + vr) / 2
            bounds = [(low, middle), (middle, high)] if monotone[j] > 0 else [(middle, high), (low, middle)]
        goes = binned[rows, j] <= k
        nodes["feature"][at], nodes["threshold"][at] = j, float(cuts[j][k])
        nodes["left"][at] = grow(rows[goes], g, h, level + 1, *bounds[0])
        nodes["right"][at] = grow(rows[~goes], g, h, level + 1, *bounds[1])
        return at

    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-6), 0, -np.inf, np.inf))
    return Forest(
        base,
        depth,
        np.array(roots, np.int64),
        np.array(nodes["feature"], np.int64),
        np.array(nodes["threshold"], float),
        np.array(nodes["left"], np.int64),
        np.array(nodes["right"], np.int64),
        np.array(nodes["value"], float),
    )
