"""Gradient boosted trees for a few hundred to a few hundred thousand rows of small features, and calibration, in numpy."""

from __future__ import annotations

import numpy as np


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """The best (gain, feature, limit): rows with x <= limit go left."""
    best = None
    G, H = g.sum(), h.sum()
    base = G * G / (H + 1)
    for f in range(x.shape[1]):
        values, at = np.unique(x[:, f], return_inverse=True)
        if len(values) < 2:
            continue
        if len(values) > 64:
            cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)))
            at, values = np.searchsorted(cuts, x[:, f]), cuts
        gl, hl = np.cumsum(np.bincount(at, g, len(values)))[:-1], np.cumsum(np.bincount(at, h, len(values)))[:-1]
        nl = np.cumsum(np.bincount(at, minlength=len(values)))[:-1]
        gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - base
        gain[(nl < least) | (len(x) - nl < least)] = 0
        if len(gain) and (k := int(gain.argmax())) >= 0 and gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), f, float(values[k]))
    return best


def _grow(x, g, h, depth: int, least: int, rate: float):
    cut = _split(x, g, h, least) if depth and len(x) >= 2 * least else None
    if cut is None:
        return float(-rate * g.sum() / (h.sum() + 1))
    left = x[:, cut[1]] <= cut[2]
    return cut[1], cut[2], _grow(x[left], g[left], h[left], depth - 1, least, rate), _grow(x[~left], g[~left], h[~left], depth - 1, least, rate)


def _values(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, limit, low, high = tree
    left, out = x[:, f] <= limit, np.empty(len(x))
    out[left], out[~left] = _values(low, x[left]), _values(high, x[~left])
    return out


class Boosted:
    """Log loss, trees of small depth, each fitted to what the earlier ones leave."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5):
        p = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(p / (1 - p)))
        z = np.full(len(y), self.base)
        self.trees = []
        for _ in range(rounds if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-z))
            self.trees.append(tree := _grow(x, p - y, p * (1 - p), depth, least, rate))
            z += _values(tree, x)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for tree in self.trees:
            z += _values(tree, x)
        return 1 / (1 + np.exp(-z))


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The smallest score from which the rows at or above it have ``precision``; above 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ends = np.flatnonzero(np.append(np.diff(p[order]) != 0, True))  # equal scores go together
    good = ends[right[ends] >= precision]
    return float(p[order][good[-1]]) if len(good) else 2.0


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step function nearest to (x, y), for ``np.interp``."""
    means: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        means.append([y[i], 1, x[i], x[i]])
        while len(means) > 1 and (means[-2][0] >= means[-1][0] or means[-2][3] == means[-1][2]):
            m, n, _, hi = means.pop()
            p = means[-1]
            means[-1] = [(p[0] * p[1] + m * n) / (p[1] + n), p[1] + n, p[2], hi]
    return np.array([v for m in means for v in (m[2], m[3])]), np.array([v for m in means for v in (m[0], m[0])])
