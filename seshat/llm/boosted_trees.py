"""Gradient-boosted trees for a yes-or-no label, with monotonic constraints, kept as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees' nodes end to end. A leaf points to itself on both sides; ``roots`` has each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds for each row of ``x``: all trees step down one level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)


class _Grower:
    def __init__(self, binned: np.ndarray, cuts: list[np.ndarray], signs: np.ndarray, depth: int, l2: float, least: int):
        self.binned, self.cuts, self.signs, self.depth, self.l2, self.least = binned, cuts, signs, depth, l2, least
        self.nodes: list[list[float]] = []  # feature, threshold, left, right, value

    def _split(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float) -> tuple | None:
        """The best (gain, feature, bin, left value, right value) whose values keep the feature's direction."""
        best = None
        all_g, all_h = g[rows].sum(), h[rows].sum()
        for f, cuts in enumerate(self.cuts):
            bins = self.binned[rows, f]
            size = len(cuts) + 1
            gl = np.bincount(bins, g[rows], size).cumsum()[:-1]
            hl = np.bincount(bins, h[rows], size).cumsum()[:-1]
            nl = np.bincount(bins, minlength=size).cumsum()[:-1]
            if not len(gl):
                continue
            vl = np.clip(-gl / (hl + self.l2), low, high)
            vr = np.clip(-(all_g - gl) / (all_h - hl + self.l2), low, high)
            gain = -(gl * vl + 0.5 * (hl + self.l2) * vl**2) - ((all_g - gl) * vr + 0.5 * (all_h - hl + self.l2) * vr**2)
            gain[(nl < self.least) | (len(rows) - nl < self.least) | (self.signs[f] * (vr - vl) < 0)] = -np.inf
            k = int(gain.argmax())
            if best is None or gain[k] > best[0]:
                best = (gain[k], f, k, vl[k], vr[k])
        v = np.clip(-all_g / (all_h + self.l2), low, high)
        alone = -(all_g * v + 0.5 * (all_h + self.l2) * v**2)
        return best if best and best[0] > alone + 1e-9 else None

    def grow(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int, out: np.ndarray, rate: float) -> int:
        me = len(self.nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + self.l2), low, high)) * rate
        self.nodes.append([0, 0.0, me, me, value])
        found = self._split(rows, g, h, low, high) if level < self.depth else None
        if found is None:
            out[rows] += value
            return me
        _, f, k, vl, vr = found
        middle, go_left = (vl + vr) / 2, self.binned[rows, f] <= k
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(self.signs[f])]
        left = self.grow(rows[go_left], g, h, *bounds[0], level + 1, out, rate)
        right = self.grow(rows[~go_left], g, h, *bounds[1], level + 1, out, rate)
        self.nodes[me] = [f, float(self.cuts[f][k]), left, right, 0.0]
        return me


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 20) -> Forest:
    """Log-loss boosting with histogram splits. signs: 1 where the score may only rise with the feature, -1 only fall, 0 free."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T, strict=True)]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], 1)
    rate0 = min(max(y.mean(), 1e-6), 1 - 1e-6)
    base = float(np.log(rate0 / (1 - rate0)))
    score, grower, roots = np.full(len(y), base), _Grower(binned, cuts, np.array(signs), depth, l2, least), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grower.grow(np.arange(len(y)), p - y, p * (1 - p), -np.inf, np.inf, 0, score, rate))
    columns = list(zip(*grower.nodes, strict=True)) or [()] * 5
    ints = [np.array(c, np.int32) for c in (columns[0], columns[2], columns[3])]
    return Forest(ints[0], np.array(columns[1]), ints[1], ints[2], np.array(columns[4]), np.array(roots, np.int64), depth, base)
