"""An R-tree over count vectors of sets, for candidates of a Jaccard join.

A set's elements are hashed into groups and counted; two sets share at most the sum of the smaller counts.
The largest counts below a node bound all sets below it in the same way. Entries are in order of set size,
so that a node also has a narrow range of sizes.
"""

from __future__ import annotations

import numpy as np

GROUPS = 1024
FAN_OUT = 16

#: Two sets link when LINK[1] * intersection >= LINK[0] * (sum of sizes): 7 i >= 3 (a + b) is i / union >= 3 / 4.
LINK = (3, 7)


def count_vectors(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each set and group, and what the set has beyond 255 in its groups, summed up."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(owner * GROUPS + (values >> np.uint64(54)).astype(np.int64), minlength=n * GROUPS).reshape(n, GROUPS)
    return np.minimum(counts, 255).astype(np.uint8), np.maximum(counts - 255, 0).sum(1)


class CountTree:
    """Over vectors whose sizes ascend; ``labels`` are classes within which nothing is searched."""

    def __init__(self, vectors: np.ndarray, over: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.levels = [(vectors, over, sizes, labels, labels)]
        while len(self.levels[-1][0]) > FAN_OUT:
            v, o, s, low, high = self.levels[-1]
            cuts = np.arange(0, len(v), FAN_OUT)
            self.levels.append((np.maximum.reduceat(v, cuts), np.maximum.reduceat(o, cuts), s[cuts], np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))

    def before(self, at: int) -> np.ndarray:
        """Entries below ``at`` of another label that can link with it, in order."""
        vector, over, size, label, _ = (x[at] for x in self.levels[0])
        share, whole = LINK
        found = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            v, o, s, low, high = self.levels[depth]
            step = FAN_OUT**depth
            found = found[(found * step < at) & ((low[found] != label) | (high[found] != label))]
            shared = np.minimum(v[found], vector).sum(1, dtype=np.int64) + np.minimum(o[found], over)
            found = found[whole * shared >= share * (s[found] + size)]
            if depth and len(found):
                found = (found[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                found = found[found < len(self.levels[depth - 1][0])]
        return found[whole * self.levels[0][2][found] >= share * (self.levels[0][2][found] + size)]
