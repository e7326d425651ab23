"""A packed R-tree over count vectors, searched by an upper bound of set overlap."""

from __future__ import annotations

import numpy as np

FANOUT = 8
#: Candidate combinations that are bounded at once.
CHUNK = 1 << 16


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of sizes a and b whose Jaccard similarity is ``percent`` / 100."""
    return -(-percent * (a + b) // (100 + percent))


class CountTree:
    """Points are count vectors of sets; a node keeps the largest coordinates, the smallest size and a common label."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> None:
        # Packed by size and, within runs of equal size rank, by the coordinate that varies most.
        widest = int(vectors.var(axis=0).argmax()) if len(vectors) else 0
        tiles = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // (FANOUT * FANOUT)
        self.order = np.lexsort((vectors[:, widest], tiles))
        self.levels = [(vectors[self.order], sizes[self.order], labels[self.order], np.ones(len(sizes), bool))]
        while len(self.levels[-1][1]) > FANOUT:
            top, least, label, pure = self.levels[-1]
            cuts = np.arange(0, len(least), FANOUT)
            low, high = np.minimum.reduceat(label, cuts), np.maximum.reduceat(label, cuts)
            made = (np.maximum.reduceat(top, cuts), np.minimum.reduceat(least, cuts), low)
            self.levels.append((*made, (low == high) & np.logical_and.reduceat(pure, cuts)))

    def search(self, vectors: np.ndarray, sizes: np.ndarray, labels: np.ndarray, percent: int):
        """Pairs (query, point) of different labels whose summed coordinate minima allow ``percent``."""
        found = []
        queries = np.arange(len(sizes))
        step = max(1, CHUNK // max(1, len(self.levels[-1][1])))
        for begin in range(0, len(queries), step):
            mine = queries[begin : begin + step]
            width = len(self.levels[-1][1])
            q, node = np.repeat(mine, width), np.tile(np.arange(width), len(mine))
            for depth in range(len(self.levels) - 1, -1, -1):
                keep = np.concatenate([self._may(depth, q[i : i + CHUNK], node[i : i + CHUNK], vectors, sizes, labels, percent) for i in range(0, len(q), CHUNK)]) if len(q) else np.zeros(0, bool)
                q, node = q[keep], node[keep]
                if depth:
                    child = node[:, None] * FANOUT + np.arange(FANOUT)
                    inside = (child < len(self.levels[depth - 1][1])).ravel()
                    q, node = np.repeat(q, FANOUT)[inside], child.ravel()[inside]
            found.append((q, self.order[node]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _may(self, depth, q, node, vectors, sizes, labels, percent):
        top, least, label, pure = self.levels[depth]
        bound = np.minimum(vectors[q], top[node]).sum(axis=1)
        return (bound >= needed(sizes[q], least[node], percent)) & ~(pure[node] & (label[node] == labels[q]))
