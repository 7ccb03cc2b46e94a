"""Gradient-boosted trees for two classes, on small dense numpy tables."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Log-odds as a sum of shallow trees over binned features.

    Trees are complete binary trees of one depth, stored as arrays, so that a
    batch is scored by ``depth`` vector steps a tree.
    """

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, least: float = 4.0, share: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least, self.share = rounds, depth, rate, bins, least, share

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        weight = np.ones(len(y)) if weight is None else weight
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        inner = 2**self.depth - 1
        mean = np.average(y, weights=weight)
        self.base = float(np.log(mean / (1 - mean)))
        self.feature = np.zeros((self.rounds, inner), np.int32)
        self.cut = np.full((self.rounds, inner), np.inf, np.float64)
        self.leaf = np.zeros((self.rounds, inner + 1))
        total = np.full(len(y), self.base)
        pick, columns = np.random.default_rng(7), [np.ascontiguousarray(c) for c in binned.T]
        for r in range(self.rounds):
            # A tree is grown on a share of the rows, the same ones at each training.
            some = np.flatnonzero(pick.random(len(y)) < self.share) if self.share < 1 else np.arange(len(y))
            p = 1 / (1 + np.exp(-total[some]))
            g, h = weight[some] * (p - y[some]), weight[some] * p * (1 - p)
            own = [c[some] for c in columns]
            node = np.zeros(len(some), np.int64)
            for level in range(self.depth):
                n, first = 2**level, 2**level - 1
                best = np.full(n, 1e-9)
                where = [(0, None)] * n
                for f in range(x.shape[1]):
                    k = len(edges[f]) + 1
                    if k < 2:
                        continue
                    at = (node - first) * k + own[f]
                    gs = np.cumsum(np.bincount(at, g, n * k).reshape(n, k), 1)
                    hs = np.cumsum(np.bincount(at, h, n * k).reshape(n, k), 1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < self.least / 4) | (ht - hs < self.least / 4)] = -1
                    gain[:, -1] = -1
                    j = gain.argmax(1)
                    better = gain[np.arange(n), j] > best
                    for i in np.flatnonzero(better):
                        best[i], where[i] = gain[i, j[i]], (f, int(j[i]))
                go = np.zeros(len(some), np.int64)
                for i, (f, j) in enumerate(where):
                    if j is not None:
                        self.feature[r, first + i], self.cut[r, first + i] = f, edges[f][j]
                        mine = node == first + i
                        go[mine] = own[f][mine] > j
                node = 2 * node + 1 + go
            leaf = node - inner
            self.leaf[r] = -self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
            total += self.leaf[r][self._leaves(x, r)]
        return self

    def _leaves(self, x: np.ndarray, r: int) -> np.ndarray:
        """The leaf of tree r that each row falls into."""
        rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[r][node]] > self.cut[r][node])
        return node - len(self.cut[r])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the second class."""
        total = np.full(len(x), self.base)
        for r in range(len(self.leaf)):
            total += self.leaf[r][self._leaves(x, r)]
        return total
