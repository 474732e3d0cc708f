"""Gradient-boosted trees with logistic loss on binned features, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Trees:
    """Complete binary trees of one depth; a split sends values above its edge right."""

    def __init__(self, depth: int = 3, rounds: int = 80, rate: float = 0.15, bins: int = 64, ridge: float = 1.0):
        self.depth, self.rounds, self.rate, self.bins, self.ridge = depth, rounds, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(rate / (1 - rate))), []
        raw = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree, leaf = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            raw += tree[2][leaf]
        return self

    def _grow(self, binned, g, h):
        n, f = binned.shape
        inner = (1 << self.depth) - 1
        feature, place, node = np.zeros(inner, int), np.full(inner, self.bins, int), np.zeros(n, int)
        for level in range(self.depth):
            first, wide = (1 << level) - 1, 1 << level
            best = np.full(wide, 1e-9)
            for j in range(f):
                at = (node - first) * self.bins + binned[:, j]
                gs = np.bincount(at, g, wide * self.bins).reshape(wide, self.bins).cumsum(axis=1)
                hs = np.bincount(at, h, wide * self.bins).reshape(wide, self.bins).cumsum(axis=1)
                G, H = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.ridge) + (G - gs) ** 2 / (H - hs + self.ridge) - G**2 / (H + self.ridge)
                gain = np.where((hs > 1) & (H - hs > 1), gain, 0)
                cut = gain.argmax(axis=1)
                got = gain[np.arange(wide), cut]
                better = got > best
                best[better] = got[better]
                feature[first : first + wide][better] = j
                place[first : first + wide][better] = cut[better]
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > place[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        # a value above the edge falls into a later bin
        edge = np.array([self.edges[j][c] if c < len(self.edges[j]) else np.inf for j, c in zip(feature, place)])
        return (feature, edge, self.rate * gs / (hs + self.ridge)), leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), (1 << self.depth) - 1
        for feature, edge, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > edge[node])
            out += value[node - inner]
        return out


class Isotonic:
    """Non-decreasing steps by pooling adjacent violators; between them values are interpolated."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> "Isotonic":
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []
        for s, v in zip(score[order], y[order]):
            blocks.append([v, 1.0, s, s])
            while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
                b = blocks.pop()
                blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
        # the ends keep away from 0 and 1, so that scores still rank
        value = [(b[0] + 0.5) / (b[1] + 1) if b[1] > 1 else b[0] / b[1] for b in blocks]
        self.x = np.array([e for b in blocks for e in (b[2], b[3])])
        self.y = np.maximum.accumulate(np.repeat(value, 2))
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y) if len(self.x) else np.zeros(len(score))
