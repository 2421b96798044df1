"""Gradient-boosted regression trees on binned features."""

from __future__ import annotations

import numpy as np


class Trees:
    """Squared-error boosting with depth-limited trees over quantile bins; the fit is deterministic."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 48, leaf: float = 12.0, l2: float = 2.0, subsample: float = 0.7, seed: int = 1) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.leaf, self.l2, self.subsample, self.seed = rounds, depth, rate, bins, leaf, l2, subsample, seed

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> Trees:
        n, f = x.shape
        w = np.ones(n) if w is None else w
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int64)
        self.base = float(np.average(y, weights=w)) if n else 0.0
        pred = np.full(n, self.base)
        rng = np.random.default_rng(self.seed)
        size = self.bins + 1
        offset = np.arange(f) * size
        self.feature, self.cut, self.value = [], [], []
        for _ in range(self.rounds):
            g = (y - pred) * w
            take = np.flatnonzero(rng.random(n) < self.subsample)
            bt, gt, wt = b[take], g[take], w[take]
            node = np.zeros(len(take), np.int64)
            feats, cuts = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, size, np.int64)
            for d in range(self.depth):
                k = 2**d
                flat = (node[:, None] * (f * size) + offset + bt).ravel()
                hg = np.bincount(flat, np.repeat(gt, f), k * f * size).reshape(k, f, size).cumsum(2)
                hw = np.bincount(flat, np.repeat(wt, f), k * f * size).reshape(k, f, size).cumsum(2)
                tg, tw = hg[:, :, -1:], hw[:, :, -1:]
                gain = hg**2 / (hw + self.l2) + (tg - hg) ** 2 / (tw - hw + self.l2) - tg**2 / (tw + self.l2)
                gain[(hw < self.leaf) | (tw - hw < self.leaf)] = 0.0
                best = gain.reshape(k, -1).argmax(1)
                top = gain.reshape(k, -1)[np.arange(k), best]
                ff, cc = best // size, np.where(top > 1e-9, best % size, size)
                feats[k - 1 : 2 * k - 1], cuts[k - 1 : 2 * k - 1] = ff, cc
                node = node * 2 + (bt[np.arange(len(take)), ff[node]] > cc[node])
            k = 2**self.depth
            value = self.rate * np.bincount(node, gt, k) / (np.bincount(node, wt, k) + self.l2)
            self.feature.append(feats)
            self.cut.append(cuts)
            self.value.append(value)
            pred += value[self._leaf(b, feats, cuts)]
        return self

    def _leaf(self, b: np.ndarray, feats: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        node = np.zeros(len(b), np.int64)
        rows = np.arange(len(b))
        for d in range(self.depth):
            at = 2**d - 1 + node
            node = node * 2 + (b[rows, feats[at]] > cuts[at])
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int64)
        out = np.full(len(x), self.base)
        for feats, cuts, value in zip(self.feature, self.cut, self.value):
            out += value[self._leaf(b, feats, cuts)]
        return out
