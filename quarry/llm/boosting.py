"""Gradient-boosted trees for two classes, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: split features and values level by level, then leaf values."""

    feature: np.ndarray  # trees x (2**depth - 1)
    value: np.ndarray
    leaf: np.ndarray  # trees x 2**depth
    bias: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1."""
        out = np.full(len(x), self.bias)
        depth = int(np.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))
        for f, v, leaf in zip(self.feature, self.value, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > v[at])
            out += leaf[at - (2**depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, penalty: float = 1.0) -> Trees:
    """Newton boosting of the log-loss with histogram splits."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)  # > cut i: bin over i
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p0 / (1 - p0)))
    odds = np.full(len(y), bias)
    inner = 2**depth - 1
    out = Trees(np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), bias)
    width = x.shape[1] * bins
    flat = binned + np.arange(x.shape[1]) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-odds))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first = 2**level - 1
            count = 2**level
            keys = ((at - first)[:, None] * width + flat).ravel()
            gs = np.bincount(keys, weights=np.repeat(g, x.shape[1]), minlength=count * width).reshape(count, x.shape[1], bins)
            hs = np.bincount(keys, weights=np.repeat(h, x.shape[1]), minlength=count * width).reshape(count, x.shape[1], bins)
            gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + penalty) + (ga - gl) ** 2 / (ha - hl + penalty) - ga**2 / (ha + penalty)
            gain[(hl < 1) | (ha - hl < 1)] = 0
            for node in range(count):
                k, b = divmod(int(gain[node].argmax()), bins)
                if gain[node, k, b] > 1e-6 and b < len(cuts[k]):
                    out.feature[t, first + node], out.value[t, first + node] = k, cuts[k][b]
            f, v = out.feature[t][at], out.value[t][at]
            at = 2 * at + 1 + (x[np.arange(len(x)), f] > v)
        leaf = at - inner
        gs, hs = np.bincount(leaf, weights=g, minlength=inner + 1), np.bincount(leaf, weights=h, minlength=inner + 1)
        out.leaf[t] = -rate * gs / (hs + penalty)
        odds = odds + out.leaf[t][leaf]
    return out
