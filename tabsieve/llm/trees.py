"""Gradient-boosted trees with a logistic loss over dense features, in numpy: histogram splits, complete trees, vectorised scoring."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Boosted:
    """Trees of fixed depth: feature and threshold by node (level order), value by leaf. A row goes right where its feature is above the threshold."""

    def __init__(self, base: float, trees: list):
        self.base, self.trees = base, trees

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(value)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 1.0, weight: np.ndarray | None = None) -> Boosted:
    n, d = x.shape
    weight = np.ones(n) if weight is None else weight
    mean = min(max(float((weight * y).sum() / max(weight.sum(), 1e-12)) if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    if not n or y.min() == y.max():
        return Boosted(base, [])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    f, trees = np.full(n, base), []
    for _ in range(n_trees):
        p = sigmoid(f)
        g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        inner, leaves = 2**depth - 1, 2**depth
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            G, H = np.bincount(local, g, width), np.bincount(local, h, width)
            best = np.full(width, 1e-9)
            for j in range(d):
                if not len(edges[j]):
                    continue
                k = local * bins + binned[:, j]
                gl = np.bincount(k, g, width * bins).reshape(width, bins).cumsum(1)[:, : len(edges[j])]
                hl = np.bincount(k, h, width * bins).reshape(width, bins).cumsum(1)[:, : len(edges[j])]
                gr, hr = G[:, None] - gl, H[:, None] - hl
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (G**2 / (H + l2))[:, None]
                gain[(hl < least * 0.05) | (hr < least * 0.05)] = 0
                at = gain.argmax(1)
                won = gain[np.arange(width), at] > best
                best[won] = gain[won, at[won]]
                feature[first : first + width][won] = j
                threshold[first : first + width][won] = edges[j][at[won]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        f += value[leaf]
        trees.append((feature, threshold, value))
    return Boosted(base, trees)


class Isotonic:
    """Non-decreasing step-wise linear map from scores to probabilities, by pooling adjacent violators."""

    def __init__(self, score: np.ndarray, y: np.ndarray):
        if not len(score):
            self.x, self.y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
            return
        xs, inverse = np.unique(score, return_inverse=True)
        w = np.bincount(inverse).astype(float)
        m = np.bincount(inverse, y) / w
        blocks: list[list[float]] = []  # mean, weight, first, last
        for k in range(len(xs)):
            blocks.append([m[k], w[k], xs[k], xs[k]])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                b, a = blocks.pop(), blocks.pop()
                total = a[1] + b[1]
                blocks.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2], b[3]])
        self.x = np.array([v for b in blocks for v in (b[2], b[3])])
        self.y = np.array([b[0] for b in blocks for _ in (0, 1)])

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
