"""Gradient-boosted regression trees for small training sets, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Arrays of a binary tree; feature -1 marks a leaf."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for a, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            a.append(v)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        f, c, lt, r, v = (np.asarray(a) for a in (self.feature, self.cut, self.left, self.right, self.value))
        at = np.zeros(len(x), int)
        while True:
            inner = np.flatnonzero(f[at] >= 0)
            if not len(inner):
                return v[at]
            node = at[inner]
            at[inner] = np.where(x[inner, f[node]] <= c[node], lt[node], r[node])


class Bins:
    """Features cut at up to ``most`` quantiles, so that all splits of a node are tried in one pass."""

    def __init__(self, x: np.ndarray, most: int = 48):
        self.cuts = []
        codes = np.empty(x.shape, np.int64)
        for j in range(x.shape[1]):
            v = np.unique(x[:, j])
            between = (v[1:] + v[:-1]) / 2
            if len(between) > most:
                between = np.unique(between[np.linspace(0, len(between) - 1, most).astype(int)])
            self.cuts.append(between)
            codes[:, j] = np.searchsorted(between, x[:, j], side="left")
        self.width = max((len(c) for c in self.cuts), default=0) + 1
        self.codes = codes + np.arange(x.shape[1]) * self.width

    def split(self, rows: np.ndarray, g: np.ndarray, least: int, use: np.ndarray) -> tuple[int, int]:
        """Feature (of those in the mask ``use``) and cut number with the greatest gain that leaves ``least`` rows on either side, or -1."""
        n_features = len(self.cuts)
        flat = self.codes[rows].ravel()
        size = n_features * self.width
        count = np.bincount(flat, minlength=size).reshape(n_features, self.width).cumsum(1)[:, :-1]
        total = np.bincount(flat, np.repeat(g, n_features), minlength=size).reshape(n_features, self.width).cumsum(1)[:, :-1]
        n, s = len(rows), g.sum()
        ok = (count >= least) & (n - count >= least) & use[:, None]
        if not ok.any():
            return -1, -1
        left, right = np.maximum(count, 1), np.maximum(n - count, 1)
        gain = np.where(ok, total**2 / left + (s - total) ** 2 / right - s * s / n, -1.0)
        at = int(np.argmax(gain))
        return (-1, -1) if gain.flat[at] <= 1e-12 else divmod(at, self.width - 1)


@dataclass
class Boosted:
    """Squared-error boosting with shrinkage, row and column subsampling; deterministic for a seed."""

    n_trees: int = 120
    depth: int = 3
    rate: float = 0.08
    least: int = 5
    subsample: float = 0.8
    #: Share of the features a tree may use, so that no single one decides.
    columns: float = 0.4
    seed: int = 7
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        rng = np.random.default_rng(self.seed)
        bins = Bins(x)
        self.base, self.trees = float(y.mean()), []
        pred = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            rows = np.sort(rng.choice(len(y), max(2, int(len(y) * self.subsample)), replace=False))
            use = np.zeros(x.shape[1], bool)
            use[rng.choice(x.shape[1], max(1, round(x.shape[1] * self.columns)), replace=False)] = True
            tree = Tree()
            self._grow(tree, tree.add(0.0), bins, x, rows, y - pred, use, self.depth)
            self.trees.append(tree)
            pred += self.rate * tree.predict(x)
        return self

    def _grow(self, tree: Tree, node: int, bins: Bins, x: np.ndarray, rows: np.ndarray, g: np.ndarray, use: np.ndarray, depth: int) -> None:
        tree.value[node] = float(g[rows].mean())
        if depth == 0 or len(rows) < 2 * self.least or bins.width < 2:
            return
        j, k = bins.split(rows, g[rows], self.least, use)
        if j < 0:
            return
        cut = float(bins.cuts[j][k])
        go = x[rows, j] <= cut
        tree.feature[node], tree.cut[node] = j, cut
        tree.left[node], tree.right[node] = tree.add(0.0), tree.add(0.0)
        self._grow(tree, tree.left[node], bins, x, rows[go], g, use, depth - 1)
        self._grow(tree, tree.right[node], bins, x, rows[~go], g, use, depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self.rate * t.predict(x)
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares non-decreasing fit (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, score sum
    for s, v in zip(score[order], y[order]):
        blocks.append([float(v), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, s2 = blocks.pop()
            v1, w1, s1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, s1 + s2])
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])
