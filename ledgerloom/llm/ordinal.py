"""Cumulative-link (proportional odds) regression on sparse features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np


#: Grade of a row of which only that it is not the lowest is known.
UNKNOWN = -1


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class CumulativeLink:
    """P(grade > k) = sigmoid(x.w - cut_k), one weight vector for all ordered cuts.

    Fitted by gradient descent with Adam and an L2 penalty; the cuts stay ordered
    because all but the first are parametrised by log distances.
    """

    n_grades: int
    l2: float = 0.02
    steps: int = 600
    rate: float = 0.05
    weights: dict[str, float] = field(default_factory=dict)
    cuts: np.ndarray | None = None

    def fit(self, rows: Sequence[dict[str, float]], grades: Sequence[int], sample_weight: Sequence[float] | None = None) -> CumulativeLink:
        names = sorted({k for r in rows for k in r})
        at = {k: i for i, k in enumerate(names)}
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = np.array([at[k] for r in rows for k in r], dtype=np.int64)
        val = np.array([v for r in rows for v in r.values()], dtype=float)
        y = np.asarray(grades)
        sw = np.ones(len(y)) if sample_weight is None else np.asarray(sample_weight, float)
        sw = sw / sw.sum()
        above = np.stack([(y > k) | (y == UNKNOWN) for k in range(self.n_grades - 1)], 1).astype(float)
        # of an unknown grade it is only known that it exceeds the lowest one
        told = np.stack([(y != UNKNOWN) | (k == 0) for k in range(self.n_grades - 1)], 1) * sw[:, None]
        theta = np.concatenate([np.zeros(len(names)), [1.0], np.zeros(self.n_grades - 2)])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, self.steps + 1):
            w = theta[: len(names)]
            gaps = np.exp(theta[len(names) + 1 :])
            cuts = theta[len(names)] + np.concatenate([[0.0], np.cumsum(gaps)])
            z = np.bincount(row, weights=val * w[col], minlength=len(rows))
            err = (_sigmoid(z[:, None] - cuts) - above) * told
            g = np.empty_like(theta)
            g[: len(names)] = np.bincount(col, weights=val * err.sum(1)[row], minlength=len(names)) + self.l2 * w / max(1, len(y)) * 10
            g[len(names)] = -err.sum()
            tail = -err.sum(0)
            g[len(names) + 1 :] = [gaps[k] * tail[k + 1 :].sum() for k in range(self.n_grades - 2)]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        gaps = np.exp(theta[len(names) + 1 :])
        self.cuts = theta[len(names)] + np.concatenate([[0.0], np.cumsum(gaps)])
        self.weights = {k: float(theta[i]) for k, i in at.items()}
        return self

    def tails(self, row: dict[str, float]) -> np.ndarray:
        """P(grade > k) for every k."""
        z = sum(self.weights.get(k, 0.0) * v for k, v in row.items())
        return _sigmoid(z - self.cuts)

    def expected(self, row: dict[str, float]) -> float:
        return float(self.tails(row).sum())
