"""A regularised logistic regression on sparse binary features, trained on the driver on a bounded sample."""

from __future__ import annotations

import numpy as np


def fit(rows: list[np.ndarray], labels: np.ndarray, dim: int, l2: float = 1.0, rounds: int = 120, values: list[np.ndarray] | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias; the classes weigh the same. ``rows``: feature numbers of each example; ``values``: theirs, or 1."""
    y = np.asarray(labels, np.float64)
    n, pos = len(y), max(1.0, y.sum())
    weight = np.where(y > 0, 0.5 * n / pos, 0.5 * n / max(1.0, n - pos)) / n
    cols = np.concatenate(rows).astype(np.int64) if n else np.empty(0, np.int64)
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    val = np.concatenate(values) if values is not None else np.ones(len(cols))
    return fit_flat(cols, of, val, y, weight, dim, l2, rounds)


def fit_flat(cols: np.ndarray, of: np.ndarray, val: np.ndarray, y: np.ndarray, weight: np.ndarray, dim: int, l2: float, rounds: int) -> tuple[np.ndarray, float]:
    """The same on flat arrays: feature, example and value of each entry; label and weight of each example."""
    n = len(y)
    w, b = np.zeros(dim), 0.0
    m, v, mb, vb = np.zeros(dim), np.zeros(dim), 0.0, 0.0
    for t in range(1, rounds + 1):  # Adam on the full batch
        z = np.bincount(of, w[cols] * val, n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad, gb = np.bincount(cols, g[of] * val, dim) + l2 * w / n, g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.08 * (1 - t / rounds) + 0.005
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, float(b)


def probability(row: np.ndarray, w: np.ndarray, b: float, values: np.ndarray | None = None) -> float:
    z = float((w[row] if values is None else w[row] * values).sum()) + b
    return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


def measures(truth: np.ndarray, said: np.ndarray) -> dict[str, float]:
    """Precision, recall and F1; 1 where there is nothing to be right about."""
    hit = float((truth & said).sum())
    p, r = (hit / said.sum() if said.any() else 1.0), (hit / truth.sum() if truth.any() else 1.0)
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0}
