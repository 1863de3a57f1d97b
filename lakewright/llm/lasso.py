"""Logistic regression with an L1 penalty by accelerated proximal gradient steps, on the driver over a bounded sample."""

from __future__ import annotations

import numpy as np


class Dense:
    def __init__(self, rows: np.ndarray) -> None:
        self.rows, self.width = rows, rows.shape[1]

    def times(self, w: np.ndarray) -> np.ndarray:
        return self.rows @ w

    def back(self, r: np.ndarray) -> np.ndarray:
        return r @ self.rows


class Sparse:
    """Rows as lists of column numbers with one value each."""

    def __init__(self, rows: list, values: list | None, width: int) -> None:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.row = np.repeat(np.arange(len(rows)), sizes)
        self.column = np.concatenate([*map(np.asarray, rows), np.empty(0)]).astype(np.int64)
        self.value = np.ones(len(self.row)) if values is None else np.concatenate([*map(np.asarray, values), np.empty(0)])
        self.n, self.width = len(rows), width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _norm(x, steps: int = 15) -> float:
    """The largest eigenvalue of the rows' products, by power iteration."""
    v = np.random.Generator(np.random.PCG64(3)).random(x.width)
    size = 0.0
    for _ in range(steps):
        v = x.back(x.times(v))
        size = float(np.linalg.norm(v))
        if size == 0:
            return 0.0
        v /= size
    return size


def fit(x, y: np.ndarray, l1: float, steps: int = 300, pairs=None, pair_strength: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and intercept. pairs: rows x - x' of sentences and their counterparts; half their squared scores
    times `pair_strength`, on average, are added to the loss. Without rows the intercept is 0; it is not penalised."""
    n, width = len(y), x.width
    if not n:
        return np.zeros(width), 0.0
    m = pairs.n if pairs is not None else 0
    bound = (_norm(x) + n) / (4 * n) + (pair_strength * _norm(pairs) / m if m else 0)
    step = 1 / (1.1 * bound)
    share = np.clip(y.mean(), 0.5 / (n + 1), 1 - 0.5 / (n + 1))
    w, b = np.zeros(width), float(np.log(share / (1 - share)))
    v, c, t = w, b, 1.0
    for _ in range(steps):
        r = (sigmoid(x.times(v) + c) - y) / n
        slope = x.back(r)
        if m:
            slope = slope + pair_strength / m * pairs.back(pairs.times(v))
        moved = v - step * slope
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        new_b = c - step * float(r.sum())
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, b
