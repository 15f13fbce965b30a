"""Weighted L2 logistic regression on sparse rows (L-BFGS) and Platt calibration, in numpy alone."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """CSR rows: feature ids and values, and n+1 offsets."""

    index: np.ndarray
    value: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def blocks(self, rows: int = 256):
        """(first row, end row, ids, values, row starts) of runs of rows, so that what is computed at once stays small."""
        for a in range(0, len(self), rows):
            b = min(a + rows, len(self))
            cut = slice(self.first[a], self.first[b])
            yield a, b, self.index[cut], self.value[cut], self.first[a : b + 1] - self.first[a]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self))
        for a, b, index, value, first in self.blocks():
            total = np.concatenate([[0.0], np.cumsum(value * w[index])])
            out[a:b] = total[first[1:]] - total[first[:-1]]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, float)))


def fit(x: Rows, y: np.ndarray, weight: np.ndarray, dim: int, l2: float = 1e-3, steps: int = 120) -> np.ndarray:
    """Weights of dim features and, last, the bias. Minimises the weighted mean log loss plus l2/2 |w|^2."""
    weight = weight / weight.sum()
    sign = np.where(y > 0, 1.0, -1.0)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        margin = sign * (x.dot(w[:-1]) + w[-1])
        slope = -sign * weight * sigmoid(-margin)
        grad = np.empty_like(w)
        grad[:-1] = l2 * w[:-1]
        for a, b, index, value, first in x.blocks():
            grad[:-1] += np.bincount(index, weights=value * np.repeat(slope[a:b], np.diff(first)), minlength=dim)
        grad[-1] = slope.sum()
        return float((weight * np.logaddexp(0, -margin)).sum() + 0.5 * l2 * (w[:-1] @ w[:-1])), grad

    w = np.zeros(dim + 1)
    f, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, d, r in reversed(past):
            alphas.append(a := r * (s @ q))
            q -= a * d
        if past:
            s, d, _ = past[-1]
            q *= (s @ d) / (d @ d)
        for (s, d, r), a in zip(past, reversed(alphas), strict=True):
            q += (a - r * (d @ q)) * s
        step, down = 1.0, q @ g
        if down <= 0:
            break
        while True:
            f2, g2 = loss(w - step * q)
            if f2 <= f - 1e-4 * step * down or step < 1e-9:
                break
            step /= 2
        s, d = -step * q, g2 - g
        w, f, g = w + s, f2, g2
        if s @ d > 1e-12:
            past = [*past[-9:], (s, d, 1 / (s @ d))]
        if np.abs(g).max() < 1e-7:
            break
    return w


def platt(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of sigmoid(a * score + b), by Newton's method on smoothed targets (Platt, 1999)."""
    up, down = weight[y > 0].sum(), weight[y <= 0].sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = sigmoid(a * score + b)
        g = weight * (p - t)
        h = weight * p * (1 - p) + 1e-12
        ga, gb = (g * score).sum(), g.sum()
        haa, hab, hbb = (h * score * score).sum() + 1e-6, (h * score).sum(), h.sum() + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        most = max(abs(da), abs(db), 1.0)
        a, b = a - da / most, b - db / most
        if max(abs(da), abs(db)) < 1e-9:
            break
    return float(a), float(b)


@dataclass
class Model:
    """Hashed linear weights, bias and calibration."""

    weights: np.ndarray
    bias: float
    a: float
    b: float

    def probability(self, linear: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * (linear + self.bias) + self.b)


def train(x: Rows, y: np.ndarray, weight: np.ndarray, dim: int, held_out: np.ndarray, l2: float) -> Model:
    """Fit on the rows that aren't held out, calibrate on those that are (on all rows if these lack a class)."""
    fitted = ~held_out
    if len(set(y[fitted])) < 2:
        fitted = np.ones(len(y), bool)
    w = fit(x, y, np.where(fitted, weight, 0.0), dim, l2)  # no weight: no part in it
    rest = held_out if len(set(y[held_out])) == 2 else np.ones(len(y), bool)
    a, b = platt(x.dot(w[:-1])[rest] + w[-1], y[rest], weight[rest])
    return Model(w[:-1].astype(np.float32), float(w[-1]), a, b)
