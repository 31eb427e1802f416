"""Logistic regression in numpy, fitted by L-BFGS."""

from __future__ import annotations

import numpy as np

from tipscope.llm.base import ship

ship(__name__)


class Rows:
    """Sparse 0/1 rows: column indices with the places where rows begin."""

    def __init__(self, columns, counts, width):
        self.columns, self.counts, self.width = columns, counts, width
        self.row = np.repeat(np.arange(len(counts)), counts)

    def dot(self, w):
        return np.bincount(self.row, weights=w[self.columns], minlength=len(self.counts))

    def back(self, g):
        return np.bincount(self.columns, weights=g[self.row], minlength=self.width)


class Dense:
    def __init__(self, x):
        self.x, self.width = x, x.shape[1]

    def dot(self, w):
        return self.x @ w

    def back(self, g):
        return g @ self.x


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x, y, l2=1.0, scale=None, weight=None, rounds=60, memory=8):
    """Weights and intercept; ``scale`` multiplies the features. Labels of one
    class only give zero weights and that class's log odds."""
    y = np.asarray(y, float)
    s = np.ones(x.width) if scale is None else scale
    u = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    mean = (np.sum(u * y) + 0.5) / (np.sum(u) + 1)
    p = np.zeros(x.width + 1)
    p[-1] = np.log(mean / (1 - mean))
    if len(y) == 0 or y.min() == y.max():
        return p[:-1], p[-1]

    def loss(p):
        z = x.dot(s * p[:-1]) + p[-1]
        g = u * (sigmoid(z) - y)
        f = np.sum(u * (np.logaddexp(0, z) - y * z)) + 0.5 * l2 * p[:-1] @ p[:-1]
        return f, np.append(s * x.back(g) + l2 * p[:-1], g.sum())

    f, g = loss(p)
    past = []
    for _ in range(rounds):
        q, marks = g.copy(), []
        for d, e, r in reversed(past):
            a = r * (d @ q)
            q -= a * e
            marks.append(a)
        if past:
            d, e, _ = past[-1]
            q *= (d @ e) / (e @ e)
        else:
            q /= max(1.0, np.abs(g).sum())
        for (d, e, r), a in zip(past, reversed(marks)):
            q += d * (a - r * (e @ q))
        step, slope = 1.0, -(g @ q)
        while step > 1e-10:
            new = p - step * q
            f_new, g_new = loss(new)
            if f_new <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        d, e = new - p, g_new - g
        done = f - f_new < 1e-7 * max(1, abs(f))
        p, f, g = new, f_new, g_new
        if d @ e > 1e-12:
            past = [*past, (d, e, 1 / (d @ e))][-memory:]
        if done:
            break
    return s * p[:-1], p[-1]
