"""Linear models in numpy: sparse logistic regression, and non-negative positive-unlabelled risk on dense features."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(z, -60, 60)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


#: Entries of sparse rows that a step takes at a time: they bound the memory beside the rows.
CHUNK = 1 << 20


def _sums(w: np.ndarray, take: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of w[take[at[i]:at[i + 1]]]. Prefix sums go on from chunk to chunk, so that the result doesn't depend on CHUNK."""
    upto, total = np.zeros(len(at)), 0.0
    for lo in range(0, len(take), CHUNK):
        part = w[take[lo : lo + CHUNK]]
        part[0] += total
        np.cumsum(part, out=part)
        i, j = np.searchsorted(at, (lo, lo + len(part)), side="right")
        upto[i:j] = part[at[i:j] - lo - 1]
        total = part[-1]
    return upto[1:] - upto[:-1]


class Rows:
    """Sparse rows of present features: row i has columns col[at[i]:at[i + 1]]; and a few dense columns."""

    def __init__(self, at: np.ndarray, col: np.ndarray, width: int, dense: np.ndarray) -> None:
        self.at, self.col, self.width, self.dense = at, col, width, dense
        rows = max(1, len(at) - 1)
        # sorted in place as numbers column * rows + row
        key = np.repeat(np.arange(len(at) - 1, dtype=np.uint32 if rows * width < 1 << 32 else np.uint64), np.diff(at))
        for lo in range(0, len(col), CHUNK):
            key[lo : lo + CHUNK] += col[lo : lo + CHUNK].astype(key.dtype) * key.dtype.type(rows)
        key.sort()
        self.col_at = np.searchsorted(key, np.arange(width + 1, dtype=key.dtype) * key.dtype.type(rows))
        key %= key.dtype.type(rows)
        self.row_by_col = key

    def dot(self, w: np.ndarray) -> np.ndarray:
        return _sums(w, self.col, self.at) + self.dense @ w[self.width :]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate((_sums(r, self.row_by_col, self.col_at), self.dense.T @ r))


def logistic(x: Rows, y: np.ndarray, ridge: float = 2e-4, steps: int = 120) -> np.ndarray:
    """Weights of L2 logistic regression by accelerated gradient steps; the last dense column is the constant one, not penalised."""
    n = max(1, len(y))
    per_row = np.diff(x.at) + (x.dense**2).sum(axis=1)
    # well above what is safe for the longest rows: a step that is too far is taken back and halved
    step = 32.0 / max(1.0, float(np.quantile(per_row, 0.95)) + 1)
    w = v = np.zeros(x.width + x.dense.shape[1])
    base = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    w[-1] = np.log(base / (1 - base))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 0
    v, t = w.copy(), 1.0
    best, before = w, np.inf
    for _ in range(steps):
        z = x.dot(v)
        g = x.back(sigmoid(z) - y) / n + penalty * v
        new = v - step * g
        z = x.dot(new)
        loss = float(np.mean(np.logaddexp(0, z) - y * z) + 0.5 * (penalty * new * new).sum())
        if loss > before:  # too far: begin momentum anew with a smaller step
            step /= 2
            v, t = best.copy(), 1.0
            continue
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / s * (new - best)
        best, before, t = new, loss, s
    return best


def pu_risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """(prior * R+(p), R-(u) - prior * R-(p)) with the logistic loss; rows with the constant as last column."""
    zp, zu = p @ w, u @ w
    return prior * float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def nn_pu(p: np.ndarray, u: np.ndarray, prior: float, ridge: float = 1e-3, epochs: int = 40, rate: float = 0.02, seed: int = 1) -> np.ndarray:
    """Weights (the constant last) that minimise the non-negative PU risk (Kiryo et al. 2017) with the logistic loss.

    Risk: prior * R+(p) + max(0, R-(u) - prior * R-(p)). In a batch where the second part is negative, a step up that part is taken.
    """
    g = np.random.default_rng(seed)
    add = lambda x: np.concatenate((x, np.ones((len(x), 1))), axis=1)
    p, u = add(p), add(u)
    w = np.zeros(p.shape[1])
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    batches = max(1, min(len(p), len(u)) // 1000)
    for _ in range(epochs):
        for a, b in zip(np.array_split(g.permutation(len(p)), batches), np.array_split(g.permutation(len(u)), batches), strict=True):
            grad = pu_gradient(w, p[a], u[b], prior) + ridge * np.append(w[:-1], 0)
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def pu_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Of the non-negative risk; where its second part is negative, of that part with the sign turned."""
    zp, zu = p @ w, u @ w
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    up = u.T @ sigmoid(zu) / len(u) - prior * (p.T @ sigmoid(zp)) / len(p)
    return -up if negative < 0 else up - prior * (p.T @ (1 - sigmoid(zp))) / len(p)


def mixture_share(p: np.ndarray, u: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among unlabelled rows from scores of both that a model didn't see (best bin estimation, Garg et al. 2021):
    the ratio of the two top bins at the threshold where its upper confidence bound is least."""
    p = np.sort(p)
    at = np.unique(p)
    top_p = 1 - np.searchsorted(p, at) / len(p)
    top_u = 1 - np.searchsorted(np.sort(u), at) / len(u)
    slack = np.sqrt(np.log(4 / delta) / (2 * len(u))) + np.sqrt(np.log(4 / delta) / (2 * len(p)))
    best = np.argmin((top_u + (1 + gamma) * slack) / top_p)
    return float(min(top_u[best] / top_p[best], 1.0))
