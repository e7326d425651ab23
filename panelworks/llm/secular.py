"""Symmetric eigendecompositions under rank-one updates: secular equations with deflation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_EPS = np.finfo(np.float64).eps
_STEPS = 100


def secular_roots(poles: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``diag(poles) + z z'`` for rising, distinct poles and a ``z`` without zeros.

    Root i lies between pole i and the next one, the last below its pole + z'z. Each is found as the distance from its
    nearer pole, by rational interpolation through both neighbours ("middle way") and by bisection where a step leaves
    the bracket. Returns the index of that pole and the distance, so that differences to poles keep full precision.
    """
    n = len(poles)
    square = z * z
    total = square.sum()
    gaps = np.append(np.diff(poles), total)
    i = np.arange(n)
    # The sign of the function in the middle of an interval tells which end is nearer.
    ahead = poles[None, :] - poles[:, None]
    middle = 1 + (square / (ahead - gaps[:, None] / 2)).sum(axis=1)
    right = (middle < 0) & (i < n - 1)
    origin = i + right
    apart = poles[None, :] - poles[origin][:, None]
    low = np.where(right, -gaps / 2, 0.0)
    high = np.where(right, 0.0, np.where(middle < 0, gaps, gaps / 2))
    low[-1] = gaps[-1] / 2 if middle[-1] < 0 else 0.0
    at = (low + high) / 2
    below = np.tril(np.ones((n, n), dtype=bool))
    todo = i
    for _ in range(_STEPS):
        delta = apart[todo] - at[todo, None]
        term = square / delta
        slope = term / delta
        f = 1 + term.sum(axis=1)
        size = 1 + np.abs(term).sum(axis=1)
        left_slope = np.where(below[todo], slope, 0).sum(axis=1)
        all_slope = slope.sum(axis=1)
        low[todo] = np.where(f < 0, at[todo], low[todo])
        high[todo] = np.where(f > 0, at[todo], high[todo])
        own = delta[np.arange(len(todo)), todo]
        following = np.where(todo < n - 1, delta[np.arange(len(todo)), np.minimum(todo + 1, n - 1)], 0.0)
        with np.errstate(all="ignore"):
            c = f - own * left_slope - following * (all_slope - left_slope)
            a = (own + following) * f - own * following * all_slope
            b = own * following * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            final = own + own * own * all_slope / (f - own * all_slope)
            step = np.where(todo < n - 1, step, final)
            fresh = at[todo] + step
            outside = ~((fresh > low[todo]) & (fresh < high[todo]))
        fresh[outside] = (low[todo][outside] + high[todo][outside]) / 2
        done = (np.abs(f) <= 4 * _EPS * size * n**0.5) | (high[todo] - low[todo] <= 2 * _EPS * np.abs(at[todo])) | (fresh == at[todo])
        at[todo[~done]] = fresh[~done]
        todo = todo[~done]
        if not len(todo):
            break
    return origin, at


def rank_one(values: np.ndarray, vectors: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of ``vectors diag(values) vectors' + x x'``.

    Parts of ``x`` too small to matter are deflated, and so are equal eigenvalues, after a rotation that puts all of
    ``x`` into one of them. The update of the rest is recomputed from its roots, which keeps the vectors orthogonal.
    """
    order = np.argsort(values, kind="stable")
    d, q = values[order], vectors[:, order]
    z = q.T @ x
    scale = max(np.abs(d[[0, -1]]).max(), float(z @ z))
    if scale == 0 or not np.any(z):
        return d, q
    small = 8 * _EPS * scale
    norm = np.sqrt(z @ z)
    live = np.flatnonzero(np.abs(z) * norm > small)
    if len(live) > 1 and np.min(np.diff(d[live])) <= small:
        q = q.copy()
        kept: list[int] = []
        for k in live:
            if kept and d[k] - d[kept[-1]] <= small:
                j = kept.pop()
                length = np.hypot(z[j], z[k])
                cos, sin = z[k] / length, z[j] / length
                q[:, j], q[:, k] = cos * q[:, j] - sin * q[:, k], sin * q[:, j] + cos * q[:, k]
                z[j], z[k] = 0.0, length
            kept.append(k)
        live = np.array(kept)
    if not len(live):
        return d, q
    poles, part = d[live], z[live]
    origin, at = secular_roots(poles, part)
    away = (poles[None, :] - poles[origin][:, None]) - at[:, None]  # [root, pole]
    # The z for which these roots are exact.
    ratio = -away.T  # [pole, root]: root - pole
    exact = np.sqrt(np.abs(_products(ratio, poles))) * np.where(part < 0, -1.0, 1.0)
    columns = exact[:, None] / away.T
    columns /= np.sqrt((columns * columns).sum(axis=0))
    out_d, out_q = d.copy(), q.copy()
    out_d[live] = poles[origin] + at
    out_q[:, live] = q[:, live] @ columns
    return out_d, out_q


def _products(ratio: np.ndarray, poles: np.ndarray) -> np.ndarray:
    """For each pole i the product over roots j of (root j - pole i), over that of (pole j - pole i), paired in order."""
    n = len(poles)
    i = np.arange(n)
    paired = np.where(np.arange(n - 1)[None, :] < i[:, None], np.arange(n - 1)[None, :], np.arange(1, n)[None, :])
    return ratio[:, -1] * (ratio[:, :-1] / (poles[paired] - poles[:, None])).prod(axis=1) if n > 1 else ratio[:, 0]


@dataclass
class Spectrum:
    """Count, mean and scatter (sum of centred outer products, as eigenvalues and eigenvectors) of some vectors."""

    count: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, vector: np.ndarray, times: int = 1) -> None:
        """``times`` copies of a vector: one centred rank-one update."""
        away = vector - self.mean
        total = self.count + times
        if self.count:
            x = away * np.sqrt(self.count / total * times)
            self.values, self.vectors = rank_one(self.values, self.vectors, x)
        self.mean = self.mean + away * (times / total)
        self.count = total

    def merge(self, other: Spectrum) -> None:
        """The other one's spectrum as successive rank-one updates, and one for the distance of the means."""
        if not other.count:
            return
        if not self.count:
            self.count, self.mean, self.values, self.vectors = other.count, other.mean, other.values, other.vectors
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, np.sqrt(value) * vector)
        self.add(other.mean, other.count)

    def to_bytes(self) -> bytes:
        return np.concatenate(([self.count], self.mean, self.values, self.vectors.ravel())).tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes, size: int) -> Spectrum:
        flat = np.frombuffer(blob, np.float64)
        mean, values = flat[1 : size + 1].copy(), flat[size + 1 : 2 * size + 1].copy()
        return cls(int(flat[0]), mean, values, flat[2 * size + 1 :].reshape(size, size).copy())
