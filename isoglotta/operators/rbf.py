"""Weights of linear radial interpolation for any number of points.

Up to ``DENSE`` points are one least-squares problem. More are solved by conjugate gradients: the product of a block of rows
with the vectors is a task that makes its distances anew, so no matrix is kept, and the preconditioner is a sparse inverse
factor in which each point sees its ``NEAR`` nearest predecessors in a random order. Driver and tasks hold a few numbers a point.
Where places are so far apart for their steps that doubles can't hold the sums, weights and residuals are in extended precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

DENSE, NEAR = 2000, 40
#: Distances that a task holds at once, and distances of one product above which it is dealt to executors.
BLOCK, LOCAL = 2_000_000, 100_000_000
#: The residual at the points, as a share of the largest value, that is aimed at, and that is an error.
AIM, LEAST = 1e-9, 1e-6


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = np.square(x[:, 0, None] - y[None, :, 0])
    d += np.square(x[:, 1, None] - y[None, :, 1])
    return np.sqrt(d, out=d)


def values(at: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of distances times weights at some places, in the weights' precision, a block of places at a time."""
    at = at.astype(w.dtype)
    step = max(1, BLOCK // max(1, len(x)))
    return np.concatenate([distances(at[s : s + step], x) @ w for s in range(0, len(at), step)]) if len(at) else np.zeros((0, *w.shape[1:]))


def _factor(x: np.ndarray, lo: int, hi: int, near: int, far: float) -> tuple[np.ndarray, np.ndarray]:
    """Columns lo..hi of the inverse factor of ``far - distance``: (places, values), the point itself first; absent places have 0."""
    d = distances(x[lo:hi], x[:hi])
    d[np.arange(hi)[None, :] >= np.arange(lo, hi)[:, None]] = np.inf
    at = np.argpartition(d, near, axis=1)[:, :near] if hi > near else np.broadcast_to(np.arange(hi), (hi - lo, hi))
    gone = np.isinf(np.take_along_axis(d, at, axis=1))
    at = np.hstack([np.arange(lo, hi)[:, None], at])
    gone = np.hstack([np.zeros((hi - lo, 1), bool), gone])
    p = x[at]
    k = far - np.sqrt(np.square(p[:, :, None, :] - p[:, None, :, :]).sum(axis=-1))
    k[gone[:, :, None] | gone[:, None, :]] = 0
    i, j = np.nonzero(gone)
    k[i, j, j] = 1
    e = np.zeros((hi - lo, at.shape[1], 1))
    e[:, 0] = 1
    z = np.linalg.solve(k, e)[:, :, 0]
    z /= np.sqrt(z[:, :1])
    wide = near + 1 - at.shape[1]
    return np.pad(at, ((0, 0), (0, wide))).astype(np.int32), np.pad(np.where(gone, 0, z), ((0, 0), (0, wide)))


def _spread(spark: SparkSession, n: int, run) -> list:
    """Results of ``run(lo, hi)``, a tuple of arrays, over ranges of rows in order; on executors if there is much to do."""
    step = max(1, BLOCK // n)
    cuts = [(s, min(n, s + step)) for s in range(0, n, step)]
    if n * n <= LOCAL:
        return [run(*c) for c in cuts]

    def each(frames):
        for f in frames:
            for i in f["id"]:
                yield pd.DataFrame({"id": [i]} | {f"a{k}": [a.tobytes()] for k, a in enumerate(run(*cuts[i]))})

    kinds = [(a.dtype, a.shape[1:]) for a in run(0, 1)]
    tasks = min(len(cuts), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.range(0, len(cuts), 1, tasks).mapInPandas(each, "id bigint" + "".join(f", a{k} binary" for k in range(len(kinds)))).collect()
    return [tuple(np.frombuffer(bytes(r[f"a{k}"]), kind).reshape(-1, *shape) for k, (kind, shape) in enumerate(kinds)) for r in sorted(rows, key=lambda r: r["id"])]


def _inverse(spark: SparkSession, x: np.ndarray, y: np.ndarray, far: float) -> np.ndarray:
    """``z`` with ``(far - distances) z = y`` for points in random order."""
    n = len(x)
    at, f = (np.concatenate(a) for a in zip(*_spread(spark, n, lambda lo, hi: _factor(x, lo, hi, NEAR, far))))

    def near(r):
        t = np.stack([(f * r[at, k]).sum(axis=1) for k in range(r.shape[1])], axis=1)
        return np.stack([np.bincount(at.ravel(), (f * t[:, k, None]).ravel(), n) for k in range(r.shape[1])], axis=1)

    def times(v):
        d = np.concatenate([a for (a,) in _spread(spark, n, lambda lo, hi: (distances(x[lo:hi].astype(v.dtype), x) @ v,))])
        return far * v.sum(axis=0) - d

    size = np.maximum(np.abs(y).max(axis=0), 1e-300)
    z, r = np.zeros_like(y), y.copy()
    for _ in range(12):  # each round solves for what the last one left, by the true residual
        own, e = r.astype(float), np.zeros_like(y)
        aim = np.maximum(AIM * size, 1e-6 * np.abs(own).max(axis=0))
        p = q = near(own)
        rq = (own * q).sum(axis=0)
        for _ in range(500):
            kp = times(p)
            a = np.divide(rq, (p * kp).sum(axis=0), out=np.zeros_like(rq), where=rq > 0)
            e, own = e + a * p, own - a * kp
            if (np.abs(own).max(axis=0) <= aim).all():
                break
            q = near(own)
            new = (own * q).sum(axis=0)
            p, rq = q + np.divide(new, rq, out=np.zeros_like(rq), where=rq > 0) * p, new
        z, last = z + e, np.abs(r).max(axis=0)
        r = y - times(z)
        left = np.abs(r).max(axis=0)
        if (left <= AIM * size).all():
            break
        if ((left <= AIM * size) | ~(left <= last / 2)).all():  # what is left is rounding
            if (left <= LEAST * size).all() or z.dtype == np.longdouble:
                break
            z = z.astype(np.longdouble)
            r = y - times(z)
    if not (left <= LEAST * size).all():
        raise ArithmeticError(f"interpolation of {n} points did not converge: residuals {left}")
    return z


def weights(spark: SparkSession, x: np.ndarray, y: np.ndarray, constant: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, w, c): sums of ``-distance * w`` plus c, where w adds up to 0, or (without a constant) of ``distance * w``, are y at x.

    Points at the same place count as one with their mean, which is what least squares makes of them.
    """
    if len(x) <= DENSE:
        n, one = len(x), int(constant)
        a = np.zeros((n + one, n + one))
        a[:n, :n] = -distances(x, x) if constant else distances(x, x)
        if constant:
            a[n, :n], a[:n, n] = 1, 1
        w = np.linalg.lstsq(a, np.vstack([y, np.zeros((one, y.shape[1]))]), rcond=None)[0]
        return x, w[:n], w[n] if constant else np.zeros(y.shape[1])
    x, place = np.unique(x, axis=0, return_inverse=True)
    place, n = place.ravel(), len(x)
    y = np.stack([np.bincount(place, v, n) for v in y.T], axis=1) / np.bincount(place, minlength=n)[:, None]
    if n <= DENSE:
        return weights(spark, x, y, constant)
    order = np.random.default_rng(0).permutation(n)
    x, y = x[order], y[order]
    # Twice the diameter, and more: then the kernel is positive definite, and it gives the same sums if weights add up to 0.
    far = 2.0 * float(np.hypot(*np.ptp(x, axis=0)))
    z = _inverse(spark, x, np.hstack([y, np.ones((n, 1))]), far)
    g, h = z[:, :-1], z[:, -1:]
    if constant:
        c = g.sum(axis=0) / h.sum()
        return x, g - h * c, c
    return x, far * h * (g.sum(axis=0) / (far * h.sum() - 1)) - g, np.zeros(y.shape[1])
