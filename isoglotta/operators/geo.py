"""Point tables, interpolation grids and orders behind maps and heat maps. Rendering is left to other tools.

Localities of a matrix are a checked number; points to interpolate are any number (``rbf``). Grids are computed by partition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rbf
from .aggregates import jitter

MAX_POINTS = 5000


def upgma(d: np.ndarray) -> list[tuple[int, int, float]]:
    """Average-linkage merges (node, node, distance); leaves 0..n-1, merge i makes node n+i; ties: smallest nodes."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, size, out = list(range(n)), np.ones(n), []
    for k in range(n - 1):
        i, j = divmod(int(np.argmin(d)), len(d))
        i, j = min(i, j), max(i, j)
        out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), float(d[i, j])))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        size[i] += size[j]
        ids[i] = n + k
        d = np.delete(np.delete(d, j, 0), j, 1)
        size = np.delete(size, j)
        del ids[j]
    return out


def leaf_order(d: np.ndarray) -> list[int]:
    """Leaves of the average-linkage tree, turned so that the sum of distances of neighbours is least.

    For each node and each pair of its outer leaves the best sum is kept (cubic in the leaves); ties go to the first leaves.
    """
    n = len(d)
    if n < 2:
        return list(range(n))
    member, best, how, child = {i: [i] for i in range(n)}, {i: np.zeros((1, 1)) for i in range(n)}, {}, {}
    for k, (a, b, _) in enumerate(upgma(d)):
        node, x, y = n + k, member[a], member[b]
        child[node], member[node] = (a, b), x + y
        size = len(x) + len(y)
        cost, inner = np.full((size, size), np.inf), np.full((size, size, 2), -1)
        joint = d[np.ix_(x, y)]
        # left[i, j]: best over i's far ends m of best[a][i, m] + d[m, j]
        left = (best[a][:, :, None] + joint[None, :, :])
        m = left.argmin(axis=1)
        left = left.min(axis=1)
        both = left[:, :, None] + best[b][None, :, :]
        r = both.argmin(axis=1)
        cost[: len(x), len(x) :] = both.min(axis=1)
        cost[len(x) :, : len(x)] = cost[: len(x), len(x) :].T
        inner[: len(x), len(x) :, 1] = r
        inner[: len(x), len(x) :, 0] = np.take_along_axis(m, r, axis=1)
        best[node], how[node] = cost, inner
        del best[a], best[b]

    def walk(node: int, first: int, last: int) -> list[int]:
        """Leaves of a node from its ``first`` to its ``last`` member (places among its members)."""
        if node < n:
            return [node]
        a, b = child[node]
        na = len(member[a])
        if first >= na:
            return walk(node, last, first)[::-1]
        m, r = how[node][first, last]
        return walk(a, first, int(m)) + walk(b, int(r), last - na)

    root = 2 * n - 2
    first, last = divmod(int(best[root].argmin()), len(member[root]))
    return walk(root, first, last)


def dendrogram(d: np.ndarray, order: list[int] | None = None) -> list[tuple[int, float, float, float, float, float]]:
    """(merge, x and height of the left part, x and height of the right one, height of the joint); leaf k of the order stands at 10 k + 5."""
    n, order = len(d), order or leaf_order(d)
    at = {leaf: (10.0 * k + 5, 0.0) for k, leaf in enumerate(order)}
    out = []
    for k, (a, b, h) in enumerate(upgma(d)):
        (x1, y1), (x2, y2) = sorted((at.pop(a), at.pop(b)))
        out.append((k, x1, y1, x2, y2, h))
        at[n + k] = ((x1 + x2) / 2, h)
    return out


def matrix(m: DataFrame) -> tuple[list, np.ndarray]:
    """(keys, dense matrix) of long (a, b, value); at most MAX_POINTS keys."""
    n = m.select("a").distinct().limit(MAX_POINTS + 1).count()
    if n > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} localities: cluster a sample")
    p = m.toPandas().pivot(index="a", columns="b", values="value").sort_index()
    p = p.reindex(columns=p.index)
    return list(p.index), p.to_numpy(dtype=float)


def heatmap_order(m: DataFrame) -> DataFrame:
    """(id, place) of localities in leaf order of their distances."""
    keys, d = matrix(m)
    order = leaf_order(np.triu(d, 1) + np.triu(d, 1).T) if len(keys) > 1 else list(range(len(keys)))
    return m.sparkSession.createDataFrame([(keys[k], i) for i, k in enumerate(order)], f"id {m.schema['a'].dataType.simpleString()}, place int")


def dendro_heat(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((merge, x1, y1, x2, y2, height), (a, b, x, y, value)): the tree's joints and the matrix in leaf order; drawing is left to a plotter."""
    keys, d = matrix(m)
    d = np.triu(d, 1) + np.triu(d, 1).T
    order, spark = leaf_order(d), m.sparkSession
    kind = m.schema["a"].dataType.simpleString()
    places = spark.createDataFrame([(keys[k], i) for i, k in enumerate(order)], f"id {kind}, place int")
    heat = m.join(places.select(F.col("id").alias("a"), F.col("place").alias("x")), "a").join(places.select(F.col("id").alias("b"), F.col("place").alias("y")), "b")
    return spark.createDataFrame(dendrogram(d, order), "merge int, x1 double, y1 double, x2 double, y2 double, height double"), heat.select("a", "b", "x", "y", "value")


def _points(points: DataFrame, value: str, key: str) -> pd.DataFrame:
    """Points with a value, in order of their place; a few numbers a point reach the driver."""
    ok = points.where(f"lat IS NOT NULL AND lon IS NOT NULL AND `{value}` IS NOT NULL")
    return jitter(ok, key).select("lat", "lon", value).orderBy("lat", "lon").toPandas()


def grid(spark, lat0: float, lon0: float, lat1: float, lon1: float, resolution: int = 100) -> DataFrame:
    """(row, col, lat, lon): row-major grid with ``resolution`` points on the longer side."""
    size = np.array([lat1 - lat0, lon1 - lon0])
    rows, cols = np.maximum((size / size.max() * resolution).astype(int), 1)
    at = lambda i, n, lo, hi: F.lit(lo) + F.col(i) * ((hi - lo) / max(1, n - 1))
    cells = spark.range(int(rows) * int(cols)).select(F.floor(F.col("id") / int(cols)).alias("row"), (F.col("id") % int(cols)).alias("col"))
    return cells.select("row", "col", at("row", int(rows), lat0, lat1).alias("lat"), at("col", int(cols), lon0, lon1).alias("lon"))


def area(points: DataFrame, cells: DataFrame, value: str = "label", key: str = "did") -> DataFrame:
    """(row, col, lat, lon, value): class of each grid point by linear radial interpolation (-r plus a constant) of one-hot classes."""
    p = _points(points, value, key)
    names = sorted(p[value].unique())
    x, y = p[["lat", "lon"]].to_numpy(float), (p[value].to_numpy()[:, None] == np.array(names)[None, :]).astype(float)
    x, w, c = rbf.weights(points.sparkSession, x, y, True)
    kind = points.schema[value].dataType.simpleString()

    def run(frames):
        for f in frames:
            s = c - rbf.values(f[["lat", "lon"]].to_numpy(float), x, w)
            yield f.assign(value=[names[i] for i in s.argmax(axis=1)])

    return cells.select("row", "col", "lat", "lon").mapInPandas(run, f"row bigint, col bigint, lat double, lon double, value {kind}")


def isogloss(points: DataFrame, cells: DataFrame, value: str = "value", key: str = "did") -> DataFrame:
    """(row, col, lat, lon, value): linear radial interpolation without a polynomial, within 0 and 1; contours are for a plotter."""
    p = _points(points, value, key)
    x, w, _ = rbf.weights(points.sparkSession, p[["lat", "lon"]].to_numpy(float), p[[value]].to_numpy(float), False)

    def run(frames):
        for f in frames:
            yield f.assign(value=np.clip(rbf.values(f[["lat", "lon"]].to_numpy(float), x, w)[:, 0], 0, 1).astype(float))

    return cells.select("row", "col", "lat", "lon").mapInPandas(run, "row bigint, col bigint, lat double, lon double, value double")


def inside(points: DataFrame, lat0: float, lon0: float, lat1: float, lon1: float) -> DataFrame:
    """Points strictly inside a box."""
    return points.where((F.col("lat") > lat0) & (F.col("lat") < lat1) & (F.col("lon") > lon0) & (F.col("lon") < lon1))
