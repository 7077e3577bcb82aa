"""Reconstruction of proto-classes: imputation, decision trees over one-hot readings, class summaries.

Trees of ``reconstruct`` and ``reconstruct_elements`` are grown level by level: tasks count the classes on both sides of all
splits, and the driver holds nodes and names of features only. ``denoise`` and ``impute_logistic`` work on the driver, on at
most ``MAX_ROWS`` characters, which is checked.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import top_values

MAX_ROWS = 50_000
#: Bytes of class counts that a task holds at once.
COUNTS = 64_000_000


def one_hot(f: pd.DataFrame) -> tuple[np.ndarray, list[tuple[str, str]], list[slice]]:
    """(matrix, names, a block for each column); null and '' have no column."""
    parts, names, blocks, at = [], [], [], 0
    for c in f.columns:
        values = sorted({v for v in f[c] if isinstance(v, str) and v})
        parts.append((f[c].to_numpy()[:, None] == np.array(values, dtype=object)[None, :]).astype(float))
        names += [(c, v) for v in values]
        blocks.append(slice(at, at + len(values)))
        at += len(values)
    return np.concatenate(parts, axis=1) if parts else np.zeros((len(f), 0)), names, blocks


def _entropy(y: np.ndarray, blocks: list[slice]) -> float:
    """Mean over outputs of the entropy (bits) of their classes; a missing value is a class of its own."""
    return float(_entropies(y.sum(axis=0)[None, :], np.array([len(y)]), blocks)[0])


def _entropies(counts: np.ndarray, n: np.ndarray, blocks: list[slice]) -> np.ndarray:
    """The same of groups of rows, from their class counts and sizes."""
    total = np.zeros(len(counts))
    for b in blocks:
        p = counts[:, b] / n[:, None]
        p = np.concatenate([p, np.maximum(0.0, 1 - p.sum(axis=1, keepdims=True))], axis=1)
        total -= np.where(p > 1e-12, p * np.log2(np.maximum(p, 1e-12)), 0.0).sum(axis=1)
    return total / max(1, len(blocks))


def grow(x: np.ndarray, y: np.ndarray, blocks: list[slice], min_leaf: int = 3, min_decrease: float = 0.002) -> np.ndarray:
    """Leaf numbers (from 0, left to right) of a binary tree that lowers the mean entropy of all outputs."""
    leaf, count, n = np.zeros(len(x), dtype=int), 0, len(x)

    def split(rows: np.ndarray) -> None:
        nonlocal count
        best, h = None, _entropy(y[rows], blocks)
        if len(rows) >= 2 * min_leaf and h > 0:
            size = x[rows].sum(axis=0)
            able = np.flatnonzero((size >= min_leaf) & (len(rows) - size >= min_leaf))
            # class counts of both sides of all splits, from one product
            inside = x[rows][:, able].T @ y[rows]
            outside = y[rows].sum(axis=0) - inside
            on_n, off_n = size[able], len(rows) - size[able]
            gains = len(rows) / n * (h - (on_n * _entropies(inside, on_n, blocks) + off_n * _entropies(outside, off_n, blocks)) / len(rows))
            for j, gain in zip(able, gains):
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, x[rows, j] > 0)
        if best is None or best[0] < min_decrease:
            leaf[rows] = count
            count += 1
            return
        split(rows[~best[1]])
        split(rows[best[1]])

    if n:
        split(np.arange(n))
    return leaf


def impute_frequent(cells: DataFrame) -> DataFrame:
    """(cid, col, value): missing (cid, col) pairs get the column's most frequent value (ties: the smallest)."""
    known = cells.where(F.coalesce("value", F.lit("")) != "")
    count = known.groupBy("col", "value").agg(F.count("*").alias("n"))
    mode = count.groupBy("col").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("m"))
    grid = cells.select("cid").distinct().join(mode, F.lit(True))
    return grid.join(known, ["cid", "col"], "left").select("cid", "col", F.coalesce("value", "m").alias("value"))


def l1_logistic(x: np.ndarray, y: np.ndarray, classes: int, c: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights (features x classes, the last row the constant) of multinomial logistic regression with an L1 penalty of strength 1 / c.

    Accelerated proximal gradient steps of the summed loss; the constant isn't penalised. The step is the inverse of a bound on
    the curvature: half the largest eigenvalue of x'x, from power steps.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    v = np.ones(x.shape[1])
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1 / (0.5 * 1.05 * max(np.linalg.norm(x @ v) ** 2, 1e-12))
    w = u = np.zeros((x.shape[1], classes))
    t, target = 1.0, np.eye(classes)[y]
    for _ in range(steps):
        z = x @ u
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = u - step * (x.T @ (p - target))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step / c, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


def impute_logistic(cells: DataFrame, rounds: int = 3, c: float = 1.0, steps: int = 40) -> DataFrame:
    """(cid, col, value): missing cells start as their column's most frequent value; then, for ``rounds`` rounds and column by column (fewest
    missing first), they become what L1 logistic regression on all other columns' one-hot values predicts."""
    n = cells.select("cid").distinct().limit(MAX_ROWS + 1).count()
    if n > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} characters")
    known = cells.where(F.coalesce("value", F.lit("")) != "").toPandas().pivot(index="cid", columns="col", values="value").sort_index()
    values = {k: sorted(known[k].dropna().unique()) for k in known.columns}
    code = np.stack([known[k].map({v: i for i, v in enumerate(values[k])}).fillna(-1).to_numpy(dtype=int) for k in known.columns], axis=1)
    missing = code < 0
    for j in range(code.shape[1]):
        code[missing[:, j], j] = np.bincount(code[~missing[:, j], j]).argmax()
    sizes = [len(values[k]) for k in known.columns]
    blocks = np.cumsum([0] + sizes)
    hot = np.zeros((len(code), blocks[-1]))
    for j in range(code.shape[1]):
        hot[np.arange(len(code)), blocks[j] + code[:, j]] = 1
    for _ in range(rounds):
        for j in sorted(np.flatnonzero(missing.any(axis=0)).tolist(), key=lambda j: (missing[:, j].sum(), j)):
            gone = missing[:, j]
            if sizes[j] > 1:
                others = np.delete(hot, np.s_[blocks[j] : blocks[j + 1]], axis=1)
                w = l1_logistic(others[~gone], code[~gone, j], sizes[j], c, steps)
                code[gone, j] = (others[gone] @ w[:-1] + w[-1]).argmax(axis=1)
            hot[gone, blocks[j] : blocks[j + 1]] = np.eye(sizes[j])[code[gone, j]]
    filled = pd.DataFrame({"cid": np.repeat(known.index.to_numpy(), code.shape[1]), "col": list(known.columns) * len(code), "value": [values[k][v] for row in code for k, v in zip(known.columns, row)]})
    return cells.sparkSession.createDataFrame(filled, f"cid {cells.schema['cid'].dataType.simpleString()}, col string, value string")


def leaf_values(leaf: np.ndarray, y: np.ndarray, blocks: list[slice]) -> np.ndarray:
    """Per row and output the place (in its block) of the most frequent value of the row's leaf (ties: the first)."""
    out = np.zeros((len(leaf), len(blocks)), dtype=int)
    for k in np.unique(leaf):
        rows = leaf == k
        counts = y[rows].sum(axis=0)
        out[rows] = [int(counts[b].argmax()) if counts[b].size else 0 for b in blocks]
    return out


def denoise(cells: DataFrame, min_leaf: int = 1, min_decrease: float = 0.0001) -> tuple[DataFrame, DataFrame]:
    """((cid, col, value), (cid, proto)): every cell as the tree over all columns gives it back, and the tree's leaf."""
    n = cells.select("cid").distinct().limit(MAX_ROWS + 1).count()
    if n > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} characters")
    f = impute_frequent(cells).toPandas().pivot(index="cid", columns="col", values="value").sort_index()
    x, names, blocks = one_hot(f)
    leaf = grow(x, x, blocks, min_leaf, min_decrease)
    kind, spark = cells.schema["cid"].dataType.simpleString(), cells.sparkSession
    back = [names[b.start + k][1] for row in leaf_values(leaf, x, blocks) for b, k in zip(blocks, row)]
    long = pd.DataFrame({"cid": np.repeat(f.index.to_numpy(), len(blocks)), "col": list(f.columns) * len(f), "value": back})
    return spark.createDataFrame(long, f"cid {kind}, col string, value string"), spark.createDataFrame(pd.DataFrame({"cid": f.index, "proto": leaf.astype("int64")}), f"cid {kind}, proto bigint")


def _codes(cells: DataFrame) -> tuple[DataFrame, list[tuple], np.ndarray]:
    """((cid, codes), (col, value) of each feature, place of each feature's column): the feature of each cell, missing ones the column's most frequent."""
    known = cells.where(F.coalesce("value", F.lit("")) != "").groupBy("col", "value").agg(F.count("*").alias("n")).collect()
    known = sorted((r["col"], r["value"], r["n"]) for r in known)
    names, cols = [(c, v) for c, v, _ in known], sorted({c for c, _, _ in known})
    place = {c: k for k, c in enumerate(cols)}
    col_of = np.array([place[c] for c, _ in names], dtype=int)
    mode, top = np.zeros(len(cols), dtype=np.uint32), [0] * len(cols)
    for f, (c, _, n) in enumerate(known):
        if n > top[place[c]]:
            mode[place[c]], top[place[c]] = f, n
    kinds = {k: cells.schema[k].dataType.simpleString() for k in ("cid", "col", "value")}
    ids = cells.sparkSession.createDataFrame([(c, v, f) for f, (c, v) in enumerate(names)], f"col {kinds['col']}, value {kinds['value']}, f int")
    sets = cells.select("cid", "col", "value").join(F.broadcast(ids), ["col", "value"], "left").groupBy("cid").agg(F.collect_list("f").alias("f"))

    def pack(batches):
        for b in batches:
            f, m = b.column("f"), np.tile(mode, (b.num_rows, 1))
            found = f.flatten().to_numpy(zero_copy_only=False)
            m[np.repeat(np.arange(b.num_rows), np.diff(f.offsets.to_numpy())), col_of[found]] = found
            yield pa.record_batch([b.column("cid"), pa.array([r.tobytes() for r in m], pa.binary())], names=["cid", "codes"])

    return sets.select("cid", "f").mapInArrow(pack, f"cid {kinds['cid']}, codes binary"), names, col_of


def _nodes(codes: np.ndarray, col_of: np.ndarray, feature: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The node of a tree that each row ends in."""
    at, rows = np.zeros(len(codes), dtype=int), np.arange(len(codes))
    while (inner := feature[at] >= 0).any():
        f = np.maximum(feature[at], 0)
        at = np.where(inner, child[at, (codes[rows, col_of[f]] == f).astype(int)], at)
    return at


def _trees(cells: DataFrame, outputs: dict[str, tuple], min_leaf: int) -> DataFrame:
    """(cid, a leaf for each output), of the trees that ``grow`` makes; outputs: name -> (is a column one of its?, least decrease)."""
    packed, names, col_of = _codes(cells)
    packed = packed.persist(StorageLevel.MEMORY_AND_DISK)  # read for each level
    n, wide, many = packed.count(), len(set(col_of.tolist())), len(names)
    own = {e: np.flatnonzero([f(c) for c, _ in names]) for e, (f, _) in outputs.items()}
    blocks = {}
    for e, ys in own.items():
        cuts = [0, *(np.flatnonzero(np.diff(col_of[ys])) + 1).tolist(), len(ys)]
        blocks[e] = [slice(a, b) for a, b in zip(cuts, cuts[1:])] if len(ys) else []
    trees = {e: (np.array([-1]), np.zeros((1, 2), dtype=int)) for e in outputs}
    open_ = {e: [0] if len(ys) else [] for e, ys in own.items()}
    step = {e: max(1, COUNTS // (8 * (len(ys) + 1))) for e, ys in own.items()}
    read = lambda b: np.frombuffer(b"".join(b.column("codes").to_pylist()), dtype=np.uint32).reshape(b.num_rows, wide)

    def gains_of(units: list[tuple]) -> list:
        """Per (output, node, first feature) the gains of the splits by its features, -inf where a side is too small."""

        def count(batches):
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for s in range(0, b.num_rows, 4096):
                    codes = read(b.slice(s, 4096))
                    x = np.zeros((len(codes), many), dtype=np.float32)
                    x[np.arange(len(codes))[:, None], codes] = 1
                    at = {e: _nodes(codes, col_of, *trees[e]) for e in {u[0] for u in units}}
                    for k, (e, node, f) in enumerate(units):
                        part = x[at[e] == node]
                        if len(part):
                            y, own_x = part[:, own[e]], part[:, f : f + step[e]]
                            new = np.concatenate([[len(part)], own_x.sum(axis=0), y.sum(axis=0), (own_x.T @ y).ravel()], dtype=np.float64)
                            sums[k] = sums[k] + new if k in sums else new
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["k", "v"])

        def judge(table: pa.Table) -> pa.Table:
            k, v = table.column("k")[0].as_py(), sum(np.frombuffer(r.as_buffer(), dtype=np.float64) for r in table.column("v"))
            e, _, f = units[k]
            size, wide_y = min(step[e], many - f), len(own[e])
            rows, on, y, inside = v[0], v[1 : size + 1], v[size + 1 : size + 1 + wide_y], v[size + 1 + wide_y :].reshape(size, wide_y)
            out, h = np.full(size, -np.inf), float(_entropies(y[None, :], np.array([rows]), blocks[e])[0])
            if rows >= 2 * min_leaf and h > 0:
                able = np.flatnonzero((on >= min_leaf) & (rows - on >= min_leaf))
                on_n, off_n = on[able], rows - on[able]
                out[able] = rows / n * (h - (on_n * _entropies(inside[able], on_n, blocks[e]) + off_n * _entropies(y - inside[able], off_n, blocks[e])) / rows)
            return pa.table({"k": pa.array([k], pa.int32()), "v": pa.array([out.tobytes()], pa.binary())})

        found = packed.select("codes").mapInArrow(count, "k int, v binary").groupBy("k").applyInArrow(judge, "k int, v binary").collect()
        return [(units[r["k"]], np.frombuffer(bytes(r["v"]))) for r in found]

    while any(open_.values()):
        units = [(e, node, f) for e, nodes in open_.items() for node in nodes for f in range(0, many, step[e])]
        gains = {(e, node): np.full(many, -np.inf) for e, node, _ in units}
        weight = {e: 8 * min(step[e], many) * (len(own[e]) + 1) for e in outputs}
        while units:
            held, now = 0, []
            while units and (not now or held + weight[units[0][0]] <= COUNTS):
                held += weight[units[0][0]]
                now.append(units.pop(0))
            for (e, node, f), v in gains_of(now):
                gains[e, node][f : f + len(v)] = v
        open_ = {e: [] for e in outputs}
        for (e, node), v in gains.items():
            best = None
            for j in np.flatnonzero(v > -np.inf).tolist():
                if best is None or v[j] > v[best] + 1e-12:
                    best = j
            if best is not None and v[best] >= outputs[e][1]:
                feature, child = trees[e]
                more = len(feature)
                child[node], feature[node] = (more, more + 1), best
                trees[e] = np.append(feature, [-1, -1]), np.vstack([child, np.zeros((2, 2), dtype=int)])
                open_[e] += [more, more + 1]
    leaf = {}
    for e, (feature, child) in trees.items():
        leaf[e], stack, count = np.zeros(len(feature), dtype=np.int64), [0], 0
        while stack:  # leaves are numbered from left to right
            node = stack.pop()
            if feature[node] >= 0:
                stack += [child[node, 1], child[node, 0]]
            else:
                leaf[e][node], count = count, count + 1

    def place(batches):
        for b in batches:
            codes = read(b)
            yield pa.record_batch([b.column("cid"), *(pa.array(leaf[e][_nodes(codes, col_of, *trees[e])]) for e in outputs)], names=["cid", *outputs])

    kinds = "".join(f", `{e}` bigint" for e in outputs)
    return packed.mapInArrow(place, f"cid {cells.schema['cid'].dataType.simpleString()}{kinds}")


def reconstruct(cells: DataFrame, min_leaf: int = 3, min_decrease: float = 0.002) -> DataFrame:
    """(cid, proto): leaf of a multi-output tree that predicts all columns from all columns."""
    return _trees(cells, {"proto": (lambda c: True, min_decrease)}, min_leaf)


def reconstruct_elements(cells: DataFrame, min_leaf: int = 3, min_decrease: dict[str, float] | None = None) -> DataFrame:
    """(cid, a leaf for each element): a tree for each element predicts that element's columns from all columns.

    Columns are named '{locality}/{element}'; ``min_decrease`` has the elements and their thresholds.
    """
    least = min_decrease or {"initial": 0.002, "final": 0.002, "tone": 0.01}
    return _trees(cells, {e: (lambda c, e=e: c.rsplit("/", 1)[-1] == e, v) for e, v in least.items()}, min_leaf)


def get_syllables(readings: DataFrame, classes: DataFrame, elements: Sequence[str]) -> DataFrame:
    """Per class and element the ten most frequent values."""
    return top_values(readings.join(classes, "cid"), "proto", elements)
