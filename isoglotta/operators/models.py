"""Encoder models of readings: vocabularies, bilinear scoring of localities and characters, training.

Weights are small dense arrays (vocabularies are parameters) and are broadcast; rows stay distributed. Each
training step sums gradients over partitions, so the driver sees one gradient a partition and never a row.
``fit_characters`` is for any number of characters: their embeddings stay with their rows, on the executors.
"""

from __future__ import annotations

import copy
import json
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as pa_type
from pyspark.sql.types import ArrayType, StringType

from isoglotta.llm.common import Scratch

from .encode import make_dict, with_vocabulary


@dataclass
class Processor:
    """Vocabularies of locality, character and target columns; ids 1..n, 0 for null and unknown values."""

    dialects: dict[str, list] = field(default_factory=dict)
    chars: dict[str, list] = field(default_factory=dict)
    targets: dict[str, list] = field(default_factory=dict)

    @classmethod
    def build(cls, data: DataFrame, dialects: Sequence[str], chars: Sequence[str], targets: Sequence[str], min_frequency=None, max_categories: int | None = None) -> "Processor":
        def vocabulary(columns):
            return {c: [r["value"] for r in make_dict(data, c, (min_frequency or {}).get(c) if isinstance(min_frequency, dict) else min_frequency, max_categories).orderBy("code").collect()] for c in columns}

        return cls(vocabulary(dialects), vocabulary(chars), vocabulary(targets))

    def sizes(self) -> dict[str, list[int]]:
        return {k: [len(v) + 1 for v in getattr(self, k).values()] for k in ("dialects", "chars", "targets")}

    def encode(self, data: DataFrame) -> DataFrame:
        """Add arrays dialect_ids, char_ids, target_ids."""
        for kind, name in (("dialects", "dialect_ids"), ("chars", "char_ids"), ("targets", "target_ids")):
            table = getattr(self, kind)
            for c, v in table.items():
                data = with_vocabulary(data, c, v, f"_{kind}_{c}")
            data = data.withColumn(name, F.array(*(F.col(f"_{kind}_{c}").cast("long") for c in table)) if table else F.array().cast("array<bigint>")).drop(*(f"_{kind}_{c}" for c in table))
        return data

    def to_json(self) -> str:
        return json.dumps({"dialect_vocabs": list(self.dialects.values()), "char_vocabs": list(self.chars.values()), "target_vocabs": list(self.targets.values())}, ensure_ascii=False)


def known_rows(encoded: DataFrame) -> DataFrame:
    """Rows with at least one known locality, character and target id."""
    return encoded.where(" AND ".join(f"exists({c}, x -> x <> 0)" for c in ("dialect_ids", "char_ids", "target_ids")))


class BilinearEncoder:
    """out[o] = sum d[i] W[i, j, o] c[j] (+ c[o] with ``residual``); logits of a target: out times its embeddings, plus a bias."""

    def __init__(self, sizes: dict[str, list[int]], dialect_size: int = 20, char_size: int = 20, output_size: int = 20, residual: bool = False, bias: bool = True, seed: int = 0, missing_id: int | None = 0):
        rng = np.random.default_rng(seed)
        make = lambda *s: rng.normal(0, 0.1, s)
        self.residual, self.missing_id = residual, missing_id
        self.p = {f"d{i}": make(n, dialect_size) for i, n in enumerate(sizes["dialects"])}
        self.p |= {f"c{i}": make(n, char_size) for i, n in enumerate(sizes["chars"])}
        self.p |= {f"t{i}": make(n, output_size) for i, n in enumerate(sizes["targets"])}
        self.p |= {f"b{i}": np.zeros(n) for i, n in enumerate(sizes["targets"])} if bias else {}
        self.p["w"] = make(dialect_size, char_size, output_size)
        if residual and char_size != output_size:
            raise ValueError("a residual needs outputs as wide as characters")
        self.n = {k[0]: len(sizes[k]) for k in ("dialects", "chars", "targets")}

    def _mean(self, kind: str, ids: np.ndarray) -> np.ndarray:
        return sum(self.p[f"{kind}{i}"][ids[:, i]] for i in range(self.n[kind])) / self.n[kind]

    def transform(self, d: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.einsum("ni,ijo,nj->no", d, self.p["w"], c, optimize=True)
        return out + c if self.residual else out

    def logits(self, d_ids: np.ndarray, c_ids: np.ndarray) -> list[np.ndarray]:
        out = self.transform(self._mean("d", d_ids), self._mean("c", c_ids))
        return [out @ self.p[f"t{i}"].T + self.p.get(f"b{i}", 0) for i in range(self.n["t"])]

    def probabilities(self, d_ids, c_ids) -> list[np.ndarray]:
        out = []
        for z in self.logits(d_ids, c_ids):
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(e / e.sum(axis=1, keepdims=True))
        return out

    def gradients(self, d_ids, c_ids, t_ids, weights=None) -> tuple[dict[str, np.ndarray], float, np.ndarray, np.ndarray]:
        """(gradient sums, loss sum, correct and counted per target); missing targets are masked, targets weigh 1 if no weights are given."""
        d, c = self._mean("d", d_ids), self._mean("c", c_ids)
        out, g = self.transform(d, c), {k: np.zeros_like(v) for k, v in self.p.items()}
        g_out, loss, right, seen = np.zeros_like(out), 0.0, np.zeros(self.n["t"]), np.zeros(self.n["t"])
        for i, p in enumerate(self.probabilities(d_ids, c_ids)):
            y = t_ids[:, i]
            mask = np.ones(len(y), dtype=bool) if self.missing_id is None else y != self.missing_id
            scale = 1.0 if weights is None else weights[i]
            loss -= scale * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))[mask].sum()
            right[i], seen[i] = (p.argmax(axis=1) == y)[mask].sum(), mask.sum()
            z = p.copy()
            z[np.arange(len(y)), y] -= 1
            z[~mask] = 0
            z *= scale
            g[f"t{i}"] += z.T @ out
            if f"b{i}" in g:
                g[f"b{i}"] += z.sum(axis=0)
            g_out += z @ self.p[f"t{i}"]
        g["w"] += np.einsum("ni,nj,no->ijo", d, c, g_out, optimize=True)
        g_d = np.einsum("ijo,nj,no->ni", self.p["w"], c, g_out, optimize=True)
        g_c = np.einsum("ijo,ni,no->nj", self.p["w"], d, g_out, optimize=True) + (g_out if self.residual else 0)
        for kind, ids, grad in (("d", d_ids, g_d), ("c", c_ids, g_c)):
            for i in range(self.n[kind]):
                np.add.at(g[f"{kind}{i}"], ids[:, i], grad / self.n[kind])
        return g, loss, right, seen

    def predict(self, encoded: DataFrame, keys: Sequence[str]) -> DataFrame:
        """keys and predicted (array of a class id for each target)."""
        sent = encoded.sparkSession.sparkContext.broadcast(self)

        def run(frames):
            for f in frames:
                if len(f):
                    z = sent.value.logits(np.stack(f.dialect_ids), np.stack(f.char_ids))
                    yield f[list(keys)].assign(predicted=list(np.stack([x.argmax(axis=1) for x in z], axis=1)))

        kinds = ", ".join(f"`{k}` {encoded.schema[k].dataType.simpleString()}" for k in keys)
        return encoded.select(*keys, "dialect_ids", "char_ids").mapInPandas(run, f"{kinds}, predicted array<bigint>")

    def predict_proba(self, encoded: DataFrame, keys: Sequence[str]) -> DataFrame:
        """keys and probabilities (for each target an array of its classes')."""
        sent = encoded.sparkSession.sparkContext.broadcast(self)

        def run(frames):
            for f in frames:
                if len(f):
                    p = sent.value.probabilities(np.stack(f.dialect_ids), np.stack(f.char_ids))
                    yield f[list(keys)].assign(probabilities=[[x[i].tolist() for x in p] for i in range(len(f))])

        kinds = ", ".join(f"`{k}` {encoded.schema[k].dataType.simpleString()}" for k in keys)
        return encoded.select(*keys, "dialect_ids", "char_ids").mapInPandas(run, f"{kinds}, probabilities array<array<double>>")

    def fit_batches(self, train: DataFrame, validate: DataFrame | None = None, target_weights: Sequence[float] | None = None, epochs: int = 20, batch_size: int = 100, rate: float = 0.1, path: str | None = None) -> list[dict]:
        """Mini-batch training; per epoch a dict of training loss and, with ``validate``, its loss and accuracy.

        In an epoch every partition takes gradient steps over batches of its own rows, starting from the broadcast weights; the results,
        weighted by rows, are averaged (with one partition that is plain mini-batch descent). With ``path`` the weights and losses of each
        epoch are written there, and a later call goes on after the last epoch that it finds.
        """
        spark, log, first = train.sparkSession, [], 0
        weights = None if target_weights is None else np.asarray(target_weights, dtype=float)
        if path is not None and (done := self._epochs(spark, path)):
            first = max(done)
            self.load(spark, f"{path}/epoch={first}/weights")
            log = [{k: v for k, v in r.asDict().items() if v is not None} for r in spark.read.json(f"{path}/epoch={first}/log").orderBy("epoch").collect()]
        names = sorted(self.p)
        for epoch in range(first + 1, epochs + 1):
            sent = spark.sparkContext.broadcast(self)

            def run(frames):
                m, rows, loss = copy.deepcopy(sent.value), 0, 0.0  # noqa: B023
                for f in frames:
                    for at in range(0, len(f), batch_size):
                        b = f.iloc[at : at + batch_size]
                        g, own, _, _ = m.gradients(*(np.stack(b[c]) for c in ("dialect_ids", "char_ids", "target_ids")), weights)
                        for k in m.p:
                            m.p[k] -= rate * g[k] / len(b)
                        rows, loss = rows + len(b), loss + own
                if rows:
                    yield pd.DataFrame({"w": [np.concatenate([m.p[k].ravel() for k in names]).tobytes()], "n": [rows], "loss": [loss]})

            found = train.select("dialect_ids", "char_ids", "target_ids").mapInPandas(run, "w binary, n bigint, loss double").collect()  # one a partition
            sent.unpersist()
            if not found:
                raise ValueError("no rows to learn from")
            n = sum(r["n"] for r in found)
            mean, at = sum(np.frombuffer(bytes(r["w"])) * (r["n"] / n) for r in found), 0
            for k in names:
                self.p[k], at = mean[at : at + self.p[k].size].reshape(self.p[k].shape).copy(), at + self.p[k].size
            log.append({"epoch": epoch, "loss": sum(r["loss"] for r in found) / n})
            if validate is not None:
                e = self.evaluate(validate, weights)
                log[-1] |= {"validation_loss": e["loss"], "validation_accuracy": e["accuracy"]}
            if path is not None:
                self.save(spark, f"{path}/epoch={epoch}/weights")
                spark.createDataFrame([(json.dumps(x),) for x in log], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/epoch={epoch}/log")
        return log

    @staticmethod
    def _epochs(spark: SparkSession, path: str) -> list[int]:
        """Epochs that were written whole: the log comes last."""
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch=*/log/_SUCCESS")
        found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
        return [int(f.getPath().toString().rsplit("epoch=", 1)[1].split("/")[0]) for f in found]

    def _sums(self, encoded: DataFrame, weights=None):
        sent = encoded.sparkSession.sparkContext.broadcast(self)

        def run(frames):
            total = None
            for f in frames:
                if len(f):
                    g, loss, right, seen = sent.value.gradients(*(np.stack(f[c]) for c in ("dialect_ids", "char_ids", "target_ids")), weights)
                    own = np.concatenate([g[k].ravel() for k in sorted(g)] + [[loss], right, seen, [len(f)]])
                    total = own if total is None else total + own
            if total is not None:
                yield pd.DataFrame({"s": [total.tobytes()]})

        rows = encoded.select("dialect_ids", "char_ids", "target_ids").mapInPandas(run, "s binary").collect()  # one a partition
        if not rows:
            raise ValueError("no rows to learn from")
        s = np.sum([np.frombuffer(bytes(r["s"])) for r in rows], axis=0)
        g, at = {}, 0
        for k in sorted(self.p):
            g[k], at = s[at : at + self.p[k].size].reshape(self.p[k].shape), at + self.p[k].size
        n = self.n["t"]
        return g, s[at], s[at + 1 : at + 1 + n], s[at + 1 + n : at + 1 + 2 * n], s[-1]

    def fit(self, encoded: DataFrame, epochs: int = 20, rate: float = 0.5, decay: float = 0.9) -> list[float]:
        """Adaptive full-batch steps (each row's share of the gradient); losses a row by epoch."""
        losses, cache = [], {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(epochs):
            g, loss, _, _, n = self._sums(encoded)
            losses.append(float(loss / n))
            for k in self.p:
                step = g[k] / n
                cache[k] = decay * cache[k] + (1 - decay) * step * step
                self.p[k] = self.p[k] - rate * 0.1 * step / (np.sqrt(cache[k]) + 1e-8)
        return losses

    def evaluate(self, encoded: DataFrame, target_weights: Sequence[float] | None = None) -> dict:
        _, loss, right, seen, n = self._sums(encoded, None if target_weights is None else np.asarray(target_weights, dtype=float))
        return {"loss": float(loss / n), "accuracy": [float(r / s) if s else float("nan") for r, s in zip(right, seen)]}

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(k, list(v.shape), v.ravel().tolist()) for k, v in self.p.items()]
        spark.createDataFrame(rows, "name string, shape array<bigint>, value array<double>").write.mode("overwrite").parquet(path)

    def load(self, spark: SparkSession, path: str) -> "BilinearEncoder":
        for r in spark.read.parquet(path).collect():
            self.p[r["name"]] = np.array(r["value"]).reshape(r["shape"])
        return self


def draws(key: np.ndarray, size: int, scale: float = 0.1) -> np.ndarray:
    """Normal draws (keys x size) that depend on the 64-bit keys only."""
    x = key.astype(np.uint64)[:, None] + (np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53
    return scale * np.sqrt(-2 * np.log1p(-u[:, :size])) * np.cos(2 * np.pi * u[:, size:])


def fit_characters(data: DataFrame, dialect: str, char: str, targets: Sequence[str], size: int = 20, epochs: int = 20, rate: float = 0.5, decay: float = 0.9, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """((dialect, char, predicted), losses a row by epoch): ``BilinearEncoder.fit`` and ``predict`` over one locality and one character column.

    A row is a character with its readings, its embedding and that one's step size; an epoch rewrites the embeddings where they are
    and sends the driver the gradients of what characters share. Vocabularies of localities and targets are held by the driver,
    that of characters by nobody: embeddings start from hashes of the character. A character's readings are one list.
    """
    p = Processor.build(data, [dialect], [], targets)
    places, n_t = p.dialects[dialect], len(targets)
    rng = np.random.default_rng(seed)
    shared = {"d": rng.normal(0, 0.1, (len(places) + 1, size))} | {f"t{i}": rng.normal(0, 0.1, (len(v) + 1, size)) for i, v in enumerate(p.targets.values())}
    shared |= {f"b{i}": np.zeros(len(v) + 1) for i, v in enumerate(p.targets.values())} | {"w": rng.normal(0, 0.1, (size, size, size))}
    cache = {k: np.zeros_like(v) for k, v in shared.items()}
    kinds = {c: data.schema[c].dataType.simpleString() for c in (dialect, char)}

    coded = p.encode(data.select(dialect, char, *targets))
    # a locality is its id, 0 if null and -1 if empty; the model's id of both is 0
    place = F.when(F.col(dialect).cast("string") == "", -1).otherwise(F.element_at("dialect_ids", 1))
    reading = F.concat(F.array(place), "target_ids")
    known = F.coalesce(F.col(char).cast("string"), F.lit("")) != ""
    rows = coded.groupBy(char).agg(F.sort_array(F.collect_list(reading)).alias("r")).select(F.col(char).alias("c"), known.alias("known"), F.xxhash64(char, F.lit(seed)).alias("key"), "r")

    def pack(batches):
        for b in batches:
            flat = b.column("r").flatten().flatten().to_numpy().astype(np.int32).reshape(-1, 1 + n_t)
            cuts = np.concatenate([[0], np.cumsum([len(r) for r in b.column("r")])]).astype(int)
            e = draws(b.column("key").to_numpy(zero_copy_only=False).astype(np.int64), size)
            binary = lambda v: pa.array(v, pa.binary())
            own = [flat[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]
            yield pa.record_batch([b.column("c"), b.column("known"), binary(own), binary([x.tobytes() for x in e]), binary([bytes(8 * size)] * len(e)), binary([None] * len(e))], names=names)

    def chunks(batches):
        """Batches of few characters: (batch, character of each reading, its codes, embeddings)."""
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                b = whole.slice(s, 2000)
                r = b.column("r").to_pylist()
                at = np.repeat(np.arange(len(r)), [len(x) // (4 * (1 + n_t)) for x in r])
                codes = np.frombuffer(b"".join(r), dtype=np.int32).reshape(-1, 1 + n_t)
                order = np.argsort(codes[:, 0], kind="stable")
                yield b, at[order], codes[order], np.frombuffer(b"".join(b.column("e").to_pylist())).reshape(-1, size)

    def outputs(m, place, c):
        """(places with rows, their ranges, outputs): the rows are in the order of their places."""
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]]).astype(int) if len(place) else np.zeros(1, int)
        ranges = [(int(place[i]), slice(i, j)) for i, j in zip(cuts, cuts[1:])]
        out = np.zeros_like(c)
        for k, r in ranges:
            out[r] = c[r] @ m["dw"][k]
        return ranges, out

    def epoch(m):
        def run(batches):
            g, total = {k: np.zeros_like(v) for k, v in m.items() if k not in ("d", "w")}, np.zeros(2)
            for b, at, codes, e in chunks(batches):
                learn = (codes[:, 0] > 0) & (codes[:, 1:] > 0).any(axis=1) & b.column("known").to_numpy(zero_copy_only=False)[at]
                at, codes = at[learn], codes[learn]
                c = e[at]
                ranges, out = outputs(m, codes[:, 0], c)
                g_out, rows = np.zeros_like(out), np.arange(len(codes))
                for i in range(n_t):
                    z, y = out @ m[f"t{i}"].T + m[f"b{i}"], codes[:, 1 + i]
                    z = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
                    z /= z.sum(axis=1, keepdims=True)
                    total[0] -= np.log(np.maximum(z[rows, y], 1e-300))[y != 0].sum()
                    z[rows, y] -= 1
                    z[y == 0] = 0
                    g[f"t{i}"] += z.T @ out
                    g[f"b{i}"] += z.sum(axis=0)
                    g_out += z @ m[f"t{i}"]
                total[1] += len(codes)
                g_c = np.zeros_like(c)
                for k, r in ranges:
                    g["dw"][k] += c[r].T @ g_out[r]
                    g_c[r] = g_out[r] @ m["dw"][k].T
                step = np.stack([np.bincount(at, g_c[:, j], len(e)) for j in range(size)], axis=1) / learnt
                v = decay * np.frombuffer(b"".join(b.column("v").to_pylist())).reshape(-1, size) + (1 - decay) * step * step
                e = e - rate * 0.1 * step / (np.sqrt(v) + 1e-8)
                new = [pa.array([x.tobytes() for x in a], pa.binary()) for a in (e, v)]
                yield pa.record_batch([b.column("c"), b.column("known"), b.column("r"), *new, b.column("s")], names=names)
            flat = np.concatenate([total] + [g[k].ravel() for k in order])
            yield pa.RecordBatch.from_pylist([dict.fromkeys(names) | {"s": flat.tobytes()}], schema=pa.schema([(k, t) for k, t in zip(names, types)]))

        return run

    names = ["c", "known", "r", "e", "v", "s"]
    types = [pa_type(data.schema[char].dataType), pa.bool_(), *[pa.binary()] * 4]
    schema = f"c {kinds[char]}, known boolean, r binary, e binary, v binary, s binary"
    order = ["dw", *(f"{k}{i}" for i in range(n_t) for k in "tb")]
    store = Scratch(data.sparkSession)  # a table an epoch: plans that hold each other grow too long
    state = store.table(rows.mapInArrow(pack, schema))
    learnt = coded.where(known & (F.element_at("dialect_ids", 1) > 0) & F.exists("target_ids", lambda x: x > 0)).count()
    losses: list[float] = []
    mixed = lambda: np.einsum("li,ijo->ljo", shared["d"], shared["w"])
    for _ in range(epochs if learnt else 0):
        m = shared | {"dw": mixed()}
        new = store.table(state.where("s IS NULL").mapInArrow(epoch(m), schema), "snappy")
        sums = sum(np.frombuffer(bytes(r["s"])) for r in new.where("s IS NOT NULL").select("s").collect())  # one a partition
        store.release(state)
        state, g, at = new, {}, 2
        for k in order:
            g[k], at = sums[at : at + m[k].size].reshape(m[k].shape), at + m[k].size
        g_dw = g.pop("dw")
        g |= {"d": np.einsum("ijo,ljo->li", shared["w"], g_dw), "w": np.einsum("li,ljo->ijo", shared["d"], g_dw)}
        losses.append(float(sums[0] / sums[1]))
        for k in shared:
            step = g[k] / learnt
            cache[k] = decay * cache[k] + (1 - decay) * step * step
            shared[k] = shared[k] - rate * 0.1 * step / (np.sqrt(cache[k]) + 1e-8)

    last, spelt = shared | {"dw": mixed()}, pa.array([*places, None, ""] if kinds[dialect] == "string" else [*places, None, None], pa_type(data.schema[dialect].dataType))

    def predict(batches):
        for b, at, codes, e in chunks(batches):
            _, out = outputs(last, np.maximum(codes[:, 0], 0), e[at])
            best = np.stack([(out @ last[f"t{i}"].T + last[f"b{i}"]).argmax(axis=1) for i in range(n_t)], axis=1).astype(np.int64)
            place = np.where(codes[:, 0] > 0, codes[:, 0] - 1, len(places) - codes[:, 0])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, n_t), pa.int32()), pa.array(best.ravel()))
            yield pa.record_batch([spelt.take(pa.array(place)), b.column("c").take(pa.array(at)), lists], names=[dialect, char, "predicted"])

    return state.where("s IS NULL").mapInArrow(predict, f"`{dialect}` {kinds[dialect]}, `{char}` {kinds[char]}, predicted array<bigint>"), losses


@dataclass
class LinearChain:
    """A linear-chain tagger: per-feature tag scores and tag transitions, decoded by Viterbi."""

    tags: list[str]
    weights: dict[tuple[str, str], float]
    transitions: dict[tuple[str, str], float]

    @classmethod
    def train(cls, sequences: list[tuple[list[list[str]], list[str]]], epochs: int = 5) -> "LinearChain":
        """Averaged perceptron over (features of each place, tags) sequences: after each wrong path the right one's weights rise by 1 and the wrong one's fall."""
        tags = sorted({t for _, ts in sequences for t in ts})
        now: dict[str, dict] = {"w": defaultdict(float), "t": defaultdict(float)}
        total: dict[str, dict] = {"w": defaultdict(float), "t": defaultdict(float)}
        tagger, seen = cls(tags, now["w"], now["t"]), 0

        def add(kind, key, by):
            now[kind][key] += by
            total[kind][key] += by * seen  # what the average lacks of this change

        for _ in range(epochs):
            for rows, right in sequences:
                found = tagger.decode(rows)
                if found != right:
                    for path, by in ((right, 1.0), (found, -1.0)):
                        for fs, t in zip(rows, path):
                            for f in fs:
                                add("w", (f, t), by)
                        for a, b in zip(path, path[1:]):
                            add("t", (a, b), by)
                seen += 1
        mean = {kind: {k: v - total[kind][k] / max(1, seen) for k, v in now[kind].items()} for kind in now}
        return cls(tags, mean["w"], mean["t"])

    def decode(self, rows: list[list[str]]) -> list[str]:
        if not rows:
            return []
        emit = np.array([[sum(self.weights.get((f, t), 0.0) for f in fs) for t in self.tags] for fs in rows])
        move = np.array([[self.transitions.get((a, b), 0.0) for b in self.tags] for a in self.tags])
        score, back = emit[0], []
        for e in emit[1:]:
            s = score[:, None] + move
            back.append(s.argmax(axis=0))
            score = s.max(axis=0) + e
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return [self.tags[i] for i in reversed(path)]


def train_tagger(data: DataFrame, column: str, tags: str, epochs: int = 5, max_rows: int = 50_000) -> LinearChain:
    """A tagger from syllables and their tags (array, one a character); at most ``max_rows`` rows, drawn by hash, reach the driver."""
    from isoglotta.functions.phonetics import char_features

    rows = data.where(F.size(tags) == F.length(column)).orderBy(F.xxhash64(column), column).limit(max_rows).select(char_features(F.col(column)).alias("f"), F.col(tags).alias("t")).collect()
    return LinearChain.train([(feature_rows(r["f"]), list(r["t"])) for r in rows], epochs)


def feature_rows(features) -> list[list[str]]:
    names = [f"{p}_{k}" for p in ("before", "own", "after") for k in ("char", "type", "manner")]
    return [[f"{n}={r[n]}" for n in names if r[n] is not None] for r in features]


def tag_syllables(data: DataFrame, column: str, tagger: LinearChain, out: str = "tags") -> DataFrame:
    """Tags of each character, from its features and its neighbours'; decoding is sequential, so it runs in pandas batches."""
    from isoglotta.functions.phonetics import char_features

    def decode(frames):
        for f in frames:
            yield f.drop(columns="_features").assign(**{out: [None if r is None else tagger.decode(feature_rows(r)) for r in f["_features"]]})

    schema = data.drop(out).schema.add(out, ArrayType(StringType()))
    return data.drop(out).withColumn("_features", char_features(F.col(column))).mapInPandas(decode, schema)
