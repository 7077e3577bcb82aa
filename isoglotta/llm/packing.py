"""Best-fit packing into fixed-length sequences by patterns fitted with non-negative least squares.

Only a histogram of lengths (at most ``capacity`` rows) reaches the driver. Lengths are put into classes
of ``unit`` ids; every multiset of up to three classes that fills a sequence is a pattern. Non-negative
least squares fits repeat counts of patterns to the class histogram (long classes weigh more, short ones
can fill gaps later), the counts are rounded down, and each pattern takes real lengths: the longest of
its classes, the last one best fitting what is left. Residual lengths, longest first, go where they leave
the least room, into open sequences or new ones.

The plan is a list of runs "ranks a to b of length L lie at offset o of sequences s, s+1, ..."; its size
depends on the number of distinct lengths only. A document's rank among those of its length is the count
in earlier partitions plus its place in its own, so nothing is sorted and no length is gathered in a task. These
counts, at most ``capacity`` a partition, meet the partition's pieces in its own task; only the plan is broadcast.

Null texts count as empty: one end id. Repeated rows are packed each. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read
from .tokenization import cached_tokenizer, public_path


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600, tol: float = 1e-9) -> np.ndarray:
    """min |a x - b| with x >= 0 by an active set (Lawson and Hanson)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if not w[j] > tol:
            break
        passive[j] = True
        while True:
            cols = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if z.min(initial=1.0) > 0:
                break
            low = z <= 0
            xs = x[cols]
            step = np.min(xs[low] / np.maximum(xs[low] - z[low], 1e-300))
            xs = xs + step * (z - xs)
            x[:] = 0
            xs[xs <= 1e-12] = 0
            x[cols] = xs
            passive[cols[xs <= 0]] = False
            if not passive.any():
                return x
        x[:] = 0
        x[cols] = z
    return x


def patterns(classes: int, present: np.ndarray) -> list[tuple[int, ...]]:
    """Falling tuples of up to three present classes whose sum is ``classes``."""
    out = [(classes,)] if present[classes] else []
    for a in range(classes - 1, 0, -1):
        if not present[a]:
            continue
        if (b := classes - a) <= a and present[b]:
            out.append((a, b))
        for b in range(min(a, classes - a - 1), 0, -1):
            c = classes - a - b
            if c > b:
                break
            if present[b] and present[c]:
                out.append((a, b, c))
    return out


class _Open:
    """Groups of equal sequences by the room left in them."""

    def __init__(self, capacity: int):
        self.by_room: dict[int, list] = defaultdict(list)
        self.has = np.zeros(capacity + 1, dtype=bool)

    def add(self, room: int, count: int, slots: tuple) -> None:
        self.by_room[room].append((count, slots))
        self.has[room] = True

    def tightest(self, length: int) -> int | None:
        k = int(np.argmax(self.has[length:]))
        return length + k if self.has[length + k] else None

    def fill(self, room: int, length: int, most: int) -> int:
        count, slots = self.by_room[room].pop()
        n = min(count, most)
        if count > n:
            self.by_room[room].append((count - n, slots))
        elif not self.by_room[room]:
            self.has[room] = False
        self.add(room - length, n, (*slots, length))
        return n


def plan(histogram: dict[int, int], capacity: int, unit: int | None = None) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in each) that hold every length as often as it occurs."""
    unit = unit or max(1, capacity // 128)
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        left[length] = n
    done = [(int(left[capacity]), (capacity,))] if left[capacity] else []
    left[capacity] = 0
    classes = -(-capacity // unit)
    of = -(-np.arange(capacity + 1) // unit)
    hist = np.bincount(of, weights=left, minlength=classes + 1)
    open_, found = _Open(capacity), patterns(classes, hist > 0)

    def longest(to: int) -> int:
        k = np.flatnonzero(left[: to + 1])
        return int(k[-1]) if len(k) else 0

    if found:
        a = np.zeros((classes, len(found)))
        for j, p in enumerate(found):
            for c in p:
                a[c - 1, j] += 1
        weight = np.sqrt(np.arange(1, classes + 1) / classes)
        scale = hist.max()
        x = nnls(a * weight[:, None], hist[1:] / scale * weight) * scale
        for j in np.argsort([-p[0] for p in found], kind="stable"):
            repeat = int(x[j] + 1e-9)
            while repeat > 0:
                take: list[int] = []
                for k, c in enumerate(found[j]):
                    room = capacity - sum(take)
                    spent = left.copy() if k else left
                    for t in take:
                        spent[t] -= 1
                    last = k == len(found[j]) - 1
                    at = np.flatnonzero(spent[: room + 1] > 0) if last else np.flatnonzero(spent[(c - 1) * unit + 1 : c * unit + 1] > 0) + (c - 1) * unit + 1
                    if not len(at) or last and at[-1] <= (c - 2) * unit:
                        take = []
                        break
                    take.append(int(at[-1]))
                if not take or capacity - sum(take) > 2 * unit:  # the classes have run dry: what is left is residual
                    break
                n = repeat
                for t in set(take):
                    n = min(n, int(left[t]) // take.count(t))
                for t in take:
                    left[t] -= n
                open_.add(capacity - sum(take), n, tuple(take))
                repeat -= n
    while length := longest(capacity):
        n = int(left[length])
        while n:
            room = open_.tightest(length)
            if room is None:
                per = capacity // length
                if n >= per:
                    open_.add(capacity - per * length, n // per, (length,) * per)
                    n -= n // per * per
                else:
                    open_.add(capacity - n * length, 1, (length,) * n)
                    n = 0
            else:
                n -= open_.fill(room, length, n)
        left[length] = 0
    return done + [g for groups in open_.by_room.values() for g in groups if g[0]]


def runs(sequences: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """The plan by (length, first rank): parallel arrays length, rank, sequence, offset, repeat in a sequence."""
    base, rank, rows = 0, defaultdict(int), []
    for count, slots in sequences:
        offset, k = 0, 0
        while k < len(slots):
            same = 1
            while k + same < len(slots) and slots[k + same] == slots[k]:
                same += 1
            length = slots[k]
            rows.append((length, rank[length], base, offset, same))
            rank[length] += count * same
            offset, k = offset + length * same, k + same
        base += count
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "offset", "same"), a.T.copy()))


def pack_lengths(pieces: DataFrame, store: Scratch, capacity: int = 4096, length_col: str = "length", part_col: str = "part", rank_col: str = "rank") -> DataFrame:
    """Add sequence_id and offset to every row of ``pieces``.

    ``part_col`` and ``rank_col``: any split of the rows, and the row's place from 0 among the rows of
    its length in its part. ``pieces`` should be a written table; it is read three times.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy(part_col, length_col).agg(F.count("*").alias("n"))
    before = Window.partitionBy(length_col).orderBy(part_col).rowsBetween(Window.unboundedPreceding, 0)
    firsts = store.table(counts.select(F.col(part_col).alias("part"), F.col(length_col).alias("length"), "n", (F.sum("n").over(before) - F.col("n")).alias("first")))
    histogram = {r[0]: r[1] for r in firsts.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    sent = spark.sparkContext.broadcast(runs(plan(histogram, capacity)))  # bounded by the distinct lengths
    rest = [c for c in pieces.columns if c not in (part_col, rank_col)]

    def place(mine: pa.Table, starts: pa.Table) -> pa.Table:
        """The pieces of one part; ``starts``: the rank of its first piece of each length, at most capacity rows."""
        r = sent.value
        span = int(r["rank"].max(initial=0)) + 1
        key = r["length"] * span + r["rank"]
        length = mine.column(length_col).to_numpy().astype(np.int64)
        first = np.zeros(capacity + 1, dtype=np.int64)
        first[starts.column("length").to_numpy()] = starts.column("first").to_numpy()
        rank = first[length] + mine.column(rank_col).to_numpy()
        k = np.searchsorted(key, length * span + np.minimum(rank, span - 1), side="right") - 1
        d = rank - r["rank"][k]
        return mine.select(rest).append_column("sequence_id", pa.array(r["sequence"][k] + d // r["same"][k])).append_column("offset", pa.array(r["offset"][k] + d % r["same"][k] * length))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*rest).schema)
    return pieces.groupBy(part_col).cogroup(firsts.groupBy("part")).applyInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids: id, piece, start, length, ids_crc32, part, rank. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        end, tok = np.array([end_id], dtype="<u4").tobytes(), cached_tokenizer(tokenizer_path)
        for b in batches:
            keep, rows = [], []
            for i, text in enumerate(b.column(1)):
                ids = memoryview(tok.ids(text.as_py()) + end)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    keep.append(i)
                    rows.append((piece, at // 4, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int32())), *(pa.array(list(c), t) for c, t in zip(cols, kinds))], names=[id_col, "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.select(id_col, text_col).mapInArrow(cut, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint")


def pack_documents(docs: DataFrame, capacity: int = 4096, tokenizer_path: str | None = None) -> DataFrame:
    store = Scratch(docs.sparkSession)
    pieces = store.table(token_pieces(docs, tokenizer_path or public_path("word_bpe_49k.json"), capacity))
    out = pack_lengths(pieces, store, capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
