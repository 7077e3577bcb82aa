"""MinHash near-duplicate detection with sequential Bayesian verification.

A text's set is its distinct shingles of five words (A-Z lower-cased, words are runs without 0x20 and
0x09-0x0D; a text of fewer words is one shingle), as 64-bit fingerprints. Texts with equal sets form a
class (128-bit fingerprint of the set) and only one representative goes on, so thousands of copies are one
node. Signatures hold ``bands * rows`` minima; representatives that agree in a whole band are candidates.

Candidates are compared in rounds, and no bucket is ever expanded into all its pairs:

1. In each bucket every member is paired with the most central one (one pair a member): that whose
   buckets are largest. What many copies derive from is central, and joins them at once.
2. Members of a bucket that are still in different components are compared, in blocks of about ``block`` x
   ``block`` members a task that hold signatures and sets, so no pair leaves a task but a verified link, at most
   one for each join of two components there. Pairs within a component can't change the result and are skipped,
   and a pair that shares several buckets is compared in its first. So every candidate pair that could matter is looked at.

A comparison takes signature batches one after another and stops when the posterior probability that the
similarity reaches the threshold (uniform prior; a binomial tail) falls below ``miss``. Survivors are
verified exactly on full sets, with integers: 100 * intersection >= 85 * union. Two sets whose sizes
differ too much can't reach that and are not compared. A link at the threshold is missed by the bands with
probability (1 - 0.85**5)**20 = 8e-6 and by each batch with at most about ``miss``; links above, far less.

Components come from minimum labels with pointer jumping, on the links only; every step is a written
table in the shared folder. Hot keys (a bucket's leader, a class) sit in joins that adaptive execution
splits, and are pre-aggregated where grouped.

Null or wordless texts have an empty set and are linked with nothing. Rows that repeat an id are one
document of that id, with the links of any of its texts. A null id is linked with nothing and gets a null component.
Ids may have any type that sorts. Other columns are ignored. ``keep_one`` keeps one of rows that repeat id and text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batched_words, mix, read

SHINGLE, BANDS, ROWS, BATCH = 5, 20, 5, 20
K = BANDS * ROWS
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, K, dtype=np.uint64)
_C = [np.uint64(pow(0xD1342543DE82EF95, j, 1 << 64)) for j in range(SHINGLE + 1)]


def shingle_set(h: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle fingerprints of a text's word fingerprints."""
    if not len(h):
        return np.empty(0, dtype=np.uint64)
    k = min(SHINGLE, len(h))
    with np.errstate(over="ignore"):
        s = h[: len(h) - k + 1] * _C[0]
        for j in range(1, k):
            s = s + h[j : len(h) - k + 1 + j] * _C[j]
        return np.unique(mix(s + np.uint64(k)))


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(K, 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 2048):
            x = (s[i : i + 2048, None] * _A + _B) >> np.uint64(32)
            out = np.minimum(out, x.min(axis=0).astype(np.uint32))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(ROWS):
            x = mix(x + sig.reshape(BANDS, ROWS)[:, j])
    return x.view(np.int64)


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest matches of n for which P(similarity >= threshold) is at least ``miss`` (uniform prior)."""
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def limits(threshold: float, miss: float) -> list[tuple[int, int]]:
    return [(n, least_matches(n, threshold, miss)) for n in range(BATCH, K + 1, BATCH)]


def survivors(a: np.ndarray, b: np.ndarray, bounds) -> np.ndarray:
    """Which rows of the signature matrices a and b may be similar."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for n, least in bounds:
        if not len(alive):
            break
        matches = matches + (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def sizes_fit(n, m, percent: int):
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _signed(batches, whole_sets: bool):
    for b in batches:
        for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
            sets = [shingle_set(h) for h in batched_words(part.column(1).to_pylist())]
            sigs = [signature(s) for s in sets]
            n = pa.array([len(s) for s in sets], pa.int64())
            blob = pa.array([s.tobytes() for s in sigs], pa.binary())
            if whole_sets:
                yield pa.RecordBatch.from_arrays([part.column(0), n, blob, pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "sig", "items"])
                continue
            keys = [_class_key(s) if len(s) else (None, None) for s in sets]
            bands = pa.array([band_keys(g) if len(s) else None for s, g in zip(sets, sigs)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), bands], names=["id", "n", "k1", "k2", "bands"])


def _class_key(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, K)


def block_links(key, ids, comp, chunk, sig, sets, percent, bounds):
    """Verified links (a, b) between components in one block (bucket, chunk i, chunk j): at most one for each two components joined."""
    bucket, left, right = key
    sizes, number = np.array([len(x) for x in sets]), {}
    own = np.array([number.setdefault(c, len(number)) for c in comp])
    top = np.arange(len(number))
    keys = np.stack([band_keys(g) for g in sig])
    shingles, where = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(where.reshape(-1), np.cumsum(sizes)[:-1])
    mark, out = np.zeros(len(shingles), dtype=np.int64), []
    others = np.flatnonzero(chunk == right)
    for x in np.flatnonzero(chunk == left).tolist():
        y = others[others > x] if left == right else others
        y = y[(top[own[y]] != top[own[x]]) & sizes_fit(sizes[y], sizes[x], percent)]
        if len(y):  # is this the first bucket that the pair shares?
            first = (keys[y] == keys[x]).argmax(axis=1)
            y = y[keys[x][first] == bucket]
        if len(y):
            y = y[survivors(np.broadcast_to(sig[x], (len(y), K)), sig[y], bounds)]
        if not len(y):
            continue
        mark[parts[x]] = 1
        same = np.add.reduceat(mark[np.concatenate([parts[k] for k in y])], np.cumsum(sizes[y]) - sizes[y])
        mark[parts[x]] = 0
        for k in y[100 * same >= percent * (sizes[x] + sizes[y] - same)].tolist():
            p, q = top[own[x]], top[own[k]]
            if p != q:
                top[top == q] = p
                out.append((min(ids[x], ids[k]), max(ids[x], ids[k])))
    return out


def components(edges: DataFrame, store: Scratch) -> DataFrame:
    """id and comp (smallest id reachable) of every id with an edge. Columns of ``edges``: a, b."""
    both = store.table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    held = store.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")))
    while True:
        label = held.select("id", "comp")
        near = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("comp").alias("m"))
        step = store.table(label.join(near, label["id"] == near["a"]).select("id", F.least("comp", "m").alias("comp"), F.col("comp").alias("was")))
        up = step.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
        new = store.table(step.join(up, "comp").select("id", F.least("comp", "top").alias("comp"), "was"))
        done = new.where("comp <> was").isEmpty()
        store.release(held)
        store.release(step)
        held = new
        if done:
            return held.select("id", "comp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, miss: float = 1e-5, block: int = 256) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept."""
    store = Scratch(docs.sparkSession)
    bounds = limits(percent / 100, miss)
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = store.table(named.mapInArrow(lambda b: _signed(b, False), f"id {kind}, n bigint, k1 bigint, k2 bigint, bands array<bigint>"))
    classes = store.table(signed.where("n > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.any_value("bands").alias("bands")))
    banded = classes.select("id", F.explode("bands").alias("bucket"))
    buckets = store.table(banded.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"))
    shared = store.table(banded.join(buckets, "bucket"))
    # how central a member is: the sizes of its buckets; what most copies derive from shares most
    held = store.table(shared.join(shared.groupBy("id").agg(F.sum("m").alias("s")), "id").select("bucket", "id", "m", "s"))
    store.release(shared)
    ids = held.select("id").distinct()
    members = store.table(named.join(ids.hint("shuffle_hash"), "id").mapInArrow(lambda b: _signed(b, True), f"id {kind}, n bigint, sig binary, items binary"))

    def exact(pairs: DataFrame) -> DataFrame:
        a = members.select(F.col("id").alias("a"), F.col("items").alias("x"))
        b = members.select(F.col("id").alias("b"), F.col("items").alias("y"))

        def check(batches):
            for t in batches:
                ok = []
                for x, y in zip(t.column("x"), t.column("y")):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * same >= percent * (len(x) + len(y) - same))
                yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return pairs.join(a, "a").join(b, "b").mapInArrow(check, f"a {kind}, b {kind}")

    def compare(pairs: DataFrame) -> DataFrame:
        a = members.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("x"))
        b = members.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("y"))

        def prune(batches):
            for t in batches:
                t = t.filter(pa.array(sizes_fit(t.column("na").to_numpy(), t.column("nb").to_numpy(), percent)))
                if t.num_rows:
                    yield t.select(["a", "b"]).take(pa.array(survivors(_matrix(t.column("x")), _matrix(t.column("y")), bounds)))

        return pairs.join(a, "a").join(b, "b").mapInArrow(prune, f"a {kind}, b {kind}")

    central = F.min_by("id", F.struct(-F.col("s"), F.col("id"))).alias("leader")

    def star(rows: DataFrame, leaders: DataFrame) -> DataFrame:
        d = rows.join(leaders, "bucket").where("id <> leader")
        return d.select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")).distinct()

    # round 1: every member against its bucket's most central one
    led = store.table(held.groupBy("bucket").agg(central))
    links = store.table(exact(store.table(compare(star(held, led)))))
    label = components(links, store)

    # round 2: members of a bucket, besides its leader, that are in different components
    rest = held.where("m > 2").join(led.withColumnRenamed("leader", "id"), ["bucket", "id"], "left_anti").join(label, "id", "left")
    rest = store.table(rest.select("bucket", "id", "m", F.coalesce("comp", "id").alias("comp")))
    open_ = rest.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    chunks = F.ceil(F.col("m") / block).cast("int")
    dealt = rest.join(open_, "bucket").select("bucket", "id", "comp", F.pmod(F.xxhash64("id"), chunks).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("o"))
    placed = dealt.select("bucket", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "id", "comp").join(members, "id")
    group_by = ("bucket", "i", "j")
    ordered = placed.repartition(*group_by).sortWithinPartitions(*group_by)

    def across(batches):
        held_rows, key = [], None

        def group():
            t = pa.Table.from_batches(held_rows)
            kept = block_links(key, t.column("id").to_pylist(), t.column("comp").to_pylist(), t.column("c").to_numpy(), _matrix(t.column("sig")), [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("items")], percent, bounds)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], t.schema.field("id").type) for k in (0, 1)], names=["a", "b"])

        for t in batches:
            k = np.stack([t.column(x).to_numpy().astype(np.int64) for x in group_by], axis=1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                now = tuple(k[s].tolist())
                if key is not None and now != key:
                    yield group()
                    held_rows = []
                key = now
                held_rows.append(t.slice(s, e - s))
        if held_rows:
            yield group()

    wanted = ordered.select(*group_by, "c", "id", "comp", "sig", "items")
    found = store.table(wanted.mapInArrow(across, f"a {kind}, b {kind}").distinct())
    if not found.isEmpty():
        label = components(links.unionByName(found), store)

    top = classes.select("k1", "k2", "id").join(label, "id", "left").select("k1", "k2", F.coalesce("comp", "id").alias("comp"))
    out = signed.select("id", "n", "k1", "k2").join(top, ["k1", "k2"], "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), comp.eqNullSafe(F.col("id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay (one document of each component), all columns kept. Rows without an id stay."""
    groups = near_groups(docs, id_col, text_col)
    gone = groups.where(~F.col("kept") & F.col(id_col).isNotNull()).select(id_col)
    rest = docs.join(gone, id_col, "left_anti").select(docs.columns)
    again = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col)
    if again.isEmpty():
        return rest
    plain = [c for c in docs.columns if c not in (id_col, text_col)]
    one = rest.join(again, id_col, "left_semi").groupBy(id_col, F.struct(text_col).alias("_t")).agg(F.first(F.struct(F.lit(0), *plain)).alias("_row"))
    return rest.join(again, id_col, "left_anti").select(docs.columns).unionByName(one.select(id_col, "_t.*", *(F.col("_row")[c].alias(c) for c in plain)).select(docs.columns))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))
