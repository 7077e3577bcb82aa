"""Shared helpers: scratch tables in the shared folder, table readers, word fingerprints."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Temporary folders of local sessions by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only in local mode."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir"):
        return found
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="isoglotta-")
        atexit.register(shutil.rmtree, _LOCAL[sc.applicationId], True)
    return f"file://{_LOCAL[sc.applicationId]}"


#: Tables that exist: path -> (weak reference, in the JVM, to what a plan needs to read it; deletes it).
_LIVE: dict[str, tuple] = {}


def _delete(path: str) -> None:
    try:
        _LIVE.pop(path)[1]()
    except Exception:  # the JVM may have ended; then the shared folder's owner clears it
        pass


def sweep() -> None:
    """Delete the tables that no plan can read any more."""
    for path, (held, _) in list(_LIVE.items()):
        try:
            if held.refersTo(None):
                _delete(path)
        except Exception:  # of a JVM that has ended
            _LIVE.pop(path, None)


def watch(df: DataFrame, path: str) -> DataFrame:
    """Delete ``path`` once no plan can read the files that ``df`` reads there."""
    sc, leaves = df.sparkSession.sparkContext, df._jdf.queryExecution().analyzed().collectLeaves()
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    files = next(x.relation().location() for x in map(leaves.apply, range(leaves.size())) if x.nodeName().startswith("LogicalRelation") and path.split("/")[-1] in x.relation().location().rootPaths().mkString())

    def drop():
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)

    _LIVE[path] = jvm.java.lang.ref.WeakReference(files), drop
    return df


@atexit.register
def _end() -> None:
    for path in list(_LIVE):
        _delete(path)


class Scratch:
    """Parquet tables in the shared folder, each there as long as any plan can read it.

    ``table`` cuts the lineage as a checkpoint does, but columnar, compressed and column-pruned. All frames
    derived from a table hold its file index in the JVM, and so do cached plans and views; once that is
    garbage the next ``table`` deletes the files, and the end of the process deletes the rest. ``release``
    deletes a table early, which must have no reader left.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/isoglotta-{spark.sparkContext.applicationId}"
        sweep()

    def folder(self) -> str:
        """A path of its own, for files that ``watch`` then ties to their readers."""
        sweep()
        return f"{self.root}/{uuid.uuid4().hex}"

    def table(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        path, conf = self.folder(), self.spark.conf
        before = conf.get(CLEAN, "false")
        conf.set(CLEAN, "true")  # no other plan reads the shuffles of this one: they go as it ends, not with the driver's garbage
        try:
            df.write.option("compression", compression).parquet(path)
        finally:
            conf.set(CLEAN, before)
        out = watch(self.spark.read.schema(df.schema).parquet(path), path)
        out._isoglotta_path = path
        return out

    def tidy(self) -> None:
        """Let the driver's JVM collect what nothing refers to: Spark then deletes the files of past shuffles, and ``sweep`` past tables."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        sweep()

    def release(self, df: DataFrame) -> None:
        _delete(df._isoglotta_path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A-Z to a-z on UTF-8 bytes; bytes of longer code points are never touched.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _POW or len(_POW[0]) < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _POW[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, dtype=np.uint64))]) for b in (_BASE, _INV)]
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of lower-cased UTF-8 ``data``.

    Words are runs without 0x20 and 0x09-0x0D. A word's 64-bit fingerprint is a polynomial over its
    bytes, from one cumulative sum for the whole buffer, and then mixed; buffers are best under a MB.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        e = np.empty(0, dtype=np.int64)
        return np.empty(0, dtype=np.uint64), e, e
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)])])
        h = (total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h), starts, ends


def batched_words(texts, piece: int = 1 << 19):
    """Per text its word fingerprints, as one list; short texts share a buffer, long ones have their own."""
    out: list = [None] * len(texts)
    group, held = [], 0

    def flush():
        data = b"\n".join(b for _, b in group)
        h, starts, _ = word_hashes(data)
        at = np.cumsum([0] + [len(b) + 1 for _, b in group])
        cut = np.searchsorted(starts, at)
        for k, (i, _) in enumerate(group):
            out[i] = h[cut[k] : cut[k + 1]]
        group.clear()

    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass").translate(LOWER)
        group.append((i, b))
        held += len(b) + 1
        if held >= piece:
            flush()
            held = 0
    if group:
        flush()
    return out
