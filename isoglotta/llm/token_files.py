"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A shard is one self-contained byte string, little-endian throughout:

    "FRV2", u32 part, u32 place in the part, u64 ids in earlier shards of the part,
    u32 number of documents, u64 number of ids, u32 number of distinct ids,
    a byte for each document (1: it has an id), the document ids (i64 each),
    the number of ids of each document (u32 each),
    the distinct ids by falling frequency in the shard (u32 each; ties by id),
    control bytes (two bits a value, four values a byte: its length in bytes less one),
    data bytes (each id's rank, 1 to 4 bytes).

Frequent ids have ranks under 256 and take one byte. Decoding looks every control byte up in a table of
256 x 4 lengths and gathers all values with numpy; no value is handled on its own.

A set of files is a folder that the caller names: ``shards`` (one shard a row, in parts) and ``index`` (the ids
before each part), both stored through Spark's writer, so any store that Spark writes will do. Documents are
range-partitioned and sorted by id, so parts and shards follow each other in ascending order; ranks are of the shard,
so no pass over the corpus comes before. A shard holds about ``shard_ids`` ids and at least one document.
``encode_shard`` and ``decode_shard`` are the format itself.

Null texts count as empty (only the end id); rows with a null id come first, rows that repeat an id stay
next to each other, ordered by text. Ids must be integers. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read, watch
from .tokenization import cached_tokenizer, public_path

MAGIC, HEAD = b"FRV2", struct.Struct("<4sIIQIQI")
#: Lengths of the four values that each control byte describes.
LENGTHS = np.array([[1 + (b >> 2 * k & 3) for k in range(4)] for b in range(256)], dtype=np.uint8)


def encode_values(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = np.ascontiguousarray(v, dtype="<u4")
    n = (1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)).astype(np.uint8)
    codes = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    codes[: len(v)] = n - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control, v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < n[:, None]]


def decode_values(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    n = LENGTHS[control].reshape(-1)[:count]
    ends = np.cumsum(n, dtype=np.int64)
    starts = ends - n
    out = data[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(n > k)
        if not len(more):
            break
        out[more] |= data[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids by falling frequency, rank of every id)."""
    if len(ids) and int(ids.max()) < 1 << 22:  # a vocabulary's ids: count them without sorting
        counts = np.bincount(ids)
        distinct = np.flatnonzero(counts)
        table = distinct[np.lexsort((distinct, -counts[distinct]))]
        rank = np.zeros(len(counts), dtype=np.uint32)
        rank[table] = np.arange(len(table), dtype=np.uint32)
        return table, rank[ids]
    distinct, where, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((distinct, -counts))
    rank = np.empty(len(order), dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return distinct[order], rank[where.reshape(-1)]


def encode_shard(docs: list[np.ndarray], names: list[int | None], part: int = 0, seq: int = 0, before: int = 0) -> bytes:
    """One shard of documents' ids."""
    ids = np.concatenate(docs).astype(np.uint32, copy=False) if docs else np.empty(0, dtype=np.uint32)
    table, rank = ranked(ids)
    control, data = encode_values(rank)
    head = HEAD.pack(MAGIC, part, seq, before, len(docs), len(ids), len(table))
    has = np.array([n is not None for n in names], dtype=np.uint8)
    known, sizes = np.array([n or 0 for n in names], dtype="<i8"), np.array([len(d) for d in docs], dtype="<u4")
    return b"".join((head, *(x.tobytes() for x in (has, known, sizes, table.astype("<u4"), control, data))))


def shard_head(blob: bytes) -> tuple[int, int, int, int]:
    """(part, place in the part, ids before it in the part, ids)."""
    magic, part, seq, before, _, count, _ = HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a token-id shard")
    return part, seq, before, count


def decode_shard(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """(ids of all documents in turn, ids per document, document ids)."""
    shard_head(blob)
    *_, docs, count, distinct = HEAD.unpack_from(blob)
    at = HEAD.size
    has = np.frombuffer(blob, np.uint8, docs, at)
    known = np.frombuffer(blob, "<i8", docs, at := at + docs)
    sizes = np.frombuffer(blob, "<u4", docs, at := at + 8 * docs)
    table = np.frombuffer(blob, "<u4", distinct, at := at + 4 * docs)
    raw = np.frombuffer(blob, np.uint8, offset=at + 4 * distinct)
    n_control = -(-count // 4)
    ids = table[decode_values(raw[:n_control], raw[n_control:], count)] if count else np.empty(0, dtype=np.uint32)
    return ids, sizes, [n if h else None for n, h in zip(known.tolist(), has.tolist())]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_ids: int = 1 << 20) -> None:
    """Write the files of ``docs`` to the folder ``path``, which must not exist."""
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids must be integers, not {kind}")

    def encode(batches):
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], dtype="<u4").tobytes()
        tok, names, held, size = cached_tokenizer(tokenizer_path), [], [], 0

        def shard():
            nonlocal seq, before, size, names, held
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([size], pa.int64()), pa.array([encode_shard(held, names, part, seq, before)], pa.binary())], names=["part", "n_ids", "shard"])
            seq, before, size, names, held = seq + 1, before + size, 0, [], []
            return row

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1)):
                held.append(np.frombuffer(tok.ids(text.as_py()) + end, "<u4"))
                names.append(name)
                size += len(held[-1])
                if size >= shard_ids:
                    yield shard()
        if held:
            yield shard()

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(encode, "part int, n_ids bigint, shard binary").write.option("compression", "none").parquet(f"{path}/shards")
    sizes = docs.sparkSession.read.parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")  # a row a part
    sizes.select("part", before.alias("start")).coalesce(1).write.parquet(f"{path}/index")


def read_token_files(spark: SparkSession, path: str, broadcast_parts: int = 1_000_000) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before), n_tokens, ids_crc32; all from the shards but the start of their part.

    The index has a row for each part; it is broadcast up to ``broadcast_parts`` of them, else joined.
    """
    index = spark.read.schema("part int, start bigint").parquet(f"{path}/index")
    shards = spark.read.schema("part int, n_ids bigint, shard binary").parquet(f"{path}/shards")

    def decode(batches):
        for b in batches:
            for part_start, shard in zip(b.column(0).to_pylist(), b.column(1)):
                blob = shard.as_py()
                ids, sizes, names = decode_shard(blob)
                ends = np.cumsum(sizes, dtype=np.int64)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                start = part_start + shard_head(blob)[2] + ends - sizes
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    starts = F.broadcast(index) if index.count() <= broadcast_parts else index
    return shards.join(starts, "part").select("start", "shard").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark).folder()
    write_token_files(read(spark, sf_dir, "documents"), folder, public_path("byte_bpe_50k.json"))
    return watch(read_token_files(spark, folder), folder)
