"""Benchmark decontamination by Wu-Manber search over words.

Symbols are words: runs of code points that are neither ASCII punctuation nor white space, A-Z
lower-cased. Patterns are the windows of ``size`` consecutive words of each item; an item with fewer
words (but some) is one pattern. Patterns of one length share tables: a shift table over blocks of up to
three words says how far a search may jump when the block at its end is in no pattern at that place, a
bucket by the last block lists the patterns that may end there, and direct comparison confirms them.

Documents are never shuffled while the benchmark's distinct (item, text) rows have at most ``block_bytes``
of text: then it is broadcast whole. A larger one is dealt into blocks of about that size, so that a worker
holds the tables of one block only; documents get row numbers in a written table, each block is searched
in a pass of its own over that table, and the hits (only of rows that have any) meet by row number.

Null or wordless texts have n_words 0 and no hits; wordless items never match; an item counts once however
often its rows repeat. Rows that repeat a document id, or have none, are searched and returned one by one.
Other columns of the inputs are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read

#: Separators (0x00-0x2F, 0x3A-0x40, 0x5B-0x60, 0x7B-0x7F) to spaces and A-Z to a-z, on UTF-8 bytes.
WORDS = bytes(b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


class WuManber:
    """Search for the windows of items in lists of words."""

    def __init__(self, items: list[tuple[object, str | None]], size: int = 10, block: int = 3):
        patterns: dict[tuple, set] = defaultdict(set)
        for item, text in items:
            w = words_of(text)
            for i in range(max(1, len(w) - size + 1) if w else 0):
                patterns[tuple(w[i : i + size])].add(item)
        self.sets = []
        for m in sorted({len(p) for p in patterns}):
            b, shift, bucket = min(block, m), {}, defaultdict(list)
            for p, owners in patterns.items():
                if len(p) == m:
                    for end in range(b, m + 1):
                        key = p[end - b : end]
                        shift[key] = min(shift.get(key, m), m - end)
                    bucket[p[m - b :]].append((p, owners))
            self.sets.append((m, b, shift, dict(bucket)))

    def find(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans [start, end) in order of their ends by pattern length, and the items hit."""
        spans, items = [], set()
        for m, b, shift, bucket in self.sets:
            at, n, jump = m, len(w), m - b + 1
            while at <= n:
                key = tuple(w[at - b : at])
                s = shift.get(key, jump)
                if s:
                    at += s
                    continue
                text = tuple(w[at - m : at])
                for p, owners in bucket[key]:
                    if p == text:
                        spans.append((at - m, at))
                        items |= owners
                at += 1
        return spans, items


def union_length(spans) -> int:
    total, reach = 0, -1
    for s, e in sorted(spans):
        s = max(s, reach)
        if e > s:
            total, reach = total + e - s, e
    return total


def _blocks(items: DataFrame, block_bytes: int) -> int:
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return max(1, -(-total // block_bytes))


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """Per document: id, n_words, n_hit, items (array), spans (array of start, end word positions)."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    arrow_item = pa.string() if item_kind == "string" else pa.int64()
    distinct = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("t")).distinct()
    n_blocks = _blocks(distinct, block_bytes)
    dealt = distinct.withColumn("b", F.pmod(F.xxhash64("t", "item"), F.lit(n_blocks)))
    numbered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    if n_blocks > 1:
        numbered = Scratch(spark).table(numbered)  # else a second pass might number rows otherwise
    schema = f"id {kind}, n_words bigint, items array<{item_kind}>, starts array<int>, ends array<int>, row bigint"

    def search(k: int) -> DataFrame:
        items = [(r["item"], r["t"]) for r in dealt.where(F.col("b") == k).select("item", "t").collect()]  # about block_bytes
        sent = spark.sparkContext.broadcast(items)
        made: list = []

        def run(batches):
            if not made:
                made.append(WuManber(sent.value, size))
            for batch in batches:
                for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                    found = []
                    for i, t in enumerate(part.column(1)):
                        w = words_of(t.as_py())
                        spans, hit = made[0].find(w)
                        if spans or not k:  # the first pass tells the words of every document
                            found.append((i, len(w), sorted(hit), [s for s, _ in spans], [e for _, e in spans]))
                    cols = list(zip(*found)) if found else [()] * 5
                    at, kinds = pa.array(list(cols[0]), pa.int32()), (pa.int64(), pa.list_(arrow_item), pa.list_(pa.int32()), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), *(pa.array(list(c), t) for c, t in zip(cols[1:], kinds)), part.column(2).take(at)], names=["id", "n_words", "items", "starts", "ends", "row"])

        return numbered.mapInArrow(run, schema)

    whole = search(0)
    if n_blocks > 1:
        for k in range(1, n_blocks):
            whole = whole.unionByName(search(k))
        whole = whole.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    ordered = F.array_sort(F.arrays_zip("starts", "ends"))
    reach = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["ends"] - F.greatest(s["starts"], a["to"]))).alias("n"), F.greatest(a["to"], s["ends"]).alias("to")),
        lambda a: a["n"].cast("long"),
    )
    return whole.select(F.col("id").alias(id_col), "n_words", reach.alias("n_hit"), "items", ordered.alias("spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, all columns kept.

    One filter, without a join; with a large benchmark one for each block, each over what the last one kept, as written.
    """
    spark, schema, at = docs.sparkSession, docs.schema, docs.columns.index(text_col)
    texts = benchmark.select(F.col(item_text).alias("t")).distinct()
    n_blocks = _blocks(texts, block_bytes)
    dealt = texts.withColumn("b", F.pmod(F.xxhash64("t"), F.lit(n_blocks)))

    def clean(sent):
        def run(batches):
            search = WuManber(sent.value, size)
            for b in batches:
                for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                    yield part.filter(pa.array([not search.find(words_of(t.as_py()))[0] for t in part.column(at)], pa.bool_()))

        return run

    store = Scratch(spark)
    for k in range(n_blocks):
        items = [(0, r["t"]) for r in dealt.where(F.col("b") == k).select("t").collect()]  # about block_bytes
        sent = spark.sparkContext.broadcast(items)
        docs = docs.mapInArrow(clean(sent), schema)
        if k < n_blocks - 1:
            docs = store.table(docs)
            sent.unpersist()
    return docs


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    joined = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SPLIT = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLE_SQL = f"""
WITH b AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, w[i:i+9] AS p, len(w[i:i+9]) AS m
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
),
d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hit AS (
  SELECT DISTINCT doc_id, i, m, item_id FROM (SELECT doc_id, i, l.m AS m, w[i:i+l.m-1] AS p FROM places, (SELECT DISTINCT m FROM pat) l WHERE i + l.m - 1 <= len(w)) JOIN pat USING (p, m)
),
pos AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS j FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
  sha256(coalesce(j, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
