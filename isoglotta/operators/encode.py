"""Dictionaries, category codes, token vectors and value-disjoint splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def make_dict(data: DataFrame, column: str, min_frequency: int | float | None = None, max_categories: int | None = None, sort: str = "value") -> DataFrame:
    """(value, count, code): values that are neither null nor empty, by value or by falling count (ties by value), code from 0.

    A fractional ``min_frequency`` is a share of all rows, null ones too. The code comes from a window over the
    kept categories, which is one task: set ``max_categories`` where the column isn't categorical.
    """
    c = data.where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    if isinstance(min_frequency, float):
        total = data.agg(F.floor(F.lit(min_frequency) * F.count("*")).alias("least"))
        c = c.join(F.broadcast(total), (F.col("least") <= 1) | (F.col("count") >= F.col("least"))).drop("least")
    elif min_frequency and min_frequency > 1:
        c = c.where(F.col("count") >= min_frequency)
    if max_categories is not None:
        c = c.orderBy(F.desc("count"), "value").limit(max_categories)
    order = [F.col("value")] if sort == "value" else [F.desc("count"), F.col("value")]
    return c.withColumn("code", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def ordinal(data: DataFrame, column: str, out: str = "code", missing: str = "", unknown: int = -1, start: int = 0) -> DataFrame:
    """Dense codes by sorted value; null and ``missing`` get ``unknown``. Codes are made from the distinct values and joined."""
    values = data.select(column).where(F.col(column).isNotNull() & (F.col(column) != missing)).distinct()
    codes = values.withColumn(out, (F.row_number().over(Window.orderBy(column)) - 1 + start).cast("long"))
    return data.join(codes, column, "left").fillna({out: unknown})


def with_vocabulary(data: DataFrame, column: str, vocabulary: Sequence, out: str = "id") -> DataFrame:
    """1..n by place in the vocabulary, 0 for null and unknown values. The vocabulary is a parameter, so it is bounded."""
    spark = data.sparkSession
    table = spark.createDataFrame([(v, i) for i, v in enumerate(vocabulary, 1)], f"`{column}` {data.schema[column].dataType.simpleString()}, `{out}` bigint")
    return data.join(F.broadcast(table) if len(vocabulary) <= 100_000 else table, column, "left").fillna({out: 0})


def vectorize(data: DataFrame, row: str, columns: Sequence[str], separator: str = " ", binary: bool = False, norm: str | None = None) -> DataFrame:
    """(row, col, token, weight): token counts of each column's cell, normalised inside the column's block if asked."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("cell")) for c in columns)))
    t = data.select(F.col(row).alias("row"), pairs.alias("x")).select("row", "x.col", F.explode(F.split("x.cell", separator)).alias("token")).where("token <> ''")
    c = t.groupBy("row", "col", "token").agg((F.lit(1.0) if binary else F.count("*").cast("double")).alias("weight")) if not binary else t.distinct().withColumn("weight", F.lit(1.0))
    if norm:
        w = Window.partitionBy("row", "col")
        size = F.sum("weight").over(w) if norm == "l1" else F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(w))
        c = c.withColumn("weight", F.col("weight") / size)
    return c


def offsets(sizes: DataFrame, key: str, size: str) -> DataFrame:
    """Where each block starts if blocks follow each other in key order."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return sizes.withColumn("start", F.sum(size).over(w) - F.col(size))


def hash_uniform(x: Column, seed: int = 0) -> Column:
    """A number in (0, 1) that every engine with md5 can make from a value and a seed."""
    h = F.md5(F.concat(x.cast("string"), F.lit(f"#{seed}")))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def value_disjoint_split(data: DataFrame, column: str, train_size: float = 0.9, seed: int = 0) -> DataFrame:
    """Add ``train``: no value is in both parts. Values are drawn without replacement with weight count**2 (exponential races); those
    before the cumulative share of rows reaches ``train_size`` are training values. The first drawn always is, the last never."""
    c = data.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    c = c.withColumn("key", -F.log(hash_uniform(F.col(column), seed)) / (F.col("n") * F.col("n")))
    w, all_ = Window.orderBy("key", column), Window.partitionBy()
    c = c.select(column, F.row_number().over(w).alias("i"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum("n").over(all_).alias("total"), F.count("*").over(all_).alias("k"))
    train = F.when(F.col("i") == 1, True).when(F.col("i") == F.col("k"), False).otherwise(F.col("cum") < train_size * F.col("total"))
    return data.join(c.select(column, train.alias("train")), column, "left")


def stratified_split(data: DataFrame, key: str, stratum: str, test_size: float = 0.1, val_size: float = 0.1, seed: int = 0) -> DataFrame:
    """Add ``part`` (train, val, test) by the rank of a hash within the stratum; strata of one row are pooled."""
    n = F.count("*").over(Window.partitionBy(stratum))
    d = data.withColumn("_s", F.when(n >= 2, F.col(stratum).cast("string")).otherwise(F.lit("")))
    w = Window.partitionBy("_s").orderBy(hash_uniform(F.col(key), seed), key)
    d = d.withColumn("_r", (F.row_number().over(w) - 0.5) / F.count("*").over(Window.partitionBy("_s")))
    return d.withColumn("part", F.when(F.col("_r") < test_size, "test").when(F.col("_r") < test_size + val_size, "val").otherwise("train")).drop("_s", "_r")


def sample_keys(data: DataFrame, key: str, n: int | None = None, seed: int = 0) -> DataFrame:
    """Rows of ``n`` keys drawn by hash (all keys if None), with the key's place in the shuffled order."""
    order = data.select(key).where(F.col(key).isNotNull()).distinct().orderBy(hash_uniform(F.col(key), seed), key)
    drawn = (order if n is None else order.limit(n)).select(key, hash_uniform(F.col(key), seed).alias("draw"))
    return data.join(drawn, key)


def pc2color(data: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(r, g, b) of the first three components: z-score with the population deviation / 6 + 0.5, within 0 and 1; missing ones 0.5."""
    out, stats = data, data.agg(*(f(c).alias(f"_{n}_{c}") for c in columns[:3] for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = out.crossJoin(F.broadcast(stats))
    for i, name in enumerate("rgb"):
        if i < len(columns):
            c = columns[i]
            z = F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) / 6 + 0.5
            out = out.withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), z)))
        else:
            out = out.withColumn(name, F.lit(0.5))
    return out.drop(*stats.columns)
