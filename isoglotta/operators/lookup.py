"""Lookups by key, numbering, first rows of a key, and splits by count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import hash_uniform


def lookup(data: DataFrame, table: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the table's ``value`` at a composite key; null where the table lacks it or a key is null."""
    return data.join(table.select(*keys, F.col(value).alias(out)), list(keys), "left")


def fill_from(data: DataFrame, table: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Null labels are looked up in the table at a composite key; others stay. Only rows without a label are joined."""
    found = table.select(*keys, F.col(label).alias("_found"))
    open_ = data.where(F.col(label).isNull()).join(found, list(keys), "left").withColumn(label, F.col("_found")).drop("_found")
    return data.where(F.col(label).isNotNull()).unionByName(open_.select(data.columns))


def attach(data: DataFrame, info: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns of ``info`` (one row for each key) beside the rows of ``data``; null for unknown keys."""
    return data.drop(*columns).join(info.select(key, *columns), key, "left")


def numbered(data: DataFrame, order: Sequence[str], out: str = "number", start: int = 0, ranges: int = 256) -> DataFrame:
    """Consecutive numbers in the order of columns that identify a row.

    Rows are dealt into ranges of the first column (bounds from a sample, which only decides the deal), numbered inside each and
    moved by the count of the earlier ones, so no window holds all rows.
    """
    first = order[0]
    few = data.where(F.col(first).isNotNull()).select(first, hash_uniform(F.col(first)).alias("_h")).distinct().orderBy("_h", first).limit(20 * ranges)
    seen = sorted(r[0] for r in few.collect())
    bounds = seen[:: max(1, len(seen) // ranges)]
    kind = data.schema[first].dataType
    at = F.size(F.filter(F.array(*(F.lit(b).cast(kind) for b in bounds)), lambda b: b <= F.col(first))) if bounds else F.lit(0)
    dealt = data.withColumn("_range", F.when(F.col(first).isNull(), -1).otherwise(at))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")  # a row a range
    offset = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(offset), "_range").withColumn(out, (place - 1 + F.col("_before") + start).cast("long")).drop("_range", "_before")


def concat_numbered(order: Sequence[str], out: str = "did", source: str = "dataset", **sources: DataFrame) -> DataFrame:
    """UNION ALL with the source's name and new numbers from 0, in the order of sources and, inside one, of ``order``."""
    all_ = None
    for i, (name, d) in enumerate(sources.items()):
        d = d.withColumns({source: F.lit(name), "_i": F.lit(i)})
        all_ = d if all_ is None else all_.unionByName(d, allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("_i").orderBy(*order))
    sizes = all_.groupBy("_i").agg(F.count("*").alias("_n"))
    before = sizes.select("_i", (F.sum("_n").over(Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    return all_.join(F.broadcast(before), "_i").withColumn(out, (F.col("_before") + place - 1).cast("long")).drop("_i", "_before")


def keep_first(data: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key (null keys are keys) in the order of columns; partial aggregation, no window."""
    rest = [c for c in data.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return data.groupBy(*keys).agg(row).select(*keys, "_row.*").select(data.columns)


def split_counts(data: DataFrame, key: str, stratum: str, test: int, val: int, seed: int = 0) -> DataFrame:
    """Add ``part``: exactly ``test`` and ``val`` rows (or all there are), dealt to strata by their share, the rest train.

    Every stratum has the whole part of its share; rows left over go to the largest remainders (ties: the smaller stratum).
    """
    n = data.groupBy(stratum).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy())
    shares = n
    for name, want in (("_t", test), ("_v", val)):
        exact = F.col("_n") * F.lit(want) / total
        shares = shares.withColumn(f"{name}e", exact).withColumn(name, F.floor(f"{name}e"))
        left = F.least(F.lit(want), total) - F.sum(name).over(Window.partitionBy())
        by = Window.partitionBy().orderBy(F.desc(F.round(F.col(f"{name}e") - F.col(name), 9)), stratum)  # a row a stratum
        shares = shares.withColumn(name, F.col(name) + F.when(F.row_number().over(by) <= left, 1).otherwise(0)).drop(f"{name}e")
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_uniform(F.col(key), seed), key))
    joined = data.join(shares.drop("_n"), data[stratum].eqNullSafe(shares[stratum])).drop(shares[stratum]).withColumn("_r", place)
    part = F.when(F.col("_r") <= F.col("_t"), "test").when(F.col("_r") <= F.col("_t") + F.col("_v"), "val").otherwise("train")
    return joined.withColumn("part", part).drop("_t", "_v", "_r")


def halves(keys: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Distinct keys with ``half`` 1 or 2: two random halves (the second has the odd one)."""
    d = keys.select(key).where(F.col(key).isNotNull()).distinct()
    r = F.row_number().over(Window.partitionBy().orderBy(hash_uniform(F.col(key), seed), key))
    return d.select(key, F.when(r <= F.floor(F.count("*").over(Window.partitionBy()) / 2), 1).otherwise(2).alias("half"))
