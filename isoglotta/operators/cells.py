"""Cells (did, cid, element, value, seq): the long form that every operator reads or makes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ELEMENTS = ("initial", "final", "tone")


def first_value(x: Column, seq: Column) -> Column:
    """Aggregate: the first non-null value in row order, whatever the order of arrival."""
    return F.min_by(x, F.when(x.isNotNull(), seq))


def joined_values(x: Column, seq: Column, separator: str = " ") -> Column:
    """Aggregate: non-null values in row order, joined; null if there is none."""
    rows = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(seq.alias("seq"), x.alias("x")))))
    return F.when(F.count(x) > 0, F.array_join(F.transform(rows, lambda r: r["x"]), separator))


def transform(data: DataFrame, index: str = "did", columns: str = "cid", values: Sequence[str] | None = None, aggfunc: str | Callable[[Column, Column], Column] = "first", seq: str = "seq") -> DataFrame:
    """One row per (index, columns) pair, its readings reduced by ``aggfunc`` ('first', 'join' or a function of value and order).

    Rows with a null key vanish. This is the long form of the pivot; ``wide`` makes columns of it.
    """
    reduce = {"first": first_value, "join": joined_values}.get(aggfunc, aggfunc)
    values = values or [c for c in data.columns if c not in (index, columns, seq)]
    return data.where(F.col(index).isNotNull() & F.col(columns).isNotNull()).groupBy(index, columns).agg(*(reduce(F.col(v), F.col(seq)).alias(v) for v in values))


def wide(cells: DataFrame, index: str, columns: str, values: Sequence[str], keys: Sequence) -> DataFrame:
    """Pivot to one column per key and value, named '{key}_{value}'. Keys are given, so no job looks for them."""
    out = cells.groupBy(index).pivot(columns, list(keys)).agg(*(F.first(v).alias(v) for v in values))
    return out if len(values) > 1 else out.withColumnsRenamed({str(k): f"{k}_{values[0]}" for k in keys})


def melt(cells: DataFrame, elements: Sequence[str] = ELEMENTS) -> DataFrame:
    """(did, cid, element, value): one row per filled cell."""
    pairs = F.explode(F.array(*(F.struct(F.lit(e).alias("element"), F.col(e).alias("value")) for e in elements)))
    return cells.select("did", "cid", pairs.alias("x")).select("did", "cid", "x.element", "x.value").where(F.coalesce(F.col("value"), F.lit("")) != "")


def fill_first(data: DataFrame, by: str, columns: Sequence[str], seq: str = "seq") -> DataFrame:
    """Nulls become the group's first non-null value in row order; columns independently."""
    w = Window.partitionBy(by).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return data.withColumns({c: F.coalesce(F.col(c), F.first(c, ignorenulls=True).over(w)) for c in columns})


def drop_empty(data: DataFrame, subset: Sequence[str] = ELEMENTS) -> DataFrame:
    return data.na.drop("all", subset=list(subset))


def drop_sparse(cells: DataFrame, did_share: float = 0.2, char_share: float = 0.5) -> DataFrame:
    """Cells of localities with enough characters, then of characters in enough of these localities."""
    n_chars = cells.agg(F.countDistinct("cid").alias("n"))
    dids = cells.groupBy("did").agg(F.countDistinct("cid").alias("k")).crossJoin(F.broadcast(n_chars)).where(F.col("k") >= did_share * F.col("n")).select("did")
    kept = cells.join(dids, "did", "left_semi")
    n_dids = dids.agg(F.count("*").alias("n"))
    cids = kept.groupBy("cid").agg(F.countDistinct("did").alias("k")).crossJoin(F.broadcast(n_dids)).where(F.col("k") >= char_share * F.col("n")).select("cid")
    return kept.join(cids, "cid", "left_semi")


def without_note(data: DataFrame, note: str = "note", mark: str = "文") -> DataFrame:
    """Drop rows whose note holds the mark; rows without a note stay."""
    return data.where(~F.coalesce(F.contains(F.col(note), F.lit(mark)), F.lit(False)))


def conform(data: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly these columns; missing ones are null strings."""
    return data.select(*(F.col(c) if c in data.columns else F.lit(None).cast("string").alias(c) for c in columns))
