"""Cells kept up to date from a stream of readings.

Counts of values are an ordinary streaming aggregation (update mode). First readings are kept by batch: each
micro-batch is reduced to one row per cell and element and merged into a Parquet table by version folders, so a rerun of
a batch writes the same version again and readers never see half of one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoglotta.operators.cells import ELEMENTS


def value_counts(stream: DataFrame, elements: Sequence[str] = ELEMENTS) -> DataFrame:
    """(did, element, value, n) of a stream of readings; null and empty values don't count."""
    pairs = F.explode(F.array(*(F.struct(F.lit(e).alias("element"), F.col(e).alias("value")) for e in elements)))
    x = stream.select("did", pairs.alias("x")).select("did", "x.element", "x.value").where(F.coalesce("value", F.lit("")) != "")
    return x.groupBy("did", "element", "value").agg(F.count("*").alias("n"))


def first_cells(stream: DataFrame, path: str, checkpoint: str, elements: Sequence[str] = ELEMENTS, **trigger):
    """Start a query that keeps (did, cid, element, value, seq), the first non-null value of every cell's element, in
    ``{path}/v={batch}``; the newest version is the table. Readings may arrive in any order."""
    pairs = F.explode(F.array(*(F.struct(F.lit(e).alias("element"), F.col(e).alias("value")) for e in elements)))
    keep = ("did", "cid", "element", "value", "seq")

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.select("did", "cid", "seq", pairs.alias("x")).select("did", "cid", "x.element", "x.value", "seq").where("value IS NOT NULL AND did IS NOT NULL AND cid IS NOT NULL")
        if number > 0:
            new = new.unionByName(batch.sparkSession.read.parquet(f"{path}/v={number - 1}").select(*keep))
        new.groupBy("did", "cid", "element").agg(F.min_by("value", "seq").alias("value"), F.min("seq").alias("seq")).select(*keep).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
