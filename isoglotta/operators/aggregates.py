"""Summaries of groups, keys and windows over readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dialects(data: DataFrame) -> DataFrame:
    """Distinct non-null localities."""
    return data.select("did").where("did IS NOT NULL").distinct()


def characters(data: DataFrame) -> DataFrame:
    """Distinct (cid, character) pairs that aren't both null."""
    return data.select("cid", "character").na.drop("all").distinct()


def character_of(data: DataFrame) -> DataFrame:
    """One character for each cid: the smallest."""
    return data.where("cid IS NOT NULL").groupBy("cid").agg(F.min("character").alias("character"))


def top_values(data: DataFrame, by: str, columns: Sequence[str], k: int = 10) -> DataFrame:
    """Per group and column: 'value:count' of the k most frequent values (ties by value), comma-joined."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("element"), F.col(c).alias("value")) for c in columns)))
    c = data.select(F.col(by).alias("cluster"), pairs.alias("x")).select("cluster", "x.element", "x.value").where("value IS NOT NULL").groupBy("cluster", "element", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cluster", "element").orderBy(F.desc("n"), "value")
    top = c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    text = F.transform(F.array_sort(F.collect_list(F.struct("r", "value", "n"))), lambda t: F.concat(t["value"], F.lit(":"), t["n"].cast("string")))
    return top.groupBy("cluster", "element").agg(F.array_join(text, ",").alias("frequencies"))


def mode(data: DataFrame, by: str, column: str) -> DataFrame:
    """Per group the most frequent value; ties: the smallest."""
    c = data.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.count("*").alias("n"))
    return c.groupBy(by).agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias(column))


def cluster_entropy(data: DataFrame, by: str, did: str, column: str) -> DataFrame:
    """Per group the mean over localities of the entropy (natural logarithm) of a column's values."""
    c = data.where(F.col(column).isNotNull()).groupBy(by, did, column).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(by, did))
    e = c.withColumn("p", p).groupBy(by, did).agg((-F.sum(F.col("p") * F.log("p"))).alias("h"))
    return e.groupBy(by).agg(F.avg("h").alias("entropy"))


def relative_frequency(data: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """(by..., column, p): share of each value inside its block."""
    c = data.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    return c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def missing_share(cells: DataFrame, elements: Sequence[str]) -> DataFrame:
    """Per cid the share of missing values in its cells."""
    return cells.groupBy("cid").agg(F.avg(sum((F.when(F.coalesce(F.col(e), F.lit("")) == "", 1.0).otherwise(0.0) for e in elements), F.lit(0.0)) / len(elements)).alias("missing"))


def monophones(data: DataFrame, glyph: str) -> DataFrame:
    """Add ``monophone``: does the glyph occur once?"""
    return data.withColumn("monophone", F.count("*").over(Window.partitionBy(glyph)) == 1)


def extent(data: DataFrame, scale: float = 0.0, margin: float = 0.01) -> DataFrame:
    """One row lat0, lon0, lat1, lon1: of finite points; with a scale, mean -+ scale * population deviation inside that; then widened by margin * range."""
    ok = data.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) AND abs(lat) < double('Infinity') AND abs(lon) < double('Infinity')")
    a = ok.agg(*(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max), ("m", F.avg), ("s", F.stddev_pop))))
    out = []
    for c in ("lat", "lon"):
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        if scale > 0:
            lo, hi = F.greatest(lo, F.col(f"m_{c}") - scale * F.col(f"s_{c}")), F.least(hi, F.col(f"m_{c}") + scale * F.col(f"s_{c}"))
        out += [(lo - margin * (hi - lo)).alias(f"{c}0"), (hi + margin * (hi - lo)).alias(f"{c}1")]
    return a.select(*out)


def jitter(data: DataFrame, key: str, step: float = 1e-4) -> DataFrame:
    """The k-th point (from 0, in key order) at the same place moves east by k * step."""
    w = Window.partitionBy("lat", "lon").orderBy(key)
    return data.withColumn("lon", F.col("lon") + (F.row_number().over(w) - 1) * step)


def concat_sources(**sources: DataFrame) -> DataFrame:
    """UNION ALL with the source's name in ``dataset``; missing columns are null."""
    out = None
    for name, d in sources.items():
        d = d.withColumn("dataset", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def script_is_simplified(chars: DataFrame, column: str, to_simplified) -> DataFrame:
    """One row: do fewer than three glyphs change when converted? ``to_simplified``: Column -> Column."""
    return chars.agg((F.count_if(F.col(column) != to_simplified(F.col(column))) < 3).alias("simplified"))
