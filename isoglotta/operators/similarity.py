"""Pairwise statistics of localities: chi-square, conditional entropy, and what is derived from them.

Each is one plan: distinct cells become features, features meet on the character (a self-join whose size is
the number of localities that share a character, squared), and counts are reduced with partial aggregation.
A pair of localities for which a feature is undefined keeps its row with a null value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import ELEMENTS


def features(cells: DataFrame, elements: Sequence[str] = ELEMENTS, cross: bool = True) -> DataFrame:
    """(did, cid, k, v): element k joined with the next one (no separator), or elements alone. Empty is missing."""
    part = [F.coalesce(F.col(e), F.lit("")) for e in elements]
    n = len(part)
    v = [F.concat(part[i], part[(i + 1) % n]) for i in range(n)] if cross and n > 1 else part
    return cells.select("did", "cid", F.posexplode(F.array(*v)).alias("k", "v")).where("v <> ''")


def _pairs(source: DataFrame, target: DataFrame, same_k: bool) -> DataFrame:
    """Co-occurrence counts (a, b, k, q, va, vb, o) over shared characters."""
    a = source.select(F.col("did").alias("a"), "cid", "k", F.col("v").alias("va"))
    b = target.select(F.col("did").alias("b"), "cid", F.col("k").alias("q"), F.col("v").alias("vb"))
    on = (a["cid"] == b["cid"]) & (a["k"] == b["q"]) if same_k else a["cid"] == b["cid"]
    return a.join(b, on).groupBy("a", "b", "k", "q", "va", "vb").agg(F.count("*").alias("o"))


def _all_pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """Localities x localities; localities only, never characters."""
    return source.select(F.col("did").alias("a")).distinct().join(target.select(F.col("did").alias("b")).distinct(), F.lit(True))


def chi2(cells: DataFrame, dest: DataFrame | None = None, elements: Sequence[str] = ELEMENTS, cross: bool = True) -> DataFrame:
    """(a, b, value): mean over features of (chi2 - dof) / sqrt(2 dof)."""
    x = features(cells, elements, cross)
    y = x if dest is None else features(dest, elements, cross)

    def margins(f: DataFrame, did: str, v: str, p: str, nc: str) -> DataFrame:
        w = Window.partitionBy("did", "k")
        m = f.groupBy("did", "k", "v").agg(F.count("*").alias("c"))
        return m.select(F.col("did").alias(did), "k", F.col("v").alias(v), (F.col("c") / F.sum("c").over(w)).alias(p), F.count("*").over(w).alias(nc))

    o = _pairs(x, y, same_k=True).drop("q")
    o = o.join(margins(x, "a", "va", "pa", "na"), ["a", "k", "va"]).join(margins(y, "b", "vb", "pb", "nb"), ["b", "k", "vb"])
    z = o.groupBy("a", "b", "k").agg(
        (F.sum(F.col("o") * F.col("o") / F.col("pa") / F.col("pb")) / F.sum("o") - F.sum("o")).alias("chi"),
        ((F.max("na") - 1) * (F.max("nb") - 1)).cast("double").alias("dof"),
    )
    each = F.try_divide(F.col("chi") - F.col("dof"), F.sqrt(2 * F.col("dof")))
    stat = z.groupBy("a", "b").agg(F.when(F.count(each) == len(elements), F.avg(each)).alias("value"))
    return _all_pairs(x, y).join(stat, ["a", "b"], "left")


def entropy(cells: DataFrame, dest: DataFrame | None = None, elements: Sequence[str] = ELEMENTS) -> DataFrame:
    """(a, b, value): sum over the elements of b of the least conditional entropy given a cross feature of a (natural logarithm)."""
    x, y = features(cells, elements, True), features(cells if dest is None else dest, elements, False)
    o = _pairs(x, y, same_k=False)
    r = o.groupBy("a", "b", "k", "q", "va").agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.log("o")).alias("e"))
    h = r.groupBy("a", "b", "k", "q").agg((F.sum(F.col("n") * F.log("n") - F.col("e")) / F.sum("n")).alias("h"))
    best = h.groupBy("a", "b", "q").agg(F.min("h").alias("h"))
    best = best.groupBy("a", "b").agg(F.when(F.count("h") == len(elements), F.sum("h")).alias("value"))
    return _all_pairs(x, y).join(best, ["a", "b"], "left")


def _diagonal(m: DataFrame, key: str, name: str) -> DataFrame:
    return m.where("a = b").select(F.col("a").alias(key), F.col("value").alias(name))


def normalize_sim(m: DataFrame) -> DataFrame:
    """Symmetric mean over the geometric mean of the diagonals, within -1 and 1."""
    t = m.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("value").alias("back"))
    mean = m.join(t, ["a", "b"]).select("a", "b", ((F.col("value") + F.col("back")) / 2).alias("s"))
    ratio = F.try_divide(F.col("s"), F.sqrt("da") * F.sqrt("db"))
    out = mean.join(_diagonal(m, "a", "da"), "a").join(_diagonal(m, "b", "db"), "b")
    return out.select("a", "b", F.when(ratio.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))).alias("value"))


def sim2dist(m: DataFrame) -> DataFrame:
    out = m.join(_diagonal(m, "a", "da"), "a").join(_diagonal(m, "b", "db"), "b")
    d = F.col("da") + F.col("db") - 2 * F.col("value")
    return out.select("a", "b", F.when(d.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), d))).alias("value"))


def dist2sim(m: DataFrame) -> DataFrame:
    top = m.groupBy("b").agg(F.max("value").alias("top"))
    left = top.select(F.col("b").alias("a"), F.col("top").alias("ta"))
    right = top.withColumnRenamed("top", "tb")
    return m.join(left, "a").join(right, "b").select("a", "b", (1 - F.try_divide(F.col("value"), F.sqrt("ta") * F.sqrt("tb"))).alias("value"))
