"""Phonological rules: characters of two sets are expected to share an element."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoglotta.functions.phonetics import tokens

from .cells import melt


def load_rules(path: str, spark, characters: DataFrame | None = None) -> DataFrame:
    """Rules from CSV (element, cid1, cid2; lists by white space; '#' comments), with a display name."""
    raw = spark.read.csv(path, header=True, comment="#", schema="element string, cid1 string, cid2 string")
    rules = raw.select(F.monotonically_increasing_id().alias("rule_id"), "element", tokens(F.coalesce("cid1", F.lit(""))).alias("cid1"), tokens(F.coalesce("cid2", F.lit(""))).alias("cid2"))
    return named_rules(rules, characters)


def named_rules(rules: DataFrame, characters: DataFrame | None = None) -> DataFrame:
    """Add name ('element:cid1=cid2', lists by commas), and char1 and char2 if characters (cid, character) are given; then the name holds these."""
    if characters is None:
        return rules.withColumn("name", F.concat("element", F.lit(":"), F.array_join("cid1", ","), F.lit("="), F.array_join("cid2", ",")))
    chars = characters.groupBy("cid").agg(F.min("character").alias("character"))
    for side in ("1", "2"):
        ids = rules.select("rule_id", F.posexplode(f"cid{side}").alias("pos", "cid")).join(chars, "cid")
        text = ids.groupBy("rule_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "character"))), lambda r: r["character"]), "").alias(f"char{side}"))
        rules = rules.join(text, "rule_id", "left").fillna("", [f"char{side}"])
    return rules.withColumn("name", F.concat("element", F.lit(":"), "char1", F.lit("="), "char2"))


def compliance(cells: DataFrame, rules: DataFrame, norm: str | None = "l2") -> DataFrame:
    """(did, rule_id, value): dot product of the token counts of a rule's two character sets, each normalised ('l1', 'l2', None).

    ``cells``: one row per (did, cid) and element columns whose readings are separated by white space.
    A cid without readings contributes nothing; an empty side gives 0. Rules are broadcast if Spark finds them small.
    """
    long = melt(cells).select("did", "cid", "element", F.explode(tokens(F.col("value"))).alias("token"))
    ids = F.explode(F.expr("transform(cid1, c -> struct(1 AS side, c AS cid)) || transform(cid2, c -> struct(2 AS side, c AS cid))"))
    sides = rules.select("rule_id", "element", ids.alias("x")).select("rule_id", "element", "x.side", "x.cid")
    count = long.join(sides, ["element", "cid"]).groupBy("did", "rule_id", "side", "token").agg(F.count("*").cast("double").alias("n"))
    by_token = count.groupBy("did", "rule_id", "token").agg(*(F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0.0)).alias(f"n{s}") for s in (1, 2)))
    size = {"l1": F.sum, "l2": lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))}.get(norm, lambda c: F.lit(1.0))
    value = by_token.groupBy("did", "rule_id").agg(F.sum(F.col("n1") * F.col("n2")).alias("dot"), size("n1").alias("s1"), size("n2").alias("s2"))
    value = value.select("did", "rule_id", F.coalesce(F.try_divide("dot", F.col("s1") * F.col("s2")), F.lit(0.0)).alias("value"))
    grid = cells.select("did").where("did IS NOT NULL").distinct().join(rules.select("rule_id"), F.lit(True))
    return grid.join(value, ["did", "rule_id"], "left").fillna(0.0, ["value"])
