"""Jobs: python -m isoglotta COMMAND DATASET [options]. DATASET is a folder of CSV files or one CSV file."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from isoglotta.operators import cells as C
from isoglotta.operators import recon, rules, similarity
from isoglotta.sources.datasets import Catalog, cached, clear_cache, write_csv


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="isoglotta", description=__doc__)
    p.add_argument("command", choices=("similarity", "compliance", "reconstruct", "refresh"))
    p.add_argument("dataset")
    p.add_argument("-o", "--output", required=True, help="folder of the result (CSV), or of the cache for refresh")
    p.add_argument("-m", "--method", choices=("chi2", "entropy"), default="chi2")
    p.add_argument("-r", "--rules", help="CSV of rules (element, cid1, cid2)")
    p.add_argument("-n", "--norm", choices=("l1", "l2", "none"), default="l2")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("isoglotta").getOrCreate()
    data = Catalog(spark).get(a.dataset)
    if data is None:
        raise SystemExit(f"no dataset named {a.dataset}")
    if a.command == "refresh":
        clear_cache(spark, a.output)
        cached(data, spark, a.output)
        return
    readings = data.data if "seq" in data.data.columns else data.data.withColumn("seq", F.monotonically_increasing_id())
    if a.command == "compliance":
        joined = C.transform(C.without_note(readings) if "note" in readings.columns else readings, "did", "cid", C.ELEMENTS, "join")
        out = rules.compliance(joined, rules.load_rules(a.rules, spark), None if a.norm == "none" else a.norm)
    else:
        table = C.transform(readings, "did", "cid", C.ELEMENTS)
        if a.command == "similarity":
            out = getattr(similarity, a.method)(table)
        else:
            out = recon.reconstruct(C.melt(table).select("cid", F.concat_ws("/", "did", "element").alias("col"), "value"))
    write_csv(out, a.output)


if __name__ == "__main__":
    main()
