"""The corpus pipeline: toxicity, exact and near duplicates, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``. The toxicity stage learns from its own
input and the labels table; the decontamination stage reads the benchmark table.

The scores of the first stage are of a trained model and the last stage's places of a packing plan, so no
SQL gives these rows; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isoglotta.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from isoglotta.llm.common import Scratch, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, docs = Scratch(spark), read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
