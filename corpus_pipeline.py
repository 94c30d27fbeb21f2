"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
documents. A row without doc_id is a document of its own and ranks after all others. Near copies are judged on five-word shingles at similarity 0.8. run() writes
each stage's rows to the shared folder, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from evidentia.llm.common import materialise, table


def _only(docs: DataFrame, decide: Callable[[DataFrame], DataFrame], condition: str) -> DataFrame:
    """The rows of docs whose decision meets the condition; rows without doc_id are numbered down from the greatest long for it."""
    own = F.lit(2**63 - 1) - F.monotonically_increasing_id()
    unnamed = materialise(docs.where("doc_id IS NULL").withColumn("doc_id", own).withColumn("unnamed", F.lit(True)), "unnamed")
    named = docs.where("doc_id IS NOT NULL").withColumn("unnamed", F.lit(False)).unionByName(unnamed)
    kept = named.join(decide(named).where(condition).select("doc_id"), "doc_id", "left_semi")
    return kept.withColumn("doc_id", F.when(~F.col("unnamed"), F.col("doc_id"))).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, exact_dedup.exact_dedup, "kept")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, near_dedup.near_components, "kept")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, lambda d: decontamination.contamination(d, table(spark, sf_dir, "benchmark")), "NOT contaminated")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learned scores, minimum hashes and token ids have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
