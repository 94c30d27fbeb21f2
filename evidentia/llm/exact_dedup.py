"""Exact dedup by a log-structured merge index, in DataFrame operations only.

Each task's share of the input is a memtable: memtables are flushed as runs sorted by
digest, with Parquet's Bloom filter and min/max statistics in each file. Compaction
merges the runs by digest, level by level, keeping the smallest id and the number of
rows. A hit (a row whose digest belongs to another row) is verified byte for byte against
the row that stays.

Defined cases: null text is empty text. Empty tables give empty results. Rows that share
a doc_id are one document repeated: they count in group_size and carry the same flags. A
row without doc_id is a document of its own, ranks after all others, and its result has no
doc_id; keep_id is null where such a row stays. Columns besides doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, named, table

#: Runs that a flush writes, and runs that a compaction merges.
RUNS, FANOUT = 4, 4
#: Members of a hot group that one copy of the kept text serves in verification.
MEMBERS_A_COPY = 256

BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "100000"}


def normalised(text: Column) -> Column:
    """Each run of white space as one space; a lone space needs no work."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


class MergeIndex:
    """Levels of sorted digest runs in the shared folder.

    flush writes memtables as runs of level 0: one for each RUNS-th part of the tasks, each file sorted by digest
    with a Bloom filter and statistics, which point look-ups (find) are pushed down to. compact merges FANOUT runs
    of a level into one of the next, keeping of each digest the smallest id and the number of rows, until one is left.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[list[DataFrame]] = [[]]
        self.flushed: list[DataFrame] = []

    def flush(self, docs: DataFrame) -> None:
        """Write the memtables of docs (doc_id, text, unnamed) as runs; no shuffle."""
        entries = docs.select("doc_id", "unnamed", F.sha2(normalised(F.col("text")), 256).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run"))
        stored = materialise(entries.sortWithinPartitions("run", "digest"), "runs", by="run", **BLOOM)
        self.flushed.append(stored)
        one = F.col("doc_id"), F.col("unnamed"), F.lit(1).cast("long").alias("n"), F.col("digest")
        self.levels[0] += [stored.where(F.col("run") == k).select(*one) for k in range(RUNS)]

    def entries(self) -> DataFrame:
        """Every row that was flushed."""
        return reduce(DataFrame.unionByName, self.flushed).select("doc_id", "unnamed", "digest")

    def compact(self) -> DataFrame:
        """The one run that is left: digest, doc_id (smallest), unnamed, n."""
        level = 0
        while sum(map(len, self.levels)) > 1 or level == 0:
            runs, self.levels[level] = self.levels[level], []
            if len(self.levels) == level + 1:
                self.levels.append([])
            for k in range(0, len(runs), FANOUT):
                merged = reduce(DataFrame.unionByName, runs[k : k + FANOUT]).groupBy("digest").agg(F.min(F.struct("doc_id", "unnamed")).alias("k"), F.sum("n").alias("n"))
                merged = merged.select("k.doc_id", "k.unnamed", "n", "digest")
                last = len(runs) <= FANOUT
                self.levels[level + 1].append(materialise(merged.sortWithinPartitions("digest"), f"level{level + 1}", **BLOOM) if last else merged)
            level += 1
        return next(r for runs in self.levels for r in runs)

    def find(self, digests: list[str]) -> DataFrame:
        """Entries of these digests in all runs; the files' filters and statistics rule out most."""
        return reduce(DataFrame.unionByName, [r for runs in self.levels for r in runs]).where(F.col("digest").isin(digests))


def _verified(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows of hits whose text differs from the kept row's: (digest, norm, doc_id).

    The kept text is repeated once for every MEMBERS_A_COPY members, so a group that
    holds a third of all rows spreads over many tasks.
    """
    hits = hits.drop("unnamed")
    ids = hits.select("doc_id").distinct()
    texts = (
        docs.join(ids, "doc_id", "left_semi")
        .select("doc_id", "unnamed", normalised(F.col("text")).alias("norm"))
        .withColumn("digest", F.sha2("norm", 256))
    )
    groups = hits.select("digest", "keep_id", "n").distinct().withColumn("copies", F.ceil(F.col("n") / MEMBERS_A_COPY).cast("int"))
    keepers = (
        groups.withColumnRenamed("keep_id", "doc_id")
        .join(texts.drop("unnamed"), ["doc_id", "digest"])
        .groupBy("digest", "copies")
        .agg(F.min("norm").alias("kept"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    )
    members = hits.where(F.col("doc_id") != F.col("keep_id")).select(
        "doc_id", "digest", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / MEMBERS_A_COPY)).cast("int").alias("salt")
    )
    return (
        members.join(texts, ["doc_id", "digest"])
        .join(keepers, ["digest", "salt"])
        .where(F.col("norm") != F.col("kept"))
        .select("doc_id", "unnamed", "digest", "norm")
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    docs = named(docs)
    index = MergeIndex(docs.sparkSession)
    index.flush(docs)
    entries, top = index.entries(), index.compact().select("digest", F.col("doc_id").alias("keep_id"), F.col("unnamed").alias("keep_unnamed"), "n")
    hits = materialise(entries.join(top.where("n > 1"), "digest"), "hits")
    wrong = materialise(_verified(docs, hits), "unequal")
    out = entries.join(hits.select("doc_id", "digest", "keep_id", "keep_unnamed", "n").distinct(), ["doc_id", "digest"], "left").select(
        "doc_id",
        "unnamed",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("keep_unnamed", "unnamed").alias("keep_unnamed"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("digest").alias("text_sha256"),
    )
    if not wrong.isEmpty():  # texts that differ under one digest form groups of their own
        own = wrong.groupBy("digest", "norm").agg(F.min(F.struct("doc_id", "unnamed")).alias("own"), F.count(F.lit(1)).alias("own_n"))
        fixed = wrong.join(own, ["digest", "norm"]).select("doc_id", F.col("digest").alias("text_sha256"), "own", "own_n")
        less = wrong.groupBy(F.col("digest").alias("text_sha256")).agg(F.count(F.lit(1)).alias("less"))
        out = (
            out.join(fixed.distinct(), ["doc_id", "text_sha256"], "left")
            .join(less, "text_sha256", "left")
            .select(
                "doc_id",
                "unnamed",
                F.coalesce("own.doc_id", "keep_id").alias("keep_id"),
                F.coalesce("own.unnamed", "keep_unnamed").alias("keep_unnamed"),
                F.coalesce("own_n", F.col("group_size") - F.coalesce("less", F.lit(0))).alias("group_size"),
                "text_sha256",
            )
        )
    known = lambda c, blank: F.when(~F.col(blank), F.col(c)).alias(c)
    return out.select(known("doc_id", "unnamed"), known("keep_id", "keep_unnamed"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
     g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.h AS text_sha256 FROM n JOIN g USING (h)
"""
