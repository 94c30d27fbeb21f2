"""Connected components of an edge table, by label propagation and pointer jumping.

No neighbour list is gathered: each round is two joins and a minimum, written to the
shared folder, so a node with a third of all edges is only a skewed join, which adaptive
execution splits. Labels are minimal node ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label for every node of edges; label is the smallest node that it reaches."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
    both = materialise(both.where("u <> v").distinct(), "edges")
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = materialise(new.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("label"), "old"), "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
