"""Property-graph building, integrity, temporal index and expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, by: list[str], *order) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def mention_edges(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """One edge a (chunk, entity): mentions, greatest confidence, names joined in order.

    mentions: chunk, mention, entity_key, confidence; entities: entity_key, entity, name.
    Mentions without an entity are left out.
    """
    joined = mentions.join(entities, "entity_key")
    return joined.groupBy("chunk", "entity").agg(
        F.count(F.lit(1)).alias("n_mentions"), F.round(F.max("confidence"), 6).alias("confidence"), F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("names")
    )


def relation_edges(relations: DataFrame, to_entity: DataFrame) -> DataFrame:
    """Endpoints resolved through (mention, entity); unresolved edges and loops go."""
    a = to_entity.select(F.col("mention").alias("source"), F.col("entity").alias("source_entity"))
    b = to_entity.select(F.col("mention").alias("target"), F.col("entity").alias("target_entity"))
    return relations.join(a, "source").join(b, "target").where("source_entity <> target_entity")


def incidence(edges: DataFrame, *keep: str) -> DataFrame:
    """Each edge from both ends (a loop twice): node, other, kept columns."""
    return edges.select(F.col("source").alias("node"), F.col("target").alias("other"), *keep).unionAll(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), *keep))


def degrees(edges: DataFrame) -> DataFrame:
    return incidence(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def one_hop(seeds: DataFrame, edges: DataFrame, *keep: str) -> DataFrame:
    return seeds.join(incidence(edges, *keep), "node")


def two_hop(seeds: DataFrame, edges: DataFrame, cap: int = 60) -> DataFrame:
    """Directed paths seed, middle, seed of one group (query); middles outside the group's seeds.

    At most cap edges of each node, by neighbour, are followed.
    """
    order = F.row_number().over(Window.partitionBy("node").orderBy("other"))
    inc = incidence(edges).distinct().withColumn("r", order).where(F.col("r") <= cap).select("node", "other")
    first = seeds.join(inc, "node").select("query", F.col("node").alias("a"), F.col("other").alias("mid"))
    first = first.join(seeds.select("query", F.col("node").alias("mid")), ["query", "mid"], "left_anti")
    last = inc.select(F.col("node").alias("mid"), F.col("other").alias("b"))
    paths = first.join(last, "mid").where("a <> b")
    return paths.join(seeds.select("query", F.col("node").alias("b")), ["query", "b"], "left_semi").select("query", "a", "mid", "b")


def beam(seeds: DataFrame, edges: DataFrame, hops: int, width: int) -> DataFrame:
    """Paths of 1 to hops edges without revisits; after each hop the best `width` of a query go on.

    edges: source, target, weight. Score is the sum of weights; ties by the path itself.
    """
    inc, out = incidence(edges, "weight"), None
    front = seeds.select("query", F.array("node").alias("path"), F.lit(0.0).alias("score"))
    for _ in range(hops):
        step = front.withColumn("node", F.element_at("path", -1)).join(inc, "node").where(~F.array_contains("path", F.col("other")))
        step = step.groupBy("query", F.concat("path", F.array("other")).alias("path")).agg(F.max(F.round(F.col("score") + F.col("weight"), 6)).alias("score"))
        r = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "path"))
        front = step.withColumn("r", r).where(F.col("r") <= width).drop("r")
        out = front if out is None else out.unionByName(front)
    return out


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, repeated ids, broken edges, edges without evidence."""
    ids = nodes.select("id").distinct()
    broken = edges.join(ids.select(F.col("id").alias("source")), "source", "left_anti").select("edge_id").union(edges.join(ids.select(F.col("id").alias("target")), "target", "left_anti").select("edge_id")).distinct()
    a = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), (F.count(F.lit(1)) - F.countDistinct("id")).alias("repeated_nodes"))
    b = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.coalesce(F.col("evidence"), F.lit("")) == "").alias("no_evidence"))
    return a.crossJoin(b).crossJoin(broken.agg(F.count(F.lit(1)).alias("broken_edges")))  # one row each


def repair_relation(kind: Column, source: Column, target: Column) -> tuple[Column, Column]:
    """(type, swapped): direction and type that fit the types of the ends."""
    place = lambda c: c == "Place"
    swap = ((kind == "OCCURRED_AT") & source.isin("Place", "Time") & (target == "Event")) | ((kind == "PARTICIPATED_IN") & (source == "Event") & target.isin("Person", "Organization"))
    s = F.when(swap, target).otherwise(source)
    t = F.when(swap, source).otherwise(target)
    out = (
        F.when((kind == "OCCURRED_AT") & (s != "Event"), "RELATED_TO")
        .when((kind == "LOCATED_IN") & (s == "Event") & place(t), "OCCURRED_AT")
        .when((kind == "LOCATED_IN") & ~(s.isin("Place", "Organization") & place(t)), "RELATED_TO")
        .when((kind == "PARTICIPATED_IN") & ~(s.isin("Person", "Organization") & (t == "Event")), "RELATED_TO")
        .otherwise(kind)
    )
    return out, swap


def components(edges: DataFrame, write) -> DataFrame:
    """(node, label): smallest node reached, by label propagation with pointer jumping.

    write cuts the lineage of a round's labels (a checkpoint or a stored table).
    """
    both = write(incidence(edges).where("node <> other").distinct())
    labels = write(both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        far = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = write(step.join(far, "low", "left").select("node", "old", F.least("low", F.coalesce("far", "low")).alias("label")))
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
