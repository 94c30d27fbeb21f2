"""Extractions to graph rows: merges within a chunk, chunk and entity nodes, look-ups.

Entity rows: chunk, ord, local, type, name, aliases, years, description, evidence, confidence.
Relation rows: chunk, ord, source, target, type, description.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def merge_in_chunk(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, id_map): entities of one chunk, type and key become the first one.

    Aliases and years are united and sorted (of a lone entity they stay as they are); texts come from the
    highest confidence, the earliest of equals. id_map: chunk, local, kept.
    """
    rows = entities.withColumn("key", T.key(F.col("name")))
    by = ["chunk", "type", "key"]
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    sure = F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("ord"))
    made = rows.groupBy(*by).agg(
        F.min_by(F.struct("ord", "local", "name", "aliases", "years"), "ord").alias("f"), united("aliases").alias("all_aliases"), united("years").alias("all_years"),
        F.max_by(F.struct("description", "evidence", "confidence"), sure).alias("b"), F.count(F.lit(1)).alias("n"),
    )
    pick = lambda own, every: F.when(F.col("n") > 1, F.col(every)).otherwise(F.col(own))
    merged = made.select(
        "chunk", "f.ord", F.col("f.local").alias("local"), "type", F.col("f.name").alias("name"), pick("f.aliases", "all_aliases").alias("aliases"), pick("f.years", "all_years").alias("years"),
        "b.description", "b.evidence", "b.confidence", "n",
    )
    kept = F.first("local").over(Window.partitionBy(*by).orderBy("ord"))
    return merged, rows.select("chunk", "local", kept.alias("kept"))


def resolve_ends(relations: DataFrame, id_map: DataFrame) -> DataFrame:
    """Ends through the chunk's id_map; an unknown end is null."""
    ids = id_map.dropDuplicates(["chunk", "local"])
    end = lambda c: ids.select("chunk", F.col("local").alias(c), F.col("kept").alias(f"{c}_kept"))
    rows = relations.join(end("source"), ["chunk", "source"], "left").join(end("target"), ["chunk", "target"], "left")
    return rows.withColumn("source", F.col("source_kept")).withColumn("target", F.col("target_kept")).select(relations.columns)


def dedup_relations(relations: DataFrame) -> DataFrame:
    """The first of each source, type, target and key of the description in a chunk."""
    rows = relations.withColumn("_k", T.key(F.coalesce("description", F.lit(""))))
    nth = F.row_number().over(Window.partitionBy("chunk", "source", "type", "target", "_k").orderBy("ord"))
    return rows.withColumn("_n", nth).where("_n = 1").drop("_k", "_n")


def _years(declared: Column, text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(declared, F.array().cast("array<int>")), T.years(text))))


def chunk_node_id(chunk: Column) -> Column:
    return F.concat(F.lit("chunk_"), chunk)


def chunk_nodes(chunks: DataFrame) -> DataFrame:
    """Nodes of chunks (chunk_id, text, years, further columns kept); blank ids go; years are declared or in the text."""
    rows = chunks.withColumn("chunk_id", T.squeeze(F.coalesce(F.col("chunk_id").cast("string"), F.lit("")))).where("chunk_id <> ''")
    rows = rows.withColumn("text", T.squeeze(F.coalesce("text", F.lit(""))))
    rest = [c for c in chunks.columns if c not in ("chunk_id", "text", "years", "char_count")]
    count = F.coalesce(F.col("char_count").cast("int"), F.length("text")) if "char_count" in chunks.columns else F.length("text")
    return rows.select(
        chunk_node_id(F.col("chunk_id")).alias("id"), F.lit("DocumentChunk").alias("type"), F.col("chunk_id").alias("name"), "chunk_id", *rest,
        _years(F.col("years"), F.col("text")).alias("years"), count.alias("char_count"), "text",
    )


def entity_nodes(entities: DataFrame) -> DataFrame:
    """Nodes of aligned entities (id, type, name, description, samples, years, further columns kept)."""
    rows = entities.withColumn("id", T.squeeze(F.coalesce(F.col("id").cast("string"), F.lit("")))).where("id <> ''")
    told = F.concat_ws(" ", F.coalesce("description", F.lit("")), F.array_join("samples", " "))
    return rows.withColumn("years", _years(F.col("years"), told))


def union_nodes(*kinds: DataFrame) -> DataFrame:
    """Nodes of all kinds; a column that a kind lacks is null for it."""
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k, allowMissingColumns=True)
    return out


def chunk_by_id(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """wanted (chunk, further columns) with the node of chunk_{chunk}, or else of the raw id."""
    side = nodes.select(F.col("id").alias("_id"), F.struct(*nodes.columns).alias("node"))
    rows = wanted.withColumn("_own", chunk_node_id(F.col("chunk").cast("string"))).withColumn("_raw", F.col("chunk").cast("string"))
    rows = rows.join(side.select(F.col("_id").alias("_own"), F.col("node").alias("_a")), "_own", "left").join(side.select(F.col("_id").alias("_raw"), F.col("node").alias("_b")), "_raw", "left")
    return rows.withColumn("node", F.coalesce("_a", "_b")).drop("_own", "_raw", "_a", "_b")
