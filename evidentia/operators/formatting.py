"""Search texts of edges, chunks and nodes, and the structs in which facts, paths and chunks are given out.

Nodes: id, type, name, description, aliases, samples, evidence_samples, years. Edges: edge, source, target,
type, description, evidence, chunk. Chunks: chunk, book, chapter, section, pages, text, contextual_text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *[T.squeeze(F.coalesce(p, F.lit(""))) for p in parts])


def edge_text(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge, text): type, description, evidence, then name and description of either end."""
    side = lambda c: nodes.select(F.col("id").alias(c), F.struct("name", "description").alias(f"_{c}"))
    rows = edges.join(side("source"), "source", "left").join(side("target"), "target", "left")
    return rows.select("edge", _joined("type", "description", "evidence", *[F.col(f"_{e}.{c}") for e in ("source", "target") for c in ("name", "description")]).alias("text"))


def chunk_text() -> Column:
    return _joined("book", "chapter", "section", "text", "contextual_text")


def node_text(samples: int = 3) -> Column:
    """Type, name, aliases, description, the first samples of either kind, and years."""
    first = lambda c: F.array_join(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, samples), " ")
    years = F.array_join(F.transform(F.coalesce("years", F.array().cast("array<int>")), lambda y: y.cast("string")), " ")
    return _joined("type", "name", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "), "description", first("samples"), first("evidence_samples"), years)


def _label(node: str) -> Column:
    return F.struct(*[F.coalesce(F.col(f"{node}.{c}"), F.lit("")).alias(c) for c in ("id", "type", "name")])


def with_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are labels (id, type, name), blank for unknown nodes."""
    side = lambda c: nodes.select(F.col("id").alias(c), F.struct("id", "type", "name").alias(f"_{c}"))
    rows = edges.join(side("source"), "source", "left").join(side("target"), "target", "left")
    return rows.withColumn("source", _label("_source")).withColumn("target", _label("_target")).drop("_source", "_target")


def facts(found: DataFrame, edges: DataFrame, nodes: DataFrame, item_years: DataFrame) -> DataFrame:
    """(id, rank, fact): found (id, edge, score, rank) as structs; item_years: kind, item, years."""
    dated = lambda kind, c, name: item_years.where(F.col("kind") == kind).select(F.col("item").alias(c), F.col("years").alias(name))
    none = F.array().cast("array<int>")
    wanted = edges.join(found.select("edge").distinct(), "edge", "left_semi")
    rows = with_labels(wanted, nodes).join(dated("edge", "edge", "_ey"), "edge", "left").join(dated("chunk", "chunk", "_cy"), "chunk", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    fact = F.struct(
        F.col("edge").alias("fact_id"), "score", text("type"), "source", "target", text("description"), text("evidence"), F.coalesce(F.col("chunk").cast("string"), F.lit("")).alias("source_chunk"),
        F.array_sort(F.coalesce("_ey", none)).alias("years"), F.array_sort(F.coalesce("_cy", none)).alias("source_chunk_years"),
    )
    return found.select("id", "edge", "score", "rank").join(rows, "edge").select("id", "rank", fact.alias("fact"))


def paths(found: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, path, score, hops, nodes, edges): found (id, path, score, nodes, edges) with labels in place of ids, in order."""
    named = nodes.select(F.col("id").alias("n"), F.struct("id", "type", "name").alias("_n"))
    at = found.select("id", "path", F.posexplode("nodes").alias("pos", "n")).join(named, "n", "left")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x["x"])
    labels = at.groupBy("id", "path").agg(ordered(_label("_n").alias("x")).alias("nodes"))
    wanted = found.select("id", "path", F.posexplode("edges").alias("pos", "edge"))
    told = with_labels(edges.join(wanted.select("edge").distinct(), "edge", "left_semi"), nodes)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = F.struct(F.col("edge").alias("fact_id"), text("type").alias("type"), "source", "target", text("description").alias("description"), text("evidence").alias("evidence"), text("chunk").alias("source_chunk"))
    steps = wanted.join(told, "edge", "left").groupBy("id", "path").agg(ordered(one.alias("x")).alias("edges"))
    rows = found.select("id", "path", "score", F.size("edges").alias("hops"))
    return rows.join(labels, ["id", "path"]).join(steps, ["id", "path"])


def chunks(found: DataFrame, rows: DataFrame, chunk_years: DataFrame) -> DataFrame:
    """(id, rank, chunk): found (id, chunk, score, rank) as structs; chunk_years: chunk, years."""
    side = rows.join(found.select("chunk").distinct(), "chunk", "left_semi").join(chunk_years.select("chunk", F.col("years").alias("_y")), "chunk", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    none = F.array().cast("array<int>")
    one = F.struct(F.col("chunk").alias("chunk_id"), "score", text("book"), text("chapter"), text("section"), F.coalesce("pages", none).alias("pages"), F.array_sort(F.coalesce("_y", none)).alias("years"), text("text"))
    return found.select("id", "chunk", "score", "rank").join(side, "chunk").select("id", "rank", one.alias("chunk"))
