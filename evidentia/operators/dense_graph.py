"""Graph retrieval by vectors: dense candidates, multi-hop paths by dense steps, facts and chunks.

similar: (id, item, dense) for a kind of item; see dense_scores(). Claims, edges and chunks are as in
graph_scores; node_years: node, year.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph_scores as S
from .graph import degrees, incidence
from .retrieval import top


def dense_scores(claims: DataFrame, items: DataFrame) -> DataFrame:
    """(id, item, dense): dot products of claim vectors (id, vector) with item vectors (item, vector).

    Claims are the stated query set: they are sent to the tasks in blocks, and every item meets them.
    """
    asked = claims.select("id", F.col("vector").alias("qv"))
    dot = F.aggregate(F.zip_with("qv", "vector", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return items.crossJoin(F.broadcast(asked)).select("id", "item", F.round(dot, 6).alias("dense"))


def seeds_and_edges(claims: DataFrame, edges: DataFrame, node_dense: DataFrame, edge_dense: DataFrame, node_years: DataFrame, top_nodes: int = 50, top_edges: int = 200) -> tuple[DataFrame, DataFrame]:
    """(seeds, edges): (id, node, reason) and (id, edge, reason), bags; claims: id, nodes (matched), years."""
    best_nodes = top(node_dense, "id", F.desc("dense"), "item", k=top_nodes)
    best_edges = top(edge_dense, "id", F.desc("dense"), "item", k=top_edges).select("id", F.col("item").alias("edge"))
    years = claims.select("id", F.explode(F.array_distinct("years")).alias("year"))
    known = incidence(edges).select("node").distinct()
    ends = best_edges.join(edges.select("edge", "source", "target"), "edge").select("id", F.explode(F.array("source", "target")).alias("node"))
    own = edges.select("edge", F.explode(F.array_distinct("years")).alias("year"))
    named = claims.select("id", F.explode("nodes").alias("node")).join(known, "node", "left_semi")
    tag = lambda df, c, name: df.select("id", c, F.lit(name).alias("reason"))
    seeds = [
        tag(best_nodes.withColumnRenamed("item", "node"), "node", "dense_node_seed"), tag(ends, "node", "edge_end"), tag(named, "node", "alias_seed"),
        tag(years.join(node_years, "year"), "node", "year_seed"),
    ]
    found = [tag(best_edges, "edge", "dense_edge"), tag(years.join(own, "year"), "edge", "year_edge")]
    return reduce(DataFrame.unionByName, seeds), reduce(DataFrame.unionByName, found)


def neighbours(edges: DataFrame, edge_dense: DataFrame, max_degree: int = 80, most: int = 20) -> DataFrame:
    """(id, node, edge, other, dense): the edges of a node that a claim goes on by, most similar first.

    A node of more than max_degree edges goes on by its max_degree best, of which, as of any, the best `most` are taken.
    """
    rows = edge_dense.select("id", F.col("item").alias("edge"), "dense").join(incidence(edges, "edge"), "edge")
    order = F.row_number().over(Window.partitionBy("id", "node").orderBy(F.desc("dense"), "edge"))
    return rows.withColumn("r", order).where(F.col("r") <= min(max_degree, most)).drop("r")


def multihop(
    claims: DataFrame, edges: DataFrame, seeds: DataFrame, node_dense: DataFrame, edge_dense: DataFrame, write, hops: int = 2, beam: int = 20, most: int = 20, max_degree: int = 80, max_seeds: int = 80
) -> DataFrame:
    """(id, nodes, edges, score): every path that a beam from each seed makes, without revisits.

    seeds: id, node. Of a claim's seeds the max_seeds most similar are used; after each hop the best `beam` paths of a
    claim and seed go on, by score and then by their edges. write cuts the lineage of a hop.
    """
    near = node_dense.select("id", F.col("item").alias("node"), F.col("dense").alias("node_dense"))
    start = seeds.select("id", "node").distinct().join(near, ["id", "node"], "left").withColumn("node_dense", F.coalesce("node_dense", F.lit(0.0)))
    start = top(start, "id", F.desc("node_dense"), "node", k=max_seeds).select("id", F.col("node").alias("seed"))
    front = write(start.select("id", "seed", F.array("seed").alias("nodes"), F.array().cast("array<string>").alias("edges"), F.lit(0.0).alias("score")))
    steps = write(neighbours(edges, edge_dense, max_degree, most))
    told = edges.select("edge", "type", "years", "tokens")
    asked = claims.select("id", F.col("years").alias("claim_years"), F.col("tokens").alias("claim_tokens"), "types")
    degree = degrees(edges).select(F.col("node").alias("other"), "degree")
    out: list[DataFrame] = []
    for depth in range(1, hops + 1):
        step = front.withColumn("node", F.element_at("nodes", -1)).join(steps, ["id", "node"]).where(~F.array_contains("nodes", F.col("other")))
        step = step.join(told, "edge").join(asked, "id").join(degree, "other").join(near.withColumnRenamed("node", "other"), ["id", "other"], "left")
        words = F.coalesce(F.size(F.array_intersect("claim_tokens", "tokens")), F.lit(0))
        typed = F.coalesce(F.array_contains("types", F.col("type")), F.lit(False))
        dated = F.coalesce(F.arrays_overlap("claim_years", "years"), F.lit(False))
        worth = S.step_score(F.col("dense"), F.col("node_dense"), words, typed, dated, F.col("degree"), F.lit(depth), max_degree)
        step = step.select(
            "id", "seed", F.concat("nodes", F.array("other")).alias("nodes"), F.concat("edges", F.array(F.col("edge").cast("string"))).alias("edges"), F.round(F.col("score") + worth, 9).alias("score")
        )
        made = write(step)
        out.append(made)
        r = F.row_number().over(Window.partitionBy("id", "seed").orderBy(F.desc("score"), "edges"))
        front = made.withColumn("r", r).where(F.col("r") <= beam).drop("r")
    return reduce(DataFrame.unionByName, out).select("id", "nodes", "edges", F.round("score", 4).alias("score"))


def _or_zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def facts(claims: DataFrame, edges: DataFrame, chunks: DataFrame, found: DataFrame, support: DataFrame, node_dense: DataFrame, edge_dense: DataFrame, most: int = 500, k: int = 8) -> DataFrame:
    """(id, edge, chunk, score, rank): the best facts among a claim's candidates (id, edge), by vectors, paths and the plain score.

    Of more than `most` candidates the best by the greatest of similarity, support and a twentieth of the cheap score are scored.
    """
    asked = S._claim_side(claims)
    full = edges.join(chunks.select("chunk", F.col("years").alias("chunk_years")), "chunk", "left").withColumn("edge", F.col("edge").cast("string"))
    alike = edge_dense.select("id", F.col("item").cast("string").alias("edge"), F.col("dense").alias("edge_dense"))
    rows = found.select("id", F.col("edge").cast("string").alias("edge")).distinct().join(full, "edge").join(asked, "id").join(alike, ["id", "edge"], "left")
    rows = rows.join(support, ["id", "edge"], "left").withColumn("support", _or_zero("support")).withColumn("edge_dense", _or_zero("edge_dense"))
    rows = top(rows.withColumn("_g", F.round(F.greatest("edge_dense", "support", S.cheap_edge_score() / 20.0), 6)), "id", F.desc("_g"), "edge", k=most, name="_r")
    near = lambda c: node_dense.select("id", F.col("item").alias(c), F.col("dense").alias(f"{c}_dense"))
    rows = rows.join(near("source"), ["id", "source"], "left").join(near("target"), ["id", "target"], "left")
    score = S.edge_score_dense(S.edge_score(), F.col("edge_dense"), F.col("source_dense"), F.col("target_dense"), F.col("support"))
    scored = rows.select("id", "edge", "chunk", score.alias("score")).where("score > 0")
    return top(scored, "id", F.desc("score"), "edge", k=k)


def chunk_score_dense(base: Column, dense: Column) -> Column:
    return F.round(base + F.greatest(F.lit(0.0), F.coalesce(dense, F.lit(0.0))) * 8.0, 4)


def retrieve(claims: DataFrame, edges: DataFrame, chunks: DataFrame, node_years: DataFrame, vectors: dict[str, DataFrame], write, k: int = 8, top_nodes: int = 50, top_edges: int = 200, top_paths: int = 20) -> tuple[DataFrame, DataFrame]:
    """(facts, paths) of all claims by vectors; vectors: claims (id, vector), nodes and edges (item, vector)."""
    node_dense = write(dense_scores(vectors["claims"], vectors["nodes"]))
    edge_dense = write(dense_scores(vectors["claims"], vectors["edges"]))
    seeds, found = seeds_and_edges(claims, edges, node_dense, edge_dense, node_years, top_nodes, top_edges)
    made = multihop(claims, edges, seeds, node_dense, edge_dense, write)
    best = top(made, "id", F.desc("score"), "edges", k=top_paths)
    along = best.select("id", F.explode("edges").alias("edge"))
    candidates = found.select("id", F.col("edge").cast("string").alias("edge")).unionByName(along)
    return facts(claims, edges, chunks, candidates, S.path_support(made, top_paths), node_dense, edge_dense, k=k), best
