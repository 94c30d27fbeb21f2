"""Lexical and dense retrieval, rank fusion and evidence fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Rows of a query block that is sent to every task.
QUERY_BLOCK = 20_000


def top(df: DataFrame, by: str, *order, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1; the order must leave no ties."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col(name) <= k)


def postings(docs: DataFrame, terms: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, dl, term, tf) of these terms alone: other words are dropped before they are counted."""
    words = docs.select(F.col(doc_id).alias("doc"), T.tokens(F.col(text)).alias("w"))
    pairs = words.select("doc", F.size("w").alias("dl"), F.explode("w").alias("term")).join(terms, "term", "left_semi")
    return pairs.groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, text: str = "text", k: int = 5, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query, doc, score, rank): BM25 over an inverted index, joined on terms.

    Negative idf is epsilon times the mean idf; query terms count as often as they
    occur; documents without a common term fill up the ranks, later documents first.
    """
    size = docs.select(F.size(T.tokens(F.col(text))).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = docs.select(F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(size))  # one row
    df = df.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("idf").alias("mean"))
    weights = df.crossJoin(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("idf") < 0, epsilon * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    asked = queries.select(F.col(query_id).alias("query"), F.explode(T.tokens(F.col(text))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qf"))
    post = postings(docs, asked.select("term").distinct(), doc_id, text)
    hits = post.join(weights.join(asked, "term"), "term")
    part = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("query", "doc").agg(F.round(F.sum(part), 6).alias("score"))
    last = docs.select(F.col(doc_id).alias("doc")).orderBy(F.desc("doc")).limit(2 * k)  # 2k rows
    fill = queries.select(F.col(query_id).alias("query")).crossJoin(F.broadcast(last)).withColumn("score", F.lit(0.0))
    both = scored.unionByName(fill.join(scored.select("query", "doc"), ["query", "doc"], "left_anti"))
    return top(both, "query", F.desc("score"), F.desc("doc"), k=k)


def dense(queries: DataFrame, vectors: DataFrame, query_id: str, doc_id: str, vector: str = "embedding", k: int = 5) -> DataFrame:
    """(query, doc, score, rank) by dot product; queries meet all vectors block by block."""
    asked = queries.select(F.col(query_id).alias("query"), F.col(vector).alias("qv"))
    blocks = -(-asked.count() // QUERY_BLOCK)
    out = None
    for i in range(max(1, blocks)):
        part = asked if blocks <= 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)
        dot = F.aggregate(F.zip_with("qv", "dv", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
        pairs = vectors.select(F.col(doc_id).alias("doc"), F.col(vector).alias("dv")).crossJoin(F.broadcast(part))
        found = top(pairs.select("query", "doc", F.round(dot, 6).alias("score")), "query", F.desc("score"), F.desc("doc"), k=k)
        out = found if out is None else out.unionByName(found)
    return out


def rrf(first: DataFrame, second: DataFrame, k: int = 5, constant: int = 60) -> DataFrame:
    """(query, doc, rrf, rank) from two ranked lists; ties by rank in the first, then in the second."""
    a, b = (x.select("query", "doc", F.col("rank").alias(n)) for x, n in ((first, "r1"), (second, "r2")))
    both = a.join(b, ["query", "doc"], "full")
    term = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    return top(both.withColumn("rrf", F.round(term("r1") + term("r2"), 9)), "query", F.desc("rrf"), F.asc_nulls_last("r1"), F.asc_nulls_last("r2"), k=k)


def fuse(text: DataFrame, graph: DataFrame, n_text: int, n_graph: int, most: int) -> DataFrame:
    """Text evidence, then graph evidence, each document once; text wins."""
    rows = text.where(F.col("rank") <= n_text).select("query", "doc", F.lit(0).alias("b"), "rank").unionByName(
        graph.where(F.col("rank") <= n_graph).select("query", "doc", F.lit(1).alias("b"), "rank")
    )
    one = rows.groupBy("query", "doc").agg(F.min(F.struct("b", "rank")).alias("m"))
    out = one.select("query", "doc", F.when(F.col("m.b") == 0, "text").otherwise("graph").alias("branch"), "m.b", F.col("m.rank").alias("source_rank"))
    return top(out, "query", "b", "source_rank", "doc", k=most).drop("b")


def hub_penalty(evidence: DataFrame, weight: float = 0.15) -> DataFrame:
    """Adds hub_freq (distinct queries of a document) and score / (1 + weight * ln(1 + hub_freq))."""
    hubs = evidence.groupBy("doc").agg(F.countDistinct("query").alias("hub_freq"))
    return evidence.join(hubs, "doc").withColumn("final", F.round(F.col("score") / (1 + weight * F.log1p("hub_freq")), 6))


def keyword_candidates(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, rarest: int = 20, most: int = 50) -> DataFrame:
    """Documents that hold one of a query's rarest tokens, at most `most` postings of a token by id."""
    words = docs.select(F.col(doc_id).alias("doc"), F.explode(F.array_distinct(T.content_tokens(F.col("text")))).alias("term"))
    df = words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(T.content_tokens(F.col("text")))).alias("term")).join(df, "term")
    chosen = top(asked, "query", "df", "term", k=rarest, name="r").select("query", "term")
    first = top(words.join(chosen.select("term").distinct(), "term", "left_semi"), "term", "doc", k=most, name="r").select("term", "doc")
    return chosen.join(first, "term").groupBy("query", "doc").agg(F.count(F.lit(1)).alias("n_terms"))


def coverage(gold: DataFrame, passages: DataFrame, by: list[str]) -> DataFrame:
    """Multiset coverage: for (by, passage) the sum of least term counts over gold's tokens.

    gold: (query, term, tf); passages: by columns with query, and (term, tf).
    """
    total = gold.groupBy("query").agg(F.sum("tf").alias("total"))
    both = gold.withColumnRenamed("tf", "g").join(passages.withColumnRenamed("tf", "p"), ["query", "term"])
    return both.groupBy(*by).agg(F.sum(F.least("g", "p")).alias("common")).join(total, "query").withColumn("coverage", F.round(F.col("common") / F.col("total"), 6))
