"""Rows in and out of evaluation: joins on ids, keys, order, evidence of one shape, chosen chunks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import bm25, dense, rrf


def last_wins(rows: DataFrame, by: str, ord: str) -> DataFrame:
    """Of rows with one id, the last in order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(ord)))).where("_r = 1").drop("_r")


def with_text(graph: DataFrame, text: DataFrame, id_: str = "id", ord: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(rows, missing): graph rows beside the last text row of their id (struct text, null if none), and how many lack one."""
    side = last_wins(text, id_, ord)
    side = side.select(F.col(id_).cast("string").alias("_k"), F.struct(*[c for c in side.columns if c != id_]).alias("text"))
    rows = graph.withColumn("_k", F.col(id_).cast("string")).join(side, "_k", "left").drop("_k")
    return rows, rows.agg(F.count_if(F.col("text").isNull()).alias("missing"), F.count(F.lit(1)).alias("rows"))


def in_all(ids: DataFrame, *sides: DataFrame, id_: str = "id") -> DataFrame:
    """Rows of ids that stand on every side, with its columns; others are skipped."""
    out = ids
    for s in sides:
        out = out.join(s, id_)
    return out


def pool_rows(rows: DataFrame, pool: DataFrame, id_: str = "id") -> DataFrame:
    """Rows beside their pool row, nulls where it is missing."""
    return rows.join(pool, id_, "left")


def mandatory(ids: DataFrame, rows: DataFrame, id_: str = "id", shown: int = 20) -> DataFrame:
    """Rows of all ids; raises where some are missing, naming the first of them."""
    missing = ids.select(id_).distinct().join(rows, id_, "left_anti")
    some = [r[0] for r in missing.orderBy(id_).limit(shown).collect()]
    if some:
        raise ValueError(f"{missing.count()} ids are missing: {', '.join(map(str, some))}")
    return ids.join(rows, id_)


def row_key(id_: Column, ord: Column) -> Column:
    """The id, or __idx_ and the place of a row without one."""
    return F.coalesce(id_.cast("string"), F.concat(F.lit("__idx_"), ord.cast("string")))


def prefix(rows: DataFrame, n: int, ord: str = "ord") -> DataFrame:
    """The first n rows by their place from 0."""
    return rows.where(F.col(ord) < n)


def in_order(results: DataFrame, rows: DataFrame, key: str = "key", ord: str = "ord") -> DataFrame:
    """Results with the place of their input row, sorted by it."""
    return results.drop(ord).join(rows.select(key, ord), key).orderBy(ord)


def in_commits(pending: DataFrame, key: str, every: int) -> Iterator[DataFrame]:
    """Pending rows in parts of about `every`, dealt by a hash of their key: a part that is written need not run again."""
    parts = max(1, -(-pending.count() // every))
    for k in range(parts):
        yield pending.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k)


def build_query(*fields: Column) -> Column:
    """One query text of several fields."""
    return T.squeeze(F.concat_ws(" ", *fields))


def choose_chunks(chunks: DataFrame, books: list[str] | None = None, confidences: list[str] | None = None, dated: bool = False, limit: int | None = None) -> DataFrame:
    """Chunks (ord, book, section_confidence, years) of these books and confidences, with years if dated, the first `limit`."""
    out = chunks
    if books:
        out = out.where(F.col("book").isin(books))
    if confidences:
        out = out.where(F.col("section_confidence").isin(confidences))
    if dated:
        out = out.where(F.size("years") > 0)
    return out if limit is None else out.orderBy("ord").limit(limit)


EVIDENCE = "chunk string, branch string, book string, chapter string, section string, pages array<int>, years array<int>, text string, final double, text_rank int, bm25 double, dense double"


def _have(rows: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in rows.columns else F.lit(None)).cast(kind)


def text_evidence(rows: DataFrame) -> DataFrame:
    """Text evidence in the common shape (query and EVIDENCE): the chunk is the document, else its source, else its rank."""
    of = lambda n, k="string": _have(rows, n, k)
    named = F.coalesce(F.nullif(of("doc_id"), F.lit("")), F.nullif(of("source"), F.lit("")), F.concat(F.lit("text_rank_"), of("rank")))
    pages = F.coalesce(of("pages", "array<int>"), F.array_compact(F.array(of("page", "int"))))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("int"))
    none = F.array().cast("array<int>")
    return rows.select(
        "query", named.alias("chunk"), F.lit("text").alias("branch"), of("book").alias("book"), of("chapter").alias("chapter"), of("section").alias("section"), pages.alias("pages"),
        F.coalesce(of("years", "array<int>"), none).alias("years"), F.coalesce(of("text"), F.lit("")).alias("text"), F.coalesce(of("score", "double"), F.lit(0.0)).alias("final"),
        zero(of("rank", "int")).alias("text_rank"), F.coalesce(of("bm25", "double"), F.lit(0.0)).alias("bm25"), F.coalesce(of("dense", "double"), F.lit(0.0)).alias("dense"),
    )


def graph_evidence(rows: DataFrame) -> DataFrame:
    """Graph evidence in the same shape; what it lacks is null, but lists are empty."""
    of = lambda n, k="string": _have(rows, n, k)
    none = F.array().cast("array<int>")
    return rows.select(
        "query", of("chunk").alias("chunk"), F.lit("graph").alias("branch"), of("book").alias("book"), of("chapter").alias("chapter"), of("section").alias("section"),
        F.coalesce(of("pages", "array<int>"), none).alias("pages"), F.coalesce(of("years", "array<int>"), none).alias("years"), F.coalesce(of("text"), F.lit("")).alias("text"),
        of("score", "double").alias("final"), of("rank", "int").alias("text_rank"), of("bm25", "double").alias("bm25"), of("dense", "double").alias("dense"),
    )


def text_input(claims: DataFrame, found: DataFrame, most: int = 5) -> DataFrame:
    """Evaluation rows (id, claim, label, evidence) with the best text evidence; found as text_evidence takes it."""
    best = text_evidence(found).where((F.col("text_rank") >= 1) & (F.col("text_rank") <= most))
    listed = best.groupBy(F.col("query").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("text_rank", "chunk", "text"))), lambda e: F.struct(e["chunk"].alias("chunk"), e["text"].alias("text"))).alias("evidence"))
    empty = F.array().cast("array<struct<chunk:string,text:string>>")
    return claims.join(listed, "id", "left").withColumn("evidence", F.coalesce("evidence", empty))


def oracle_input(claims: DataFrame) -> DataFrame:
    """Evaluation rows whose one evidence is the gold passage (column gold); none where it is blank."""
    gold = T.squeeze(F.coalesce("gold", F.lit("")))
    one = F.array(F.struct(F.lit("gold").alias("chunk"), gold.alias("text")))
    return claims.withColumn("evidence", F.when(gold != "", one).otherwise(F.array().cast("array<struct<chunk:string,text:string>>")))


def retrieve(method: str, queries: DataFrame, docs: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame, ids: tuple[str, str, str, str], k: int = 5, pool: int = 20) -> DataFrame:
    """(query, doc, score, rank) by bm25, dense or hybrid; ids: query and document id, then those of their vectors."""
    q, d, vq, vd = ids
    if method == "bm25":
        return bm25(queries, docs, q, d, k=k)
    if method == "dense":
        return dense(query_vectors, doc_vectors, vq, vd, k=k)
    if method == "hybrid":
        both = rrf(bm25(queries, docs, q, d, k=pool), dense(query_vectors, doc_vectors, vq, vd, k=pool), k=k)
        return both.select("query", "doc", F.col("rrf").alias("score"), "rank")
    raise ValueError(f"unknown method {method!r}: bm25, dense or hybrid")


def online(queries: DataFrame, docs: DataFrame, query_vectors: DataFrame | None, doc_vectors: DataFrame | None, ids: tuple[str, str, str, str], k: int = 5) -> DataFrame:
    """Hybrid retrieval for a few questions; without vectors by BM25 alone."""
    method = "bm25" if query_vectors is None or doc_vectors is None else "hybrid"
    return retrieve(method, queries, docs, query_vectors, doc_vectors, ids, k=k)
