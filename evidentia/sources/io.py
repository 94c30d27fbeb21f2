"""Readers and writers: JSON arrays, page text files, chunk JSON, CSV and reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A whole-file JSON array, by an explicit schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row a text file below path: path, book (its folder), page (0 if the name has none), text; empty files go."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    page = F.coalesce(F.regexp_extract("path", r"_(\d+)(?:\.jpg)?\.txt$", 1).try_cast("int"), F.lit(0))
    return rows.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("book"), page.alias("page"), "text").where(F.trim("text") != "")


def page_lines(pages: DataFrame) -> DataFrame:
    return pages.select("book", "page", F.posexplode(F.split("text", r"\R")).alias("line_no", "line"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, page, index_text (contextual text or else text); chunks without text go."""
    rows = read_json(spark, path, "chunk_id string, pages array<int>, text string, contextual_text string")
    text = T.squeeze(F.coalesce(F.nullif(F.col("contextual_text"), F.lit("")), F.col("text")))
    return rows.select("chunk_id", F.get("pages", F.lit(0)).alias("page"), text.alias("index_text")).where(F.length("index_text") > 0)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, **metadata: str) -> None:
    """A graph as three tables below path: metadata (one row with the counts), nodes and edges."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    spark = nodes.sparkSession
    counts = spark.read.parquet(f"{path}/nodes").agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(spark.read.parquet(f"{path}/edges").agg(F.count(F.lit(1)).alias("n_edges")))  # one row each
    counts.select("*", *[F.lit(v).alias(k) for k, v in metadata.items()]).write.mode("overwrite").parquet(f"{path}/metadata")


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("metadata", "nodes", "edges")}


def save_json(value: object, path: str) -> None:
    """A small JSON document on the driver's disk, indented, letters as they are, ending in a newline; replaced whole."""
    target = Path(path)
    part = target.with_name(target.name + ".tmp")
    part.write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    part.replace(target)


def report(counts: DataFrame, title: str) -> str:
    """A Markdown table of a small aggregate."""
    cols = counts.columns
    lines = [f"# {title}", "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    return "\n".join(lines + ["| " + " | ".join(str(v) for v in r) + " |" for r in counts.toLocalIterator()]) + "\n"
