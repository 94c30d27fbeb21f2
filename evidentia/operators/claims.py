"""Claims: validation, dedup with label conflicts, sampling, metrics, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing_fields(df: DataFrame, id_: str, fields: list[str]) -> DataFrame:
    """Rows with null or blank required fields, and which."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    found = F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in fields]))
    return df.select(F.col(id_), F.array_join(found, ",").alias("missing")).where("missing <> ''")


def dedup(df: DataFrame, key: str, label: str, order: str, keep_conflicts: bool = False) -> DataFrame:
    """First row of each key; keys with several labels are dropped whole unless kept."""
    groups = df.groupBy(key).agg(F.min(order).alias("first"), F.countDistinct(label).alias("n_labels"), F.count(F.lit(1)).alias("n_rows"))
    chosen = groups if keep_conflicts else groups.where("n_labels <= 1")
    return df.join(chosen.select(key, F.col("first").alias(order), "n_rows"), [key, order], "inner")


def conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(label).alias("n_labels")).where("n_labels > 1")


def systematic(df: DataFrame, stratum: str, order: str, quota: int) -> DataFrame:
    """quota rows of each stratum at indices floor(i * n / quota); a smaller stratum whole."""
    w = Window.partitionBy(stratum).orderBy(order)
    rows = df.withColumn("idx", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(stratum)))
    i = F.ceil(F.col("idx") * F.lit(quota) / F.col("n"))  # the one candidate i with floor(i n / quota) = idx
    return rows.where((F.col("n") <= quota) | ((i < quota) & (F.floor(i * F.col("n") / quota) == F.col("idx")))).drop("n")


def balanced(df: DataFrame, label: str, order: str, limit: int) -> DataFrame:
    """limit // 2 rows of label 1, filled up with label 0, by order."""
    r = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return df.withColumn("r", r).where(((F.col(label) == 1) & (F.col("r") <= limit // 2)) | ((F.col(label) == 0) & (F.col("r") <= limit - limit // 2))).drop("r")


def quota(df: DataFrame, label: str, order: str, n: int) -> DataFrame:
    return df.withColumn("r", F.row_number().over(Window.partitionBy(label).orderBy(order))).where(F.col("r") <= n).drop("r")


def stratified_random(df: DataFrame, stratum: str, id_: str, rate: float, seed: int = 42) -> DataFrame:
    """max(1, ceil(rate * n)) rows of each stratum by a seeded hash."""
    w = Window.partitionBy(stratum)
    r = F.row_number().over(w.orderBy(F.xxhash64(F.col(id_), F.lit(seed)), id_))
    rows = df.withColumn("r", r).withColumn("n", F.count(F.lit(1)).over(w))
    return rows.where(F.col("r") <= F.greatest(F.lit(1), F.ceil(rate * F.col("n")))).drop("r", "n")


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that no finished row has; errors are tried again if done leaves them out."""
    return todo.join(done.select(key), key, "left_anti")


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row of counts and rates of a two-class verdict (1 is real, 0 fake)."""
    n = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(predicted) == p))
    c = df.agg(n(1, 1).alias("tr"), n(1, 0).alias("ff"), n(0, 1).alias("fr"), n(0, 0).alias("tf"), F.count_if(F.col(predicted).isNull()).alias("unknown"))
    div = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tr, ff, fr, tf = map(F.col, ("tr", "ff", "fr", "tf"))
    return c.select(
        *map(F.col, ("tr", "ff", "fr", "tf", "unknown")),
        div(tr + tf, tr + ff + fr + tf).alias("accuracy"),
        div(tr, tr + fr).alias("precision_real"),
        div(tr, tr + ff).alias("recall_real"),
        div(2 * tr, 2 * tr + fr + ff).alias("f1_real"),
        div(tf, tf + ff).alias("precision_fake"),
        div(tf, tf + fr).alias("recall_fake"),
        div(2 * tf, 2 * tf + fr + ff).alias("f1_fake"),
    )
