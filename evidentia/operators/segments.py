"""Ordered lines to sections, neighbours and overlaps, as plain windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sections(lines: DataFrame, book: str, order: str, heading: str, exercise: str, resume: str) -> DataFrame:
    """Adds state, kept and section to lines.

    An exercise line starts a stretch that is dropped until a line that resumes; kept
    headings number the sections of a book from 1; kept lines before the first are 0.
    """
    w = Window.partitionBy(book).orderBy(order)
    event = F.when(F.col(exercise), "start").when(F.col(resume), "resume")
    rows = lines.withColumn("state", F.last(event, ignorenulls=True).over(w))
    rows = rows.withColumn("kept", ~(F.col(exercise) | F.coalesce(F.col("state") == "start", F.lit(False))))
    return rows.withColumn("section", F.sum(F.when(F.col("kept") & F.col(heading), 1).otherwise(0)).over(w))


def neighbours(rows: DataFrame, group: str, order: str, id_: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("prev_id", F.lag(id_).over(w)).withColumn("next_id", F.lead(id_).over(w))


def adjacent_groups(rows: DataFrame, order: list[str], id_: str, kind: str, block: str) -> DataFrame:
    """For each row, the rows at most two before and after in its block that have its kind, itself included."""
    w = Window.partitionBy(block).orderBy(*order).rowsBetween(-2, 2)
    near = F.collect_list(F.struct(F.col(kind).alias("k"), F.col(id_).alias("i"))).over(w)
    return rows.withColumn("near", near).withColumn(
        "members", F.expr(f"array_sort(transform(filter(near, x -> x.k = {kind}), x -> x.i))")
    ).drop("near")
