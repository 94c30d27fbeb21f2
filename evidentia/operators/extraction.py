"""Entities and relations out of a model's answers on chunks: validation, warnings, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Node and relation types that a model may give.
ENTITY_TYPES = ["Person", "Organization", "Event", "Place", "Time", "Concept"]
RELATION_TYPES = ["PARTICIPATED_IN", "OCCURRED_AT", "LOCATED_IN", "RELATED_TO", "CAUSES", "RESULTS_IN", "BEFORE", "AFTER"]

_ENTITY = "local_id string, type string, name string, aliases array<string>, description string, years array<string>, evidence_text string, confidence string"
_RELATION = "source string, target string, type string, description string, evidence_text string, confidence string"


def extraction_prompt(text: Column) -> Column:
    head = f"Extract entities and relations from the passage as one JSON object with the lists entities ({_ENTITY}) and relations ({_RELATION}). Entity types: {', '.join(ENTITY_TYPES)}. Relation types: {', '.join(RELATION_TYPES)}.\n\nPassage:\n"
    return F.concat(F.lit(head), text)


def _clean(c: str) -> Column:
    return T.squeeze(F.coalesce(F.col(c), F.lit("")))


def _parsed(answers: DataFrame, list_: str, fields: str) -> DataFrame:
    items = F.from_json(T.json_object(F.col("answer")), f"{list_} array<struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>>")[list_]
    return answers.select("chunk", F.posexplode(items).alias("pos", "x")).select("chunk", (F.col("pos") + 1).alias("pos"), "x.*")


def entities(answers: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Adds warning (null: valid) to the entities of answers (chunk, answer).

    A missing local id, and one that a valid entity before has in its chunk, becomes e and the
    entity's place. Years are the given ones and those in the texts.
    """
    rows = _parsed(answers, "entities", _ENTITY).withColumn("type", _clean("type")).withColumn("name", _clean("name"))
    kind = F.when(F.col("type") == "", "<empty>").otherwise(F.col("type"))
    rows = rows.withColumn("warning", F.when(~F.col("type").isin(types or ENTITY_TYPES), F.concat(F.lit("skipped entity with invalid type: "), kind)).when(F.col("name") == "", "skipped entity with empty name"))
    own = F.concat(F.lit("e"), F.col("pos").cast("string"))
    rows = rows.withColumn("local_id", F.when(_clean("local_id") == "", own).otherwise(_clean("local_id")))
    nth = F.row_number().over(Window.partitionBy("chunk", "local_id", F.col("warning").isNull()).orderBy("pos"))
    rows = rows.withColumn("local_id", F.when((nth > 1) & F.col("warning").isNull(), own).otherwise(F.col("local_id")))
    none = F.array().cast("array<string>")
    given = F.transform(F.coalesce("years", none), lambda y: y.try_cast("int"))
    years = F.filter(F.concat(given, T.years(F.concat_ws(" ", "name", "description", "evidence_text"))), lambda y: y.between(1000, 2099))
    aliases = F.filter(F.transform(F.coalesce("aliases", none), T.squeeze), lambda a: a != "")
    return rows.select(
        "chunk", "pos", "local_id", "type", "name", aliases.alias("aliases"), _clean("description").alias("description"), F.array_sort(F.array_distinct(years)).alias("years"),
        _clean("evidence_text").alias("evidence_text"), T.confidence(F.col("confidence")).alias("confidence"), "warning",
    )


def relations(answers: DataFrame, valid: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Adds warning (null: valid) to the relations of answers; both ends must be valid entities of the chunk."""
    rows = _parsed(answers, "relations", _RELATION)
    for c in ("type", "source", "target", "description", "evidence_text"):
        rows = rows.withColumn(c, _clean(c))
    ids = valid.where("warning IS NULL").select("chunk", "local_id").distinct()
    end = lambda c: ids.select("chunk", F.col("local_id").alias(c), F.lit(True).alias(f"{c}_known"))
    rows = rows.join(end("source"), ["chunk", "source"], "left").join(end("target"), ["chunk", "target"], "left")
    kind = F.when(F.col("type") == "", "<empty>").otherwise(F.col("type"))
    known = F.coalesce(F.col("source_known") & F.col("target_known"), F.lit(False))
    warning = F.when(~F.col("type").isin(types or RELATION_TYPES), F.concat(F.lit("skipped relation with invalid type: "), kind)).when(~known, F.concat(F.lit("skipped relation with unknown endpoint: "), "source", F.lit("->"), "target"))
    return rows.select("chunk", "pos", "source", "target", "type", "description", "evidence_text", T.confidence(F.col("confidence")).alias("confidence"), warning.alias("warning"))


def preview(c: Column, most: int = 500) -> Column:
    return F.left(T.squeeze(F.coalesce(c, F.lit(""))), F.lit(most))


def audit_rows(sample: DataFrame, entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sampled relations beside the names of their ends and the head of their passage; chunks: chunk, text."""
    end = lambda c: entities.select("chunk", F.col("local_id").alias(c), F.col("name").alias(f"{c}_name"), F.col("type").alias(f"{c}_type"))
    rows = sample.join(end("source"), ["chunk", "source"], "left").join(end("target"), ["chunk", "target"], "left").join(chunks.select("chunk", preview(F.col("text")).alias("passage")), "chunk", "left")
    return rows.select("chunk", "pos", "type", "source", "source_name", "source_type", "target", "target_name", "target_type", "description", "evidence_text", "confidence", "passage")
