"""Claims read by a model: the question, the checked answer, and what retrieval takes from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .extraction import ENTITY_TYPES, RELATION_TYPES

_MENTION = "array<struct<text:string, type_hint:string, role:string, importance:string>>"
_HINT = "array<struct<source:string, relation:string, target:string, evidence_text:string, confidence:string>>"
SCHEMA = f"time_expressions array<string>, entity_mentions {_MENTION}, event_mentions {_MENTION}, relation_hints {_HINT}, claim_focus array<string>, keywords array<string>"


def claim_prompt(claim: Column) -> Column:
    head = (
        "Read the claim and answer with one JSON object: time_expressions, entity_mentions and event_mentions (text, type_hint, role, importance), relation_hints (source, relation, "
        f"target, evidence_text, confidence), claim_focus, keywords. Types: {', '.join(ENTITY_TYPES)}. Relations: {', '.join(RELATION_TYPES)}.\n\nClaim:\n"
    )
    return F.concat(F.lit(head), claim)


def _text(c: Column) -> Column:
    return T.squeeze(F.coalesce(c, F.lit("")))


def _mentions(items: Column, most: int, default: str) -> Column:
    def clean(x: Column) -> Column:
        return F.struct(_text(x["text"]).alias("text"), _text(F.coalesce(x["type_hint"], F.lit(default))).alias("type_hint"), _text(x["role"]).alias("role"), T.confidence(x["importance"]).alias("importance"))

    kept = F.filter(F.transform(F.slice(items, 1, most), clean), lambda x: (x["text"] != "") & x["type_hint"].isin(ENTITY_TYPES))
    return F.coalesce(kept, F.array().cast("array<struct<text:string,type_hint:string,role:string,importance:double>>"))


def _hints(items: Column, most: int) -> Column:
    def clean(x: Column) -> Column:
        return F.struct(*[_text(x[c]).alias(c) for c in ("source", "relation", "target", "evidence_text")], T.confidence(x["confidence"]).alias("confidence"))

    kept = F.filter(F.transform(F.slice(items, 1, most), clean), lambda x: x["relation"].isin(RELATION_TYPES) & (x["source"] != "") & (x["target"] != ""))
    return F.coalesce(kept, F.array().cast("array<struct<source:string,relation:string,target:string,evidence_text:string,confidence:double>>"))


def parse(answer: Column, most_mentions: int = 20, most_relations: int = 12) -> Column:
    """A model's answer as a struct; lists are cut first, then blank texts and unknown types go.

    An answer that is null or no JSON object, as where no model is asked, is an empty parse.
    """
    read = F.from_json(F.coalesce(T.json_object(answer), F.lit("{}")), SCHEMA)
    return T.let(
        read,
        lambda a: F.struct(
            T.string_list(a["time_expressions"]).alias("time_expressions"), _mentions(a["entity_mentions"], most_mentions, "").alias("entity_mentions"),
            _mentions(a["event_mentions"], most_mentions, "Event").alias("event_mentions"), _hints(a["relation_hints"], most_relations).alias("relation_hints"),
            T.string_list(a["claim_focus"]).alias("claim_focus"), T.string_list(a["keywords"]).alias("keywords"),
        ),
    )


def parse_claims(claims: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Adds years and parse to claims (id, claim); answers: id, answer, or none where no model is asked."""
    rows = claims.withColumn("answer", F.lit(None).cast("string")) if answers is None else claims.join(answers.select("id", "answer"), "id", "left")
    return rows.withColumn("years", T.years(F.coalesce("claim", F.lit("")))).withColumn("parse", parse(F.col("answer"))).drop("answer")


def keywords(parsed: Column, matches: Column) -> Column:
    """A claim's phrases: keywords, events, entities, then names and aliases matched; the first of each key.

    matches: array of structs with name and alias.
    """
    named = F.flatten(F.transform(F.coalesce(matches, F.array().cast("array<struct<name:string,alias:string>>")), lambda m: F.array(m["name"], m["alias"])))
    texts = lambda c: F.transform(parsed[c], lambda m: m["text"])
    phrases = F.filter(F.transform(F.concat(parsed["keywords"], texts("event_mentions"), texts("entity_mentions"), named), lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != ""))
    keyed = F.filter(F.transform(phrases, lambda p: F.struct(T.key(p).alias("k"), p.alias("p"))), lambda x: x["k"] != "")
    none = F.array().cast("array<struct<k:string,p:string>>")
    once = F.aggregate(keyed, none, lambda done, x: F.when(F.exists(done, lambda d: d["k"] == x["k"]), done).otherwise(F.concat(done, F.array(x))))
    return F.transform(once, lambda x: x["p"])


def relation_types(parsed: Column) -> Column:
    return F.array_distinct(F.transform(parsed["relation_hints"], lambda h: h["relation"]))


def query_text(claim: Column, query: Column, words: Column, parsed: Column, matches: Column, years: Column) -> Column:
    """One text for retrieval: claim, query, keywords, hints, matches (name, alias, type) and years."""
    hints = F.flatten(F.transform(parsed["relation_hints"], lambda h: F.array(h["source"], h["relation"], h["target"], h["evidence_text"])))
    found = F.flatten(F.transform(matches, lambda m: F.array(m["name"], m["alias"], m["type"])))
    parts = F.concat(F.array(claim, query), words, hints, found, F.transform(years, lambda y: y.cast("string")))
    return T.squeeze(F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " "))
