"""Reports of each stage as small aggregates in long form (section, item, n), rendered last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = ("section", "item", "n")


def counts(df: DataFrame, section: str, item: Column | str) -> DataFrame:
    """One row an item, most frequent first when sorted; null items are 'none'."""
    c = F.col(item) if isinstance(item, str) else item
    return df.groupBy(F.coalesce(c.cast("string"), F.lit("none")).alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "item", "n")


def total(df: DataFrame, section: str, **values: Column) -> DataFrame:
    """One row a named aggregate of the whole table."""
    one = df.agg(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in values.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).alias("n")) for n in values])
    return one.select(F.explode(pairs).alias("x")).select(F.lit(section).alias("section"), "x.item", "x.n")


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select("section", "item", F.round(F.col("n").cast("double"), 6).alias("n")) for p in parts])


def corpus(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    return together(counts(pages, "pages", "reason"), counts(chunks, "chunks", "kind"), total(chunks, "chunk_size", characters=F.sum(F.length("text")), mean=F.avg(F.length("text"))))


def cleanup(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """entities, relations: type, reason (null: kept)."""
    return together(counts(entities, "entities", "reason"), counts(relations, "relations", "reason"), counts(entities.where("reason IS NULL"), "entity_types", "type"), counts(relations.where("reason IS NULL"), "relation_types", "type"))


def alignment(reps: DataFrame, entities: DataFrame) -> DataFrame:
    return together(counts(reps, "representatives", "type"), counts(entities, "entities", "type"), total(entities, "merges", merged=F.count_if(F.col("n_entities") > 1), mentions=F.sum("n_mentions")))


def graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return together(counts(nodes, "nodes", "type"), counts(edges, "edges", "type"))


def temporal(items: DataFrame) -> DataFrame:
    """items: kind, id, year."""
    per = items.groupBy("kind", "id").agg(F.countDistinct("year").alias("n_years"))
    span = total(items, "years", first=F.min("year"), last=F.max("year"), distinct=F.countDistinct("year"))
    return together(counts(per, "items", "kind"), counts(per, "years_an_item", "n_years"), span)


def fusion(evidence: DataFrame) -> DataFrame:
    return together(counts(evidence, "branches", "branch"), total(evidence, "claims", claims=F.countDistinct("query"), evidence=F.count(F.lit(1))))


def retrieval(facts: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates: reason, n."""
    reasons = candidates.groupBy("reason").agg(F.sum("n").alias("n")).select(F.lit("candidate_reasons").alias("section"), F.col("reason").alias("item"), F.col("n").cast("double").alias("n"))
    return together(reasons, total(facts, "facts", claims=F.countDistinct("id"), facts=F.count(F.lit(1)), mean_score=F.avg("score")))


def facet_eda(facets: DataFrame, matches: DataFrame, evidence: DataFrame, top: int = 20) -> DataFrame:
    """Values and matched share a facet type, evidence a claim, chunks used most."""
    hit = matches.select("id", "facet", "value").distinct().withColumn("hit", F.lit(1))
    rate = facets.join(hit, ["id", "facet", "value"], "left").groupBy("facet").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("n"))
    claims = facets.groupBy("facet").agg(F.countDistinct("id").alias("n"))
    named = lambda df, section: df.select(F.lit(section).alias("section"), F.col("facet").alias("item"), "n")
    per = evidence.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.max("candidates").alias("c"))
    used = counts(evidence, "top_chunks", "chunk").orderBy(F.desc("n"), "item").limit(top)
    return together(counts(facets, "values", "facet"), named(claims, "claims"), named(rate, "match_rate"), total(per, "evidence", candidates=F.avg("c"), kept=F.avg("k")), used)


def verdicts(rows: DataFrame) -> DataFrame:
    """rows: truth, label (real, fake, unknown, error), wrong_facets, n_evidence. Rates leave out unknown labels and errors."""
    valid = F.col("label").isin("real", "fake")
    right = valid & (F.col("label") == F.col("truth"))
    n = lambda t, p: F.count_if((F.col("truth") == t) & (F.col("label") == p))
    div = lambda a, b: F.try_divide(a, b)
    f1 = {c: div(2 * n(c, c), 2 * n(c, c) + n(c, o) + n(o, c)) for c, o in (("real", "fake"), ("fake", "real"))}
    share = {c: F.count_if(valid & (F.col("truth") == c)) for c in f1}
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rates = total(
        rows, "rates", rows=F.count(F.lit(1)), valid=F.count_if(valid), coverage=div(F.count_if(valid), F.count(F.lit(1))), accuracy=div(F.count_if(right), F.count_if(valid)),
        precision_real=div(n("real", "real"), n("real", "real") + n("fake", "real")), recall_real=div(n("real", "real"), n("real", "real") + n("real", "fake")), f1_real=f1["real"],
        precision_fake=div(n("fake", "fake"), n("fake", "fake") + n("real", "fake")), recall_fake=div(n("fake", "fake"), n("fake", "fake") + n("fake", "real")), f1_fake=f1["fake"],
        macro_f1=(zero(f1["real"]) + zero(f1["fake"])) / 2, weighted_f1=div(zero(f1["real"]) * share["real"] + zero(f1["fake"]) * share["fake"], share["real"] + share["fake"]),
        no_evidence=F.count_if(F.coalesce("n_evidence", F.lit(0)) == 0),
    )
    wrong = rows.where(valid & ~right).select(F.explode("wrong_facets").alias("f"))
    return together(rates, counts(rows, "labels", "label"), counts(rows, "truth", "truth"), counts(wrong, "wrong_facets", "f"))
