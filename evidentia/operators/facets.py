"""Facets of claims: rules, matches with graph nodes, evidence under a budget, scores, routing.

Facets are kept in long form, one row a value: id, facet, value, pos.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import aliases as A
from .retrieval import top

#: The facet types, in order, and the facet of a node type.
FACETS = ["person", "organization", "event", "place", "time", "concept", "quantity", "action", "result"]
FACET_OF_TYPE = {"Person": "person", "Organization": "organization", "Event": "event", "Place": "place", "Time": "time", "Concept": "concept"}
#: Facets never looked up as names, and those whose absence turns the graph on.
NOT_NAMES = ["quantity", "action", "result"]
KEY_FACETS = ["time", "place", "result"]


def _distinct(rows: DataFrame, most: int) -> DataFrame:
    """(id, facet, value, pos): cleaned values, the first of each key, at most `most` a facet."""
    rows = rows.withColumn("value", T.facet_value(F.col("value"))).withColumn("k", T.key(F.col("value"))).where("value <> ''")
    one = rows.groupBy("id", "facet", "k").agg(F.min(F.struct("pos", "value")).alias("m")).select("id", "facet", "m.value", F.col("m.pos").alias("at"))
    w = Window.partitionBy("id", "facet").orderBy("at", "value")
    return one.withColumn("pos", F.row_number().over(w).cast("int")).where(F.col("pos") <= most).drop("at")


def rule_facets(texts: DataFrame, names: DataFrame, longest: int = 8, most_aliases: int = 40, most: int = 8) -> DataFrame:
    """Facets of texts (id, text) without a model: alias matches by node type, years, quantities.

    names: entity, name, weight, type. Texts are read once: a text's n-grams, years and
    quantities become rows together, and stay together by id from there on.
    """
    deciding = A.deciding(names.select("entity", "name", "weight"), most_aliases)
    known, _, few = A.sendable(deciding)
    row = lambda facet, pos, value, start: F.struct(facet.cast("string").alias("facet"), pos.cast("int").alias("pos"), value.cast("string").alias("value"), start.cast("int").alias("start"))
    none, key = F.lit(None), F.col("key")
    grams = F.transform(A.ngrams(key, longest), lambda w: row(none, none, w, A.place(key, w)))
    listed = lambda name, values: F.transform(values, lambda v, i: row(F.lit(name), i, v, none))
    # a text without years, quantities or a key has null for an array, which must not blank the others
    every = F.flatten(F.array_compact(F.array(grams, listed("time", F.array_sort("years")), listed("quantity", F.col("quantities")))))
    read = texts.select("id", T.key(F.col("text")).alias("key"), T.years(F.col("text")).alias("years"), T.quantities(F.col("text")).alias("quantities"))
    rows = read.select("id", F.explode(every).alias("x")).select("id", "x.*").withColumn("alias", F.when(F.col("facet").isNull(), F.col("value")))
    rows = rows.join(known.withColumn("known", F.lit(True)), "alias", "left").where("facet IS NOT NULL OR known")
    one = rows.groupBy("id").agg(F.collect_set(F.when(F.col("known"), A.priority())).alias("c"), F.collect_list(F.when(F.col("facet").isNotNull(), F.struct("facet", "value", "pos", F.lit(None).cast("bigint").alias("entity")))).alias("listed"))
    spans = F.transform(A.folded("c", most_aliases), lambda s: F.struct(F.lit(None).cast("string").alias("facet"), s["alias"].alias("value"), (s["start"] - 1_000_000).alias("pos"), s["entity"].alias("entity")))
    found = one.select("id", F.explode(F.concat(spans, "listed")).alias("x")).select("id", "x.*")
    kinds = names.select(F.col("entity").cast("bigint").alias("entity"), "type").distinct().where(F.col("type").isin(list(FACET_OF_TYPE)))
    kinds = kinds.join(deciding.select(F.col("entity").cast("bigint").alias("entity")).distinct(), "entity", "left_semi")
    kind = F.create_map(*[F.lit(x) for p in FACET_OF_TYPE.items() for x in p])[F.col("type")]
    found = found.join(F.broadcast(kinds) if few else kinds, "entity", "left").withColumn("facet", F.coalesce("facet", kind)).where("facet IS NOT NULL")
    return _distinct(found.select("id", "facet", "value", "pos"), most)


def coerce_facets(answers: DataFrame, rules: DataFrame, most: int = 8) -> DataFrame:
    """A model's facets (id, facets map<string, array<string>>) over rules: a facet that the model names,
    even with an empty list, is the model's; all others are the rules'."""
    given = answers.select("id", F.explode("facets").alias("facet", "values")).where(F.col("facet").isin(FACETS))
    said = given.select("id", "facet", F.posexplode(F.coalesce("values", F.array().cast("array<string>"))).alias("pos", "value"))
    rest = rules.join(given.select("id", "facet"), ["id", "facet"], "left_anti").select("id", "facet", "pos", "value")
    return _distinct(said.unionByName(rest), most)


def match(facets: DataFrame, names: DataFrame, node_years: DataFrame, types: Mapping[str, list[str]] | None = None, most: int = 5, substring: bool = True) -> DataFrame:
    """(id, facet, value, ord, node, method): nodes of facet values, at most `most` a value.

    Time values meet nodes of their years first, then names; names within longer aliases
    count only where nothing else was found. Each distinct value is looked up once.

    names: entity, name, weight, type; node_years: year, entity; types: node types allowed for a facet.
    """
    values = facets.select("facet", "value").distinct()
    dated = values.where("facet = 'time'").select("facet", "value", F.explode(T.years(F.col("value"))).alias("year"))
    near = top(node_years.distinct(), "year", "entity", k=most, name="r")
    by_year = dated.join(near, "year").select("facet", "value", F.lit(0).alias("stage"), (F.col("year") * 100 + F.col("r")).cast("long").alias("at"), F.col("entity").cast("long").alias("node"), F.lit("year_index").alias("method"))
    asked = values.where(~F.col("facet").isin(NOT_NAMES)).select(F.struct("facet", "value").alias("id"), F.col("value").alias("text"))
    kinds = names.select("entity", "type").distinct()
    limits = {f: list(t) for f, t in (types or {}).items() if t}

    def allowed(found: DataFrame) -> DataFrame:
        if not types:
            return found
        rows = [F.when(F.col("id.facet") == f, F.col("type").isin(t)) for f, t in limits.items()]
        return found.join(kinds, "entity").where(F.coalesce(*rows, F.lit(True))).drop("type")

    # names of the types of each facet that is limited, and all names for the others
    told = names.select("entity", "name", "weight", "type")
    told = told if not types else told.drop("type").join(kinds, "entity")
    sets = F.array(F.lit(""), *[F.when(F.coalesce(F.col("type").isin(t), F.lit(True)), F.lit(f"={f}")) for f, t in limits.items()])
    told = told.select(F.explode(F.array_compact(sets)).alias("kind"), "entity", "name", "weight")
    own = F.when(F.col("id.facet").isin(list(limits)), F.concat(F.lit("="), "id.facet")).otherwise("")
    spans = A.matched(asked.withColumn("kind", own), told, most=most, by=["kind"])
    # longer aliases are taken before shorter ones, as they were accepted
    size = (1000 - F.least(F.size(F.split("alias", " ")), F.lit(999))) * 10000 - F.least(F.length("alias"), F.lit(9999))
    whole = spans.select("id.facet", "id.value", F.lit(1).alias("stage"), size.cast("long").alias("at"), F.col("entity").alias("node"), F.lit("alias").alias("method"))
    found = by_year.unionByName(whole)
    if substring:
        rest = asked.join(found.select(F.struct("facet", "value").alias("id")).distinct(), "id", "left_anti")
        parts = allowed(A.within_longer(rest, names.select("entity", "name")))
        found = found.unionByName(parts.select("id.facet", "id.value", F.lit(2).alias("stage"), F.length("alias").cast("long").alias("at"), F.col("entity").cast("long").alias("node"), F.lit("substring").alias("method")))
    one = found.groupBy("facet", "value", "node", "method").agg(F.min(F.struct("stage", "at")).alias("m"))
    w = Window.partitionBy("facet", "value").orderBy("m", "node")
    chosen = one.withColumn("ord", F.row_number().over(w).cast("int")).where(F.col("ord") <= most).select("facet", "value", "ord", "node", "method")
    return facets.select("id", "facet", "value").join(chosen, ["facet", "value"]).select("id", "facet", "value", "ord", "node", "method")


def match_summary(facets: DataFrame, matches: DataFrame) -> DataFrame:
    """(id, total_facets, matched_facets, match_rate): values counted as they come, matched ones by distinct key."""
    hit = matches.select("id", "facet", "value").distinct().withColumn("hit", F.lit(True))
    rows = facets.select("id", "facet", "value").join(hit, ["id", "facet", "value"], "left")
    out = rows.withColumn("value_key", T.key(F.col("value"))).groupBy("id").agg(F.count(F.lit(1)).alias("total_facets"), F.countDistinct(F.when(F.col("hit"), F.struct("facet", "value_key"))).alias("matched_facets"))
    return out.withColumn("match_rate", F.round(F.col("matched_facets") / F.col("total_facets"), 6))


def node_hits(node_chunks: DataFrame, edges: DataFrame, relations: list[str] | None = None, cap: int = 5) -> DataFrame:
    """(node, kind, pos, chunk, edge): what a facet may use of a node, in visiting order.

    The first cap chunks (kind 0), the first cap edges that have a chunk, and the very
    first edge (kind 1), outgoing edges before incoming ones. Cutting each node here
    keeps a hub's chunks and edges out of the join with matches.

    node_chunks: node, chunk; edges: edge, source, target, type, chunk, in the order of edge.
    """
    chunks = top(node_chunks.distinct(), "node", "chunk", k=cap, name="pos").select("node", F.lit(0).alias("kind"), "pos", "chunk", F.lit(None).cast(edges.schema["edge"].dataType).alias("edge"))
    kept = edges if relations is None else edges.where(F.col("type").isin(relations))
    kept = kept.withColumn("chunk", F.nullif(F.col("chunk").cast("string"), F.lit("")).cast(edges.schema["chunk"].dataType))
    inc = kept.select(F.col("source").alias("node"), F.lit(0).alias("way"), "edge", "chunk").unionByName(kept.select(F.col("target").alias("node"), F.lit(1).alias("way"), "edge", "chunk"))
    first = top(inc, "node", "way", "edge", k=1, name="pos").where("chunk IS NULL")  # only tells that no extra edge follows
    used = top(inc.where("chunk IS NOT NULL"), "node", "way", "edge", k=cap, name="r")
    lead = used.join(first.select("node", F.lit(True).alias("late")), "node", "left")
    pos = F.col("r") + F.when(F.col("late"), 1).otherwise(0)  # edge 1 is the node's very first one
    return chunks.unionByName(lead.select("node", F.lit(1).alias("kind"), pos.cast("long").alias("pos"), "chunk", "edge"))


def evidence_hits(matches: DataFrame, hits: DataFrame, year_chunks: DataFrame, cap: int = 5, strict: bool = False) -> DataFrame:
    """(id, facet, value, chunk, reason, node, edge): hits of facets under their budgets.

    A facet's hits are numbered over its matches, chunks before edges, and the first cap
    count, repeats too. Where a chunk is the last of these, the node's first edge is
    added still, if it has a chunk (not in strict mode). Chunks of a time facet's years,
    cap a year, come on top.
    """
    per = ["id", "facet", "value"]
    rows = matches.select(*per, "ord", "node").join(hits, "node")
    rows = rows.withColumn("no", F.row_number().over(Window.partitionBy(*per).orderBy("ord", "kind", "pos", "edge")))
    if not strict:
        rows = rows.withColumn("last", F.max(F.when((F.col("no") == cap) & (F.col("kind") == 0), F.col("ord"))).over(Window.partitionBy(*per)))
        extra = (F.col("kind") == 1) & (F.col("pos") == 1) & (F.col("ord") == F.col("last"))
        rows = rows.where((F.col("no") <= cap) | F.coalesce(extra, F.lit(False)))
    else:
        rows = rows.where(F.col("no") <= cap)
    reason = F.when(F.col("kind") == 0, "node_mention").otherwise("relation_1hop")
    found = rows.select(*per, "chunk", reason.alias("reason"), "node", "edge")
    years = matches.where("facet = 'time'").select(*per).distinct()
    dated = _dated(years, year_chunks, cap)
    return found.unionByName(dated, allowMissingColumns=True)


def _dated(facets: DataFrame, year_chunks: DataFrame, cap: int) -> DataFrame:
    near = top(year_chunks.distinct(), "year", "chunk", k=cap, name="r")
    asked = facets.select("id", "facet", "value", F.explode(T.years(F.col("value"))).alias("year"))
    return asked.join(near, "year").select("id", "facet", "value", "chunk", F.lit("temporal_index").alias("reason"))


def evidence(hits: DataFrame, chunks: DataFrame | None = None, most: int = 12) -> DataFrame:
    """(id, chunk, n_facets, n_relations, candidates, rank): chunks of a claim by facets, then relations.

    Hits on chunks that are not in chunks (chunk) are left out.
    """
    if chunks is not None:
        hits = hits.join(chunks.select("chunk"), "chunk", "left_semi")
    one = hits.withColumn("value_key", T.key(F.col("value"))).groupBy("id", "chunk").agg(F.countDistinct("facet", "value_key").alias("n_facets"), F.countDistinct("edge").alias("n_relations"))
    one = one.withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy("id")))
    return top(one, "id", F.desc("n_facets"), F.desc("n_relations"), "chunk", k=most)


def hub_counts(evidence: DataFrame) -> DataFrame:
    """(chunk, hub_freq): claims whose evidence holds the chunk."""
    return evidence.groupBy("chunk").agg(F.countDistinct("id").alias("hub_freq"))


def score(n_facets: Column, total: Column, n_relations: Column, claim: Column, text: Column, years: Column, hub_freq: Column | None = None,
          weights: tuple[float, float, float, float] = (0.45, 0.25, 0.20, 0.10), hub_weight: float = 0.15) -> Column:
    """Share of facets, relations, claim years met and claim words met, over the hub penalty."""
    wanted = T.years(claim)
    met = F.size(F.array_intersect(wanted, F.array_union(F.coalesce(years, F.array().cast("array<int>")), T.years(text))))
    long = lambda c: F.filter(T.tokens(c), lambda w: F.length(w) >= 3)
    parts = (
        n_facets / F.greatest(F.lit(1), F.coalesce(total, F.lit(0))),
        F.least(F.lit(1.0), F.log1p(n_relations) / F.log(F.lit(4.0))),
        F.when(F.size(wanted) > 0, met / F.size(wanted)).otherwise(0.0),
        T.overlap(F.array_distinct(long(claim)), long(text)),
    )
    total_score = sum((w * p for w, p in zip(weights, parts, strict=True)), F.lit(0.0))
    return total_score if hub_freq is None else total_score / (1 + hub_weight * F.log1p(F.coalesce(hub_freq, F.lit(0))))


def rerank(found: DataFrame, claims: DataFrame, chunks: DataFrame, most: int = 8, hub_weight: float = 0.15, crop: int = 1400) -> DataFrame:
    """(id, chunk, final, rank, text): best evidence of each claim.

    found: id, chunk, n_facets, n_relations; claims: id, claim, total_facets; chunks: chunk, text, years.
    """
    rows = found.join(claims.select("id", "claim", "total_facets"), "id").join(chunks.select("chunk", "text", "years"), "chunk").join(hub_counts(found), "chunk")
    args = [F.col(c) for c in ("n_facets", "total_facets", "n_relations", "claim", "text", "years")]
    rows = rows.withColumn("final", F.round(score(*args, F.col("hub_freq") if hub_weight > 0 else None, hub_weight=hub_weight), 6))
    return top(rows, "id", F.desc("final"), "chunk", k=most).select("id", "chunk", "final", "hub_freq", "rank", F.left("text", F.lit(crop)).alias("text"))


def router(facets: DataFrame, texts: DataFrame, matches: DataFrame, ranked: DataFrame, graph: DataFrame) -> DataFrame:
    """One row a claim: facet coverage by its text evidence, key facets missing, agreement of two rankings, route.

    facets: id, facet, value; texts: id, text (its text evidence, one row); ranked: id, doc,
    r1, r2 (ranks, null if not ranked); graph: id of claims with graph evidence.
    """
    words = texts.select("id", F.array_distinct(T.content_tokens(F.col("text"))).alias("w"))
    v = F.array_distinct(T.content_tokens(F.col("value")))
    rows = facets.join(words, "id", "left").withColumn("met", F.coalesce((F.size(v) > 0) & (F.size(F.array_except(v, "w")) == 0), F.lit(False)))
    cover = rows.groupBy("id").agg(F.round(F.avg(F.col("met").cast("int")), 3).alias("c"), F.bool_or(~F.col("met") & F.col("facet").isin(KEY_FACETS)).alias("m"))
    agree = ranked.groupBy("id").agg(F.round(F.count_if((F.col("r1") <= 5) & (F.col("r2") <= 5)) / 5.0, 2).alias("a"))
    seeds = matches.select("id", "facet", "value").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    out = texts.select("id").join(cover, "id", "left").join(agree, "id", "left").join(seeds, "id", "left").join(graph.select("id", F.lit(True).alias("g")).distinct(), "id", "left")
    out = out.select(
        "id", F.coalesce("c", F.lit(1.0)).alias("facet_coverage"), F.coalesce("m", F.lit(False)).alias("missing_key_facet"), F.coalesce("a", F.lit(1.0)).alias("rank_agreement"),
        F.coalesce(F.col("n") >= 2, F.lit(False)).alias("graph_seedable"), F.coalesce("g", F.lit(False)).alias("has_graph_evidence"),
    )
    return out.withColumn("route", F.expr("has_graph_evidence AND (missing_key_facet OR facet_coverage < 0.8 OR (rank_agreement < 0.4 AND graph_seedable))"))
