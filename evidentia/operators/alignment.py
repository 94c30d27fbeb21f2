"""Extracted entities and relations: drop rules, salience caps, candidate groups, merges, alias tables.

Representatives are rows entity, type, name, key (match key), fold (folded key), mentions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import components
from .graph_scores import number

#: Salience of entity and relation types, and precedence of types in a merge.
ENTITY_PRIORITY = {"Event": 60, "Person": 55, "Organization": 55, "Place": 45, "Time": 45, "Concept": 20}
RELATION_PRIORITY = {"CAUSES": 60, "RESULTS_IN": 60, "PARTICIPATED_IN": 55, "OCCURRED_AT": 50, "BEFORE": 45, "AFTER": 45, "LOCATED_IN": 35, "RELATED_TO": 20}
#: Words that tell a state.
STATE_CUES = ["quốc gia", "tên nước", "quốc hiệu", "nước ", "chính phủ", "thực dân", "đế quốc", "liên bang", "dân chủ cộng hòa"]


def _priority(c: Column, table: dict[str, int]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in table.items() for x in p])[c], F.lit(0))


def entity_drop_reason(kind: Column, name: Column, sure: Column, generic: list[str], least: float = 0.8, longest: int = 80) -> Column:
    """Why an entity goes, or null: empty field, low confidence, long or generic concept."""
    clean = T.squeeze(F.coalesce(name, F.lit("")))
    return (
        F.when((F.coalesce(kind, F.lit("")) == "") | (clean == ""), "empty_required_field")
        .when(T.confidence(sure) < least, "low_confidence")
        .when((kind == "Concept") & (F.length(clean) > longest), "long_concept_name")
        .when((kind == "Concept") & F.coalesce(T.key(clean).isin(generic), F.lit(False)), "generic_concept")
    )


def relation_drop_reason(source: Column, target: Column, kind: Column, description: Column, sure: Column, least: float = 0.8) -> Column:
    """Why a relation goes, or null; source and target are resolved ends, null if unknown."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(source.isNull() | target.isNull(), "unknown_endpoint").when(source == target, "self_loop").when(T.confidence(sure) < least, "low_confidence").when(blank(kind) | blank(description), "empty_required_field")
    )


def cap(entities: DataFrame, relations: DataFrame, most_entities: int = 12, most_relations: int = 20) -> tuple[DataFrame, DataFrame]:
    """The most salient entities of each chunk, then the most salient relations between these.

    entities: chunk, entity, ord, type, name, confidence, n_years; relations: chunk, ord,
    source, target, type, confidence. Ties go to the earlier row.
    """
    ends = relations.select("chunk", F.explode(F.array("source", "target")).alias("entity")).groupBy("chunk", "entity").agg(F.count(F.lit(1)).alias("degree"))
    salience = T.confidence(F.col("confidence")) * 100 + _priority(F.col("type"), ENTITY_PRIORITY) + F.coalesce("degree", F.lit(0)) * 6 + F.col("n_years") * 4 - F.greatest(F.lit(0), F.length("name") - 60) * 0.2
    rows = entities.join(ends, ["chunk", "entity"], "left").withColumn("salience", F.round(salience, 6))
    by = lambda *order: F.row_number().over(Window.partitionBy("chunk").orderBy(*order))
    kept = rows.withColumn("r", by(F.desc("salience"), "ord")).where(F.col("r") <= most_entities).drop("r", "degree")
    side = lambda n: kept.select("chunk", F.col("entity").alias(n), F.col("type").alias(f"{n}_type"))
    near = relations.join(side("source"), ["chunk", "source"]).join(side("target"), ["chunk", "target"])
    worth = T.confidence(F.col("confidence")) * 100 + _priority(F.col("type"), RELATION_PRIORITY) + _priority(F.col("source_type"), ENTITY_PRIORITY) * 0.1 + _priority(F.col("target_type"), ENTITY_PRIORITY) * 0.1
    near = near.withColumn("salience", F.round(worth, 6)).withColumn("r", by(F.desc("salience"), "ord")).where(F.col("r") <= most_relations)
    return kept, near.select(*relations.columns, "salience")


def unique_mentions(mentions: DataFrame) -> DataFrame:
    """Adds mention ids chunk:local; a repeated local id takes :2, :3, ... by its place (ord)."""
    n = F.row_number().over(Window.partitionBy("chunk", "local").orderBy("ord"))
    return mentions.withColumn("n", n).withColumn("mention", F.concat_ws(":", "chunk", "local", F.when(F.col("n") > 1, F.col("n")))).drop("n")


def family(kind: Column) -> Column:
    """Types that may be one entity share a family: a type by itself, places and organizations together."""
    return F.when(kind.isin("Place", "Organization"), "Place|Organization").otherwise(kind)


def is_state(kind: Column, key: Column, samples: Column) -> Column:
    text = T.key(F.concat_ws(" ", key, samples))
    cue = F.exists(F.array(*map(F.lit, STATE_CUES)), lambda c: F.contains(text, c))
    return kind.isin("Place", "Organization") & (F.length(key) <= 35) & cue


def groups(reps: DataFrame, write: Callable[[DataFrame], DataFrame], seeds: list[list[str]] | None = None, threshold: float = 0.85, block: int = 25, size: int = 12, most: int | None = 300) -> DataFrame:
    """(group, kind, members, rank): candidate groups of one entity, best first, equal member lists once.

    Equal folded names of one family are a group by themselves, since the family relation
    is transitive; seed lists; names alike in a block of 2 to `block` that share one of
    their two longest tokens. Groups over `size` members are cut in order of
    (fold, type, entity). write cuts lineage, see components().
    """
    base = reps.select("entity", "type", "key", "fold", family(F.col("type")).alias("family"))
    fold = base.where("fold <> ''").select(F.lit("fold").alias("kind"), F.concat_ws("|", "fold", "family").alias("name"), "entity")
    rows = fold
    if seeds:
        listed = [(f"{i:03d}", s) for i, names in enumerate(seeds, 1) for s in names]
        keyed = reps.sparkSession.createDataFrame(listed, "name string, seed string").select("name", T.fold_key(F.col("seed")).alias("fold")).where("fold <> ''").distinct()
        rows = rows.unionByName(base.join(F.broadcast(keyed), "fold").select(F.lit("seed").alias("kind"), "name", "entity"))  # a list in the settings
    words = F.array_distinct(T.name_tokens(F.col("key")))
    two = F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 2)
    tok = base.select("entity", "fold", "family", F.explode(F.transform(two, lambda x: x["w"])).alias("t"))
    small = tok.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, block))
    tok = tok.join(small.select("t"), "t")
    a, b = tok.alias("a"), tok.alias("b")  # at most block^2 / 2 pairs a token
    pairs = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.family") == F.col("b.family")) & (F.col("a.entity") < F.col("b.entity")))
    alike = pairs.where(T.name_ratio(F.col("a.fold"), F.col("b.fold")) >= threshold)
    end = lambda s: F.struct(F.col("a.t").alias("t"), F.col(f"{s}.entity").alias("e"))
    joined = components(alike.select(end("a").alias("source"), end("b").alias("target")), write)
    rows = rows.unionByName(joined.select(F.lit("sim").alias("kind"), F.concat_ws("|", "node.t", F.col("label.e").cast("string")).alias("name"), F.col("node.e").alias("entity")))
    rows = rows.distinct().join(base.select("entity", "fold", "type"), "entity")
    place = F.row_number().over(Window.partitionBy("kind", "name").orderBy("fold", "type", "entity"))
    rows = rows.withColumn("part", F.floor((place - 1) / size))
    made = rows.groupBy("kind", "name", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("fold", "type", "entity"))), lambda x: x["entity"]).alias("members")).where(F.size("members") >= 2)
    urgency = F.when(F.col("kind") == "seed", 0).when(F.col("kind") == "fold", 1).otherwise(2)
    made = made.select(urgency.alias("u"), "kind", F.concat_ws("_", "kind", "name", F.col("part").cast("string")).alias("group"), "members")
    once = made.groupBy("members").agg(F.min(F.struct("u", "kind", "group")).alias("m")).select("m.*", "members").orderBy("u", F.desc(F.size("members")), "group")
    once = once if most is None else once.limit(most)
    return once.select("group", "kind", "members")


def state_windows(reps: DataFrame, write: Callable[[DataFrame], DataFrame], samples: str = "samples") -> DataFrame:
    """(entity, members): each state with at most two neighbours on either side in order of (fold, type, entity).

    Representatives with a cue of a state are numbered by range, then meet their neighbours' numbers.
    """
    rows = reps.where(is_state(F.col("type"), F.col("key"), F.col(samples))).select("entity", "type", "fold")
    rows = number(rows, ["fold", "type", "entity"], "no", "%d", write).select("entity", F.col("no").cast("long").alias("no"))
    near = rows.select("entity", F.explode(F.sequence(F.col("no") - 2, F.col("no") + 2)).alias("no")).join(rows.select("no", F.col("entity").alias("member")), "no")
    return near.groupBy("entity").agg(F.array_sort(F.collect_list("member")).alias("members")).where(F.size("members") >= 2)


def alignment_prompt(members: Column) -> Column:
    """The question which candidates are one entity; members: array of structs with entity, type, name, aliases, samples."""
    head = (
        "Decide which of these candidates name the same entity. Answer with one JSON object: aligned_entities (canonical_name, canonical_type, observed_types, aliases, "
        f"member_entity_ids, confidence, review_required, reason) and unmerged_entities (entity_id, reason). Types: {', '.join(ENTITY_PRIORITY)}. Merge only what is surely one.\n\nCandidates:\n"
    )
    return F.concat(F.lit(head), F.to_json(members))


_DECISION = (
    "aligned_entities array<struct<canonical_name:string, canonical_type:string, observed_types:array<string>, aliases:array<string>, member_entity_ids:array<string>, "
    "confidence:string, review_required:boolean, reason:string>>, unmerged_entities array<struct<entity_id:string, reason:string>>"
)


def decisions(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merges, unmerged) out of a model's answers on groups; answers: group, members, answer.

    A merge keeps its members of the group, sorted and once each, and needs two, a name and a known type.
    """
    known = lambda x: x.isin(list(ENTITY_PRIORITY))
    read = answers.select("group", "members", F.from_json(T.json_object(F.col("answer")), _DECISION).alias("a"))
    rows = read.select("group", "members", F.posexplode("a.aligned_entities").alias("pos", "x")).select("group", "pos", "members", "x.*")
    text = lambda c: T.squeeze(F.coalesce(F.col(c), F.lit("")))
    merges = rows.select(
        "group", "pos", F.array_sort(F.array_intersect("member_entity_ids", "members")).alias("members"), text("canonical_name").alias("canonical_name"), text("canonical_type").alias("canonical_type"),
        F.array_sort(F.filter(T.string_list(F.col("observed_types")), known)).alias("observed_types"), F.array_sort(T.string_list(F.col("aliases"))).alias("aliases"),
        T.confidence(F.col("confidence")).alias("confidence"), F.coalesce("review_required", F.lit(False)).alias("review_required"), text("reason").alias("reason"),
    ).where((F.size("members") >= 2) & (F.col("canonical_name") != "") & known(F.col("canonical_type")))
    left = read.select("group", "members", F.explode("a.unmerged_entities").alias("x")).where(F.expr("array_contains(members, x.entity_id)"))
    return merges, left.select("group", "x.entity_id", T.squeeze(F.coalesce("x.reason", F.lit(""))).alias("reason"))


def apply_merges(reps: DataFrame, merges: DataFrame, write: Callable[[DataFrame], DataFrame], least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(entities, map): reviewed merges applied; map is (entity, root), root the smallest entity of a class.

    merges: members, confidence, review_required, canonical_name, canonical_type; only sure
    ones count, and only their known members. The surest merge of a class names it, else
    the name and the type with most mentions do.
    """
    known = merges.where((F.col("confidence") >= least) & ~F.coalesce("review_required", F.lit(False))).withColumn("m", F.monotonically_increasing_id())
    known = write(known)  # its ids must not change
    each = known.select("m", F.posexplode("members").alias("p", "entity")).join(reps.select("entity"), "entity", "left_semi")
    first = each.groupBy("m").agg(F.min(F.struct("p", "entity")).alias("f"), F.count(F.lit(1)).alias("n")).where("n >= 2").select("m", F.col("f.entity").alias("target"))
    edges = each.join(first, "m").where("entity <> target").select(F.col("entity").alias("source"), "target")
    labels = components(edges, write)
    mapped = reps.select("entity").join(labels.select(F.col("node").alias("entity"), F.col("label").alias("root")), "entity", "left").withColumn("root", F.coalesce("root", "entity"))
    best = first.join(known, "m").join(mapped.withColumnRenamed("entity", "target"), "target").groupBy("root").agg(
        F.max_by(F.struct("canonical_name", "canonical_type", "confidence"), F.struct("confidence", -F.col("m"))).alias("b")
    )
    rows = reps.join(mapped, "entity")
    names = rows.groupBy("root", "name").agg(F.sum("mentions").alias("n")).groupBy("root").agg(F.min(F.struct((-F.col("n")).alias("n"), F.length("name").alias("l"), F.lower("name").alias("w"), "name")).alias("x"))
    kinds = rows.groupBy("root", "type").agg(F.sum("mentions").alias("n")).groupBy("root").agg(F.min(F.struct((-F.col("n")).alias("n"), (-_priority(F.col("type"), ENTITY_PRIORITY)).alias("p"), "type")).alias("y"))
    sizes = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n_entities"), F.sum("mentions").alias("n_mentions"))
    out = sizes.join(names, "root").join(kinds, "root").join(best, "root", "left")
    known_type = F.when(F.col("b.canonical_type").isin(list(ENTITY_PRIORITY)), F.col("b.canonical_type"))
    out = out.select(
        "root", F.coalesce(F.nullif("b.canonical_name", F.lit("")), "x.name").alias("name"), F.coalesce(known_type, "y.type").alias("type"), "n_entities", "n_mentions",
        F.coalesce("b.confidence", F.when(F.col("n_entities") == 1, 1.0).otherwise(0.9)).alias("confidence"),
    )
    return out, mapped


def alias_table(mentions: DataFrame, mapped: DataFrame, entities: DataFrame) -> DataFrame:
    """(alias_key, type, root, alias, name, n_mentions): names under which an entity was seen.

    mentions: mention, entity, name, type.
    """
    rows = mentions.join(mapped, "entity").withColumn("alias_key", T.key(F.col("name")))
    one = rows.groupBy("alias_key", "type", "root").agg(F.min_by("name", "mention").alias("alias"), F.count(F.lit(1)).alias("n_mentions"))
    return one.join(entities.select("root", F.col("name")), "root").select("alias_key", "type", "root", "alias", "name", "n_mentions")
