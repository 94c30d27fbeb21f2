"""Alias matching: phrases in text by joins on word n-grams, then greedy spans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T


def ngrams(key: Column, most: int) -> Column:
    """Distinct word n-grams of a key, of 1 to most words."""

    def all_of(words: Column) -> Column:
        size = F.size(words)

        def of(n: int) -> Column:
            starts = F.when(size >= n, F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

        return F.array_distinct(F.concat(*[of(n) for n in range(1, most + 1)]))

    return T.let(F.filter(F.split(key, " "), lambda w: w != ""), all_of)  # split once, not for each n-gram


def longest_words(aliases: DataFrame, alias: str = "alias") -> int:
    """Words of the longest alias: n-grams of a text go no further."""
    return aliases.agg(F.max(F.size(F.split(alias, " "))).alias("n")).first()["n"] or 1


def _letters(c: str) -> Column:
    return F.length(F.replace(c, F.lit(" ")))


#: Aliases up to which a table of names is sent to every task; beyond, n-grams and names meet by a shuffle.
SENT_NAMES = 100_000


def _keyed(aliases: DataFrame, least: int, *keep: str) -> DataFrame:
    names = aliases.select(*keep, "entity", T.key(F.col("name")).alias("alias"), "weight").where(_letters("alias") >= least)
    return names.groupBy(*keep, "entity", "alias").agg(F.max("weight").alias("weight"))


def place(key: Column, alias: Column) -> Column:
    """First place of an alias in a key, both padded by a space at either end."""
    return F.instr(F.concat(F.lit(" "), key, F.lit(" ")), F.concat(F.lit(" "), alias, F.lit(" ")))


def candidates(texts: DataFrame, aliases: DataFrame, longest: int | None = None, least: int = 4) -> DataFrame:
    """(id, key, alias, entity, start, weight): aliases that stand in a text, at their first place.

    texts: id, text; aliases: entity, name, weight. An alias of an entity counts once, and
    only with `least` letters or numbers. Aliases of up to `longest` words are looked up, of
    any length if it is not given. start is a place in the key padded by a space at
    either end.
    """
    keyed = texts.select("id", T.key(F.col("text")).alias("key"))
    names = _keyed(aliases, least)
    found = keyed.select("id", "key", F.explode(ngrams(F.col("key"), longest or longest_words(names))).alias("alias")).join(names, "alias")
    return found.withColumn("start", place(F.col("key"), F.col("alias")))


def deciding(aliases: DataFrame, most: int = 10, once: str = "entity", least: int = 4, by: list[str] | None = None) -> DataFrame:
    """(by, entity, alias, weight): the names that can decide what greedy takes; the others of an alias never do.

    All entities of an alias stand at one place, so the first that is taken keeps the others out, and so does
    whatever overlaps it. One is passed over only if its entity was taken by another of its aliases, which
    fewer than `most` were: the first entity with no other alias, or the first `most`, decide.
    """
    by = by or []
    names = _keyed(aliases, least, *by)
    order = F.struct((-F.col("weight")).alias("m"), "entity", "weight")
    if once != "entity":
        return names.groupBy(*by, "alias").agg(F.min(order).alias("o")).select(*by, "o.entity", "alias", "o.weight")
    names = names.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, F.col("entity").cast("bigint"))))
    only = names.where("_n = 1").groupBy(*by, "alias").agg(F.min(order).alias("o")).select(*by, "o.entity", "alias", "o.weight")
    first = F.row_number().over(Window.partitionBy(*by, "alias").orderBy(-F.col("weight"), "entity"))
    rest = names.where("_n > 1").withColumn("_r", first).where(F.col("_r") <= most)
    return only.unionByName(rest.select(only.columns))


def sendable(known: DataFrame) -> tuple[DataFrame, int, bool]:
    """Known names, marked for sending to every task if they are few; the words of the longest; whether they are few."""
    size = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("alias", " "))).alias("words")).first()
    few = size["n"] <= SENT_NAMES
    return F.broadcast(known) if few else known, size["words"] or 1, few


def priority() -> Column:
    """Order in which candidates are tried: every number descends, the names ascend."""
    return F.struct((-F.size(F.split("alias", " "))).alias("w"), (-F.length("alias")).alias("n"), (-F.col("weight")).alias("m"), "alias", "entity", "start")


def folded(c: Column | str, most: int = 10, once: str = "entity") -> Column:
    """The accepted spans of a text's candidates (an array of priority()), as struct(alias, entity, start, stop)."""
    empty = F.array().cast("array<struct<alias:string,entity:bigint,start:int,stop:int>>")

    def step(done: Column, x: Column) -> Column:
        stop = x["start"] + F.length(x["alias"]) + 2
        one = F.struct(x["alias"].alias("alias"), x["entity"].cast("bigint").alias("entity"), x["start"].cast("int").alias("start"), stop.cast("int").alias("stop"))
        same = lambda d: (d["entity"] == x["entity"]) & (F.lit(once == "entity") | (d["alias"] == x["alias"]))
        taken = F.exists(done, lambda d: same(d) | ((d["start"] < stop) & (x["start"] < d["stop"])))
        return F.when(taken | (F.size(done) >= most), done).otherwise(F.concat(done, F.array(one)))

    return F.aggregate(F.array_sort(c), empty, step)


def greedy(found: DataFrame, most: int = 10, once: str = "entity") -> DataFrame:
    """(id, alias, entity, start): longest aliases first, no overlap of padded spans, at most `most` a text.

    once is entity for one match an entity, or alias for one match of each alias of an entity.

    Acceptance depends on what is accepted before, so a text's candidates are folded in
    order. They are at most its n-grams' aliases.
    """
    sets = found.groupBy("id").agg(F.collect_set(priority()).alias("c"))
    spans = sets.select("id", F.explode(folded("c", most, once)).alias("s"))
    return spans.select("id", "s.alias", "s.entity", "s.start")


def matched(texts: DataFrame, aliases: DataFrame, longest: int | None = None, most: int = 10, once: str = "entity", least: int = 4, by: list[str] | None = None) -> DataFrame:
    """greedy(candidates(texts, aliases)), without the entities of an alias that decide nothing.

    by: columns of both that must be equal, so that texts of different kinds have names of their own.
    """
    by = by or []
    known, words, _ = sendable(deciding(aliases, most, once, least, by))
    keyed = texts.select("id", *by, T.key(F.col("text")).alias("key"))
    grams = keyed.select("id", *by, "key", F.explode(ngrams(F.col("key"), longest or words)).alias("alias"))
    placed = grams.select("id", *by, "alias", place(F.col("key"), F.col("alias")).alias("start"))  # texts do not travel
    return greedy(placed.join(known, ["alias", *by]), most, once)


def within_longer(facets: DataFrame, aliases: DataFrame, least: int = 6) -> DataFrame:
    """(id, entity, alias): a facet of `least` letters or numbers that is a proper word phrase of a longer alias."""
    keyed = facets.select("id", T.key(F.col("text")).alias("key")).where(_letters("key") >= least)
    names = aliases.select("entity", T.key(F.col("name")).alias("alias")).distinct()
    parts = names.select("entity", "alias", F.explode(ngrams(F.col("alias"), longest_words(keyed, "key"))).alias("key")).where("key <> alias")
    return keyed.join(parts, "key").select("id", "entity", "alias").distinct()


def representatives(mentions: DataFrame) -> DataFrame:
    """One row a (type, key): the commonest surface name (then shortest, then by letters), mentions, mean confidence.

    mentions: type, name, confidence.
    """
    rows = mentions.withColumn("key", T.key(F.col("name")))
    names = rows.groupBy("type", "key", "name").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"))
    best = F.row_number().over(Window.partitionBy("type", "key").orderBy(F.desc("n"), F.length("name"), F.lower("name"), "name"))
    ranked = names.withColumn("r", best)
    return ranked.groupBy("type", "key").agg(
        F.max(F.when(F.col("r") == 1, F.col("name"))).alias("name"), F.sum("n").alias("n_mentions"), F.count(F.lit(1)).alias("n_names"), F.round(F.sum("c") / F.sum("n"), 4).alias("confidence")
    )


def alias_rows(names: DataFrame, least: int = 4) -> DataFrame:
    """(alias, entity, name, weight): of each alias key and entity the longest surface, the earliest of equals.

    names: ord, entity, name, weight; blank names and keys under `least` letters or numbers go.
    """
    rows = names.select("ord", F.trim("entity").alias("entity"), T.facet_value(F.col("name")).alias("name"), "weight").withColumn("alias", T.key(F.col("name")))
    rows = rows.where((F.col("name") != "") & (F.col("entity") != "") & (_letters("alias") >= least))
    return rows.groupBy("alias", "entity").agg(F.max_by(F.struct("name", "weight"), F.struct(F.length("name"), -F.col("ord"))).alias("b")).select("alias", "entity", "b.name", "b.weight")


def split_text(text: Column, most: int, overlap: int) -> Column:
    """Pieces of at most `most` characters, cut after the last sentence end beyond half, overlapping."""

    def pieces(t: str | None) -> list[str]:
        out, at = [], 0
        while t and at < len(t):
            end = min(len(t), at + most)
            if end < len(t):
                cut = max(t.rfind(s, at, end) for s in (". ", "? ", "! "))
                end = cut + 1 if cut > at + most // 2 else end
            if piece := t[at:end].strip():
                out.append(piece)
            if end >= len(t):
                break
            at = max(end - overlap, at + 1)
        return out

    @F.pandas_udf(ArrayType(StringType()))
    def udf(s: pd.Series) -> pd.Series:
        return s.map(pieces)

    return udf(text)
