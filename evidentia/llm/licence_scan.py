"""Licence scan by a positional rare-token index, in DataFrame operations only.

The templates' words make an index: word to templates and offsets (postings). Document
frequencies of the licence vocabulary are counted over all files. A file is looked up by
its licence words of highest IDF: their positions less the postings' offsets are candidate
starts, the other postings are intersected at their relative positions by their IDF share,
and a template counts only where its mandatory key phrase stands whole. score is the
greatest share.

Defined cases: null text has no words (0, 0, null, null, '', '', 0.0). Repeated rows
give repeated results. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, table

#: What parts words; splitting costs a tenth of extracting all words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base: label and phrase.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Labels of the method: label, mandatory key phrase, words that may follow it (weighed by IDF).
OWN = [
    ("gpl-3", "gnu general public license version 3", ""),
    ("gpl-2", "gnu general public license version 2", ""),
    ("gpl", "terms of the gnu general public license", "as published by the free software foundation either version"),
    ("lgpl", "gnu lesser general public license", ""),
    ("agpl-3", "gnu affero general public license", "version 3"),
    ("bsd", "redistribution and use in source and binary forms", "with or without modification are permitted provided that the following conditions are met"),
    (
        "mit",
        "permission is hereby granted free of charge",
        "to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge",
    ),
    ("apache-2", "licensed under the apache license version 2 0", "the license you may not use this file except in compliance with the license"),
    ("isc", "permission to use copy modify and or distribute this software", "for any purpose with or without fee is hereby granted"),
    ("mpl-2", "mozilla public license version 2", ""),
    ("unlicense", "released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by-sa", "cc by sa", ""),
    ("cc-by-nc", "creative commons attribution noncommercial", "international license"),
]
#: Share of a template's IDF weight that must stand at its relative positions; licence words of highest IDF looked up in a file.
LEAST, RARE = 0.6, 4


def _templates() -> list[dict]:
    out = [{"label": lab, "key": p.split(), "rest": [], "base": True} for lab, p in BASE]
    return out + [{"label": lab, "key": k.split(), "rest": r.split(), "base": False} for lab, k, r in OWN]


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _strings(words: list[str]) -> Column:
    return _array(words).cast("array<string>")


def _hits(templates: list[dict], idf: dict[str, float]) -> Column:
    """The templates that stand in the column words, as array of structs t (template), s (start word), share (of IDF).

    The file's licence words of highest IDF, and the rarest key word of each template among them, are looked up in the
    postings (word to templates and offsets); positions less offsets are starts, which the key phrase and the IDF share
    of all words at their relative positions then decide.
    """
    posts: dict[str, list[tuple[int, int]]] = {}
    anchors = set()
    for t, x in enumerate(templates):
        anchors.add(max(x["key"], key=lambda w: (idf[w], w)))
        for o, w in enumerate(x["key"] + x["rest"]):
            posts.setdefault(w, []).append((t, o))
    entry = lambda t, o: F.struct(F.lit(t).alias("t"), F.lit(o).alias("o"))
    postings = F.create_map(*[c for w, p in posts.items() for c in (F.lit(w), F.array(*[entry(t, o) for t, o in p]))])
    rank = F.create_map(*[c for w in posts for c in (F.lit(w), F.lit(idf[w]))])
    keys = F.array(*[_strings(x["key"]) for x in templates])
    bodies = F.array(*[_strings(x["key"] + x["rest"]) for x in templates])
    weights = F.array(*[F.array(*[F.lit(idf[w] / sum(idf[v] for v in x["key"] + x["rest"])) for w in x["key"] + x["rest"]]) for x in templates])

    by_idf = F.transform(F.array_sort(F.transform("present", lambda w: F.struct((-rank[w]).alias("i"), w.alias("w")))), lambda x: x["w"])
    looked = F.array_union(F.slice(by_idf, 1, RARE), F.array_intersect("present", _strings(sorted(anchors))))
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(looked, x["w"]))
    starts = F.flatten(F.transform(places, lambda x: F.transform(postings[x["w"]], lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["o"]).alias("s")))))

    def share(c: Column) -> Column:
        at = F.transform(bodies[c["t"]], lambda w, i: F.when(F.get(F.col("words"), c["s"] + i) == w, weights[c["t"]][i]).otherwise(0.0))
        return F.round(F.aggregate(at, F.lit(0.0), lambda a, b: a + b), 6)

    inside = F.filter(F.array_distinct(starts), lambda c: (c["s"] >= 0) & (c["s"] + F.size(keys[c["t"]]) <= F.size("words")))
    whole = F.filter(inside, lambda c: F.slice(F.col("words"), c["s"] + 1, F.size(keys[c["t"]])) == keys[c["t"]])
    scored = F.transform(whole, lambda c: F.struct(c["t"].alias("t"), c["s"].alias("s"), share(c).alias("share")))
    return F.filter(scored, lambda c: c["share"] >= LEAST)


def licence_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    templates = _templates()
    vocab = sorted({w for t in templates for w in t["key"] + t["rest"]})
    seen = docs.select("doc_id", F.array_remove(F.split(ascii_lower(F.coalesce("text", F.lit(""))), BETWEEN), "").alias("words"))
    seen = seen.withColumn("present", F.array_intersect("words", _array(vocab)))
    whole = None
    for key in {tuple(t["key"]) for t in templates}:
        c = None
        for w in sorted(set(key), key=lambda w: (-len(w), w)):  # long words are rare, so most files are told by the first
            c = F.array_contains("present", w) if c is None else c & F.array_contains("present", w)
        whole = c if whole is None else whole | c
    # the words of a file travel on only where some key phrase's words are all there
    seen = materialise(
        seen.select("doc_id", F.size("words").cast("long").alias("n_words"), "present", F.when(whole, F.col("words")).alias("words")), "licence"
    )

    n = seen.count()
    df = {r["w"]: r["n"] for r in seen.select(F.explode("present").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a word of vocab
    idf = {w: math.log(1 + (n + 1) / (df.get(w, 0) + 1)) for w in vocab}

    none = F.array().cast("array<struct<t:int,s:int,share:double>>")
    out = seen.select("doc_id", "n_words", F.when(F.col("words").isNotNull(), _hits(templates, idf)).otherwise(none).alias("hits"))
    base = F.filter("hits", lambda c: c["t"] < len(BASE))
    names = _strings([t["label"] for t in templates])
    places = F.transform(base, lambda c: c["s"].cast("bigint"))

    def labels(found: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda c: names[c["t"]]))), ",")

    return out.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("hits")).alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("hits", lambda c: c["share"])), F.lit(0.0))).alias("score"),
    )


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))
