"""The pipeline's stages one by one against brute force, and what it refuses."""

from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline
from evidentia.llm import decontamination, toxicity

from .test_operators import LOWER, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    rows, labels = [], []
    base, item = prose(r, 150), prose(r, 40)
    for i in range(240):
        bad = i % 5 == 0
        w = prose(r, 120).split()
        for _ in range(4 * bad):
            w[r.randrange(120)] = r.choice(["grumbleskank", "monstrode", "zoltrickish"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    for i in range(240, 246):
        w = base.split()
        w[i - 240] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(246, rows[1][1]), (247, rows[1][1] + "\n"), (248, prose(r, 60) + " " + item), (249, None), (250, "")]
    at = tmp_path_factory.mktemp("sf")
    docs = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lexicon = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        rows = docs.collect()
        if name == "toxicity":
            kept = {i: t for i, t in kept.items() if lexicon.score(t) < 0.5}
            assert not {i for i in kept if i < 240 and i % 5 == 0 and i % 3} & {r.doc_id for r in rows} or len(kept) < 215
        elif name == "exact dedup":
            first = {}
            for i in sorted(kept):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i] or ""), i)
            kept = {i: kept[i] for i in first.values()}
        elif name == "near dedup":
            parent = {i: i for i in kept}
            sets = {i: shingles(t) for i, t in kept.items()}
            top = lambda x: x if parent[x] == x else top(parent[x])
            for a in kept:
                for b in kept:
                    if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        p, q = top(a), top(b)
                        parent[max(p, q)] = min(p, q)
            kept = {i: t for i, t in kept.items() if top(i) == i}
            assert 240 in kept and not {241, 242, 243, 244, 245} & set(kept)
        elif name == "decontamination":
            item = decontamination.words_of(spark.read.parquet(f"{folder}/benchmark.parquet").first().text)
            windows = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
            has = lambda w: any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))
            kept = {i: t for i, t in kept.items() if not has(decontamination.words_of(t))}
            assert 248 not in kept
        if name == "packing":
            assert {r.doc_id for r in rows} == set(kept) and docs.columns[:4] == ["doc_id", "piece", "start", "length"]
        else:
            assert docs.columns == columns and {r.doc_id: r.text for r in rows} == kept


def test_run_equals_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, folder).collect())) == sorted(map(key, docs.collect()))


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_id_are_decided_one_by_one(spark, folder):
    r = random.Random(3)
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    clean, named = prose(r, 80), prose(r, 80)
    rows = [(None, clean), (None, clean), (None, named), (1, named), (None, prose(r, 30) + " " + item)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, folder)
    assert sorted(((x.doc_id, x.text) for x in docs.collect()), key=str) == sorted([(None, clean), (1, named)], key=str)
