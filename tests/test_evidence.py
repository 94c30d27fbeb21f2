"""Facets, budgets, graph scores, alignment, models and page cleaning against plain loops and made rows."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import aliases, alignment, facets, graph_scores, models, pages, reports

from .test_engine import one


def write(df):
    """Cuts lineage in the shared folder of the session."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()


def visits(matches, chunks_of, edges, cap):
    """Hits of one facet, by the rules told in evidence_hits, as a loop."""
    out, n = [], 0
    for node in matches:
        for c in sorted(chunks_of[node]):
            out.append((c, None))
            n += 1
            if n >= cap:
                break
        near = [e for e in edges if e[1] == node] + [e for e in edges if e[2] == node]
        for e in near:
            if e[3] is not None:
                out.append((e[3], e[0]))
                n += 1
            if n >= cap:
                break
        if n >= cap:
            break
    return out


def test_evidence_budget(spark):
    rng = random.Random(5)
    node_chunks = [(n, rng.randrange(40)) for n in range(1, 9) for _ in range(rng.randrange(14))]
    edges = [(e, rng.randrange(1, 9), rng.randrange(1, 9), "R", rng.choice([None, rng.randrange(40)])) for e in range(30)]
    ms = [(i, "person", f"v{i}", o, n) for i in range(40) for o, n in enumerate(rng.sample(range(1, 9), rng.randrange(1, 6)), 1)]
    hits = facets.node_hits(spark.createDataFrame(node_chunks, "node long, chunk long"), spark.createDataFrame(edges, "edge long, source long, target long, type string, chunk long"), ["R"], 5)
    years = spark.createDataFrame([], "year int, chunk long")
    got = defaultdict(list)
    for r in facets.evidence_hits(spark.createDataFrame(ms, "id long, facet string, value string, ord int, node long"), hits, years).collect():
        got[r.id].append((r.chunk, r.edge))
    chunks_of = defaultdict(set)
    for n, c in node_chunks:
        chunks_of[n].add(c)
    rows = [(e[0], e[1], e[2], e[4]) for e in edges]
    most = 0
    key = lambda x: (x[0], x[1] is not None, x[1] or 0)
    for i in range(40):
        want = visits([m[4] for m in ms if m[0] == i], chunks_of, rows, 5)
        most = max(most, len(want))
        assert sorted(got[i], key=key) == sorted(want, key=key)
    assert most == 6
    strict = facets.evidence_hits(spark.createDataFrame(ms, "id long, facet string, value string, ord int, node long"), hits, years, strict=True)
    assert max(r["count"] for r in strict.groupBy("id").count().collect()) == 5


def test_match_and_summary(spark):
    fs = spark.createDataFrame([(1, "time", "1910"), (1, "place", "Ha Noi"), (1, "place", "ha noi"), (1, "result", "Ha Noi"), (1, "person", "chi minh")], "id long, facet string, value string")
    names = spark.createDataFrame([(1, "Ha Noi", 1, "Place"), (2, "Ho Chi Minh", 1, "Person"), (3, "1910", 1, "Time")], "entity long, name string, weight int, type string")
    years = spark.createDataFrame([(1910, 9)], "year int, entity long")
    got = {(r.facet, r.value, r.node, r.method) for r in facets.match(fs, names, years, {"place": ["Place"], "person": ["Person"]}).collect()}
    assert got == {("time", "1910", 9, "year_index"), ("time", "1910", 3, "alias"), ("place", "Ha Noi", 1, "alias"), ("place", "ha noi", 1, "alias"), ("person", "chi minh", 2, "substring")}
    three = fs.where("facet IN ('time', 'place')")
    s = facets.match_summary(three, spark.createDataFrame([(1, "place", "Ha Noi"), (1, "place", "ha noi")], "id long, facet string, value string")).first()
    assert (s.total_facets, s.matched_facets, s.match_rate) == (3, 1, 0.333333)


def test_rules_and_coercion(spark):
    texts = spark.createDataFrame([(1, "Ha Noi 1954, 12 quân và 12 quân; 3-4 km2"), (2, None)], "id long, text string")
    names = spark.createDataFrame([(1, "Ha Noi", 1, "Place")], "entity long, name string, weight int, type string")
    rules = facets.rule_facets(texts, names)
    got = {(r.id, r.facet, r.value, r.pos) for r in rules.collect()}
    assert got == {(1, "place", "ha noi", 1), (1, "time", "1954", 1), (1, "quantity", "12 quân", 1), (1, "quantity", "3-4 km2", 2)}
    said = spark.createDataFrame([(1, {"time": [], "person": ["An ", "an", "Be"]})], "id long, facets map<string, array<string>>")
    got = {(r.facet, r.value) for r in facets.coerce_facets(said, rules).collect()}
    assert got == {("place", "ha noi"), ("quantity", "12 quân"), ("quantity", "3-4 km2"), ("person", "An"), ("person", "Be")}


def test_rules_with_many_entities_of_a_name(spark):
    """A name that many entities bear is read as one value, and texts without years or names keep their other facets."""
    texts = spark.createDataFrame([(1, "red ring and old plate in 1995"), (2, "12 quân"), (3, "..."), (4, "old plate")], "id long, text string")
    bearers = [(e, n, e % 7, ("Concept", "Event", "Odd")[e % 3]) for e in range(3000) for n in [("red ring", "old plate")[e % 2]]]
    names = spark.createDataFrame(bearers, "entity long, name string, weight int, type string")
    got = {(r.id, r.facet, r.value, r.pos) for r in facets.rule_facets(texts, names).collect()}
    # of the heaviest, entity 6 bears one name and 13 the other
    assert got == {(1, "concept", "red ring", 1), (1, "event", "old plate", 1), (1, "time", "1995", 1), (2, "quantity", "12 quân", 1), (4, "event", "old plate", 1)}
    assert aliases.deciding(names).count() == 2


def test_match_with_many_entities_of_a_name(spark):
    """Each facet meets the first entity of the types that are its own."""
    bearers = [(e, "red ring", e % 7, ("Concept", "Event")[e % 2]) for e in range(2000)]
    names = spark.createDataFrame([*bearers, (5000, "red ring", 99, None), (5001, "red ring", 98, "Place")], "entity long, name string, weight int, type string")
    fs = spark.createDataFrame([(1, "concept", "red ring"), (1, "event", "Red Ring"), (2, "person", "red ring")], "id long, facet string, value string")
    none = spark.createDataFrame([], "year int, entity long")
    got = {(r.facet, r.node, r.method) for r in facets.match(fs, names, none, {"concept": ["Concept"], "event": ["Event"]}).collect()}
    # a node without a type is never ruled out
    assert got == {("concept", 5000, "alias"), ("event", 5000, "alias"), ("person", 5000, "alias")}
    got = facets.match(fs, names.where("entity < 5000"), none, {"concept": ["Concept"], "event": ["Event"]}).where("facet IN ('concept', 'event')").collect()
    assert {(r.facet, r.node) for r in got} == {("concept", 6), ("event", 13)}


def test_evidence_score(spark):
    row = spark.createDataFrame([(2, 4, 1, "won in 1945 alpha beta", "alpha 1945", [1946], 3)], "f int, t int, r int, claim string, text string, years array<int>, hub int")
    c = F.col
    got = row.select(facets.score(c("f"), c("t"), c("r"), c("claim"), c("text"), c("years")).alias("x"), facets.score(c("f"), c("t"), c("r"), c("claim"), c("text"), c("years"), c("hub")).alias("y")).first()
    import math

    plain = 0.45 * 0.5 + 0.25 * 0.5 + 0.2 * 1 + 0.1 * 0.5
    assert got.x == pytest.approx(plain) and got.y == pytest.approx(plain / (1 + 0.15 * math.log(4)))


def test_answers(spark):
    v = lambda s: one(spark, T.verdict, s)
    cut = v('{"label": "fake", "reasoning": "x')
    assert (cut.label, cut.how) == ("fake", "json")
    whole = v('```json\n{"label": "Real", "confidence": 3, "evidence_ids": ["E1", "E1"], "wrong_facets": ["time|place; mood"]}\n```')
    assert (whole.label, whole.confidence, whole.evidence_ids, whole.wrong_facets) == ("real", 1.0, ["E1"], ["time", "place"])
    saved = v('{"label": "fake", "reasoning": "a "b" c", "confidence": 0.4, "wrong_facets": ["time"')
    assert (saved.label, saved.confidence, saved.how) == ("fake", 0.4, "salvaged")
    assert v("no idea") is None and v(None) is None and v("") is None
    assert v('x {"label": "insufficient evidence"} y').label == "fake"


def test_graph_scores(spark):
    claims = spark.createDataFrame([(1, ["a", "b"], ["Person"], [1945], ["alpha", "beta"], ["ha noi"], ["CAUSES"])], "id long, nodes array<string>, node_types array<string>, years array<int>, tokens array<string>, phrases array<string>, types array<string>")
    schema = "edge long, source string, target string, type string, chunk string, confidence double, source_type string, target_type string, years array<int>, tokens array<string>, key string"
    edges = spark.createDataFrame([(1, "a", "b", "CAUSES", "x", 0.9, "Person", "Event", [1945], ["alpha"], " in ha noi "), (2, "c", "d", "BEFORE", None, None, None, None, None, ["beta"], None)], schema)
    chunks = spark.createDataFrame([("x", [1945, 1946], ["beta"], " ha noi "), ("y", None, None, None)], "chunk string, years array<int>, tokens array<string>, key string")
    nodes = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x")], "node string, chunk string")
    found, linked = graph_scores.retrieve(claims, edges, chunks, nodes, spark.createDataFrame([], "node string, year int"))
    assert [(r.edge, r.score) for r in found.orderBy("rank").collect()] == [(1, round(12 + 3 + 2 + 0.6 + 2 + 3 + 1 + 0.45, 4)), (2, 0.6)]
    assert [(r.chunk, r.score) for r in linked.collect()] == [("x", round(min(12, 24.05 * 0.6) + 4 + 2 + 0.4 + 2, 4))]
    paths = spark.createDataFrame([(1, [1, 2], 2.0), (1, [2], -1.0)], "id long, edges array<long>, score double")
    assert {(r.edge, r.support) for r in graph_scores.path_support(paths).collect()} == {(1, 1.0), (2, 1.0)}
    labels = graph_scores.path_labels(
        spark.createDataFrame([("p", 1, [1]), ("q", 1, [2]), ("r", 2, [1]), ("s", 3, [1])], "path string, id long, edges array<long>"),
        edges.withColumn("evidence", F.lit("e")), spark.createDataFrame([(1, [1945]), (2, [1800])], "id long, years array<int>"), chunks.select("chunk", "years"),
    )
    assert {r.path: (r.label, r.grounded) for r in labels.collect()} == {"p": ("SUPPORT", True), "q": ("EXPLICIT_REFUTE?", False), "r": ("POSSIBLE_CONFLICT", True), "s": ("SUPPORT", True)}


def _random_graph(spark, seed):
    """Claims with several nodes, years and tokens, many of them alike; loops, nulls and repeated node years."""
    rng = random.Random(seed)
    some = lambda values, most: rng.choice([None, []]) if rng.random() < 0.1 else [rng.choice(values) for _ in range(rng.randint(1, most))]
    years, words, nodes = list(range(1900, 1906)), ["red", "old", "big", "far"], [f"n{i}" for i in range(9)]
    alike = [(some(["P", "Q"], 2), some(years, 3), some(words, 3), some(["ring", "bolt"], 2), some(["A", "B"], 2)) for _ in range(4)]
    claims = [(i, some(nodes, 3), *rng.choice(alike)) for i in range(12)]
    claims = spark.createDataFrame(claims, "id long, nodes array<string>, node_types array<string>, years array<int>, tokens array<string>, phrases array<string>, types array<string>")
    edges = [(i, rng.choice(nodes), rng.choice(nodes), rng.choice("ABC"), rng.choice(["k1", "k2", "k3", "k4", None]), rng.choice([0.2, 0.9, None]), rng.choice(["P", "Q", None]), "R", some(years, 2), some(words, 2), rng.choice([" a ring ", " bolt ", None])) for i in range(150)]
    edges = spark.createDataFrame(edges, "edge long, source string, target string, type string, chunk string, confidence double, source_type string, target_type string, years array<int>, tokens array<string>, key string")
    chunks = spark.createDataFrame([(f"k{i}", some(years, 3), some(words, 2), rng.choice([" ring ", " x "])) for i in range(1, 30)], "chunk string, years array<int>, tokens array<string>, key string")
    near = spark.createDataFrame([(rng.choice(nodes), f"k{rng.randint(1, 31)}") for _ in range(30)], "node string, chunk string")
    dated = spark.createDataFrame([(rng.choice(nodes), rng.choice(years)) for _ in range(8)], "node string, year int")
    return claims, edges, chunks, near, dated


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_of_candidates(spark, seed):
    """Counted by sets of nodes, years and tokens, candidates number as many as their rows."""
    claims, edges, chunks, _, dated = _random_graph(spark, seed)
    rows = graph_scores.candidate_edges(claims, edges, chunks, dated, 2, 7)
    want = rows.groupBy("id", "reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("edge").alias("e"))
    got = graph_scores.candidate_counts(claims, graph_scores.wide_edges(edges, chunks), dated, 2, 7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_best_facts_of_classes(spark, seed):
    """Scored by classes of claims, facts are those of all candidates, however small the pool."""
    claims, edges, chunks, near, dated = _random_graph(spark, seed)
    for most, k in ((3, 2), (12, 8), (1500, 8)):
        want = graph_scores.facts(claims, edges, chunks, graph_scores.candidate_edges(claims, edges, chunks, dated, 2, 7), most, k)
        got = graph_scores.best_facts(claims, graph_scores.wide_edges(edges, chunks), dated, most, k, 2, 7)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_best_chunks_of_classes(spark, seed):
    """Scored by classes of claims, chunks are those of all candidates, however small the pool."""
    claims, edges, chunks, near, dated = _random_graph(spark, seed)
    found = graph_scores.best_facts(claims, graph_scores.wide_edges(edges, chunks), dated).localCheckpoint()
    for most, k in ((3, 2), (700, 3)):
        want = graph_scores.linked_chunks(claims, found, chunks, near, graph_scores.candidate_chunks(claims, found, chunks, near, 2, 7), most, k)
        got = graph_scores.best_chunks(claims, found, chunks, near, most, k, 2, 7)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_alignment(spark):
    reps = spark.createDataFrame([(1, "Place", "Hà Nội", "hà nội", "ha noi", 3), (2, "Organization", "Ha Noi", "ha noi", "ha noi", 5), (3, "Person", "ha noi", "ha noi", "ha noi", 1), (4, "Event", "revolution august", "revolution august", "revolution august", 1), (5, "Event", "revolution augustt", "revolution augustt", "revolution augustt", 1)], "entity long, type string, name string, key string, fold string, mentions long")
    got = {(r.kind, tuple(r.members)) for r in alignment.groups(reps, write, [["Hà Nội", "x"]]).collect()}
    assert got == {("fold", (2, 1)), ("seed", (2, 3, 1)), ("sim", (4, 5))}
    many = spark.createDataFrame([(i, "Place", "n", "n", "n", 1) for i in range(14)], "entity long, type string, name string, key string, fold string, mentions long")
    assert sorted(len(r.members) for r in alignment.groups(many, write).collect()) == [2, 12]
    assert [len(r.members) for r in alignment.groups(many.where("entity < 13"), write).collect()] == [12]
    merges = spark.createDataFrame([([1, 2, 99], 0.9, False, "HN", "Place"), ([2, 3], 0.5, False, None, None), ([4, 5], 0.95, True, None, None), ([4], 1.0, False, None, None)], "members array<long>, confidence double, review_required boolean, canonical_name string, canonical_type string")
    out, mapped = alignment.apply_merges(reps, merges, write)
    assert {(r.root, r.name, r.type, r.n_mentions) for r in out.collect()} == {(1, "HN", "Place", 8), (3, "ha noi", "Person", 1), (4, "revolution august", "Event", 1), (5, "revolution augustt", "Event", 1)}
    assert {(r.entity, r.root) for r in mapped.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)}


def test_state_windows(spark):
    rows = [(i, "Place", f"{'abc'[i % 3]}{i}", f"{'abc'[i % 3]}{i}", "chính phủ" if i != 4 else "") for i in range(9)]
    got = alignment.state_windows(spark.createDataFrame(rows, "entity long, type string, key string, fold string, samples string"), write)
    order = [0, 3, 6, 1, 7, 2, 5, 8]
    assert {r.entity: r.members for r in got.collect()} == {e: sorted(order[max(0, n - 2) : n + 3]) for n, e in enumerate(order)}


def test_numbers_follow_the_order(spark):
    rows = spark.range(50).select((F.col("id") * 7 % 50).alias("k"))
    got = graph_scores.number(rows, ["k"], "name", "u%06d", write).collect()
    assert {(r.k, r.name) for r in got} == {(k, f"u{k + 1:06d}") for k in range(50)}


class Moody:
    """Fails on batches and on one prompt."""

    def complete(self, prompts):
        if len(prompts) > 1 or prompts[0] == "bad":
            raise RuntimeError("no")
        return [f"<{p}>" for p in prompts]


def test_models(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id long, p string").coalesce(1)
    got = {r.id: (r.answer, r.error) for r in models.complete(rows, "p", Moody, wait=0).collect()}
    assert got == {1: ("<a>", None), 2: (None, "no"), 3: ("<>", None)}
    vectors = [r.embedding for r in models.embed(rows, "p", models.OfflineClient).collect()]
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in vectors)
    claims = spark.createDataFrame([(1, "c"), (2, "bad")], "id long, claim string")
    contexts = spark.createDataFrame([(1, "[E1] x")], "id long, context string")
    out = {r.id: r.label for r in models.verify(claims, contexts, lambda: models.OfflineClient(lambda p: '{"label": "real"}' if "[E1]" in p else "?")).collect()}
    assert out == {1: "real", 2: "error"}
    pairs = spark.createDataFrame([(1, "x", 1, "c", "aa"), (1, "y", 2, "c", "aa"), (1, "z", 3, "c", "aaa")], "id long, doc string, pos int, claim string, text string")
    assert [r.doc for r in models.rerank(pairs, lambda: lambda a, b: [float(len(x)) for x in b], 2).orderBy("rank").collect()] == ["z", "x"]


def test_lines_of_books(spark):
    h = lambda s: one(spark, pages.heading, s)
    assert (h("Bài 5: NHẬT BẢN").kind, h("Bài 5: NHẬT BẢN").number, h("Bài 5: NHẬT BẢN").title) == ("lesson", "5", "Bài 5: NHẬT BẢN")
    assert h("Bài").kind == "lesson_marker" and h("II - PHONG TRÀO CÁCH MẠNG").number == "II"
    assert h("3. Ý nghĩa lịch sử").kind == "numbered_section" and h("25. abc") is None
    assert h("CHIẾN TRANH THẾ GIỚI THỨ HAI").kind == "uppercase_heading" and h("BIỂN ĐÔNG") is None and h("") is None
    assert all(one(spark, pages.is_noise, s) for s in ("123", "Hình 12. Bản đồ", " ")) and not one(spark, pages.is_noise, "1234")
    assert one(spark, pages.is_exercise, "Hãy trình bày nguyên nhân.") and one(spark, pages.is_exercise, "Vai trò của hội nghị là gì?") and not one(spark, pages.is_exercise, "Hội nghị họp.")


def test_pages_and_chunks(spark):
    long = "Hội nghị họp tại Hà Nội năm 1945 và thông qua nhiều nghị quyết quan trọng về kinh tế. " * 2
    rows = [("b.pdf_1.jpg.txt", "b", "x " * 20 + "Bài 1 Bài 2 Bài 3 Bài 4 Bài 5 " + "y " * 40), ("b.pdf_2.jpg.txt", "b", "Mã số " + "y " * 60), ("b.pdf_3.jpg.txt", "b", "z" * 79), ("b.txt", "b", long),
            ("b.pdf_4.jpg.txt", "b", long), ("b.pdf_5.jpg.txt", "b", f"Bài 1: NHẬT BẢN\n12\n{long}\nHãy nêu ý nghĩa.\n{long}\nBài 2\n{long}")]
    records = pages.page_records(spark.createDataFrame(rows, "path string, book string, text string"))
    assert {(r.path, r.reason) for r in records.collect()} == {("b.pdf_1.jpg.txt", "publication_or_index_page"), ("b.pdf_2.jpg.txt", "publication_or_index_page"), ("b.pdf_3.jpg.txt", "too_short"), ("b.txt", "unparsed_filename"), ("b.pdf_4.jpg.txt", None), ("b.pdf_5.jpg.txt", None)}
    chunks = pages.build_chunks(records)
    got = chunks.orderBy("section").collect()
    assert [(r.section, r.kind, r.title, r.pages, r.years) for r in got] == [(0, "page_fallback", None, [4], [1945]), (1, "lesson", "Bài 1: NHẬT BẢN", [5], [1945]), (2, "lesson", "Bài 2", [5], [1945])]
    linked = pages.overlaps(chunks.select("book", F.col("section").alias("ord"), F.col("section").cast("string").alias("chunk_id"), "kind", "text"), 20).orderBy("ord").collect()
    assert [r.prev_id for r in linked] == [None, "0", "1"] and linked[1].contextual_text == linked[1].text and linked[2].contextual_text.endswith(linked[2].text) and len(linked[2].contextual_text) > len(linked[2].text)
    n = {(r.section, r.item): r.n for r in reports.corpus(records, chunks).collect()}
    assert n["pages", "none"] == 2 and n["chunks", "lesson"] == 2


def test_extraction(spark):
    from evidentia.operators import extraction

    answer = """```json
{"entities": [{"local_id": "a", "type": "Person", "name": " An  Lee ", "aliases": ["x", "x", " "], "years": ["1945", "12"], "evidence_text": "in 1946", "confidence": 2},
 {"local_id": "a", "type": "Place", "name": "Hue"}, {"type": "Dragon", "name": "d"}, {"type": "Event", "name": ""}, {"type": "Event", "name": "war"}],
 "relations": [{"source": "a", "target": "e5", "type": "PARTICIPATED_IN"}, {"source": "a", "target": "zz", "type": "CAUSES"}, {"source": "a", "target": "e2", "type": "EATS"}]}
```"""
    answers = spark.createDataFrame([("c", answer), ("d", "no idea"), ("e", None)], "chunk string, answer string")
    found = extraction.entities(answers)
    got = {r.pos: r for r in found.collect()}
    assert [(got[i].local_id, got[i].warning) for i in (1, 2, 5)] == [("a", None), ("e2", None), ("e5", None)] and len(got) == 5
    assert (got[1].name, got[1].aliases, got[1].years, got[1].confidence) == ("An Lee", ["x", "x"], [1945, 1946], 1.0)
    assert got[3].warning == "skipped entity with invalid type: Dragon" and got[4].warning == "skipped entity with empty name"
    rel = {r.pos: r.warning for r in extraction.relations(answers, found).collect()}
    assert rel == {1: None, 2: "skipped relation with unknown endpoint: a->zz", 3: "skipped relation with invalid type: EATS"}
    rows = extraction.audit_rows(extraction.relations(answers, found).where("warning IS NULL"), found, spark.createDataFrame([("c", "t  t")], "chunk string, text string")).collect()
    assert [(r.source_name, r.target_name, r.passage) for r in rows] == [("An Lee", "war", "t t")]
