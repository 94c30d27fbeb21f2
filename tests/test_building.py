"""Settings, names, parsed claims, graph rows and evaluation inputs on small made rows."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import aliases, alignment, build, claim_parse, dense_graph, formatting, inputs, models
from evidentia.sources import config, io


def test_settings(tmp_path):
    (tmp_path / "a.yaml").write_text('{"a": {"b": [1, 2]}}')
    read = config.load_settings(str(tmp_path / "a.yaml"))
    assert read["a"]["b"] == (1, 2)
    with pytest.raises(TypeError):
        read["a"]["c"] = 1
    (tmp_path / "b.yaml").write_text("[1]")
    with pytest.raises(ValueError):
        config.load_settings(str(tmp_path / "b.yaml"))
    assert config.project_path("x/y", str(tmp_path)) == tmp_path / "x/y" and str(config.project_path("/z")) == "/z"
    (tmp_path / ".env").write_text("# no\nA=1\n B = 'two=2' \nnothing\nC=3\n")
    own = {"C": "kept"}
    assert config.load_env(str(tmp_path / ".env"), own) == ["A", "B"] and own == {"A": "1", "B": "two=2", "C": "kept"}
    assert config.load_env(str(tmp_path / "none"), own) == []


def test_providers_and_slugs():
    keys = {"one": "ONE_KEY"}
    assert config.provider({"provider": "one", "model": "m"}, keys, {"ONE_KEY": "x"}) == ("one", "m")
    for settings, env in (({"provider": "two", "model": "m"}, {}), ({"provider": "one"}, {"ONE_KEY": "x"}), ({"provider": "one", "model": "m"}, {})):
        with pytest.raises(ValueError):
            config.provider(settings, keys, env)
    assert config.model_slug("one", " My Model/2 ") == "one-my-model-2" and config.model_slug("openai", "GPT-x") == "gpt-x" and config.model_slug("gemini", "gpt") == "gemini-gpt"


def test_json_and_graph_tables(spark, tmp_path):
    io.save_json({"a": "Hà"}, str(tmp_path / "x.json"))
    assert (tmp_path / "x.json").read_text(encoding="utf-8") == '{\n  "a": "Hà"\n}\n' and [p.name for p in tmp_path.iterdir()] == ["x.json"]
    nodes, edges = spark.range(3).select(F.col("id").cast("string").alias("id")), spark.createDataFrame([("0", "1")], "source string, target string")
    io.write_graph(nodes, edges, str(tmp_path / "g"), made="test")
    got = io.read_graph(spark, str(tmp_path / "g"))
    assert got["metadata"].first().asDict() == {"n_nodes": 3, "n_edges": 1, "made": "test"} and got["nodes"].count() == 3


def test_composed_and_decomposed_letters_are_alike(spark):
    a, b = "Hà Nội", "Hà Nội"
    df = spark.createDataFrame([(a, b), (None, None)], "a string, b string")
    r = df.select(*[f(F.col(c)).alias(f"{n}{c}") for n, f in (("k", T.key), ("s", T.squeeze), ("f", T.fold_key)) for c in "ab"], T.tokens(F.col("b")).alias("t")).collect()
    assert (r[0].ka, r[0].sa, r[0].fa) == (r[0].kb, r[0].sb, r[0].fb) == ("hà nội", "Hà Nội", "ha noi") and r[0].t == ["hà", "nội"] and r[1].ka is None


def test_long_aliases_match(spark):
    name = " ".join(f"word{k}" for k in range(14))
    texts = spark.createDataFrame([(1, f"before {name} after")], "id long, text string")
    known = spark.createDataFrame([(7, name, 1), (8, "a b", 1)], "entity long, name string, weight int")
    assert [r.entity for r in aliases.greedy(aliases.candidates(texts, known)).collect()] == [7]


def test_decisions_drop_strangers(spark):
    item = {"canonical_name": "N", "canonical_type": "Person", "member_entity_ids": ["b", "x", "a", "a"], "observed_types": ["Event", "Odd", "Event"], "aliases": ["z", " y "], "confidence": "0.9"}
    answer = json.dumps({"aligned_entities": [item, item | {"member_entity_ids": ["a"]}, item | {"canonical_name": " "}], "unmerged_entities": [{"entity_id": "c", "reason": "r"}, {"entity_id": "x"}]})
    rows = spark.createDataFrame([("g", ["a", "b", "c"], answer), ("h", ["a"], None)], "group string, members array<string>, answer string")
    merges, left = alignment.decisions(rows)
    m = merges.collect()
    assert len(m) == 1 and (m[0].members, m[0].observed_types, m[0].aliases, m[0].confidence) == (["a", "b"], ["Event"], ["y", "z"], 0.9)
    assert [(r.group, r.entity_id, r.reason) for r in left.collect()] == [("g", "c", "r")]
    assert '"entity":1' in rows.select(alignment.alignment_prompt(F.array(F.struct(F.lit(1).alias("entity")))).alias("p")).first().p


def test_claims_without_a_model(spark):
    claims = spark.createDataFrame([(1, "in 1945"), (2, None)], "id long, claim string")
    got = {r.id: r for r in claim_parse.parse_claims(claims).collect()}
    assert got[1].years == [1945] and got[2].years == [] and got[1].parse.keywords == [] and got[1].parse.entity_mentions == []
    bad = spark.createDataFrame([(1, "no json")], "id long, answer string")
    assert claim_parse.parse_claims(claims, bad).where("size(parse.relation_hints) = 0").count() == 2


def test_merge_in_chunk_keeps_first_and_surest(spark):
    schema = "chunk long, ord int, local string, type string, name string, aliases array<string>, years array<int>, description string, evidence string, confidence double"
    rows = [(1, 0, "a", "P", "Hà", ["z", "b"], [2], "d0", "e0", 0.5), (1, 1, "b", "P", "hà!", ["c"], [1], "d1", "e1", 0.9), (1, 2, "c", "P", "HÀ", ["b"], [], "d2", "e2", 0.9), (1, 3, "d", "E", "Hà", ["z", "y"], [], "d3", "e3", None)]
    merged, ids = build.merge_in_chunk(spark.createDataFrame(rows, schema))
    got = {r.local: r for r in merged.collect()}
    assert (got["a"].aliases, got["a"].years, got["a"].description, got["a"].confidence) == (["b", "c", "z"], [1, 2], "d1", 0.9) and got["d"].aliases == ["z", "y"]
    assert {r.local: r.kept for r in ids.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_evaluation_rows(spark):
    ids, rows = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, "x")], "id long, v string")
    with pytest.raises(ValueError, match="1 ids are missing: 2"):
        inputs.mandatory(ids, rows)
    assert inputs.in_all(ids, rows).count() == 1 and inputs.pool_rows(ids, rows).count() == 2
    keys = spark.createDataFrame([(0, "7"), (1, None)], "ord long, id string").select(inputs.row_key(F.col("id"), F.col("ord")).alias("k")).collect()
    assert [r.k for r in keys] == ["7", "__idx_1"]
    df = spark.range(100).select(F.col("id").alias("key"))
    parts = [[r.key for r in p.collect()] for p in inputs.in_commits(df, "key", 30)]
    assert len(parts) == 4 and sorted(x for p in parts for x in p) == list(range(100))
    with pytest.raises(ValueError):
        inputs.retrieve("none", df, df, df, df, ("a",) * 4)


def test_formats_name_unknown_nodes_blank(spark):
    nodes = spark.createDataFrame([("a", "P", "A")], "id string, type string, name string")
    edges = spark.createDataFrame([("e", "a", "lost", "T", None, None, None)], "edge string, source string, target string, type string, description string, evidence string, chunk string")
    found = spark.createDataFrame([(1, "e", 2.0, 1)], "id long, edge string, score double, rank int")
    fact = formatting.facts(found, edges, nodes, spark.createDataFrame([], "kind string, item string, years array<int>")).first().fact
    assert (fact.source.name, fact.target.id, fact.description, fact.years) == ("A", "", "", [])


def test_multihop_has_no_revisits(spark):
    e = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "a"), (4, "a", "a")], "edge long, source string, target string")
    e = e.withColumns({"type": F.lit("T"), "years": F.array().cast("array<int>"), "tokens": F.array().cast("array<string>")})
    claims = spark.createDataFrame([(1, [], [], [])], "id long, years array<int>, tokens array<string>, types array<string>")
    dense = e.select(F.lit(1).cast("long").alias("id"), F.col("edge").alias("item"), F.lit(0.5).alias("dense"))
    none = spark.createDataFrame([], "id long, item string, dense double")
    got = dense_graph.multihop(claims, e, spark.createDataFrame([(1, "a")], "id long, node string"), none, dense, lambda df: df.cache(), hops=3).collect()
    assert sorted(tuple(r.nodes) for r in got) == [("a", "b"), ("a", "b", "c"), ("a", "c"), ("a", "c", "b")]


def test_prompts_hold_claim_and_passages(spark):
    p = spark.createDataFrame([("the claim", ["one", "two"])], "c string, p array<string>").select(models.claim_only_prompt(F.col("c")).alias("a"), models.passages_prompt(F.col("c"), F.col("p")).alias("b")).first()
    assert "the claim" in p.a and "[1] one\n[2] two" in p.b
    silent = models.verify_claim_only(spark.createDataFrame([(1, "x")], "id long, claim string"), lambda: models.OfflineClient(lambda _: "no answer"))
    assert [(r.label, r.error) for r in silent.collect()] == [("error", "unreadable answer")]


def test_many_entities_of_an_alias(spark):
    """Only names that can decide meet the texts; what is taken is what all candidates would give."""
    rng = random.Random(5)
    words = [f"{a} {b}" for a in ("red", "blue", "old") for b in ("ring", "bolt", "plate")]
    names = [(e, w, e % 4) for e, w in enumerate(words * 300)] + [(rng.randrange(2650, 2720), rng.choice(words), rng.randrange(9)) for _ in range(60)]
    names = spark.createDataFrame(names, "entity long, name string, weight int")
    texts = spark.createDataFrame([(i, ", ".join(rng.choices([*words, "ring bolt", "x"], k=6))) for i in range(40)], "id long, text string")
    assert aliases.deciding(names).groupBy("alias").count().where("count > 40").isEmpty()
    for once in ("entity", "alias"):
        for most in (2, 10):
            want = aliases.greedy(aliases.candidates(texts, names), most, once)
            got = aliases.matched(texts, names, most=most, once=once)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
