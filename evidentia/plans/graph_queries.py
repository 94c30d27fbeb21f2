"""Queries on names, parsed claims, graph building, evaluation inputs, formatting and dense graph retrieval, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aliases as A
from ..operators import alignment as L
from ..operators import build as B
from ..operators import claim_parse as C
from ..operators import dense_graph as D
from ..operators import facets as E
from ..operators import formatting as O
from ..operators import inputs as I
from ..operators import models as M
from ..operators import retrieval as R
from .queries import _BM25, _DENSE_ITEMS, _DOT, _EDGES, _RRF, _edges, _item_vectors, checkpoint, query


def _list(c, sep: str = "|"):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


# -- names and words ---------------------------------------------------------

_KEY = r"trim(regexp_replace(lower(nfc_normalize({0})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
#: Decomposed letters: what NFC puts together.
_MARKS = [("é", 0x301), ("è", 0x300), ("ä", 0x308), ("ü", 0x308), ("ö", 0x308), ("ô", 0x302), ("ñ", 0x303)]
_PLAIN = {"é": "e", "è": "e", "ä": "a", "ü": "u", "ö": "o", "ô": "o", "ñ": "n"}
_NFD_SQL = "text"
for _a, _m in _MARKS:
    _NFD_SQL = f"replace({_NFD_SQL}, '{_a}', '{_PLAIN[_a]}' || chr({_m}))"


def _decomposed(c):
    for a, m in _MARKS:
        c = F.replace(c, F.lit(a), F.lit(_PLAIN[a] + chr(m)))
    return c


@query(
    rf"""WITH d AS (SELECT doc_id, {_NFD_SQL} AS text FROM documents)
    SELECT doc_id, text <> nfc_normalize(text) AS decomposed, md5({_KEY.format('text')}) AS key, md5(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) AS squeezed,
    length({_KEY.format('text')}) AS n FROM d"""
)
def nfd_keys(t):
    """Keys and squeezed texts of decomposed texts are those of composed ones."""
    x = _decomposed(F.col("text"))
    return t.documents.select("doc_id", (x != T.nfc(x)).alias("decomposed"), F.md5(T.key(x)).alias("key"), F.md5(T.squeeze(x)).alias("squeezed"), F.length(T.key(x)).alias("n"))


@query(
    f"""WITH x AS (SELECT c_custkey AS id, 'Chiến tranh và ' || c_mktsegment || ' của các nước ' || c_nationkey || ' 1945 ' || c_mktsegment AS text FROM customer),
    k AS (SELECT id, list_distinct(list_filter(string_split({_KEY.format('text')}, ' '), lambda w: length(w) >= 3)) AS w FROM x)
    SELECT id, array_to_string(list_sort(list_filter(w, lambda v: NOT list_contains({T.GRAPH_STOP}, v) AND NOT regexp_full_match(v, '\\d+'))), '|') AS graph,
    array_to_string(list_sort(list_filter(w, lambda v: NOT list_contains({T.NAME_STOP}, v))), '|') AS name FROM k"""
)
def stop_words(t):
    x = F.concat(F.lit("Chiến tranh và "), "c_mktsegment", F.lit(" của các nước "), F.col("c_nationkey").cast("string"), F.lit(" 1945 "), "c_mktsegment")
    return t.customer.select(F.col("c_custkey").alias("id"), _list(F.array_sort(T.graph_tokens(x))).alias("graph"), _list(F.array_sort(T.name_tokens(x))).alias("name"))


@query(
    r"""WITH x AS (SELECT o_orderkey AS id, year(o_orderdate) || ', 2029; 2030 x1999 (' || (1990 + o_orderkey % 60) || ') 19451' AS text FROM orders)
    SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b(1[0-9]{3}|20[0-2][0-9])\b'))), '|') AS years FROM x"""
)
def years_to_2029(t):
    x = F.concat(F.year("o_orderdate").cast("string"), F.lit(", 2029; 2030 x1999 ("), (1990 + F.col("o_orderkey") % 60).cast("string"), F.lit(") 19451"))
    return t.orders.select(F.col("o_orderkey").alias("id"), _list(F.array_sort(T.years_to_2029(x))).alias("years"))


@query(
    r"""SELECT p_partkey AS id, array_to_string(list_filter([trim(regexp_replace(v, '\s+', ' ', 'g')) FOR v IN l], lambda v: v <> ''), '|') AS every,
    CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || '|' || p_type END AS once FROM (SELECT p_partkey, p_brand, p_type, [' ' || p_brand || '  ', '', p_type, p_brand, '  '] AS l FROM part)"""
)
def string_lists(t):
    x = F.array(F.concat(F.lit(" "), "p_brand", F.lit("  ")), F.lit(""), "p_type", "p_brand", F.lit("  "))
    return t.part.select(F.col("p_partkey").alias("id"), _list(T.string_list(x, distinct=False)).alias("every"), _list(T.string_list(x)).alias("once"))


@query(
    f"""WITH n AS (SELECT n_nationkey AS id, lower(substr(n_name, 1, 2) || ' ' || substr(n_name, 3, 1 + n_nationkey % 3)) AS text FROM nation)
    SELECT a.id, b.id AS entity, b.text || ' land' AS alias FROM n a JOIN n b ON contains(' ' || b.text || ' land ', ' ' || a.text || ' ') WHERE length(replace(a.text, ' ', '')) >= 5"""
)
def alias_minimum(t):
    """The least length of a facet counts letters and numbers, not spaces."""
    n = t.nation.select(F.col("n_nationkey").alias("id"), F.lower(F.concat(F.substring("n_name", 1, 2), F.lit(" "), F.col("n_name").substr(F.lit(3), (1 + F.col("n_nationkey") % 3).cast("int")))).alias("text"))
    return A.within_longer(n, n.select(F.col("id").alias("entity"), F.concat("text", F.lit(" land")).alias("name")), least=5)


@query(
    f"""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS ord, 's' || l_suppkey AS entity, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag || ' flag!' ELSE l_returnflag || ' flag' END AS name, l_linenumber AS weight FROM lineitem),
    k AS (SELECT *, {_KEY.format('name')} AS alias FROM x), g AS (SELECT alias, entity, arg_max(name, (length(trim(name, ' !')), -ord)) AS name FROM k WHERE length(replace(alias, ' ', '')) >= 4 GROUP BY ALL)
    SELECT alias, entity, trim(name, ' !') AS name FROM g"""
)
def alias_rows(t):
    name = F.concat("l_returnflag", F.when(F.col("l_linenumber") % 2 == 0, " flag!").otherwise(" flag"))
    rows = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("s"), "l_suppkey").alias("entity"), name.alias("name"), F.col("l_linenumber").alias("weight"))
    return A.alias_rows(rows).select("alias", "entity", "name")


_NATION = f"SELECT c_custkey AS id, c_mktsegment AS seg, n_nationkey, {_KEY.format('n_name')} AS nat FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _alias_disjoint(t, once):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    texts = rows.select(F.col("c_custkey").alias("id"), F.concat("n_name", F.lit(" x "), "c_mktsegment", F.lit(" y segment")).alias("text"))
    segments = t.customer.select(F.lit(100).cast("long").alias("entity"), F.col("c_mktsegment").alias("name"), F.lit(1).alias("weight")).distinct()
    nations = t.nation.select(F.col("n_nationkey").cast("long").alias("entity"), F.col("n_name").alias("name"), F.lit(1).alias("weight"))
    word = t.region.where("r_regionkey = 0").select(F.lit(100).cast("long").alias("entity"), F.lit("Segment").alias("name"), F.lit(1).alias("weight"))
    return A.greedy(A.candidates(texts, segments.unionByName(word).unionByName(nations)), most=30, once=once)


_ALIASES = f"""WITH x AS ({_NATION}) SELECT id, lower(seg) AS alias, 100 AS entity, length(nat) + 4 AS start FROM x
    UNION ALL SELECT id, nat, n_nationkey, 1 FROM x WHERE length(replace(nat, ' ', '')) >= 4"""


@query(_ALIASES)
def alias_once(t):
    """One match an entity: the word segment is an alias of the entity that its longer alias has taken."""
    return _alias_disjoint(t, "entity")


@query(_ALIASES + " UNION ALL SELECT id, 'segment', 100, length(nat) + length(seg) + 7 FROM x")
def alias_each(t):
    return _alias_disjoint(t, "alias")


# -- claims read by a model: customers ---------------------------------------

_ANSWER = """{"time_expressions": ["1995", " ", "1995"], "entity_mentions": [{"text": "%s", "type_hint": "Person", "importance": 2}, {"text": " ", "type_hint": "Place"},
 {"text": "late", "type_hint": "Person"}], "event_mentions": [{"text": "%s"}, {"text": "odd", "type_hint": "Thing"}], "relation_hints": [{"source": "%s", "relation": "%s", "target": "x  y"}, {"relation": "BEFORE"}], "keywords": ["%s", "", "ring "]}"""


def _parsed(t):
    kind = F.when(F.col("c_nationkey") % 2 == 0, "CAUSES").otherwise("LIKES")
    answer = F.format_string("```json\n" + _ANSWER.replace("\n", "") + "\n```", "c_name", "c_mktsegment", "c_name", kind, "c_mktsegment")
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(" in 1995")).alias("claim"), F.when(F.col("c_custkey") % 7 > 0, answer).alias("answer"))
    return rows.withColumn("parse", C.parse(F.col("answer"), most_mentions=2)).withColumn("years", T.years(F.col("claim")))


@query(
    """SELECT c_custkey AS id, CASE WHEN ok THEN '1995' ELSE '' END AS times, CASE WHEN ok THEN c_name || '/Person/1.0' ELSE '' END AS entities, CASE WHEN ok THEN c_mktsegment || '/Event' ELSE '' END AS events,
    CASE WHEN ok AND c_nationkey % 2 = 0 THEN c_name || '>CAUSES>x y' ELSE '' END AS hints, CASE WHEN ok THEN c_mktsegment || '|ring' ELSE '' END AS keywords FROM (SELECT *, c_custkey % 7 > 0 AS ok FROM customer)"""
)
def claim_parse(t):
    """Lists are cut before they are checked; unknown types and relations go."""
    p = _parsed(t)
    told = lambda c, *f: F.array_join(F.transform(F.col(f"parse.{c}"), lambda m: F.concat_ws(">" if c == "relation_hints" else "/", *[m[x].cast("string") for x in f])), "|")
    return p.select(
        "id", _list(F.col("parse.time_expressions")).alias("times"), told("entity_mentions", "text", "type_hint", "importance").alias("entities"), told("event_mentions", "text", "type_hint").alias("events"),
        told("relation_hints", "source", "relation", "target").alias("hints"), _list(F.col("parse.keywords")).alias("keywords"),
    )


@query(
    """WITH x AS (SELECT *, c_custkey % 7 > 0 AS ok, c_custkey % 7 > 0 AND c_nationkey % 2 = 0 AS hint FROM customer),
    k AS (SELECT *, CASE WHEN ok THEN c_mktsegment || '|ring|' || c_name ELSE c_name END || '|nick' AS w FROM x)
    SELECT c_custkey AS id, w AS keywords, CASE WHEN hint THEN 'CAUSES' ELSE '' END AS types,
    c_name || ' in 1995 q ' || replace(w, '|', ' ') || CASE WHEN hint THEN ' ' || c_name || ' CAUSES x y' ELSE '' END || ' ' || c_name || ' nick Person 1995' AS query FROM k"""
)
def claim_query(t):
    p = _parsed(t).withColumn("name", F.regexp_replace("claim", " in 1995$", ""))
    p = p.withColumn("m", F.array(F.struct("name", F.lit("nick").alias("alias"), F.lit("Person").alias("type"))))
    named = F.transform("m", lambda x: F.struct(x["name"].alias("name"), x["alias"].alias("alias")))
    p = p.withColumn("w", C.keywords(F.col("parse"), named))
    return p.select("id", _list(F.col("w")).alias("keywords"), _list(C.relation_types(F.col("parse"))).alias("types"), C.query_text(F.col("claim"), F.lit("q"), F.col("w"), F.col("parse"), F.col("m"), F.col("years")).alias("query"))


@query(
    """SELECT o_custkey AS "group", array_to_string(list_sort(m), '|') AS members, 'Name ' || o_custkey AS name, CASE o_custkey % 4 WHEN 0 THEN 'Person' WHEN 1 THEN 'Place' ELSE 'Event' END AS type,
    CASE WHEN o_custkey % 2 = 0 THEN 0.5 ELSE 1.0 END AS confidence FROM (SELECT o_custkey, list(DISTINCT o_orderkey::VARCHAR) AS m FROM orders GROUP BY o_custkey) WHERE o_custkey % 4 < 3 AND len(m) >= 2"""
)
def alignment_decisions(t):
    """Answers name each member twice and a stranger; groups with an unknown type or one member give no merge."""
    groups = t.orders.groupBy(F.col("o_custkey").alias("group")).agg(F.collect_set(F.col("o_orderkey").cast("string")).alias("members"))
    kind = F.element_at(F.array(*map(F.lit, ("Person", "Place", "Event", "Thing"))), (F.col("group") % 4 + 1).cast("int"))
    item = F.struct(
        F.concat(F.lit(" Name  "), F.col("group").cast("string")).alias("canonical_name"), kind.alias("canonical_type"), F.concat("members", F.array(F.lit("none")), "members").alias("member_entity_ids"),
        F.when(F.col("group") % 2 == 0, "0.5").otherwise("7").alias("confidence"),
    )
    answers = groups.withColumn("answer", F.to_json(F.struct(F.array(item).alias("aligned_entities"))))
    merges, _ = L.decisions(answers)
    return merges.select("group", _list(F.col("members")).alias("members"), F.col("canonical_name").alias("name"), F.col("canonical_type").alias("type"), "confidence")


# -- graph rows: lines are mentions of parts in orders ------------------------

_LINE = "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey"
_MENTION = f"""m AS (SELECT l_orderkey AS chunk, {_LINE} AS ord, 'e' || {_LINE} AS local, l_returnflag AS type, p_brand AS name, {_KEY.format('p_brand')} AS key, p_type AS alias, year(l_shipdate)::INT AS y, p_name AS description,
    l_discount AS c, l_linestatus AS rtype, 'mode ' || l_linenumber % 2 AS told FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _mentions(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("chunk"), F.expr(_LINE).alias("ord"), F.concat(F.lit("e"), F.expr(_LINE).cast("string")).alias("local"), F.col("l_returnflag").alias("type"), F.col("p_brand").alias("name"),
        F.array("p_type").alias("aliases"), F.array(F.year("l_shipdate")).alias("years"), F.col("p_name").alias("description"), F.concat(F.lit("mode "), (F.col("l_linenumber") % 2).cast("string")).alias("evidence"), F.col("l_discount").alias("confidence"),
        F.col("l_linestatus").alias("rtype"),
    )


@query(
    f"""WITH {_MENTION}, f AS (SELECT *, first_value(local) OVER (PARTITION BY chunk, type, key ORDER BY ord) AS kept, row_number() OVER (PARTITION BY chunk, type, key ORDER BY c DESC, ord) AS r FROM m)
    SELECT chunk, kept AS local, type, array_to_string(list_sort(list(DISTINCT alias)), '|') AS aliases, array_to_string(list_sort(list(DISTINCT y)), '|') AS years, max(CASE WHEN r = 1 THEN description END) AS description,
    max(c) AS confidence, count(*) AS n FROM f GROUP BY chunk, kept, type, key"""
)
def entities_in_chunk(t):
    merged, _ = B.merge_in_chunk(_mentions(t).drop("rtype"))
    return merged.select("chunk", "local", "type", _list(F.col("aliases")).alias("aliases"), _list(F.col("years")).alias("years"), "description", "confidence", "n")


@query(
    f"""WITH {_MENTION}, f AS (SELECT *, first_value(local) OVER (PARTITION BY chunk, type, key ORDER BY ord) AS kept FROM m),
    r AS (SELECT chunk, ord, kept AS source, lead(kept) OVER (PARTITION BY chunk ORDER BY ord) AS target, rtype, told FROM f),
    d AS (SELECT *, row_number() OVER (PARTITION BY chunk, source, target, rtype, {_KEY.format('told')} ORDER BY ord) AS n FROM r)
    SELECT chunk, source, target, rtype AS type, told AS description FROM d WHERE n = 1"""
)
def relations_in_chunk(t):
    """Each mention is related to the next; ends go through the chunk's merged entities, repeats go."""
    from pyspark.sql import Window

    rows = _mentions(t)
    _, ids = B.merge_in_chunk(rows.drop("rtype"))
    after = F.lead("local").over(Window.partitionBy("chunk").orderBy("ord"))
    related = rows.select("chunk", "ord", F.col("local").alias("source"), after.alias("target"), F.col("rtype").alias("type"), F.col("evidence").alias("description"))
    return B.dedup_relations(B.resolve_ends(related, ids)).select("chunk", "source", "target", "type", "description")


_YEARS = r"list_transform(list_filter(regexp_extract_all({0}, '\d+'), lambda s: length(s) = 4 AND try_cast(s AS INT) BETWEEN 1000 AND 2099), lambda s: s::INT)"
_SQUEEZE = r"trim(regexp_replace(nfc_normalize({0}), '\s+', ' ', 'g'))"


def _chunk_rows(t):
    return B.chunk_nodes(t.documents.select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("In 1789  and 12345, "), F.coalesce("text", F.lit(""))).alias("text"), F.array(F.lit(2000), F.lit(1789)).alias("years"), F.col("lang").alias("book")))


def _entity_rows(t):
    return B.entity_nodes(t.part.select(
        F.concat(F.lit(" p"), "p_partkey").alias("id"), F.lit("Concept").alias("type"), F.col("p_name").alias("name"), F.concat(F.lit("made in "), (1800 + F.col("p_size")).cast("string")).alias("description"),
        F.array(F.lit("sold 1999"), F.lit("and 1700")).alias("samples"), F.array((2000 + F.col("p_partkey") % 9).cast("int")).alias("years"),
    ))


_CHUNKS = f"""cn AS (SELECT 'chunk_' || doc_id AS id, 'DocumentChunk' AS type, doc_id::VARCHAR AS name, list_sort(list_distinct(list_concat([2000, 1789], {_YEARS.format("('In 1789  and 12345, ' || coalesce(text, ''))")}))) AS years,
    length({_SQUEEZE.format("('In 1789  and 12345, ' || coalesce(text, ''))")}) AS char_count, lang AS book FROM documents)"""
_ENTITIES = "en AS (SELECT 'p' || p_partkey AS id, 'Concept' AS type, p_name AS name, list_sort(list_distinct([(2000 + p_partkey % 9)::INT, (1800 + p_size)::INT, 1999, 1700])) AS years FROM part)"


@query(f"WITH {_CHUNKS} SELECT id, type, name, array_to_string(years, '|') AS years, char_count, book FROM cn")
def chunk_nodes(t):
    return _chunk_rows(t).select("id", "type", "name", _list(F.col("years")).alias("years"), "char_count", "book")


@query(f"WITH {_ENTITIES} SELECT id, type, name, array_to_string(years, '|') AS years FROM en")
def entity_nodes(t):
    return _entity_rows(t).select("id", "type", "name", _list(F.col("years")).alias("years"))


@query(f"WITH {_CHUNKS}, {_ENTITIES} SELECT type, count(*) AS n, count(char_count) AS with_text, count(DISTINCT id) AS ids, sum(len(years))::BIGINT AS n_years FROM (SELECT id, type, years, char_count FROM cn UNION ALL SELECT id, type, years, NULL FROM en) GROUP BY type")
def graph_nodes(t):
    rows = B.union_nodes(_chunk_rows(t), _entity_rows(t))
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("char_count").alias("with_text"), F.countDistinct("id").alias("ids"), F.sum(F.size("years")).alias("n_years"))


@query(f"WITH {_CHUNKS} SELECT item_id AS chunk, cn.name FROM benchmark LEFT JOIN cn ON cn.id = 'chunk_' || item_id UNION ALL SELECT 1000000 + item_id, NULL FROM benchmark")
def chunk_lookup(t):
    wanted = t.benchmark.select(F.col("item_id").alias("chunk")).unionByName(t.benchmark.select((F.col("item_id") + 1000000).alias("chunk")))
    return B.chunk_by_id(wanted, _chunk_rows(t).select("id", "name")).select("chunk", "node.name")


# -- rows in and out of evaluation -------------------------------------------


@query(
    """WITH x AS (SELECT o_custkey AS id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY o_custkey),
    j AS (SELECT c_custkey AS id, last FROM customer LEFT JOIN x ON x.id = c_custkey) SELECT id, last, (SELECT count(*) - count(last) FROM j) AS missing FROM j"""
)
def graph_with_text(t):
    text = t.orders.select(F.col("o_custkey").alias("id"), F.struct("o_orderdate", "o_orderkey").alias("ord"), "o_orderkey")
    rows, missing = I.with_text(t.customer.select(F.col("c_custkey").alias("id")), text)
    return rows.select("id", F.col("text.o_orderkey").alias("last")).crossJoin(F.broadcast(missing.select("missing")))  # one row


@query("SELECT c_custkey AS id, c_acctbal, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_nationkey < 20")
def rows_in_all(t):
    ids = t.customer.where("c_nationkey < 20").select(F.col("c_custkey").alias("id"))
    n = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return I.in_all(ids, t.customer.select(F.col("c_custkey").alias("id"), "c_acctbal"), n)


@query("SELECT c_custkey AS id, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def pool_rows(t):
    return I.pool_rows(t.customer.select(F.col("c_custkey").alias("id")), t.orders.select(F.col("o_custkey").alias("id"), "o_orderkey"))


@query("SELECT l_orderkey AS id, l_linenumber, l_quantity, o_totalprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def mandatory_rows(t):
    """Every line must have its order; the operator raises where one is missing."""
    ids = t.lineitem.select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_quantity")
    return I.mandatory(ids, t.orders.select(F.col("o_orderkey").alias("id"), "o_totalprice"))


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN '__idx_' || (c_custkey - 1) ELSE c_custkey::VARCHAR END AS key, c_custkey - 1 AS ord, c_name FROM customer WHERE c_custkey - 1 < 500")
def keyed_in_order(t):
    """Rows by key, done in commits, put back in the order of the input; the first 500."""
    rows = t.customer.select((F.col("c_custkey") - 1).alias("ord"), I.row_key(F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey")), F.col("c_custkey") - 1).alias("key"), "c_name")
    first = I.prefix(rows, 500)
    done = None
    for part in I.in_commits(first, "key", 100):
        part = checkpoint(part.select("key", "c_name"))
        done = part if done is None else done.unionByName(part)
    return I.in_order(done, first).select("key", "ord", "c_name")


@query("SELECT p_partkey AS id, p_brand || ' ' || p_type AS query FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_partkey IN (1, 3)) AND p_size % 2 = 0 AND p_partkey % 5 > 0")
def chosen_chunks(t):
    books = [r[0] for r in t.part.where("p_partkey IN (1, 3)").select("p_brand").distinct().collect()]
    rows = t.part.select(
        F.col("p_partkey").alias("ord"), F.col("p_brand").alias("book"), F.when(F.col("p_size") % 2 == 0, "high").otherwise("low").alias("section_confidence"),
        F.when(F.col("p_partkey") % 5 > 0, F.array(F.lit(1999))).otherwise(F.array().cast("array<int>")).alias("years"), "p_brand", "p_type",
    )
    kept = I.choose_chunks(rows, books, ["high"], dated=True)
    return kept.select(F.col("ord").alias("id"), I.build_query(F.concat(F.lit(" "), "p_brand"), F.lit(None).cast("string"), F.col("p_type")).alias("query"))


@query(
    f"""WITH {_BM25}, e AS (SELECT query, doc, score, rank FROM bm WHERE rank <= 5) SELECT query, CASE WHEN doc % 5 = 0 THEN 'text_rank_' || rank WHEN doc % 2 = 0 THEN 's' || doc ELSE doc::VARCHAR END AS chunk, 'text' AS branch, '7' AS pages,
    score AS final, rank::INT AS text_rank FROM e UNION ALL SELECT o_custkey, o_orderkey::VARCHAR, 'graph', '', o_totalprice, NULL FROM orders"""
)
def evidence_shape(t):
    found = R.bm25(t.benchmark, t.documents, "item_id", "doc_id")
    text = found.select("query", F.when(F.col("doc") % 2 > 0, F.col("doc").cast("string")).otherwise("").alias("d"), F.concat(F.lit("s"), F.col("doc").cast("string")).alias("source"), "doc", "score", "rank", F.lit(7).alias("page"))
    lost = F.col("doc") % 5 == 0
    text = text.select("query", F.when(~lost, F.col("d")).alias("doc_id"), F.when(~lost, F.col("source")).alias("source"), "score", "rank", "page")
    graph = t.orders.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").cast("string").alias("chunk"), F.col("o_totalprice").alias("score"))
    rows = I.text_evidence(text).unionByName(I.graph_evidence(graph))
    return rows.select("query", "chunk", "branch", _list(F.col("pages")).alias("pages"), "final", "text_rank")


@query(
    f"""WITH {_BM25}, e AS (SELECT query, string_agg(doc::VARCHAR, '|' ORDER BY rank) AS docs FROM bm WHERE rank <= 3 GROUP BY query)
    SELECT item_id AS id, docs, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END AS n_gold FROM benchmark JOIN e ON query = item_id"""
)
def evaluation_inputs(t):
    claims = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("claim"), F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise("  ").alias("gold"))
    found = R.bm25(t.benchmark, t.documents, "item_id", "doc_id").withColumn("doc_id", F.col("doc"))
    a = I.text_input(claims, found, 3).select("id", _list(F.transform("evidence", lambda e: e["chunk"])).alias("docs"))
    return a.join(I.oracle_input(claims).select("id", F.size("evidence").alias("n_gold")), "id")


_IDS = ("item_id", "doc_id", "vec_id", "vec_id")


@query(
    f"""WITH {_BM25}, {_DENSE_ITEMS}, {_RRF} SELECT * FROM (SELECT query, doc, rrf AS score,
    row_number() OVER (PARTITION BY query ORDER BY rrf DESC, r1 ASC NULLS LAST, r2 ASC NULLS LAST) AS rank FROM rr) WHERE rank <= 5"""
)
def retrieve_by_method(t):
    return I.retrieve("hybrid", t.benchmark, t.documents, _item_vectors(t), t.embeddings, _IDS)


@query(f"WITH {_BM25} SELECT query, doc, score, rank FROM bm WHERE rank <= 3")
def online_without_vectors(t):
    return I.online(t.benchmark, t.documents, None, None, _IDS, k=3)


@query(f"SELECT s_suppkey AS id, pos, facet FROM supplier CROSS JOIN (SELECT unnest({E.FACETS}) AS facet, unnest(range(9)) AS pos)")
def empty_facets(t):
    """The nine facets of a claim in their fixed order, without values."""
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.posexplode(F.array(*map(F.lit, E.FACETS))).alias("pos", "facet"))


# -- verifiers with an offline model -----------------------------------------


def _client():
    return M.OfflineClient(lambda p: json.dumps({"label": "real" if "BUILDING" in p else "fake", "confidence": 0.75 if "[2]" in p else 0.5}))


@query("SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'real' ELSE 'fake' END AS label, 0.5 AS confidence FROM customer")
def verify_claim_only(t):
    return M.verify_claim_only(t.customer.select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(" buys for "), "c_mktsegment").alias("claim")), _client).select("id", "label", "confidence")


@query(
    """WITH o AS (SELECT o_custkey AS id, count(*) AS n, bool_or(r <= 3 AND o_orderpriority = '1-URGENT') AS u FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY o_custkey)
    SELECT c_custkey AS id, CASE WHEN coalesce(u, false) THEN 'real' ELSE 'fake' END AS label, CASE WHEN coalesce(n, 0) >= 2 THEN 0.75 ELSE 0.5 END AS confidence FROM customer LEFT JOIN o ON id = c_custkey"""
)
def verify_baseline(t):
    """The model says real where an urgent order is among the first three passages, and is surer of two."""
    passages = R.top(t.orders.select(F.col("o_custkey").alias("id"), "o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "BUILDING").otherwise("x").alias("text")), "id", "o_orderkey", k=5)
    return M.verify_baseline(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("claim")), passages, _client, most=3, batch=10).select("id", "label", "confidence")


# -- search texts and formats ------------------------------------------------


def _graph_nodes(t):
    side = lambda df, p, kind, k, n, d: df.select(F.concat(F.lit(p), k).alias("id"), F.lit(kind).alias("type"), F.col(n).alias("name"), F.col(d).alias("description"))
    return side(t.customer, "c", "Customer", "c_custkey", "c_name", "c_mktsegment").unionByName(side(t.supplier, "s", "Supplier", "s_suppkey", "s_name", "s_name"))


def _graph_edges(t):
    e = _edges(t)
    return e.select(F.concat_ws(">", "source", "target").alias("edge"), "source", "target", F.lit("BUYS").alias("type"), F.concat(F.lit(" weight  "), F.col("weight").cast("int").cast("string")).alias("description"), F.lit(None).cast("string").alias("evidence"), F.col("target").alias("chunk"))


@query(
    f"""WITH {_EDGES} SELECT source || '>' || target AS edge, 'BUYS weight ' || weight::INT || '  ' || c_name || ' ' || c_mktsegment || ' ' || s_name || ' ' || s_name AS text
    FROM e JOIN customer ON source = 'c' || c_custkey JOIN supplier ON target = 's' || s_suppkey"""
)
def edge_texts(t):
    return O.edge_text(_graph_edges(t), _graph_nodes(t))


@query("SELECT p_partkey AS id, 'Concept ' || p_name || ' ' || p_brand || ' ' || p_name || ' ' || p_type || ' a b c d 1999 2001' AS node, p_brand || '  ' || p_type || ' ' || p_name || ' ' AS chunk FROM part")
def search_texts(t):
    rows = t.part.select(
        F.col("p_partkey").alias("id"), F.lit("Concept").alias("type"), F.col("p_name").alias("name"), F.array("p_brand", "p_name").alias("aliases"), F.col("p_type").alias("description"),
        F.array(*map(F.lit, "abcx")).alias("samples"), F.array(F.lit("d")).alias("evidence_samples"), F.array(F.lit(1999), F.lit(2001)).alias("years"),
        F.col("p_brand").alias("book"), F.lit(None).cast("string").alias("chapter"), F.col("p_type").alias("section"), F.col("p_name").alias("text"), F.lit(" ").alias("contextual_text"),
    )
    return rows.select("id", O.node_text().alias("node"), O.chunk_text().alias("chunk"))


@query(
    f"""WITH {_EDGES}, f AS (SELECT c_custkey AS id, source, target, weight, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) AS rank FROM customer JOIN e ON source = 'c' || c_custkey WHERE c_custkey % 100 = 0)
    SELECT f.id, rank, source || '>' || target AS fact_id, 'Customer:' || c_name || '>Supplier:' || s_name AS ends, '2000' AS years, '1990|1995' AS chunk_years, '' AS evidence
    FROM f JOIN customer ON source = 'c' || c_custkey JOIN supplier ON target = 's' || s_suppkey WHERE rank <= 3"""
)
def fact_format(t):
    e = _edges(t).join(t.customer.where("c_custkey % 100 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.col("c_custkey").alias("id")), "source")
    found = R.top(e.select("id", F.concat_ws(">", "source", "target").alias("edge"), "target", F.col("weight").alias("score")), "id", F.desc("score"), "target", k=3)
    edges = _graph_edges(t)
    years = edges.select(F.lit("edge").alias("kind"), F.col("edge").alias("item"), F.array(F.lit(2000)).alias("years")).unionByName(
        t.supplier.select(F.lit("chunk").alias("kind"), F.concat(F.lit("s"), "s_suppkey").alias("item"), F.array(F.lit(1995), F.lit(1990)).alias("years"))
    )
    label = lambda c: F.concat_ws(":", f"fact.{c}.type", f"fact.{c}.name")
    rows = O.facts(found, edges, _graph_nodes(t), years)
    return rows.select("id", "rank", "fact.fact_id", F.concat_ws(">", label("source"), label("target")).alias("ends"), _list(F.col("fact.years")).alias("years"), _list(F.col("fact.source_chunk_years")).alias("chunk_years"), F.col("fact.evidence").alias("evidence"))


@query(
    f"""WITH {_EDGES}, f AS (SELECT c_custkey AS id, c_name, source, min(target) AS t, max(target) AS u FROM customer JOIN e ON source = 'c' || c_custkey WHERE c_custkey % 100 = 0 GROUP BY ALL HAVING min(target) <> max(target))
    SELECT id, 2 AS hops, a.s_name || '|' || c_name || '|' || b.s_name AS nodes, source || '>' || t || '|' || source || '>' || u AS edges FROM f JOIN supplier a ON t = 's' || a.s_suppkey JOIN supplier b ON u = 's' || b.s_suppkey"""
)
def path_format(t):
    own = t.customer.where("c_custkey % 100 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.col("c_custkey").alias("id"))
    two = _edges(t).join(own, "source").groupBy("id", "source").agg(F.min("target").alias("t"), F.max("target").alias("u")).where("t <> u")
    edge = lambda c: F.concat_ws(">", "source", c)
    found = two.select("id", F.lit("p").alias("path"), F.lit(1.0).alias("score"), F.array("t", "source", "u").alias("nodes"), F.array(edge("t"), edge("u")).alias("edges"))
    rows = O.paths(found, _graph_edges(t), _graph_nodes(t))
    return rows.select("id", "hops", _list(F.transform("nodes", lambda n: n["name"])).alias("nodes"), _list(F.transform("edges", lambda e: e["fact_id"])).alias("edges"))


@query("SELECT c_custkey AS id, o_orderkey AS chunk_id, year(o_orderdate)::VARCHAR AS years, '' AS chapter, o_orderpriority AS text FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 100 = 0")
def chunk_format(t):
    own = t.customer.where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("o_custkey"))
    found = t.orders.join(own, "o_custkey").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("chunk"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    none = F.lit(None).cast("string")
    rows = t.orders.select(F.col("o_orderkey").alias("chunk"), F.col("o_orderstatus").alias("book"), none.alias("chapter"), none.alias("section"), F.array().cast("array<int>").alias("pages"), F.col("o_orderpriority").alias("text"))
    out = O.chunks(found, rows, t.orders.select(F.col("o_orderkey").alias("chunk"), F.array(F.year("o_orderdate")).alias("years")))
    return out.select("id", "chunk.chunk_id", _list(F.col("chunk.years")).alias("years"), "chunk.chapter", "chunk.text")


# -- dense graph retrieval: odd vectors are nodes, even ones edges ------------

_DENSE_GRAPH = f"""ge AS (SELECT vec_id AS edge, 'n' || (vec_id + 1) AS source, 'n' || (vec_id * 3 % 100 * 2 + 1) AS target, CASE vec_id % 3 WHEN 0 THEN 'A' ELSE 'B' END AS type, (2000 + vec_id % 7)::INT AS y FROM embeddings WHERE vec_id % 2 = 0),
cl AS (SELECT vec_id AS id, (2000 + vec_id // 100 % 7)::INT AS y FROM embeddings WHERE vec_id % 100 = 0),
nd AS MATERIALIZED (SELECT a.vec_id AS id, 'n' || b.vec_id AS item, {_DOT} AS dense FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.vec_id % 2 = 1),
ed AS MATERIALIZED (SELECT a.vec_id AS id, b.vec_id AS item, {_DOT} AS dense FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.vec_id % 2 = 0),
inc AS (SELECT edge, source AS node, target AS other FROM ge UNION ALL SELECT edge, target, source FROM ge),
tn AS (SELECT id, item FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dense DESC, item) AS r FROM nd) WHERE r <= 5),
te AS (SELECT id, item AS edge FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dense DESC, item) AS r FROM ed) WHERE r <= 10),
sd AS (SELECT id, item AS node, 'dense_node_seed' AS reason FROM tn UNION ALL SELECT id, unnest([source, target]), 'edge_end' FROM te JOIN ge USING (edge) UNION ALL SELECT id, 'n1', 'alias_seed' FROM cl UNION ALL SELECT id, 'n' || vec_id, 'year_seed' FROM cl JOIN embeddings ON vec_id % 2 = 1 AND vec_id < 50 AND 2000 + vec_id % 9 = y),
ce AS (SELECT id, edge, 'dense_edge' AS reason FROM te UNION ALL SELECT id, edge, 'year_edge' FROM cl JOIN ge USING (y))"""


def _dense_graph(t):
    e = t.embeddings
    even, odd, asked = e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), e.where("vec_id % 100 = 0")
    no_words, year = F.array().cast("array<string>"), lambda c: F.array((2000 + c % 7).cast("int"))
    edges = even.select(
        F.col("vec_id").alias("edge"), F.concat(F.lit("n"), (F.col("vec_id") + 1).cast("string")).alias("source"), F.concat(F.lit("n"), (F.col("vec_id") * 3 % 100 * 2 + 1).cast("string")).alias("target"),
        F.when(F.col("vec_id") % 3 == 0, "A").otherwise("B").alias("type"), F.lit(None).cast("long").alias("chunk"), F.lit(0.5).alias("confidence"), F.lit("X").alias("source_type"), F.lit("X").alias("target_type"),
        year(F.col("vec_id")).alias("years"), no_words.alias("tokens"), F.lit(" ").alias("key"),
    )
    claims = asked.select(
        F.col("vec_id").alias("id"), F.array(F.lit("n1"), F.lit("unknown")).alias("nodes"), no_words.alias("node_types"), year(F.floor(F.col("vec_id") / 100)).alias("years"), no_words.alias("tokens"),
        no_words.alias("phrases"), F.array(F.lit("A")).alias("types"),
    )
    chunks = t.orders.limit(0).select(F.col("o_orderkey").alias("chunk"), F.array(F.year("o_orderdate")).alias("years"))
    node_years = odd.where("vec_id < 50").select(F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("node"), (2000 + F.col("vec_id") % 9).cast("int").alias("year"))
    vectors = {
        "claims": asked.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "edges": even.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector")),
        "nodes": odd.select(F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("item"), F.col("embedding").alias("vector")),
    }
    return claims, edges, chunks, node_years, vectors


@query(f"WITH {_DENSE_GRAPH} SELECT id, 'seed' AS kind, reason, count(*) AS n, min(node) AS first, max(node) AS last FROM sd GROUP BY ALL UNION ALL SELECT id, 'edge', reason, count(*), min(edge::VARCHAR), max(edge::VARCHAR) FROM ce GROUP BY ALL")
def dense_candidates(t):
    claims, edges, _, node_years, v = _dense_graph(t)
    seeds, found = D.seeds_and_edges(claims, edges, D.dense_scores(v["claims"], v["nodes"]), D.dense_scores(v["claims"], v["edges"]), node_years, 5, 10)
    count = lambda df, kind, c: df.groupBy("id", F.lit(kind).alias("kind"), "reason").agg(F.count(F.lit(1)).alias("n"), F.min(F.col(c).cast("string")).alias("first"), F.max(F.col(c).cast("string")).alias("last"))
    return count(seeds, "seed", "node").unionByName(count(found, "edge", "edge"))


_STEP = "greatest(st.dense, 0) + greatest(coalesce(nx.dense, 0), 0) * 0.25 + (ge.type = 'A')::INT * 0.3 + (ge.y = cl.y)::INT * 0.25 - 0.15 * least(1.0, dg.degree / 80.0)"
_PATHS = f"""dg AS (SELECT node, count(*) AS degree FROM inc GROUP BY node),
ss AS (SELECT id, node AS seed FROM (SELECT id, node, row_number() OVER (PARTITION BY id ORDER BY coalesce(dense, 0) DESC, node) AS r FROM (SELECT DISTINCT id, node FROM sd) LEFT JOIN nd USING (id) WHERE item = node OR item IS NULL) WHERE r <= 80),
st AS MATERIALIZED (SELECT * FROM (SELECT ed.id, inc.node, inc.edge, inc.other, ed.dense, row_number() OVER (PARTITION BY ed.id, inc.node ORDER BY ed.dense DESC, inc.edge) AS r FROM ed JOIN inc ON inc.edge = ed.item) WHERE r <= 20),
h1 AS MATERIALIZED (SELECT ss.id, seed, [seed, st.other] AS nodes, [st.edge::VARCHAR] AS edges, round({_STEP} - 0.2, 9) AS score FROM ss JOIN st ON st.id = ss.id AND st.node = seed JOIN ge USING (edge) JOIN cl ON cl.id = ss.id
    JOIN dg ON dg.node = st.other LEFT JOIN nd nx ON nx.id = ss.id AND nx.item = st.other WHERE st.other <> seed),
b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, seed ORDER BY score DESC, edges) AS r FROM h1) WHERE r <= 20),
h2 AS MATERIALIZED (SELECT b1.id, seed, list_append(nodes, st.other) AS nodes, list_append(edges, st.edge::VARCHAR) AS edges, round(b1.score + {_STEP} - 0.4, 9) AS score FROM b1 JOIN st ON st.id = b1.id AND st.node = nodes[-1] JOIN ge USING (edge) JOIN cl ON cl.id = b1.id
    JOIN dg ON dg.node = st.other LEFT JOIN nd nx ON nx.id = b1.id AND nx.item = st.other WHERE NOT list_contains(nodes, st.other)),
pa AS (SELECT id, nodes, edges, round(score, 4) AS score FROM h1 UNION ALL SELECT id, nodes, edges, round(score, 4) FROM h2)"""


@query(f"WITH {_DENSE_GRAPH}, {_PATHS.replace('80.0', '81.0')} SELECT id, array_to_string(nodes, '>') AS nodes, array_to_string(edges, '>') AS edges, score + 0 AS score FROM pa")
def dense_paths(t):
    claims, edges, _, node_years, v = _dense_graph(t)
    nodes, alike = checkpoint(D.dense_scores(v["claims"], v["nodes"])), checkpoint(D.dense_scores(v["claims"], v["edges"]))
    seeds, _ = D.seeds_and_edges(claims, edges, nodes, alike, node_years, 5, 10)
    return D.multihop(claims, edges, seeds, nodes, alike, checkpoint, max_degree=81).select("id", _list(F.col("nodes"), ">").alias("nodes"), _list(F.col("edges"), ">").alias("edges"), "score")


@query(
    f"""WITH {_DENSE_GRAPH}, {_PATHS}, bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, edges) AS r FROM pa) WHERE r <= 20),
    sp AS (SELECT id, edge, greatest(max(s), 0) AS support FROM (SELECT id, unnest(edges) AS edge, score / len(edges) AS s FROM bp) GROUP BY ALL),
    al AS (SELECT id, edge::VARCHAR AS edge FROM ce UNION SELECT id, unnest(edges) FROM bp),
    sc AS (SELECT al.id, al.edge, round(greatest(ed.dense, 0) * 12 + greatest(coalesce(a.dense, 0), coalesce(b.dense, 0), 0) * 4 + least(4.0, coalesce(support, 0) * 2) + 0.45 * (6 * ((source = 'n1')::INT + (target = 'n1')::INT) + 3 * (ge.y = cl.y)::INT + 3 * (type = 'A')::INT + 0.25), 4) AS score
        FROM al JOIN ge ON ge.edge::VARCHAR = al.edge JOIN cl ON cl.id = al.id JOIN ed ON ed.id = al.id AND ed.item = ge.edge LEFT JOIN sp ON sp.id = al.id AND sp.edge = al.edge
        LEFT JOIN nd a ON a.id = al.id AND a.item = source LEFT JOIN nd b ON b.id = al.id AND b.item = target)
    SELECT id, edge, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, edge) AS rank FROM sc WHERE score > 0) WHERE rank <= 8"""
)
def dense_facts(t):
    claims, edges, chunks, node_years, v = _dense_graph(t)
    found, _ = D.retrieve(claims, edges, chunks, node_years, v, checkpoint, top_nodes=5, top_edges=10)
    return found.select("id", "edge", "score", "rank")
