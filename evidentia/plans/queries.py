"""Queries of the evidence engine over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aliases as A
from ..operators import claims as C
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import segments as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that spark.checkpoint.dir names; in local mode a temporary one serves where it is unset."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not found and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="evidentia-"))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage as checkpoint does, in a compressed columnar file: later steps read the columns they need."""
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    path = f"{found or 'file://' + tempfile.mkdtemp(prefix='evidentia-')}/stored/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        with contextlib.suppress(Exception):  # the session may be gone by then
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(remove)
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()  # Spark deletes the shuffle files of a plan once it is garbage
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- retrieval ---------------------------------------------------------------

TOK = "list_filter(string_split(lower(trim(regexp_replace({0}, '[\\s]+', ' ', 'g'))), ' '), lambda w: w <> '')"
_BM25 = f"""
d AS (SELECT doc_id AS doc, {TOK.format('text')} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
p AS (SELECT doc, len(w) AS dl, unnest(w) AS term FROM d),
post AS (SELECT doc, dl, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, st GROUP BY term, n),
wt AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM df) ELSE idf END AS idf FROM df),
q AS (SELECT item_id AS query, unnest({TOK.format('text')}) AS term FROM benchmark),
qf AS (SELECT query, term, count(*) AS qf FROM q GROUP BY ALL),
sc AS (SELECT query, doc, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM qf JOIN post USING (term) JOIN wt USING (term), st GROUP BY ALL),
al AS (SELECT b.item_id AS query, d.doc, coalesce(sc.score, 0.0) AS score FROM benchmark b CROSS JOIN d LEFT JOIN sc ON sc.query = b.item_id AND sc.doc = d.doc),
bm AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc DESC) AS rank FROM al)"""


@query(f"WITH {_BM25} SELECT query, doc, score, rank FROM bm WHERE rank <= 5")
def bm25_topk(t):
    return R.bm25(t.benchmark, t.documents, "item_id", "doc_id")


_DOT = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2])), 6)"


@query(
    f"""SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS doc, {_DOT} AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id DESC) AS rank
    FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE rank <= 5"""
)
def dense_topk(t):
    return R.dense(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, "vec_id", "vec_id")


_DENSE_ITEMS = f"""de AS (SELECT a.vec_id AS query, b.vec_id AS doc,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id DESC) AS rank
    FROM embeddings a JOIN benchmark i ON i.item_id = a.vec_id, embeddings b)"""
_RRF = """u AS (SELECT coalesce(x.query, y.query) AS query, coalesce(x.doc, y.doc) AS doc, x.rank AS r1, y.rank AS r2
    FROM (SELECT * FROM bm WHERE rank <= 20) x FULL JOIN (SELECT * FROM de WHERE rank <= 20) y ON x.query = y.query AND x.doc = y.doc),
rr AS (SELECT query, doc, r1, r2, round(coalesce(1.0 / (60 + r1), 0.0) + coalesce(1.0 / (60 + r2), 0.0), 9) AS rrf FROM u)"""


def _item_vectors(t):
    return t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")


@query(
    f"""WITH {_BM25}, {_DENSE_ITEMS}, {_RRF} SELECT * FROM (SELECT query, doc, r1, r2, rrf,
    row_number() OVER (PARTITION BY query ORDER BY rrf DESC, r1 ASC NULLS LAST, r2 ASC NULLS LAST) AS rank FROM rr) WHERE rank <= 5"""
)
def rrf_hybrid(t):
    return R.rrf(R.bm25(t.benchmark, t.documents, "item_id", "doc_id", k=20), R.dense(_item_vectors(t), t.embeddings, "vec_id", "vec_id", k=20))


@query(
    f"""WITH {_BM25}, {_DENSE_ITEMS}, r AS (SELECT query, doc, 0 AS b, rank FROM bm WHERE rank <= 5 UNION ALL SELECT query, doc, 1, rank FROM de WHERE rank <= 3),
    o AS (SELECT *, row_number() OVER (PARTITION BY query, doc ORDER BY b, rank) AS k FROM r)
    SELECT query, doc, branch, source_rank, rank FROM (SELECT query, doc, CASE b WHEN 0 THEN 'text' ELSE 'graph' END AS branch, rank AS source_rank,
    row_number() OVER (PARTITION BY query ORDER BY b, rank, doc) AS rank FROM o WHERE k = 1) WHERE rank <= 8"""
)
def evidence_fusion(t):
    return R.fuse(R.bm25(t.benchmark, t.documents, "item_id", "doc_id"), R.dense(_item_vectors(t), t.embeddings, "vec_id", "vec_id", k=3), 5, 3, 8)


@query(
    f"""WITH {_BM25}, e AS (SELECT * FROM bm WHERE rank <= 5), h AS (SELECT doc, count(DISTINCT query) AS hub_freq FROM e GROUP BY doc)
    SELECT query, doc, score, rank, hub_freq, round(score / (1 + 0.15 * ln(1 + hub_freq)), 6) AS final FROM e JOIN h USING (doc)"""
)
def hub_rerank(t):
    return R.hub_penalty(R.bm25(t.benchmark, t.documents, "item_id", "doc_id"))


@query(f"WITH {_BM25} SELECT doc, count(*) AS n_claims, min(rank) AS best_rank FROM bm WHERE rank <= 5 GROUP BY doc")
def hub_counts(t):
    return R.bm25(t.benchmark, t.documents, "item_id", "doc_id").groupBy("doc").agg(F.count(F.lit(1)).alias("n_claims"), F.min("rank").alias("best_rank"))


_CONTENT = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 3)"


@query(
    f"""WITH w AS (SELECT doc_id AS doc, unnest(list_distinct({_CONTENT.format('text')})) AS term FROM documents),
    df AS (SELECT term, count(*) AS df FROM w GROUP BY term),
    a AS (SELECT item_id AS query, unnest(list_distinct({_CONTENT.format('text')})) AS term FROM benchmark),
    c AS (SELECT query, term FROM (SELECT query, term, row_number() OVER (PARTITION BY query ORDER BY df, term) AS r FROM a JOIN df USING (term)) WHERE r <= 20),
    f AS (SELECT term, doc FROM (SELECT term, doc, row_number() OVER (PARTITION BY term ORDER BY doc) AS r FROM w) WHERE r <= 50)
    SELECT query, doc, count(*) AS n_terms FROM c JOIN f USING (term) GROUP BY ALL"""
)
def keyword_candidates(t):
    return R.keyword_candidates(t.benchmark, t.documents, "item_id", "doc_id")


_COV = f"""g AS (SELECT item_id AS query, term, count(*) AS tf FROM (SELECT item_id, unnest({_CONTENT.format('text')}) AS term FROM benchmark) GROUP BY ALL),
    pt AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc_id AS doc, unnest({_CONTENT.format('text')}) AS term FROM documents) GROUP BY ALL)"""


def _counts(df, id_, name):
    return df.select(F.col(id_).alias(name), F.explode(T.content_tokens(F.col("text"))).alias("term")).groupBy(name, "term").agg(F.count(F.lit(1)).alias("tf"))


@query(
    f"""WITH {_BM25}, {_COV}, tot AS (SELECT query, sum(tf) AS total FROM g GROUP BY query),
    cv AS (SELECT b.query, b.doc, round(sum(least(g.tf, pt.tf)) / any_value(total), 6) AS coverage FROM bm b JOIN g ON g.query = b.query JOIN pt ON pt.doc = b.doc AND pt.term = g.term JOIN tot ON tot.query = b.query
           WHERE b.rank <= 5 GROUP BY b.query, b.doc)
    SELECT tot.query, coalesce(max(coverage), 0.0) AS best, coalesce(max(coverage), 0.0) >= 0.6 AS hit FROM tot LEFT JOIN cv USING (query) GROUP BY tot.query"""
)
def gold_hit_rate(t):
    gold = _counts(t.benchmark, "item_id", "query")
    top = R.bm25(t.benchmark, t.documents, "item_id", "doc_id").select("query", "doc")
    cov = R.coverage(gold, top.join(_counts(t.documents, "doc_id", "doc"), "doc"), ["query", "doc"])
    best = cov.groupBy("query").agg(F.max("coverage").alias("best"))
    out = gold.select("query").distinct().join(best, "query", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return out.withColumn("hit", F.col("best") >= 0.6)


@query(
    f"""WITH {_COV}, tot AS (SELECT query, sum(tf) AS total FROM g GROUP BY query),
    cv AS (SELECT query, doc, round(sum(least(g.tf, pt.tf)) / any_value(total), 6) AS coverage FROM g JOIN pt USING (term) JOIN tot USING (query) GROUP BY query, doc),
    m AS (SELECT query, max(coverage) AS best FROM cv GROUP BY query)
    SELECT count(*) AS n, count_if(best < 0.6) AS lost, round(count_if(best < 0.6) / count(*), 6) AS share, round(median(best), 6) AS middle FROM m"""
)
def structural_loss(t):
    gold = _counts(t.benchmark, "item_id", "query")
    # only the tokens of gold leave the corpus
    terms = _counts(t.documents, "doc_id", "doc").join(gold.select("term").distinct(), "term", "left_semi")
    passages = gold.select("query", "term").join(terms, "term")
    best = R.coverage(gold, passages, ["query", "doc"]).groupBy("query").agg(F.max("coverage").alias("best"))
    lost = F.count_if(F.col("best") < 0.6)
    return best.agg(F.count(F.lit(1)).alias("n"), lost.alias("lost"), F.round(lost / F.count(F.lit(1)), 6).alias("share"), F.round(F.median("best"), 6).alias("middle"))


# -- text --------------------------------------------------------------------


@query(r"SELECT doc_id, trim(regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM documents")
def normalize_key(t):
    return t.documents.select("doc_id", T.key(F.col("text")).alias("key"))


@query(f"SELECT doc_id, len(x) AS n_tokens, len(list_distinct(x)) AS n_distinct FROM (SELECT doc_id, {TOK.format('text')} AS x FROM documents)")
def token_stats(t):
    x = T.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(x).cast("long").alias("n_tokens"), F.size(F.array_distinct(x)).cast("long").alias("n_distinct"))


@query(
    r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '\d+'),
    lambda s: length(s) = 4 AND try_cast(s AS INT) BETWEEN 1000 AND 2099))), ',') AS years FROM documents"""
)
def text_years(t):
    return t.documents.select("doc_id", F.array_join(F.array_sort(T.years(F.col("text"))), ",").alias("years"))


@query(r"SELECT doc_id, round(CASE WHEN a > 0 THEN b / a ELSE 0 END, 6) AS ratio FROM (SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS a, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS b FROM documents)")
def uppercase_ratio(t):
    return t.documents.select("doc_id", F.round(T.uppercase_ratio(F.col("text")), 6).alias("ratio"))


@query(r"""SELECT doc_id, replace(strip_accents(replace(trim(regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}]+', ' ', 'g')), 'đ', 'd')), 'y', 'i') AS folded FROM documents""")
def fold_key(t):
    return t.documents.select("doc_id", T.fold_key(F.col("text")).alias("folded"))


@query()
def smart_crop(t):
    joined = R.bm25(t.benchmark, t.documents, "item_id", "doc_id", k=1).join(t.documents.select(F.col("doc_id").alias("doc"), "text"), "doc")
    joined = joined.join(t.benchmark.select(F.col("item_id").alias("query"), F.col("text").alias("claim")), "query")
    return joined.select("query", "doc", T.smart_crop(F.col("text"), F.col("claim"), 600).alias("crop"))


@query("SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'unparsed' WHEN length(html) < 1200 THEN 'too_short' WHEN regexp_matches(url, '[?]page=') THEN 'index_page' ELSE 'kept' END AS reason FROM pages")
def page_filter_reasons(t):
    reason = F.when(~F.col("url").rlike("^https?://"), "unparsed").when(F.length("html") < 1200, "too_short").when(F.col("url").rlike("[?]page="), "index_page").otherwise("kept")
    return t.pages.select("page_id", reason.alias("reason"))


# -- claims ------------------------------------------------------------------

_LAB = r"l AS (SELECT d.doc_id, trim(regexp_replace(lower(d.text), '[^\p{L}\p{N}]+', ' ', 'g')) AS key, l.quality AS label FROM documents d JOIN labels l USING (doc_id))"


def _labelled(t):
    return t.documents.join(t.labels, "doc_id").select("doc_id", T.key(F.col("text")).alias("key"), F.col("quality").alias("label"))


@query(f"WITH {_LAB}, g AS (SELECT key, min(doc_id) AS doc_id, count(DISTINCT label) AS k, count(*) AS n_rows FROM l GROUP BY key) SELECT doc_id, label, n_rows FROM g JOIN l USING (key, doc_id) WHERE k <= 1")
def claim_dedup(t):
    return C.dedup(_labelled(t), "key", "label", "doc_id").select("doc_id", "label", "n_rows")


@query(f"WITH {_LAB} SELECT min(doc_id) AS doc_id, count(*) AS n_rows, count(DISTINCT label) AS n_labels FROM l GROUP BY key HAVING count(DISTINCT label) > 1")
def label_conflicts(t):
    x = _labelled(t)
    first = x.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    return C.conflicts(x, "key", "label").join(first, "key").select("doc_id", "n_rows", "n_labels")


@query(f"WITH {_LAB}, g AS (SELECT key, count(DISTINCT label) AS k, count(*) AS n FROM l GROUP BY key) SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_keys, count_if(k > 1) AS n_conflicts, (sum(CASE WHEN k <= 1 THEN n - 1 ELSE 0 END))::BIGINT AS n_duplicates FROM g")
def claim_dedup_report(t):
    g = _labelled(t).groupBy("key").agg(F.countDistinct("label").alias("k"), F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("k") > 1).alias("n_conflicts"), F.sum(F.when(F.col("k") <= 1, F.col("n") - 1).otherwise(0)).alias("n_duplicates"))


@query("SELECT doc_id, concat_ws(',', CASE WHEN trim(coalesce(text, '')) = '' THEN 'text' END, CASE WHEN trim(coalesce(lang, '')) = '' THEN 'lang' END, CASE WHEN trim(coalesce(source, '')) = '' THEN 'source' END) AS missing FROM documents WHERE trim(coalesce(text, '')) = '' OR trim(coalesce(lang, '')) = '' OR trim(coalesce(source, '')) = ''")
def required_fields(t):
    return C.missing_fields(t.documents, "doc_id", ["text", "lang", "source"])


_CONF = "SELECT count_if(quality = 1 AND toxic = 1) AS tr, count_if(quality = 1 AND toxic = 0) AS ff, count_if(quality = 0 AND toxic = 1) AS fr, count_if(quality = 0 AND toxic = 0) AS tf, count_if(toxic IS NULL) AS unknown FROM labels"


@query(
    f"""SELECT *, round(coalesce((tr + tf) / nullif(tr + ff + fr + tf, 0), 0), 6) AS accuracy, round(coalesce(tr / nullif(tr + fr, 0), 0), 6) AS precision_real,
    round(coalesce(tr / nullif(tr + ff, 0), 0), 6) AS recall_real, round(coalesce(2 * tr / nullif(2 * tr + fr + ff, 0), 0), 6) AS f1_real,
    round(coalesce(tf / nullif(tf + ff, 0), 0), 6) AS precision_fake, round(coalesce(tf / nullif(tf + fr, 0), 0), 6) AS recall_fake,
    round(coalesce(2 * tf / nullif(2 * tf + fr + ff, 0), 0), 6) AS f1_fake FROM ({_CONF})"""
)
def confusion_matrix(t):
    return C.confusion(t.labels, "quality", "toxic")


@query(
    """WITH n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM documents JOIN labels USING (doc_id))
    SELECT doc_id, lang, idx FROM n WHERE n <= 20 OR idx IN (SELECT floor(i * n.n / 20) FROM range(20) r(i))"""
)
def stratified_systematic(t):
    return C.systematic(t.documents.join(t.labels, "doc_id").select("doc_id", "lang"), "lang", "doc_id", 20).select("doc_id", "lang", F.col("idx").cast("long").alias("idx"))


@query("SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS r FROM labels) WHERE (toxic = 1 AND r <= 20) OR (toxic = 0 AND r <= 21)")
def balanced_prefix(t):
    return C.balanced(t.labels.select("doc_id", "toxic"), "toxic", "doc_id", 41)


@query("SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r FROM labels) WHERE r <= 25")
def oracle_quota(t):
    return C.quota(t.labels.select("doc_id", "quality"), "quality", "doc_id", 25)


@query("SELECT lang, greatest(1, ceil(0.1 * count(*)))::BIGINT AS n FROM documents GROUP BY lang")
def stratified_random(t):
    return C.stratified_random(t.documents.select("doc_id", "lang"), "lang", "doc_id", 0.1).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE value > 0 AND event_type IS NOT NULL AND json_extract(props, '$.k')::INT >= 50)")
def resume_pending(t):
    done = t.events.where((F.col("value") > 0) & F.col("event_type").isNotNull() & (F.get_json_object("props", "$.k").cast("int") >= 50))
    return C.pending(t.events, done, "event_id").select("event_id", "event_type")


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), -1) AS k, CASE WHEN contains(lower(event_type), 'real') THEN 'real' WHEN contains(lower(event_type), 'fake') THEN 'fake' ELSE 'unknown' END AS label FROM events")
def response_parse(t):
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(-1))
    return t.events.select("event_id", k.alias("k"), T.label(F.col("event_type")).alias("label"))


# -- sequences ---------------------------------------------------------------

_LINES = "x AS (SELECT conv_id, turn, role = 'user' AS heading, length(text) % 5 = 0 AS ex, role = 'system' OR role = 'user' AND length(text) % 2 = 0 AS res FROM conversations)"


@query(
    f"""WITH {_LINES}, s AS (SELECT *, last_value(CASE WHEN ex THEN 'start' WHEN res THEN 'resume' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS state FROM x),
    k AS (SELECT *, NOT (ex OR coalesce(state = 'start', false)) AS kept FROM s)
    SELECT conv_id, turn, kept, (sum(CASE WHEN kept AND heading THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS section FROM k"""
)
def segment_sections(t):
    n = F.length("text")
    x = t.conversations.select("conv_id", "turn", (F.col("role") == "user").alias("h"), (n % 5 == 0).alias("e"), ((F.col("role") == "system") | (F.col("role") == "user") & (n % 2 == 0)).alias("r"))
    return S.sections(x, "conv_id", "turn", "h", "e", "r").select("conv_id", "turn", "kept", "section")


@query("SELECT conv_id, turn, lag(turn) OVER w AS prev_id, lead(turn) OVER w AS next_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def prev_next(t):
    return S.neighbours(t.conversations.select("conv_id", "turn"), "conv_id", "turn", "turn")


@query(r"SELECT conv_id, turn, CASE WHEN length(p) <= 200 THEN p ELSE regexp_replace(right(p, 200), '^\S* ', '') END AS overlap FROM (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)")
def tail_overlap(t):
    p = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", p.alias("p")).select("conv_id", "turn", T.tail(F.col("p"), 200).alias("overlap"))


@query(
    """WITH a AS (SELECT p_partkey, p_type, p_size % 3 AS k, row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_partkey) AS r FROM part)
    SELECT a.p_partkey, string_agg(b.p_partkey::VARCHAR, ',' ORDER BY b.p_partkey) AS members FROM a JOIN a b ON a.p_type = b.p_type AND a.k = b.k AND b.r BETWEEN a.r - 2 AND a.r + 2 GROUP BY a.p_partkey"""
)
def adjacent_window_groups(t):
    x = S.adjacent_groups(t.part.select("p_partkey", "p_name", "p_type", (F.col("p_size") % 3).alias("k")), ["p_name", "p_partkey"], "p_partkey", "k", "p_type")
    return x.select("p_partkey", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


# -- graph -------------------------------------------------------------------


@query("SELECT l_orderkey AS chunk, l_partkey AS entity, count(*) AS n_mentions, round(max(1 - l_discount), 6) AS confidence, any_value(p_name) AS names FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def mention_edges(t):
    m = t.lineitem.select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity_key"), (1 - F.col("l_discount")).alias("confidence"))
    return G.mention_edges(m, t.part.select(F.col("p_partkey").alias("entity_key"), F.col("p_partkey").alias("entity"), F.col("p_name").alias("name")))


@query("SELECT o_orderkey AS edge_id, c_nationkey AS source_entity, s_nationkey AS target_entity, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey")
def relation_edges(t):
    rel = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("edge_id"), F.col("l_linenumber").alias("line"), F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target")
    )
    to = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("mention"), F.col("c_nationkey").alias("entity")).unionByName(
        t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("mention"), F.col("s_nationkey").alias("entity"))
    )
    return G.relation_edges(rel, to).select("edge_id", "source_entity", "target_entity", "line")


@query("SELECT l_partkey, l_suppkey, l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def edge_dedup(t):
    return G.first_of(t.lineitem, ["l_partkey", "l_suppkey", "l_returnflag"], "l_orderkey", "l_linenumber").select("l_partkey", "l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber")


def _edges(t):
    """customer - supplier edges through orders, one a pair."""
    pairs = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return pairs.select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"), "l_extendedprice").groupBy("source", "target").agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    )


_EDGES = "e AS (SELECT 'c' || o_custkey AS source, 's' || l_suppkey AS target, count(*)::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"
_INC = "i AS (SELECT source AS node, target AS other, weight FROM e UNION ALL SELECT target, source, weight FROM e)"


@query(f"WITH {_EDGES}, {_INC} SELECT node, count(*) AS degree FROM i GROUP BY node")
def node_degree(t):
    return G.degrees(_edges(t))


@query(f"WITH {_EDGES}, {_INC} SELECT i.node, i.other, i.weight FROM i JOIN customer ON i.node = 'c' || c_custkey")
def one_hop(t):
    seeds = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return G.one_hop(seeds, _edges(t), "weight")


@query(
    f"""WITH {_EDGES}, {_INC}, n AS (SELECT DISTINCT node, other FROM i), c AS (SELECT node, other FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY other) AS r FROM n) WHERE r <= 60),
    s AS (SELECT c_nationkey % 5 AS query, 'c' || c_custkey AS node FROM customer WHERE c_custkey % 100 = 0), f AS MATERIALIZED (SELECT s.query, s.node AS a, c.other AS mid FROM s JOIN c USING (node)), l AS MATERIALIZED (SELECT s.query, c.node AS mid, s.node AS b FROM s JOIN c ON c.other = s.node)
    SELECT query, a, mid, b FROM f JOIN l USING (query, mid) WHERE a <> b"""
)
def two_hop_paths(t):
    seeds = t.customer.where("c_custkey % 100 = 0").select((F.col("c_nationkey") % 5).alias("query"), F.concat(F.lit("c"), "c_custkey").alias("node"))
    return G.two_hop(seeds, _edges(t))


@query(
    f"""WITH {_EDGES}, {_INC}, s AS (SELECT c_nationkey AS query, 'c' || c_custkey AS node FROM customer WHERE c_custkey % 100 = 0),
    p1 AS (SELECT query, node || '>' || other AS path, node, other, max(weight) AS score FROM s JOIN i USING (node) GROUP BY ALL),
    f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node, other) AS r FROM p1) WHERE r <= 20),
    p2 AS (SELECT f1.query, path || '>' || i.other AS path, f1.node, f1.other AS o1, i.other AS o2, max(score + weight) AS score FROM f1 JOIN i ON i.node = f1.other WHERE i.other <> f1.node GROUP BY ALL),
    f2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node, o1, o2) AS r FROM p2) WHERE r <= 20)
    SELECT query, path, score FROM f1 UNION ALL SELECT query, path, score FROM f2"""
)
def beam_paths(t):
    seeds = t.customer.where("c_custkey % 100 = 0").select(F.col("c_nationkey").alias("query"), F.concat(F.lit("c"), "c_custkey").alias("node"))
    return G.beam(seeds, _edges(t), 2, 20).select("query", F.array_join("path", ">").alias("path"), "score")


@query(
    f"""WITH {_EDGES}, n AS (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier)
    SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) - count(DISTINCT id) FROM n) AS repeated_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count_if(weight < 0) FROM e) AS no_evidence,
    (SELECT count(*) FROM e WHERE source NOT IN (SELECT id FROM n) OR target NOT IN (SELECT id FROM n)) AS broken_edges"""
)
def graph_integrity(t):
    nodes = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("id")).unionByName(t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id")))
    return G.integrity(nodes, _edges(t).select("source", "target", F.concat_ws(">", "source", "target").alias("edge_id"), F.lit("order").alias("evidence")))


@query("SELECT 'p' || p_partkey AS id, 'Part' AS type, p_name AS name, NULL::DOUBLE AS balance FROM part UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name, s_acctbal FROM supplier UNION ALL SELECT 'c' || c_custkey, 'Customer', c_name, c_acctbal FROM customer")
def nodes_union(t):
    f = lambda df, p, kind, k, n, *more: df.select(F.concat(F.lit(p), k).alias("id"), F.lit(kind).alias("type"), F.col(n).alias("name"), *more)
    out = f(t.part, "p", "Part", "p_partkey", "p_name").unionByName(f(t.supplier, "s", "Supplier", "s_suppkey", "s_name", F.col("s_acctbal").alias("balance")), allowMissingColumns=True)
    return out.unionByName(f(t.customer, "c", "Customer", "c_custkey", "c_name", F.col("c_acctbal").alias("balance")))


_IY = "y AS (SELECT 'order' AS kind, o_orderkey AS id, year(o_orderdate) AS year FROM orders UNION SELECT 'ship', l_orderkey, year(l_shipdate) FROM lineitem)"


def _item_year(t):
    a = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"))
    return a.union(t.lineitem.select(F.lit("ship"), "l_orderkey", F.year("l_shipdate"))).distinct()


@query(f"WITH {_IY} SELECT kind, id, string_agg(year::VARCHAR, ',' ORDER BY year) AS years FROM y GROUP BY kind, id")
def temporal_forward(t):
    return _item_year(t).groupBy("kind", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("year")), lambda v: v.cast("string")), ",").alias("years"))


@query(f"WITH {_IY} SELECT year, kind, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM y GROUP BY year, kind")
def temporal_reverse(t):
    return _item_year(t).groupBy("year", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(f"WITH {_IY} SELECT n_years, count(*) AS n_items FROM (SELECT kind, id, count(*) AS n_years FROM y GROUP BY ALL) GROUP BY n_years")
def year_histogram(t):
    return _item_year(t).groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n_years")).groupBy("n_years").agg(F.count(F.lit(1)).alias("n_items"))


@query(f"WITH {_IY} SELECT o_orderpriority AS query, y.kind, y.year, count(DISTINCT y.id) AS n FROM orders JOIN y ON y.year = year(o_orderdate) AND y.id = o_orderkey GROUP BY ALL")
def year_join(t):
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("query"))
    return o.join(_item_year(t), ["id", "year"]).groupBy("query", "kind", "year").agg(F.countDistinct("id").alias("n"))


@query("SELECT p_type, p_brand, count(*) AS n, min(p_partkey) AS first_id, round(avg(p_retailprice), 4) AS mean, round(max(p_retailprice), 4) AS best FROM part GROUP BY ALL")
def entity_merge(t):
    return t.part.groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_id"), F.round(F.avg("p_retailprice"), 4).alias("mean"), F.round(F.max("p_retailprice"), 4).alias("best"))


@query("SELECT l_orderkey, l_linenumber, r FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def entity_cap(t):
    return R.top(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey", F.desc("l_extendedprice"), "l_linenumber", k=3, name="r").drop("l_extendedprice")


_KIND = "CASE l_linenumber % 3 WHEN 0 THEN 'OCCURRED_AT' WHEN 1 THEN 'LOCATED_IN' ELSE 'PARTICIPATED_IN' END AS kind, CASE l_partkey % 5 WHEN 0 THEN 'Event' WHEN 1 THEN 'Place' WHEN 2 THEN 'Person' WHEN 3 THEN 'Time' ELSE 'Organization' END AS a, CASE l_suppkey % 3 WHEN 0 THEN 'Event' WHEN 1 THEN 'Place' ELSE 'Person' END AS b"


@query(
    f"""WITH k AS (SELECT l_orderkey, l_linenumber, {_KIND} FROM lineitem),
    w AS (SELECT *, (kind = 'OCCURRED_AT' AND a IN ('Place', 'Time') AND b = 'Event') OR (kind = 'PARTICIPATED_IN' AND a = 'Event' AND b IN ('Person', 'Organization')) AS swapped FROM k),
    x AS (SELECT *, CASE WHEN swapped THEN b ELSE a END AS s, CASE WHEN swapped THEN a ELSE b END AS t FROM w)
    SELECT l_orderkey, l_linenumber, swapped, CASE WHEN kind = 'OCCURRED_AT' AND s <> 'Event' THEN 'RELATED_TO' WHEN kind = 'LOCATED_IN' AND s = 'Event' AND t = 'Place' THEN 'OCCURRED_AT'
    WHEN kind = 'LOCATED_IN' AND NOT (s IN ('Place', 'Organization') AND t = 'Place') THEN 'RELATED_TO' WHEN kind = 'PARTICIPATED_IN' AND NOT (s IN ('Person', 'Organization') AND t = 'Event') THEN 'RELATED_TO' ELSE kind END AS type FROM x"""
)
def relation_repair(t):
    kind = F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'OCCURRED_AT' WHEN 1 THEN 'LOCATED_IN' ELSE 'PARTICIPATED_IN' END")
    a = F.expr("CASE l_partkey % 5 WHEN 0 THEN 'Event' WHEN 1 THEN 'Place' WHEN 2 THEN 'Person' WHEN 3 THEN 'Time' ELSE 'Organization' END")
    b = F.expr("CASE l_suppkey % 3 WHEN 0 THEN 'Event' WHEN 1 THEN 'Place' ELSE 'Person' END")
    out, swapped = G.repair_relation(kind, a, b)
    return t.lineitem.select("l_orderkey", "l_linenumber", swapped.alias("swapped"), out.alias("type"))


@query("WITH g AS (SELECT min(doc_id) AS label, text FROM documents GROUP BY text HAVING count(*) > 1) SELECT doc_id AS node, label FROM documents JOIN g USING (text)")
def connected_components(t):
    # each copy is tied to the smallest id of its text, found by digest; no group is gathered
    digests = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    first = digests.groupBy("h").agg(F.min("doc_id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = digests.join(first, "h").where("doc_id <> target").select(F.col("doc_id").alias("source"), "target")
    return G.components(edges, checkpoint)


@query()
def similarity_blocks(t):
    """Names that share a long token, in blocks of 2 to 25, by matching-blocks ratio."""
    names = t.part.select(F.col("p_partkey").alias("id"), T.key(F.col("p_name")).alias("name"))
    tok = names.select("id", "name", F.explode(F.array_distinct(F.split("name", " "))).alias("t")).where(F.length("t") >= 3)
    sizes = tok.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n BETWEEN 2 AND 25")
    tok = tok.join(sizes.select("t"), "t")
    pairs = tok.alias("a").join(tok.alias("b"), "t").where("a.id < b.id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.name").alias("x"), F.col("b.name").alias("y")).distinct()
    return pairs.select("a", "b", F.round(T.name_ratio("x", "y"), 6).alias("ratio")).where("ratio >= 0.85")


@query("SELECT lang, source, count(*) AS n, sum(length(text))::BIGINT AS chars, count(DISTINCT text) AS n_distinct FROM documents GROUP BY ALL")
def eda_report(t):
    return t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.countDistinct("text").alias("n_distinct"))


# -- aliases and paths -------------------------------------------------------


def _order_texts(t):
    """The part names of an order as a text."""
    names = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("id"), "l_linenumber", "p_name")
    return names.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))), lambda x: x["p_name"]), ", ").alias("text"))


@query()
def alias_match(t):
    aliases = t.part.select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"), F.col("p_size").alias("weight"))
    return A.matched(_order_texts(t), aliases)


@query(
    r"""WITH k AS (SELECT p_partkey, trim(regexp_replace(lower(p_type || ' ' || p_brand), '[^\p{L}\p{N}]+', ' ', 'g')) AS alias FROM part),
    f AS (SELECT DISTINCT trim(regexp_replace(lower(p_type), '[^\p{L}\p{N}]+', ' ', 'g')) AS key, p_type AS id FROM part)
    SELECT DISTINCT f.id, k.p_partkey AS entity, k.alias FROM f JOIN k ON contains(' ' || k.alias || ' ', ' ' || f.key || ' ') AND f.key <> k.alias WHERE length(f.key) >= 6"""
)
def alias_substring(t):
    facets = t.part.select(F.col("p_type").alias("id"), F.col("p_type").alias("text")).distinct()
    return A.within_longer(facets, t.part.select(F.col("p_partkey").alias("entity"), F.concat_ws(" ", "p_type", "p_brand").alias("name")))


@query(
    r"""WITH m AS (SELECT p_brand AS type, p_type AS name, p_size / 50.0 AS confidence, trim(regexp_replace(lower(p_type), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM part),
    n AS (SELECT type, key, name, count(*) AS n, sum(confidence) AS c FROM m GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY type, key ORDER BY n DESC, length(name), lower(name), name) AS r FROM n)
    SELECT type, key, max(CASE WHEN r = 1 THEN name END) AS name, sum(n)::BIGINT AS n_mentions, count(*) AS n_names, round(sum(c) / sum(n), 4) AS confidence FROM r GROUP BY type, key"""
)
def representatives(t):
    return A.representatives(t.part.select(F.col("p_brand").alias("type"), F.col("p_type").alias("name"), (F.col("p_size") / 50.0).alias("confidence")))


@query()
def text_split(t):
    return t.documents.select("doc_id", F.posexplode(A.split_text(F.col("text"), 2200, 200)).alias("piece", "text"))


@query(
    f"""WITH {_EDGES}, s AS (SELECT c_nationkey AS query, 'c' || c_custkey AS node FROM customer UNION ALL SELECT s_nationkey, 's' || s_suppkey FROM supplier)
    SELECT a.query, e.source, e.target, e.weight FROM e JOIN s a ON a.node = e.source JOIN s b ON b.node = e.target AND a.query = b.query"""
)
def typed_paths(t):
    seeds = t.customer.select(F.col("c_nationkey").alias("query"), F.concat(F.lit("c"), "c_custkey").alias("node"))
    seeds = seeds.unionByName(t.supplier.select(F.col("s_nationkey").alias("query"), F.concat(F.lit("s"), "s_suppkey").alias("node")))
    ends = lambda c: seeds.withColumnRenamed("node", c)
    return _edges(t).join(ends("source"), "source").join(ends("target"), ["target", "query"]).select("query", "source", "target", "weight")


@query(
    f"""WITH {_EDGES}, {_INC}, d AS (SELECT node, count(*) AS degree FROM i GROUP BY node)
    SELECT source, target, round(least(1.0, ln(1 + weight) / ln(4)) * 0.45 + 0.25 / (1 + 0.15 * ln(1 + a.degree)) + 0.2 / (1 + 0.15 * ln(1 + b.degree)), 6) AS score
    FROM e JOIN d a ON a.node = e.source JOIN d b ON b.node = e.target"""
)
def edge_score(t):
    e = _edges(t)
    d = G.degrees(e)
    e = e.join(d.select(F.col("node").alias("source"), F.col("degree").alias("da")), "source").join(d.select(F.col("node").alias("target"), F.col("degree").alias("db")), "target")
    hub = lambda c: 1 + 0.15 * F.log1p(c)
    return e.select("source", "target", F.round(F.least(F.lit(1.0), F.log1p("weight") / F.log(F.lit(4.0))) * 0.45 + 0.25 / hub("da") + 0.2 / hub("db"), 6).alias("score"))
