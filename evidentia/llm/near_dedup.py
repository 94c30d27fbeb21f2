"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A document's signature is SYMBOLS minima of BITS bits each. It is split into chunks of
CHUNK symbols. By the pigeonhole principle two signatures that differ in fewer than
2 * chunks symbols differ in at most one symbol of some chunk; so each chunk is indexed
under CHUNK keys, each with one symbol left out, and every pair under that distance
meets under some key (at similarity 0.8 a pair fails to meet with odds of about 1e-7).

No bucket's pairs are all made:
1. documents with equal shingle sets form a class, represented by its smallest id;
2. in STARS rounds every bucket has a leader; each member is tested against the closest
   of its leaders, and confirmed links are merged into components;
3. only buckets that still hold several components are searched whole, in blocks of
   bounded size, for pairs of different components with close signatures, each pair in
   the first bucket that it shares. Pairs within the largest component are not compared,
   and a task stops testing pairs of components that it has joined; it returns links only.
Each link is confirmed on the full shingle sets.

Defined cases: null, empty and white texts have no shingles, are linked with nothing and
kept. Fewer words than a shingle form one shingle. doc_id identifies a document: repeated
rows are alike. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small_batches, table
from .components import components

SYMBOLS, BITS, CHUNK = 60, 16, 5
CHUNKS = SYMBOLS // CHUNK
#: Differing symbols up to which every pair meets.
GUARANTEED = 2 * CHUNKS - 1
#: Differing symbols up to which a pair that met goes on to the full sets.
LOOSE = 30
#: Members of a bucket that one task compares with as many others.
BLOCK = 1024
#: Shingles of a block's members together (8 bytes each).
BLOCK_SHINGLES = 250_000
#: Rounds in which buckets have leaders.
STARS = 2
SHINGLE, SIMILARITY = 5, 80

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 2**64, SYMBOLS, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingles of a text."""

    def __init__(self, size: int):
        self.size, self.seen = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = _WORD.findall(text.translate(_LOWER)) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        seen = self.seen
        if len(seen) > 300_000:
            seen.clear()
        for w in set(words):
            if w not in seen:
                seen[w] = xxhash.xxh3_64_intdigest(w.encode())
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(h))
        with np.errstate(over="ignore"):
            out = h[: len(h) - size + 1].copy()
            for k in range(1, size):
                out = out * _P + h[k : len(h) - size + 1 + k]
            return np.unique(_mix(out + np.uint64(size)))


def signature(shingles: np.ndarray) -> np.ndarray:
    best = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), 1024):
            x = shingles[None, k : k + 1024] ^ _XOR[:, None]
            x *= _MUL[:, None]
            np.minimum(best, x.min(1), out=best)
        return (_mix(best) & np.uint64(2**BITS - 1)).astype(np.uint16)


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """Keys of n signatures, n x CHUNKS x CHUNK: chunk c without its symbol j."""
    with np.errstate(over="ignore"):
        x = signatures.reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
        out = np.empty(x.shape, np.uint64)
        for j in range(CHUNK):
            h = np.arange(CHUNKS, dtype=np.uint64)[None] * np.uint64(CHUNK) + np.uint64(j + 1)
            h = np.broadcast_to(h, x.shape[:2]).copy()
            for k in range(CHUNK):
                if k != j:
                    h = _mix(h * _P + x[:, :, k])
            out[:, :, j] = h
    return out.view(np.int64)


def first_bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of signatures, the number c * CHUNK + j of the first bucket that they share, or -1."""
    same = (a == b).reshape(len(a), CHUNKS, CHUNK)
    close = same.sum(2) >= CHUNK - 1
    c = close.argmax(1)
    here = same[np.arange(len(a)), c]
    j = np.where(here.all(1), 0, (~here).argmax(1))
    return np.where(close.any(1), c * CHUNK + j, -1)


_SIGNED = "doc_id long, n_shingles long, set_hash binary, signature binary"


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """n_shingles, a hash of the set and the signature of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        of = Shingler(shingle)
        for b in batches:
            sizes, hashes, signatures = [], [], []
            for t in b.column(1):
                s = of(t.as_py())
                sizes.append(len(s))
                hashes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(signatures, pa.binary())],
                names=["doc_id", "n_shingles", "set_hash", "signature"],
            )

    return materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SIGNED), "signed")


def _keys(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                k = keys_of(sig)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k.reshape(-1)), pa.array(np.repeat(b.column(0).to_numpy(), SYMBOLS)), pa.array(np.tile(np.arange(SYMBOLS, dtype=np.int16), len(sig)))],
                    names=["key", "rep", "bucket"],
                )

    return classes.select("rep", "signature").mapInArrow(run, "key long, rep long, bucket short")


def _distance(rows: DataFrame) -> DataFrame:
    """Adds the number of differing symbols of columns sa and sb, and drops them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x != y).sum(1).astype(np.int32))], names=["a", "b", "distance"])

    return rows.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, distance int")


def confirmed(full: DataFrame, pairs: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= similarity * union, on the full sets (doc_id, set)."""
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if 100 * min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(full.select(F.col("doc_id").alias("a"), F.col("set").alias("xa")), "a").join(full.select(F.col("doc_id").alias("b"), F.col("set").alias("xb")), "b")
    return joined.select("a", "b", "xa", "xb").mapInArrow(test, "a long, b long")


_MEETING = "key long, i int, j int, block int, rep long, label long, bucket short, signature binary"
_FULL = _MEETING + ", set binary"


def _grouped(rows: DataFrame, schema: str, work, out: str) -> DataFrame:
    """work(columns of one (key, i, j)) for each group of rows sorted by it; yields its batches."""
    names = [x.split()[0] for x in schema.split(", ")]

    def change(t: pa.Table) -> np.ndarray:
        key = [t.column(c).to_numpy() for c in ("key", "i", "j")]
        return np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ends = [0, *change(t).tolist(), t.num_rows]
        cols = {c: t.column(c).to_numpy() for c in names if c not in ("signature", "set")}
        cols["signature"] = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        label = cols["label"]
        for x, y in zip(ends, ends[1:]):
            if y - x > 1 and (label[x:y] != label[x]).any():
                yield from work({c: v[x:y] for c, v in cols.items()}, t.slice(x, y - x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []  # of the last group, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            cuts = change(t)
            first = [parts[-1].column(k)[-1].as_py() for k in range(3)] if parts else None
            if not len(cuts) and (first is None or first == [b.column(k)[0].as_py() for k in range(3)]):
                parts.append(b)
                continue
            cut = int(cuts[-1]) if len(cuts) else 0
            yield from done(pa.Table.from_batches([*parts, *([b.slice(0, cut)] if cut else [])]))
            parts = [b.slice(cut)]
        if parts:
            yield from done(pa.Table.from_batches(parts))

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select(*names).mapInArrow(run, out)


def _close_pairs(g: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of one group that hold different components with close signatures, whose first shared
    bucket this is: (left rows, right rows, distances), a few left rows at a time."""
    rep, label, block, sig = g["rep"], g["label"], g["block"], g["signature"]
    i, j, bucket = g["i"][0], g["j"][0], g["bucket"][0]
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if not len(left) or not len(right):
        return
    step = max(1, 20_000 // len(right))
    for k in range(0, len(left), step):
        part = left[k : k + step]
        far = (sig[part][:, None] != sig[right][None]).sum(2, dtype=np.int32)
        x, y = np.nonzero((far <= LOOSE) & (label[part][:, None] != label[right][None]))
        far, x, y = far[x, y], part[x], right[y]
        own = first_bucket(sig[x], sig[y]) == bucket
        if i == j:
            own &= rep[x] < rep[y]
        if own.any():
            yield x[own], y[own], far[own]


def _meeting(g: dict[str, np.ndarray], t: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of a group that have a close pair in it."""
    some = np.zeros(t.num_rows, bool)
    for x, y, _ in _close_pairs(g):
        some[x] = some[y] = True
    if some.any():
        yield from t.filter(pa.array(some)).combine_chunks().to_batches()


def _linked(similarity: int):
    """Confirmed links between components of a group; a pair is skipped once its sides are joined."""

    def work(g: dict[str, np.ndarray], t: pa.Table) -> Iterator[pa.RecordBatch]:
        rep, label, parent, found = g["rep"], g["label"].tolist(), {}, []
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("set")]

        def top(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = v = parent[parent[v]]
            return v

        for xs, ys, far in _close_pairs(g):
            order = np.argsort(far, kind="stable")
            for x, y in zip(xs[order].tolist(), ys[order].tolist(), strict=True):
                p, q = top(label[x]), top(label[y])
                m, n = len(sets[x]), len(sets[y])
                if p == q or 100 * min(m, n) < similarity * max(m, n):
                    continue
                k = np.searchsorted(sets[y], sets[x])
                both = int((sets[y][np.minimum(k, n - 1)] == sets[x]).sum())
                if 100 * both >= similarity * (m + n - both):
                    parent[p] = q
                    found.append((int(rep[x]), int(rep[y])))
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return work


def _blocks(labelled: DataFrame) -> DataFrame:
    """The buckets that hold several components, dealt into meetings (key, i, j).

    Members of a bucket's largest component are dealt into blocks after those of the others
    and never meet each other; every other pair of blocks meets.
    """
    parts = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    size = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("w") / BLOCK_SHINGLES))
    tops = parts.groupBy("key").agg(F.max(F.struct("n", "w", "label")).alias("top"), F.sum("n").alias("all_n"), F.sum("w").alias("all_w"), F.count(F.lit(1)).alias("labels"))
    tops = tops.where("labels > 1").select("key", F.col("top.label").alias("main"), F.col("top.n").alias("n"), F.col("top.w").alias("w"), "all_n", "all_w")
    tops = tops.withColumn("bm", size.cast("int")).withColumn("n", F.col("all_n") - F.col("n")).withColumn("w", F.col("all_w") - F.col("w")).withColumn("bo", size.cast("int"))
    tops = materialise(tops.select("key", "main", "bm", "bo"), "mixed")
    rows, inner = labelled.join(tops, "key"), F.col("label") == F.col("main")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(inner, F.col("bm")).otherwise(F.col("bo"))).cast("int") + F.when(inner, F.col("bo")).otherwise(0))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inner, F.col("bo")).otherwise(F.col("bo") + F.col("bm")) - 1)))
    return rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "label", "bucket")


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """doc_id, set for the documents of ids."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(shingle)
        for b in batches:
            for k in range(0, b.num_rows, 100):
                part = b.slice(k, 100)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([of(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], names=["doc_id", "set"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi")
    return materialise(rows.mapInArrow(sets, "doc_id long, set binary").dropDuplicates(["doc_id"]), "sets")


def near_components(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    rows = signed(docs, shingle)
    classes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    classes = materialise(classes, "classes")
    keys = materialise(_keys(classes), "keys")
    several = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    sig = classes.select("rep", "signature", "n_shingles")
    met = materialise(keys.join(several.select("key"), "key").join(sig.select("rep", "n_shingles"), "rep"), "met")
    first = classes.select(F.col("rep").alias("node"), F.col("rep").alias("label")).limit(0)
    full = _sets(docs, met.select(F.col("rep").alias("doc_id")).distinct(), shingle)
    links = None
    for k in range(STARS):  # each member with the closest of its leaders, where those are of other components
        labelled = met.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        labelled = materialise(labelled.select("key", "rep", "bucket", "label", "n_shingles"), "labelled")
        order = F.col("rep") if k == 0 else F.xxhash64("rep", F.lit(k))
        leaders = labelled.groupBy("key").agg(F.min(F.struct(order.alias("o"), "rep", "label")).alias("l"))
        leaders = materialise(leaders.select("key", F.col("l.rep").alias("leader"), F.col("l.label").alias("own")), "leaders")
        stars = labelled.join(leaders, "key").where("label <> own").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
        stars = stars.join(sig.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a").join(sig.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b")
        closest = _distance(stars).where(F.col("distance") <= LOOSE).groupBy("b").agg(F.min(F.struct("distance", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
        new = materialise(confirmed(full, materialise(closest, "stars"), similarity), "links")
        links = new if links is None else links.unionByName(new)
        first = components(links)

    # buckets that still hold several components are searched whole
    labelled = met.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    labelled = materialise(labelled.select("key", "rep", "bucket", "label", "n_shingles"), "labelled")
    rows_ = _blocks(labelled).join(sig.select("rep", "signature"), "rep")
    meeting = materialise(_grouped(rows_, _MEETING, _meeting, _MEETING), "meeting")
    more = materialise(_grouped(meeting.join(full.withColumnRenamed("doc_id", "rep"), "rep"), _FULL, _linked(similarity), "a long, b long"), "links")

    # components of components
    to = first.select(F.col("node"), F.col("label"))
    lifted = (
        more.join(to.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
        .join(to.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
        .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    )
    second = components(lifted)
    final = classes.select("set_hash", "rep").join(to.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", F.coalesce("label", "rep").alias("node"))
    final = final.join(second, "node", "left").select("set_hash", F.coalesce("label", "node").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set_hash").join(final, "set_hash", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), shingle=2)
