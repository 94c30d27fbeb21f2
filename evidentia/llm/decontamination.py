"""Benchmark decontamination by a distributed positional inverted index.

Indexing: each task cuts its documents into segments of bounded size and writes one row
a segment to the shared folder: the documents, and for every term of theirs, as a 64-bit
hash, the ascending positions where it stands (positions run through the segment, with a
gap after each document, so no match crosses documents). The index knows nothing of the
tests: it is built once and searched for any of them.

Searching: in each segment, windows of which some term has no postings are put aside by
one look-up of the tests' terms. Each other window starts from its rarest term's list and
is intersected with the offset-adjusted lists of its other terms, from rare to frequent;
all windows take these steps together, as arrays, CANDIDATES positions at a time.
Proximity search intersects the same lists within a slack.

The tests are read and sent in blocks of at most BLOCK_WORDS words, one block at a time;
longer items are cut into overlapping pieces. Each block passes over the stored index
once more, so driver and tasks hold one block however many items there are. Two words of
one hash would count as equal: for ten million of the tests' words against ten thousand
million of the documents' the odds are under 1 %, and a window needs all its terms.

Defined cases: null and empty texts have no words: 0, 0, 0, the digest of the empty
string, false. An item without words has no window. Repeated document rows are separate
rows alike; rows without doc_id stay. Items that repeat an item_id count once; items
without one count as one item named "null". Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sent, materialise, small_batches, table

WINDOW = 10
#: Words of a segment's documents, at which the segment is closed.
SEGMENT_WORDS = 600_000
#: Words of the tests in one block (some 400 bytes a word in a task at most, while its windows are ordered).
BLOCK_WORDS = 500_000
#: Positions that are intersected at a time, or one window's rarest list if that is longer.
CANDIDATES = 1_000_000
#: Distinct words whose hashes a task remembers.
REMEMBERED = 300_000

# A-Z to a-z, other ASCII but digits and a-z to a space
_PLAIN = str.maketrans({chr(c): chr(c).lower() if chr(c).isalnum() else " " for c in range(128)})


def words_of(text: str | None) -> list[str]:
    return [w for w in text.translate(_PLAIN).split(" ") if w] if text else []


class Hasher:
    """64-bit hashes of words; the latest words are remembered."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        import xxhash

        seen = self.seen
        if len(seen) > REMEMBERED:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


# -- tests -------------------------------------------------------------------


class Block:
    """The windows of some items: rows of places in the sorted terms, -1 after the last; equal windows share a row."""

    def __init__(self, pieces: list[tuple[str, np.ndarray]], window: int = WINDOW):
        self.window = window
        self.terms = np.unique(np.concatenate([h for _, h in pieces] or [np.zeros(0, np.uint64)]))
        names: dict[str, int] = {}
        rows, owner = [np.zeros((0, window), np.int32)], []
        for item, h in pieces:
            at = np.searchsorted(self.terms, h).astype(np.int32)
            if len(at) >= window:
                new = np.lib.stride_tricks.sliding_window_view(at, window)
            elif len(at):
                new = np.append(at, np.full(window - len(at), -1, np.int32))[None, :]
            else:
                continue
            rows.append(new)
            owner.append(np.full(len(new), names.setdefault(item, len(names)), np.int64))
        self.rows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.rows >= 0).sum(1)
        self.names = np.array(list(names), object)
        # items of a window: owners[offsets[w] : offsets[w + 1]]
        pairs = np.unique(np.stack([which.reshape(-1), np.concatenate([np.zeros(0, np.int64), *owner])]), axis=1)
        self.owners, self.offsets = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.rows) + 1))


def blocks_of(tests: DataFrame, window: int = WINDOW) -> Iterator[Block]:
    """All items in blocks of at most BLOCK_WORDS words; at least one block."""
    hasher, pieces, words, any_yet = Hasher(), [], 0, False
    step = max(1, BLOCK_WORDS - window + 1)
    rows = tests.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").dropDuplicates()
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        h = hasher(words_of(r["text"]))
        for a in range(0, max(1, len(h) - window + 1), step):
            piece = h[a : a + step + window - 1]
            if pieces and words + len(piece) > BLOCK_WORDS:
                yield Block(pieces, window)
                pieces, words, any_yet = [], 0, True
            pieces.append((r["item_id"], piece))
            words += len(piece)
    if pieces or not any_yet:
        yield Block(pieces, window)


# -- index -------------------------------------------------------------------

SCHEMA = "segment long, ids binary, starts binary, lengths binary, terms binary, offsets binary, postings binary"
_NULL = np.iinfo(np.int64).min


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS, window: int = WINDOW) -> DataFrame:
    """The stored index over all docs, for windows of up to `window` words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hasher, segment = Hasher(), TaskContext.get().partitionId() << 32
        ids, lengths, found, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            size = np.array(lengths, np.int64)
            starts = np.cumsum(size + window) - (size + window)
            h = np.concatenate(found)
            order = np.argsort(h, kind="stable")
            terms, first = np.unique(h[order], return_index=True)
            at = (np.arange(len(h)) + np.repeat(np.arange(len(size)) * window, size))[order]
            parts = (
                np.array([_NULL if i is None else i for i in ids], np.int64),
                starts.astype(np.uint32),
                size.astype(np.uint32),
                terms,
                np.append(first, len(h)).astype(np.uint32),
                np.diff(at, prepend=0).astype(np.uint32),  # steps between positions, wrapping at the next term
            )
            arrays = [pa.array([segment], pa.int64()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]]
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = hasher(words_of(t.as_py()))
                ids.append(i)
                lengths.append(len(h))
                found.append(h)
                n += len(h) + window
                if n >= segment_words:
                    yield close()
                    ids, lengths, found, n, segment = [], [], [], 0, segment + 1
        if ids:
            yield close()

    return materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA), "postings")


class Segment:
    def __init__(self, segment: int, ids: bytes, starts: bytes, lengths: bytes, terms: bytes, offsets: bytes, postings: bytes):
        self.segment, self.ids = segment, np.frombuffer(ids, np.int64)
        self.starts, self.lengths = np.frombuffer(starts, np.uint32).astype(np.int64), np.frombuffer(lengths, np.uint32).astype(np.int64)
        self.terms, self.offsets = np.frombuffer(terms, np.uint64), np.frombuffer(offsets, np.uint32).astype(np.int64)
        self.counts = np.diff(self.offsets)
        self.postings = np.cumsum(np.frombuffer(postings, np.uint32), dtype=np.uint32).astype(np.int64)
        self.size = int(self.starts[-1] + self.lengths[-1])

    def matches(self, block: Block, slack: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and the positions where they stand; with slack, each term within slack words of its
        place, counted from the window's rarest term, and in the same document."""
        if not len(self.terms) or not len(block.rows):
            return
        rank = np.minimum(np.searchsorted(self.terms, block.terms), len(self.terms) - 1)
        count = np.append(np.where(self.terms[rank] == block.terms, self.counts[rank], 0), np.iinfo(np.int64).max)
        alive = np.flatnonzero(count[block.rows].min(1) > 0)
        rows = block.rows[alive]
        order = np.argsort(count[rows], axis=1, kind="stable")
        rows = np.take_along_axis(rows, order, 1)
        sizes = count[rows[:, 0]]
        # every posting as (term, position) in one ascending list: one search intersects all windows
        key = np.repeat(np.arange(len(self.terms), dtype=np.int64) << 32, self.counts) + self.postings
        total = np.cumsum(sizes)
        a = 0
        while a < len(alive):
            b = max(a + 1, int(np.searchsorted(total, total[a] - sizes[a] + CANDIDATES, "right")))
            n = sizes[a:b]
            w = np.repeat(np.arange(a, b), n)
            within = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
            stand = self.postings[self.offsets[rank[rows[w, 0]]] + within]
            start = stand - order[w, 0]
            if slack:
                doc = np.searchsorted(self.starts, stand, "right") - 1
                low, high = self.starts[doc], self.starts[doc] + self.lengths[doc] - 1
            for j in range(1, block.window):
                if not len(w):
                    break
                term, at = rows[w, j], start + order[w, j]
                base = rank[term].astype(np.int64) << 32
                if slack:
                    least, most = np.maximum(at - slack, low), np.minimum(at + slack, high)
                else:
                    least = most = at
                k = np.searchsorted(key, base + np.maximum(least, 0))
                ok = (term < 0) | (k < len(key)) & (key[np.minimum(k, len(key) - 1)] <= base + most)
                w, start = w[ok], start[ok]
                if slack:
                    low, high = low[ok], high[ok]
            if len(w):
                yield alive[w], start
            a = b


# -- searches ----------------------------------------------------------------


def _spread(block: Block, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in windows, and the items that hold the window there."""
    n = block.offsets[windows + 1] - block.offsets[windows]
    place = np.repeat(np.arange(len(windows)), n)
    within = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
    return place, block.owners[block.offsets[windows[place]] + within]


def phrase_matches(index: DataFrame, block: Block, slack: int = 0) -> DataFrame:
    """doc_id, item_id (as a string), start, length: where windows stand exactly, or within slack words."""
    shared = Sent(index.sparkSession, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for b in batches:
            for row in b.to_pylist():
                seg = Segment(**row)
                for windows, at in seg.matches(block, slack):
                    # a slack may put the start before the document; the window's middle is in it or next to it
                    d = np.maximum(np.searchsorted(seg.starts, at, "right") - 1, 0)
                    if slack:
                        after = np.minimum(d + 1, len(seg.starts) - 1)
                        d = np.where(at >= seg.starts[d] + seg.lengths[d], after, d)
                    place, owner = _spread(block, windows)
                    ids = pa.array(seg.ids[d][place], mask=seg.ids[d][place] == _NULL)
                    out = [ids, pa.array(block.names[owner], pa.string()), pa.array((at - seg.starts[d])[place]), pa.array(block.lengths[windows][place].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "item_id", "start", "length"])

    return index.mapInArrow(run, "doc_id long, item_id string, start long, length long")


_FOUND = "segment long, place int, doc_id long, n_words long, runs array<struct<s:int,e:int>>, items array<string>"


def _found(index: DataFrame, sent: Sent, every: bool) -> DataFrame:
    """The documents that hold a window of the block, or all: their hit runs of words, and the items."""

    def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for b in batches:
            for row in b.to_pylist():
                seg = Segment(**row)
                cover = np.zeros(seg.size + block.window + 1, np.int32)
                held = [np.zeros((2, 0), np.int64)]
                for windows, at in seg.matches(block):
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + block.lengths[windows], -1)
                    d = np.searchsorted(seg.starts, at, "right") - 1
                    once = np.unique(d * len(block.rows) + windows)
                    place, owner = _spread(block, once % len(block.rows))
                    held.append(np.unique(np.stack([once[place] // len(block.rows), owner]), axis=1))
                edge = np.diff(np.cumsum(cover) > 0, prepend=False).nonzero()[0]
                begin, end = edge[::2], edge[1::2]
                of = np.searchsorted(seg.starts, begin, "right") - 1
                doc, owner = np.unique(np.concatenate(held, axis=1), axis=1)
                some = np.arange(len(seg.ids)) if every else np.unique(of)
                n = len(seg.ids)
                parts = [pa.array((x - seg.starts[of]).astype(np.int32)) for x in (begin, end)]
                out = [
                    pa.array(np.full(len(some), seg.segment)),
                    pa.array(some.astype(np.int32)),
                    pa.array(seg.ids[some], mask=seg.ids[some] == _NULL),
                    pa.array(seg.lengths[some]),
                    lists(np.bincount(of, minlength=n)[some], pa.StructArray.from_arrays(parts, names=["s", "e"])),
                    lists(np.bincount(doc, minlength=n)[some], pa.array(block.names[owner], pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in _FOUND.split(", ")[:6]])

    return index.mapInArrow(run, _FOUND)


def contamination(docs: DataFrame, tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    spark = docs.sparkSession
    index, blocks = build_index(docs, window=window), blocks_of(tests, window)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        found = _found(index, Sent(spark, block), True)
    else:
        parts = [_found(index, Sent(spark, Block([], window)), True)]
        while block is not None:
            sent = Sent(spark, block)
            parts.append(materialise(_found(index, sent, False), "found"))
            sent.close()
            block, after = after, next(blocks, None)
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        # a document has at most one row a block
        merged = [F.flatten(F.collect_list(c)).alias(c) for c in ("runs", "items")]
        found = found.groupBy("segment", "place").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *merged)
    items = F.array_sort(F.array_distinct("items"))
    # hit words: the union of the runs
    add = lambda x, r: F.struct((x["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(r["s"], x["end"]))).alias("n"), F.greatest(x["end"], r["e"]).alias("end"))
    hit = F.aggregate(F.array_sort("runs"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), add)["n"].cast("long")
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), items.alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
