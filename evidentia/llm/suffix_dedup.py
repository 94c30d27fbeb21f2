"""Removal of repeated byte strings by a distributed merge sort of suffixes.

Every LENGTH-byte string (window) has an anchor: the leftmost smallest of the hashes at
its first SPAN positions. Equal windows have equal anchors at equal offsets, so it is
enough to bring together the suffixes that start at anchors (about one in SPAN / 2
bytes): those that share the CORE bytes after the anchor, which lie in all its windows.

1. Hashes of cores are counted, and only anchors whose core occurs twice are kept.
2. Each task sorts its suffixes by bucket of core, folds those of equal context into one,
   and writes front-coded runs: of each suffix the common prefix with the one before it
   and the rest.
3. A bucket's runs are combined by a loser tree that carries the common prefix of each
   head with the last suffix put out: heads are told apart by those lengths, and bytes are
   compared only beyond them. Suffixes that share their core come out together, and the
   windows around their anchors are compared byte for byte.
Cores with more than HOT suffixes are not brought together: each task folds their equal
windows byte for byte, and what is left meets by a 128-bit hash of the window, counted
before the exchange, so no task holds such a group or one hot window's holders.

Defined cases: null text is empty text (0 bytes, digest of nothing). Texts under LENGTH
bytes lose nothing. Rows that repeat a document are copies of it and lose all that is
LENGTH bytes long. doc_id identifies a document; each row without one is a document of
its own, and its result has no doc_id either. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_scratch, materialise, named, small_batches, table

LENGTH, SPAN = 200, 128
CORE = LENGTH - SPAN + 1
#: Suffixes of one core beyond which its windows are dealt out one by one.
HOT = 20_000
#: Bytes of context that a bucket should hold.
BUCKET_BYTES = 16 << 20
#: Windows of a text that are looked at together.
SLAB = 1 << 22

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))



def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, first and last window start, hash of the core; windows in order."""
    out, n = [], len(data) - LENGTH + 1
    for x in range(0, max(0, n), SLAB):
        m = min(SLAB, n - x)
        part = data[x : x + m + LENGTH - 1]
        padded = np.frombuffer(part + bytes(24), np.uint8)
        w = np.ndarray((len(part) + 16,), "<u8", padded, 0, (1,))
        with np.errstate(over="ignore"):
            k = m + SPAN - 1
            h = _mix(w[:k] ^ (w[8 : k + 8] * _B))
            h = (h & ~np.uint64(0xFFFFFF)) | np.arange(k, dtype=np.uint64)
            blocks = -(-k // SPAN)
            full = np.full(blocks * SPAN, np.iinfo(np.uint64).max, np.uint64)
            full[:k] = h
            grid = full.reshape(blocks, SPAN)
            pre = np.minimum.accumulate(grid, 1).reshape(-1)
            suf = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
            low = np.minimum(suf[:m], pre[SPAN - 1 : SPAN - 1 + m]) & np.uint64(0xFFFFFF)
            first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
            last = np.append(first[1:], m) - 1
            a = low[first].astype(np.int64)
            key = np.zeros(len(a), np.uint64)
            for o in [*range(0, CORE - 7, 8), CORE - 8]:
                key = _mix(key * _A + w[a + o])
        out.append((a + x, first + x, last + x, key.view(np.int64)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _anchored(docs: DataFrame, work, schema: str) -> DataFrame:
    """work(ids, anchors of each text) for each batch, as columns of schema."""
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = [anchors((t.as_py() or "").encode()) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in work(b.column(0).to_pylist(), found)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def repeated_cores(docs: DataFrame) -> DataFrame:
    """core, n: the cores that occur twice. Anchors of other cores are never stored."""

    def count(_: list[int], found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([f[3] for f in found]), return_counts=True)

    counts = _anchored(docs, count, "core long, n long")
    return materialise(counts.groupBy("core").agg(F.sum("n").alias("n")).where("n > 1"), "cores")


def anchor_table(docs: DataFrame) -> DataFrame:
    """doc_id, core, at: every anchor; at holds its place and the bytes to its first and last window."""

    def rows(ids: list[int], found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        a, lo, hi, core = (np.concatenate(c) for c in zip(*found, strict=True))
        return np.repeat(np.array(ids, np.int64), [len(f[0]) for f in found]), core, a << 16 | (a - lo) << 8 | (hi - lo)

    return _anchored(docs, rows, "doc_id long, core long, at long")


# -- front-coded runs --------------------------------------------------------

Entry = tuple[bytes, bytes, int, int]  # suffix, bytes before it, doc_id (-1: several), first window


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, given that it is at least at."""
    n = min(len(a), len(b))
    while at + 16 <= n and a[at : at + 16] == b[at : at + 16]:
        at += 16
    while at < n and a[at] == b[at]:
        at += 1
    return at


def front_code(run: list[Entry]) -> bytes:
    """A sorted run: common prefixes with the entry before, and the rest."""
    heads, tails, last, last_left = [], [], b"", b""
    for suffix, left, doc, lo in run:
        back = left[::-1]
        p, q = common(last, suffix), common(last_left, back)
        heads.append((p, len(suffix) - p, q, len(back) - q, doc, lo))
        tails += [suffix[p:], back[q:]]
        last, last_left = suffix, back
    h = np.array(heads, np.int64).reshape(-1, 6)
    small = h[:, :4].astype("<u2").tobytes()
    return struct.pack("<I", len(h)) + small + h[:, 4].astype("<i8").tobytes() + h[:, 5].astype("<i4").tobytes() + b"".join(tails)


def decode(blob: bytes) -> tuple[list[Entry], list[int]]:
    """The run and its common prefixes, as they were written."""
    n = struct.unpack_from("<I", blob)[0]
    small = np.frombuffer(blob, "<u2", 4 * n, 4).reshape(n, 4).tolist()
    docs = np.frombuffer(blob, "<i8", n, 4 + 8 * n).tolist()
    los = np.frombuffer(blob, "<i4", n, 4 + 16 * n).tolist()
    at, last, back, out = 4 + 20 * n, b"", b"", []
    for (p, k, q, j), d, lo in zip(small, docs, los, strict=True):
        last = last[:p] + blob[at : at + k]
        at += k
        back = back[:q] + blob[at : at + j]
        at += j
        out.append((last, back[::-1], d, lo))
    return out, [s[0] for s in small]


class LoserTree:
    """Merges sorted runs with their common prefixes.

    lcp[i] is the common prefix of run i's head with the winner that it last lost to (at
    the start, with the empty string). Of two heads the one with the longer such prefix
    is smaller; only equal ones are compared, from there on.
    """

    def __init__(self, runs: list[tuple[list[Entry], list[int]]]):
        self.runs, k = runs, 1
        while k < len(runs):
            k *= 2
        self.k, self.at = k, [0] * k
        self.head: list[bytes | None] = [r[0][0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
        self.lcp, self.loser = [0] * k, [0] * k
        self.compared = 0
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        w, lost = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.loser[node] = lost
        return w

    def _play(self, i: int, j: int) -> tuple[int, int]:
        x, y = self.head[i], self.head[j]
        if x is None:
            return j, i
        if y is None:
            return i, j
        p, q = self.lcp[i], self.lcp[j]
        if p != q:
            return (i, j) if p > q else (j, i)
        c = common(x, y, p)
        self.compared += c - p + 1
        if c == len(x) or c < len(y) and x[c] < y[c]:
            self.lcp[j] = c
            return i, j
        self.lcp[i] = c
        return j, i

    def __iter__(self) -> Iterator[tuple[int, Entry]]:
        """(common prefix with the entry before, entry) in order."""
        while self.head[w := self.winner] is not None:
            entries, lcps = self.runs[w]
            yield self.lcp[w], entries[self.at[w]]
            self.at[w] += 1
            n = self.at[w]
            self.head[w] = entries[n][0] if n < len(entries) else None
            self.lcp[w] = lcps[n] if n < len(entries) else 0
            node = (w + self.k) // 2
            while node:
                w, self.loser[node] = self._play(w, self.loser[node])
                node //= 2
            self.winner = w


def repeated(group: list[Entry]) -> Iterator[tuple[int, int, int]]:
    """(doc_id, first, last window) of the windows in a group of one core that occur twice."""
    contexts: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
    for suffix, left, doc, lo in group:
        contexts.setdefault((left, suffix), []).append((doc, lo))
    unique = []
    for (left, suffix), members in contexts.items():
        some = len(members) > 1 or members[0][0] == -1
        if some:
            for doc, lo in members:
                if doc != -1:
                    yield doc, lo, lo + len(left) + len(suffix) - LENGTH
        unique.append((left + suffix, len(left), len(left) + len(suffix) - LENGTH, None if some else members[0]))
    if len(unique) < 2:
        return
    hits: dict[int, list[int]] = {}
    for d in range(SPAN):
        seen: dict[bytes, int] = {}
        for k, (text, before, last, _) in enumerate(unique):
            s = before - d
            if 0 <= s <= last:
                other = seen.setdefault(text[s : s + LENGTH], k)
                if other != k:
                    hits.setdefault(k, []).append(s)
                    if not (x := hits.setdefault(other, [])) or x[-1] != s_of(unique[other], d):
                        x.append(s_of(unique[other], d))
    for k, starts in hits.items():
        if (member := unique[k][3]) is not None:
            doc, lo = member
            starts = sorted(set(starts))
            first = prev = starts[0]
            for s in [*starts[1:], None]:
                if s is None or s != prev + 1:
                    yield doc, lo + first, lo + prev
                    first = s
                prev = s


def s_of(context: tuple[bytes, int, int, tuple[int, int] | None], d: int) -> int:
    return context[1] - d


_OUT = "bucket long, doc_id long, blob binary"


def _spans(found: dict[int, list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    if found:
        blobs = [np.array(v, "<i4").tobytes() for v in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array([-1] * len(blobs), pa.int64()), pa.array(list(found), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "doc_id", "blob"])


#: A task writes its runs when its contexts reach so many bytes.
RUN_BYTES = 48 << 20


def sorted_runs(texts: DataFrame, buckets: int) -> DataFrame:
    """From (doc_id, text, anchors) the front-coded runs of each bucket (bucket >= 0), the windows of hot
    cores (bucket -2: records of digest, document and start) and what repeats within a task (bucket -1)."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[Entry]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            known: dict[int, list[tuple[int, int]]] = {}
            windows: dict[bytes, tuple[int, int]] = {}  # a window's one holder here, or -1 for several
            for bucket, entries in sorted(rows.items()):
                entries.sort()
                folded: list[Entry] = []
                x = 0
                while x < len(entries):
                    y = x + 1
                    suffix, left = entries[x][:2]
                    while y < len(entries) and entries[y][0] == suffix and entries[y][1] == left:
                        y += 1
                    if y - x > 1:
                        for _, _, doc, lo in entries[x:y]:
                            known.setdefault(doc, []).append((lo, lo + len(left) + len(suffix) - LENGTH))
                        folded.append((suffix, left, -1, 0))
                    else:
                        folded.append(entries[x])
                    x = y
                if bucket >= 0:
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([None], pa.int64()), pa.array([front_code(folded)], pa.binary())], names=["bucket", "doc_id", "blob"])
                    continue
                for suffix, left, doc, lo in folded:
                    text = left + suffix
                    for s in range(len(text) - LENGTH + 1):
                        w = text[s : s + LENGTH]
                        if w not in windows:
                            windows[w] = (doc, lo + s)
                            continue
                        for d, at in (windows[w], (doc, lo + s)):  # equal bytes, told within the task
                            if d >= 0:
                                known.setdefault(d, []).append((at, at))
                        windows[w] = (-1, 0)
            blobs = [xxhash.xxh3_128_digest(w) + struct.pack("<qi", doc, at) for w, (doc, at) in windows.items()]
            if blobs:
                yield pa.RecordBatch.from_arrays([pa.array([-2], pa.int64()), pa.array([None], pa.int64()), pa.array([b"".join(blobs)], pa.binary())], names=["bucket", "doc_id", "blob"])
            yield from _spans(known)

        for b in batches:
            for i, t, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                data = (t.as_py() or "").encode()
                for f in found:
                    at = f["at"]
                    a, lo = at >> 16, (at >> 16) - (at >> 8 & 255)
                    hi = lo + (at & 255)
                    bucket = -2 if f["hot"] else f["core"] % buckets
                    rows.setdefault(bucket, []).append((data[a : hi + LENGTH], data[lo:a], i, lo))
                    size += (hi - lo + 1) * (LENGTH + 100) if f["hot"] else hi + LENGTH - lo + 150
                if size > RUN_BYTES:
                    yield from flush()
                    rows, size = {}, 0
        yield from flush()

    return materialise(texts.select("doc_id", "text", "anchors").mapInArrow(run, _OUT), "runs")


def merged(runs: DataFrame) -> DataFrame:
    """doc_id, blob: the windows that repeat, from the merge of each bucket's runs."""

    def work(t: pa.Table) -> pa.Table:
        found: dict[int, list[tuple[int, int]]] = {}
        group: list[Entry] = []

        def close() -> None:
            if len(group) > 1:
                for doc, a, b in repeated(group):
                    found.setdefault(doc, []).append((a, b))

        for lcp, entry in LoserTree([decode(x.as_py()) for x in t.column("blob")]):
            if lcp < CORE and group:
                close()
                group = []
            group.append(entry)
        close()
        return pa.Table.from_batches(list(_spans(found)), pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("blob", pa.binary())]))

    return runs.where("bucket >= 0").groupBy("bucket").applyInArrow(work, _OUT).select("doc_id", "blob")


def hot_windows(runs: DataFrame) -> DataFrame:
    """doc_id, blob: the windows of hot cores that several tasks hold. Tasks have folded equal windows, counts
    are added up before the exchange, and the holders meet them in a join that can be split."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([("h", "<i8"), ("g", "<i8"), ("doc", "<i8"), ("at", "<i4")])
        for b in batches:
            for blob in b.column(0):
                x = np.frombuffer(blob.as_py(), kind)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[c])) for c in kind.names], names=list(kind.names))

    rows = runs.where("bucket = -2").select("blob").mapInArrow(unpack, "h long, g long, doc long, at int")
    several = rows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g")
    held = rows.where("doc >= 0").join(several, ["h", "g"]).select(F.col("doc").alias("doc_id"), "at")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = np.repeat(b.column(1).to_numpy().astype("<i4"), 2).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.tobytes() for p in pairs], pa.binary())], names=["doc_id", "blob"])

    return held.mapInArrow(spans, "doc_id long, blob binary")


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(data: bytes, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs."""
    mark = np.zeros(len(data) + 1, np.int32)
    for blob in blobs:
        s = np.frombuffer(blob, "<i4").reshape(-1, 2)
        np.add.at(mark, s[:, 0], 1)
        np.add.at(mark, np.minimum(s[:, 1] + LENGTH, len(data)), -1)
    cover = np.concatenate([[0], (np.cumsum(mark)[:-1] > 0).astype(np.int8), [0]])
    edge = np.diff(cover)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, blobs: for documents that hold repeated windows, their starts as pairs of int32."""
    cores = repeated_cores(docs)
    total = cores.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * 300 // BUCKET_BYTES))
    few = anchor_table(docs).join(cores, "core").groupBy("doc_id").agg(F.collect_list(F.struct("at", "core", (F.col("n") > HOT).alias("hot"))).alias("anchors"))
    few = materialise(few, "anchors")
    drop_scratch(cores)
    runs = sorted_runs(docs.select("doc_id", "text").join(few, "doc_id"), buckets)
    drop_scratch(few)
    found = runs.where("bucket = -1").select("doc_id", "blob").unionByName(merged(runs)).unionByName(hot_windows(runs))
    found = materialise(found, "found")
    drop_scratch(runs)
    return found.groupBy("doc_id").agg(F.collect_list("blob").alias("blobs"))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    docs = named(docs)
    marked = docs.select("doc_id", "text", "unnamed").join(repeated_windows(docs), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, blobs in zip(b.column(1), b.column(2), strict=True):
                data = (t.as_py() or "").encode()
                start, end = _removed(data, blobs.as_py() or [])
                keep = b"".join(data[x:y] for x, y in zip([0, *end.tolist()], [*start.tolist(), len(data)], strict=True))
                out.append((len(data), len(data) - len(keep), len(start), hashlib.sha256(keep).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[x.split()[0] for x in _RESULT.split(", ")])

    rows = marked.select(F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"), "text", "blobs")
    return rows.mapInArrow(run, _RESULT)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
