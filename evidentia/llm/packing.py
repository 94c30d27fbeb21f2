"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token ids, an end id is added, and only pieces longer than a sequence
are cut. The histogram of piece lengths has at most `capacity` entries whatever the
corpus. The configuration program (hold every length as often as it occurs by fractional
multiples of fillings of a sequence) is solved by multiplicative weights, priced by a
knapsack dynamic program over all lengths, until its value meets the bound of its prices.
The multiples are rounded down, and what that leaves, at most a sequence a column, is
packed best-fit.

The plan is a table of ranges: pieces of length l with ranks from a to b go to
sequences counted from s. Its size is bounded by the program, not by the corpus. Ranks
within a length are given by counting each task's pieces, so no length is gathered in
one task.

Defined cases: null text is empty text, a piece holding only the end id. Repeated rows
give repeated pieces, each with its own place. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sent, materialise, small_batches, table

CAPACITY = 1024
END_ID = 2
#: Rate at which prices fall, share of its pieces that a column may take in a round, how far below the
#: dearest a column may be, rounds at most, and gap between value and bound that counts as solved.
RATE, STEP, NEAR, ROUNDS, CLOSE = 0.05, 0.5, 0.005, 800, 0.001


# -- the program -------------------------------------------------------------

Filling = dict[int, int]  # length: multiple


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c], the highest price within c tokens, and the index of a piece that it ends with (-1: a token is left free).

    Dynamic programming over c; each step tries every length at once.
    """
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = upto[c]
        best[c] = best[c - 1]
        if k:
            found = best[c - lengths[:k]] + prices[:k]
            j = int(found.argmax())
            if found[j] > best[c] + 1e-12:
                best[c], last[c] = found[j], j
    return best, last


def _column(j: int, lengths: list[int], last: list[int], capacity: int) -> dict[int, int]:
    """The dearest filling that holds piece j, read back from the knapsack."""
    out, c = {j: 1}, capacity - lengths[j]
    while c > 0:
        k = last[c]
        if k < 0:
            c -= 1
        else:
            out[k] = out.get(k, 0) + 1
            c -= lengths[k]
    return out


def configuration_program(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """Fractional multiples of fillings that hold every length as often as it occurs, and a lower bound.

    Multiplicative weights on the covering program: each round prices all lengths; the knapsack gives the
    dearest filling for every piece, and those within NEAR of the dearest are taken as columns, least covered pieces
    first, each by STEP of what its scarcest piece allows; prices fall by exp(-RATE * coverage gained). Total price
    over the dearest filling's is a lower bound by duality. The multiples are scaled so that all is covered.
    """
    n, names = len(lengths), lengths.tolist()
    weights, covered = (lengths / capacity) ** 1.1, np.zeros(n)
    multiples: dict[tuple[tuple[int, int], ...], float] = {}
    bound, total, kept = float(lengths @ counts) / capacity, 0.0, None
    for _ in range(ROUNDS):
        best, last = knapsack(lengths, weights, capacity)
        top = best[capacity]
        bound = max(bound, float(weights @ counts) / top)
        ends, gained = last.tolist(), np.zeros(n)
        near = weights + best[capacity - lengths] >= (1 - NEAR) * top
        for j in np.argsort(covered, kind="stable").tolist():
            if near[j] and gained[j] < STEP:
                fill = _column(j, names, ends, capacity)
                times = STEP * min(counts[i] / m for i, m in fill.items())
                key = tuple(sorted(fill.items()))
                multiples[key] = multiples.get(key, 0.0) + times
                total += times
                for i, m in fill.items():
                    gained[i] += m * times / counts[i]
        covered += gained
        weights *= np.exp(-RATE * gained)
        weights /= weights.max()
        least = covered.min()
        if least > 0:
            value = total / least
            if kept is None or value < kept[0]:
                kept = (value, {k: x / least for k, x in multiples.items()})
            if value <= (1 + CLOSE) * bound + 1:
                break
    return (kept[1] if kept else {}), bound


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Fillings by best-fit decreasing, whole groups of equal sequences at a time."""
    room: dict[int, list[list]] = {}  # free tokens: [content, sequences]
    free: list[int] = []  # ascending

    def put(content: Filling, times: int) -> None:
        left = capacity - sum(a * m for a, m in content.items())
        if left not in room:
            room[left] = []
            bisect.insort(free, left)
        room[left].append([content, times])

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            k = bisect.bisect_left(free, length)
            if k == len(free):
                m = capacity // length
                if n >= m:
                    put({length: m}, n // m)
                if n % m:
                    put({length: n % m}, 1)
                break
            groups = room[free[k]]
            content, times = groups.pop()
            if not groups:
                del room[free.pop(k)]
            use = min(n, times)
            if times > use:
                put(content, times - use)
            put(content | {length: content.get(length, 0) + 1}, use)
            n -= use
    return [(content, times) for groups in room.values() for content, times in groups]


def rounded(multiples: dict[tuple[tuple[int, int], ...], float], lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Multiples rounded down to whole sequences of pieces that are there; the rest is packed best-fit."""
    left, out = counts.astype(np.int64).tolist(), []
    for key, x in sorted(multiples.items(), key=lambda kx: (-kx[1], kx[0])):
        times = min(int(x), *(left[i] // m for i, m in key))
        if times:
            out.append(({int(lengths[i]): m for i, m in key}, times))
            for i, m in key:
                left[i] -= m * times
    return out + best_fit({int(a): n for a, n in zip(lengths, left) if n}, capacity)


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[Filling, int]], float]:
    """Fillings with whole multiples that hold exactly the histogram, and a lower bound of the sequences:
    the rounded program, or best-fit decreasing over all where that needs fewer."""
    full, histogram = histogram.get(capacity, 0), {k: v for k, v in histogram.items() if 0 < k < capacity and v}
    out: list[tuple[Filling, int]] = [({capacity: 1}, full)] if full else []
    if not histogram:
        return out, float(full)
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[a] for a in lengths.tolist()], float)
    plain = best_fit(histogram, capacity)
    multiples, bound = configuration_program(lengths, counts, capacity)
    ways = [rounded(multiples, lengths, counts, capacity), plain]
    return out + min(ways, key=lambda p: sum(n for _, n in p)), full + bound


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Filling, int]]:
    return solve(histogram, capacity)[0]


class Ranges:
    """The plan by length: rank in the length to sequence and offset."""

    def __init__(self, fillings: list[tuple[dict[int, int], int]]):
        self.by_length: dict[int, list[np.ndarray]] = {}
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        at, sequence = {}, 0
        for fill, times in fillings:
            offset = 0
            for length, m in sorted(fill.items(), reverse=True):
                rows.setdefault(length, []).append((at.get(length, 0), m, sequence, offset))
                at[length] = at.get(length, 0) + m * times
                offset += m * length
            sequence += times
        self.by_length = {k: [np.array(c, np.int64) for c in zip(*v, strict=True)] for k, v in rows.items()}
        self.sequences = sequence

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, m, sequence, offset = self.by_length[length]
        k = np.searchsorted(first, rank, "right") - 1
        inside = rank - first[k]
        return sequence[k] + inside // m[k], offset[k] + (inside % m[k]) * length


# -- tokens ------------------------------------------------------------------


def _encoder(vocabulary: str):
    """ids(text), those of the tokenizers library for this file.

    The same vocabulary in tiktoken gives the same ids several times as fast and is used
    where it is present; a text that holds a special token's string goes to tokenizers.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    ranks = vocabulary.removesuffix(".json") + ".tiktoken"
    try:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
    except (ImportError, OSError):
        return lambda t: slow.encode(t, add_special_tokens=False).ids
    return lambda t: slow.encode(t, add_special_tokens=False).ids if "<|" in t else fast.encode_ordinary(t)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document, with the task (part) and rank within task and length (nth)."""
    small_batches(docs.sparkSession, 200)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, seen = _encoder(vocabulary), TaskContext.get().partitionId(), {}
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array(ids_of(t.as_py() or "") + [END_ID], "<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    n = seen.get(y - x, 0)
                    seen[y - x] = n + 1
                    rows.append((i, k, x, y - x, zlib.crc32(ids[x:y].tobytes()), part, n))
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    stored = materialise(pieces(docs, vocabulary, capacity), "pieces")
    tally = stored.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    tally = materialise(tally, "tally")
    histogram = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    ranges = Ranges(plan(histogram, capacity))
    from pyspark.sql import Window

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = tally.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    shared = Sent(docs.sparkSession, ranges)  # bounded by the program's fillings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy() + b.column(6).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for a in np.unique(length).tolist():
                here = length == a
                sequence[here], offset[here] = shared.value.place(a, rank[here])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    joined = stored.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "nth", "first")
    return joined.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())
