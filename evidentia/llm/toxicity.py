"""Toxicity score: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs to Latin letters and reads digits and signs
between letters as the letters they stand for. The lexicon holds whole words and
word beginnings with log-odds weights, learned from labelled rows outside the
held-out fold. A hit counts unless an exception phrase (a word pair that clean rows
use) covers it. The sum of weights is normalised by length and put through a
logistic curve fitted on the same rows.

Labels are read from at most MAX_TRAIN rows, those of smallest hash of their id (the
bound is a parameter); scoring covers every row and whole texts.

Defined cases: null and empty texts have no hits and get the score of zero weight.
Repeated rows are scored alike. Without labels or without both classes the score is
0.0 for every row. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sent, materialise, small_batches, table

#: At most so many labelled rows teach the lexicon.
MAX_TRAIN = 6000
#: At most so many entries; the lexicon is sent to every task.
MAX_ENTRIES = 3000
FOLDS = 5
#: Log-odds that an entry has at least.
LEAST_WEIGHT = 3.0
PREFIXES = (3, 4, 5, 6, 7)

#: Letters of other scripts that look like Latin ones (fixed values).
HOMOGLYPHS = dict(
    zip(
        "аеорсухіјѕԁһԛαεορυνικıɡᴏ",
        "aeopcyxijsdhqaeopuvikigo",
        strict=True,
    )
) | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
#: Digits and signs read as letters (fixed values).
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_TABLE = {ord(k): v for k, v in HOMOGLYPHS.items()} | {0x200B: None, 0x200C: None, 0x200D: None, 0xAD: None}
#: At most three in a row, between letters, or digits at one end of a word.
_LEET = re.compile(r"(?<=[^\W\d_])[0134578@$!]{1,3}(?=[^\W\d_])|(?<![\w@$!])[0134578]{1,2}(?=[^\W\d_])|(?<=[^\W\d_])[0134578]{1,2}(?![\w@$!])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    out = text.lower()
    if not out.isascii():
        out = out.translate(_TABLE)
    return _LEET.sub(lambda m: "".join(map(LEET.__getitem__, m[0])), out)


def _features(text: str) -> set[str]:
    out = set()
    for w in set(_WORD.findall(fold(text))):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if len(w) >= k)
    return out


class Lexicon:
    """Entries are ' word ' or ' begin'; automaton, weights, exceptions and curve."""

    def __init__(self, weights: dict[str, float], exceptions: set[str], curve: tuple[float, float, float]):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        import ahocorasick

        if self._automaton is None:
            a = ahocorasick.Automaton()
            for w, x in self.weights.items():
                a.add_word(w, (len(w), x))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def total(self, text: str | None) -> tuple[float, int]:
        """Weight of the hits (a word counts by its heaviest entry) and words."""
        if not text:
            return 0.0, 0
        flat = " " + " ".join(_WORD.findall(fold(text))) + " "
        best: dict[int, float] = {}
        if self.weights:
            for end, (n, x) in self.automaton().iter(flat):
                start = end - n + 1
                if x > best.get(start, 0.0):
                    best[start] = x
        if self.exceptions:
            for s in list(best):
                around = flat[: s].rsplit(" ", 2)[-1], *flat[s + 1 : s + 200].split(" ", 2)[:2]
                if f"{around[0]} {around[1]}" in self.exceptions or f"{around[1]} {around[-1]}" in self.exceptions:
                    del best[s]
        return sum(best.values()), flat.count(" ") - 1

    def point(self, text: str | None) -> tuple[float, float]:
        total, words = self.total(text)
        return total / math.sqrt(words + 20.0), math.log1p(total)

    def score(self, text: str | None) -> float:
        a, b, c = self.curve
        x, y = self.point(text)
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, a * x + b * y + c))))


def _half(doc_id: int) -> int:
    return zlib.crc32(f"half {doc_id}".encode()) & 1


Counts = dict[str, list[int]]  # feature: clean and toxic rows of half 0, then of half 1


def count_features(rows: list[tuple[int, str | None, int]]) -> Counts:
    out: Counts = {}
    for i, t, y in rows:
        k = 2 * _half(i) + y
        for f in _features(t or ""):
            out.setdefault(f, [0, 0, 0, 0])[k] += 1
    return out


def count_pairs(rows: list[tuple[int, str | None, int]], heavy: set[str]) -> Counts:
    """Word pairs with a heavy entry's word; counted like features."""
    out: Counts = {}
    for i, t, y in rows:
        words = _WORD.findall(fold(t or ""))
        for f in {f"{a} {b}" for a, b in zip(words, words[1:]) if f" {a} " in heavy or f" {b} " in heavy}:
            out.setdefault(f, [0, 0, 0, 0])[2 * _half(i) + y] += 1
    return out


def weigh(counts: Counts, n: list[int], halves: tuple[int, ...]) -> dict[str, float]:
    """Log-odds weights of the heavy entries, from the rows of these halves."""
    good, bad = (sum(n[2 * h + y] for h in halves) for y in (0, 1))
    least, out = max(3, 0.004 * bad), []
    for f, c in counts.items():
        g, k = (sum(c[2 * h + y] for h in halves) for y in (0, 1))
        w = math.log((k + 0.5) / (bad + 1)) - math.log((g + 0.5) / (good + 1))
        if k >= least and w > LEAST_WEIGHT:
            out.append((-k * w, f, w))
    return {f: w for _, f, w in sorted(out)[:MAX_ENTRIES]}


def fit_curve(points: list[tuple[float, float, int]]) -> tuple[float, float, float]:
    x = np.array([(a, b, 1.0) for a, b, _ in points])
    y = np.array([float(y) for *_, y in points])
    b = np.zeros(3)
    for _ in range(50):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, b))


def _over(rows: DataFrame, work, schema: str) -> list:
    """work(list of (doc_id, text, toxic)) for each task's share; its rows, collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = work([(r["doc_id"], r["text"], r["toxic"]) for r in b.to_pylist()])
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Lexicon | None:
    """Lexicon from labelled rows outside the held-out fold, at most max_train of them.

    Only counts of heavy entries and two figures a row come to the driver. The curve is
    fitted on rows that the weights they are scored with have not seen.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ids = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )
    rows = materialise(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id"), "train")
    names = "feature string, c0 long, c1 long, c2 long, c3 long"

    def counted(work) -> DataFrame:
        got = _over(rows, lambda x: [(f, *c) for f, c in work(x).items()], names).groupBy("feature")
        return got.agg(*[F.sum(c).alias(c) for c in ("c0", "c1", "c2", "c3")])

    clean, toxic = F.col("c0") + F.col("c2"), F.col("c1") + F.col("c3")

    n = [0, 0, 0, 0]
    for r in _over(rows, lambda x: [(2 * _half(i) + y,) for i, _, y in x], "k long").groupBy("k").count().collect():
        n[r[0]] = r[1]
    if not (n[0] + n[2] and n[1] + n[3]):
        return None
    # only entries that can weigh LEAST_WEIGHT in both halves or one come to the driver
    good, bad = n[0] + n[2], n[1] + n[3]
    odds = F.log((toxic + 0.5) / (bad + 1)) - F.log((clean + 0.5) / (good + 1))
    counts = {r[0]: list(r[1:]) for r in counted(count_features).where((toxic >= 2) & (odds > LEAST_WEIGHT - 2.0)).collect()}
    whole = weigh(counts, n, (0, 1))
    halves = [weigh(counts, n, (1,)), weigh(counts, n, (0,))]  # for half 0 and half 1
    heavy = {w for w in whole if w.endswith(" ")}
    # every exception is kept: pairs said by three clean rows at least and by no toxic one, of at most max_train rows
    calm = counted(lambda x: count_pairs(x, heavy)).where((clean >= 3) & (toxic == 0)).select("feature").collect() if heavy else []
    exceptions = {r[0] for r in calm}
    lexica = [Lexicon(w, exceptions, (0.0, 0.0, 0.0)) for w in halves]
    points = _over(rows, lambda x: [(*lexica[_half(i)].point(t), y) for i, t, y in x], "x double, y double, toxic long")
    return Lexicon(whole, exceptions, fit_curve([tuple(r) for r in points.collect()]))


def score_documents(docs: DataFrame, lexicon: Lexicon | None) -> DataFrame:
    """doc_id, held_out, score, predicted; every row of docs, in one pass without a shuffle."""
    small_batches(docs.sparkSession)
    shared = Sent(docs.sparkSession, lexicon)  # at most MAX_ENTRIES entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in batches:
            ids = b.column(0).to_pylist()
            scores = [lex.score(t.as_py()) if lex else 0.0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([i is not None and zlib.crc32(str(i).encode()) % FOLDS == 0 for i in ids], pa.bool_()),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, lexicon: Lexicon | None, least: float = 0.5) -> DataFrame:
    """The rows of docs that score below least, with all their columns, in one pass."""
    if lexicon is None:
        return docs
    small_batches(docs.sparkSession)
    shared, at = Sent(docs.sparkSession, lexicon), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in batches:
            yield b.filter(pa.array([lex.score(t.as_py()) < least for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
