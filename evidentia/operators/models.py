"""Language models and encoders behind one interface; prompts from columns; answers in batches.

Clients are made once a partition by a factory that is sent to the executors; no network
code is here, and OfflineClient serves tests. A prompt that fails has an error in its row.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import top


class ModelClient(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class OfflineClient:
    """Fixed answers that depend on the prompt alone."""

    def __init__(self, answer: Callable[[str], str] | None = None, size: int = 16):
        self._answer, self._size = answer, size

    def complete(self, prompts: list[str]) -> list[str]:
        return [self._answer(p) if self._answer else '{"label": "fake", "confidence": 0.0, "evidence_ids": [], "wrong_facets": ["insufficient_evidence"]}' for p in prompts]

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [b - 127.5 for b in hashlib.sha256(t.encode()).digest()[: self._size]]
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm for x in v])
        return out


def complete(rows: DataFrame, prompt: str, factory: Callable[[], ModelClient], batch: int = 10, retries: int = 3, wait: float = 1.5) -> DataFrame:
    """Adds answer and error: batches go to the model, a failed batch goes one by one, with growing waits."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()

        def ask(prompts: list[str], tries: int) -> list[str]:
            for n in range(1, tries + 1):
                try:
                    got = client.complete(prompts)
                    if len(got) != len(prompts):
                        raise ValueError(f"{len(got)} answers to {len(prompts)} prompts")
                    return got
                except Exception:
                    if n == tries:
                        raise
                    time.sleep(wait * n)
            return []

        for part in parts:
            answers: list[str | None] = []
            errors: list[str | None] = []
            prompts = [p or "" for p in part[prompt]]
            for at in range(0, len(prompts), batch):
                some = prompts[at : at + batch]
                try:
                    answers += ask(some, 1 if len(some) > 1 else retries)
                    errors += [None] * len(some)
                    continue
                except Exception as e:
                    if len(some) == 1:
                        answers.append(None)
                        errors.append(str(e) or type(e).__name__)
                        continue
                for p in some:
                    try:
                        answers += ask([p], retries)
                        errors.append(None)
                    except Exception as e:
                        answers.append(None)
                        errors.append(str(e) or type(e).__name__)
            yield part.assign(answer=pd.Series(answers, dtype=object, index=part.index), error=pd.Series(errors, dtype=object, index=part.index))

    return rows.mapInPandas(run, f"{schema}, answer string, error string")


def embed(rows: DataFrame, text: str, factory: Callable[[], ModelClient], batch: int = 32) -> DataFrame:
    """Adds embedding; null texts are encoded as empty ones."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = factory()
        for s in parts:
            texts = [t or "" for t in s]
            yield pd.Series([v for at in range(0, len(texts), batch) for v in client.embed(texts[at : at + batch])], dtype=object)

    return rows.withColumn("embedding", vectors(F.col(text)))


def evidence_context(evidence: DataFrame, most: int = 8, chars: int = 1400, show_years: bool = True) -> DataFrame:
    """(id, context): numbered blocks E1, E2, ... of a claim's evidence, each text cropped to the claim.

    evidence: id, rank, chunk, claim, text, score, hits (array<string>), relations (array<string>), years.
    """
    rows = evidence.where(F.col("rank") <= most)
    years = F.slice(F.array_sort(F.array_distinct(F.concat(F.coalesce("years", F.array().cast("array<int>")), T.years(F.col("text"))))), 1, 12)
    lines = [
        F.format_string("[E%d] chunk_id=%s", F.col("rank"), F.col("chunk")),
        F.concat(F.lit("score="), F.col("score").cast("string")),
        F.concat(F.lit("facet_hits="), F.to_json(F.slice("hits", 1, 8))),
        F.concat(F.lit("relation_hits="), F.to_json(F.slice("relations", 1, 6))),
    ]
    if show_years:
        lines.append(F.concat(F.lit("years="), F.to_json(years)))
    block = F.concat_ws("\n", *lines, T.smart_crop(F.col("text"), F.col("claim"), chars))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "b")))
    return rows.select("id", "rank", block.alias("b")).groupBy("id").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n").alias("context"))


def verify_prompt(claim: Column, context: Column) -> Column:
    return F.concat(
        F.lit("Decide from the evidence alone whether the claim is real or fake.\nAnswer with one JSON object: label (real or fake), confidence (0 to 1), evidence_ids, wrong_facets, reasoning.\n\nClaim: "),
        claim, F.lit("\n\nEvidence:\n"), F.coalesce(context, F.lit("(none)")),
    )


def claim_only_prompt(claim: Column) -> Column:
    """The question without evidence, for a model's own knowledge."""
    return F.concat(F.lit("Decide from what you know whether the claim is real or fake.\nAnswer with one JSON object: label (real or fake), confidence (0 to 1), reasoning.\n\nClaim: "), claim)


def passages_prompt(claim: Column, passages: Column) -> Column:
    """The baseline's question: numbered passages as they are; passages: array of texts."""
    told = F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n")
    return F.concat(F.lit("Passages:\n"), told, F.lit("\n\nClaim: "), claim, F.lit("\n\nDo the passages make the claim real or fake? Answer with one JSON object: label, confidence, evidence_ids."))


def _verdicts(rows: DataFrame, factory: Callable[[], ModelClient], batch: int) -> DataFrame:
    out = complete(rows, "prompt", factory, batch).withColumn("v", T.verdict(F.col("answer")))
    error = F.coalesce("error", F.when(F.col("v").isNull(), F.lit("unreadable answer")))
    return out.select("id", F.when(error.isNull(), F.col("v.label")).otherwise("error").alias("label"), F.coalesce("v.confidence", F.lit(0.0)).alias("confidence"), error.alias("error"))


def verify_claim_only(claims: DataFrame, factory: Callable[[], ModelClient], batch: int = 10) -> DataFrame:
    """(id, label, confidence, error) from claims (id, claim) alone."""
    return _verdicts(claims.select("id", claim_only_prompt(F.col("claim")).alias("prompt")), factory, batch)


def verify_baseline(claims: DataFrame, passages: DataFrame, factory: Callable[[], ModelClient], most: int = 5, batch: int = 1) -> DataFrame:
    """(id, label, confidence, error) from the best `most` passages (id, rank, text) of each claim, a claim a call."""
    best = passages.where(F.col("rank") <= most).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("p"))
    rows = claims.join(best, "id", "left").select("id", passages_prompt(F.col("claim"), F.coalesce("p", F.array().cast("array<string>"))).alias("prompt"))
    return _verdicts(rows, factory, batch)


def facet_prompt(claim: Column) -> Column:
    return F.concat(F.lit("List the facets of the claim as one JSON object of string lists, with the keys person, organization, event, place, time, concept, quantity, action, result.\n\nClaim: "), claim)


def verify(claims: DataFrame, contexts: DataFrame, factory: Callable[[], ModelClient], batch: int = 10) -> DataFrame:
    """(id, label, confidence, evidence_ids, wrong_facets, error): each claim's verdict; unreadable answers are errors."""
    rows = claims.select("id", "claim").join(contexts, "id", "left").select("id", verify_prompt(F.col("claim"), F.col("context")).alias("prompt"))
    out = complete(rows, "prompt", factory, batch).withColumn("v", T.verdict(F.col("answer")))
    none = F.array().cast("array<string>")
    error = F.coalesce("error", F.when(F.col("v").isNull(), F.lit("unreadable answer")))
    return out.select(
        "id", F.when(error.isNull(), F.col("v.label")).otherwise("error").alias("label"), F.coalesce("v.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("v.evidence_ids", none).alias("evidence_ids"), F.coalesce("v.wrong_facets", none).alias("wrong_facets"), error.alias("error"),
    )


def rerank(pairs: DataFrame, scorer: Callable[[], Callable[[list[str], list[str]], list[float]]], k: int = 5) -> DataFrame:
    """(id, doc, score, rank): pairs (id, doc, pos, claim, text) by a pair scorer, ties by pos."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        f = scorer()
        for a, b in parts:
            yield pd.Series(f([x or "" for x in a], [x or "" for x in b]), dtype=float)

    rows = pairs.withColumn("score", scored("claim", "text"))
    return top(rows, "id", F.desc("score"), "pos", k=k).select("id", "doc", "score", "rank")
