"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A feature is present or absent in a text: words, word beginnings, word pairs, and
pairs with one or two words between them, hashed into a fixed number of slots.
FTRL gives every slot its own learning rate, and its L1 term holds all slots at
exactly zero that have not gathered enough evidence; the few weights that are
left travel to the executors.

The classifier is fitted on at most ``sample`` labelled documents, the bound of
what one task learns from. Every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import held_out, small_batches


@dataclass(frozen=True)
class Ftrl:
    """sample: documents to learn from, chosen by a hash of their id; slots: a power
    of two; alpha, beta: learning rate; l1, l2: penalties; begins: letters of a word
    that count as its beginning."""

    sample: int = 20_000
    slots: int = 1 << 22
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.5
    l2: float = 0.0
    begins: int = 4


#: ASCII characters that separate words, besides white space.
_SPACES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers that tell the positions of a pair apart, one for each gap.
_GAPS = tuple(np.uint64(2 * n + 0x632BE59BD9B4E019) for n in range(3))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACES).split()


def features(text: str | None, slots: int, begins: int) -> np.ndarray:
    """Slots of the features in a text, with repeats. Words have the lower half of the slots."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64)
    digest, n = xxhash.xxh64_intdigest, len(words)
    whole = np.fromiter(map(digest, words), np.uint64, n)
    begin = np.fromiter((digest(w[:begins], 1) for w in words if len(w) > begins), np.uint64)
    with np.errstate(over="ignore"):
        pairs = [
            (whole[: -gap - 1] * _GAPS[gap] + whole[gap + 1 :]) * _GOLDEN
            for gap in range(3)
            if n > gap + 1
        ]
    shift = np.uint64(64 - (slots.bit_length() - 1) + 1)
    low = np.concatenate([whole, begin]) * _GOLDEN >> shift
    high = [(p >> shift) + np.uint64(slots // 2) for p in pairs]
    return np.concatenate([low, *high]).astype(np.int64)


class Learner:
    """State of FTRL-proximal; slot ``slots`` is the intercept, which has no L1 term."""

    def __init__(self, spec: Ftrl):
        self.spec = spec
        self.z = np.zeros(spec.slots + 1)
        self.n = np.zeros(spec.slots + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        spec, z = self.spec, self.z[at]
        l1 = np.where(at == spec.slots, 0.0, spec.l1)
        rate = (spec.beta + np.sqrt(self.n[at])) / spec.alpha + spec.l2
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / rate)

    def learn(self, slots: np.ndarray, label: int) -> None:
        at = np.append(np.unique(slots), self.spec.slots)
        weights = self.weights(at)
        error = _sigmoid(weights.sum()) - label
        squared = error * error
        sigma = (np.sqrt(self.n[at] + squared) - np.sqrt(self.n[at])) / self.spec.alpha
        self.z[at] += error - sigma * weights
        self.n[at] += squared

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.z)
        weights = self.weights(at)
        return at[weights != 0], weights[weights != 0]


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def labelled_sample(documents: DataFrame, labels: DataFrame, spec: Ftrl) -> DataFrame:
    """At most ``sample`` rows ``text``, ``toxic``, ``turn`` (their order).

    Rows without an id, label or place in the training folds are left out. An id
    with several labels is toxic if one of them says so; of several texts the
    least counts.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
        .withColumn("turn", F.xxhash64("id"))
        .orderBy("turn", "id").limit(spec.sample)
    )
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    # The chosen ids are at most ``sample`` rows of 20 bytes.
    joined = rows.join(F.broadcast(ids), "id")
    return joined.groupBy("id", "toxic", "turn").agg(F.min("text").alias("text")).drop("id")


def train(documents: DataFrame, labels: DataFrame, spec: Ftrl | None = None) -> dict[int, float]:
    """Non-zero weights by slot. One task learns from the bounded sample, in a fixed order."""
    spec = spec or Ftrl()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(spec)
        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                learner.learn(features(text, spec.slots, spec.begins), toxic)
        slots, weights = learner.kept()
        yield pa.RecordBatch.from_pydict({"slot": slots, "weight": weights})

    small_batches(documents.sparkSession)
    ordered = labelled_sample(documents, labels, spec).repartition(1).sortWithinPartitions("turn")
    weights = ordered.select("text", "toxic").mapInArrow(run, "slot long, weight double").toPandas()
    return dict(zip(weights["slot"].tolist(), weights["weight"].tolist(), strict=True))


def scorer(weights: dict[int, float], spec: Ftrl) -> Callable[[Column], Column]:
    """A column function that gives the score of a text; other columns stay in the JVM."""
    slots = np.fromiter(weights, np.int64, len(weights))
    values = np.fromiter(weights.values(), np.float64, len(weights))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = np.zeros(spec.slots + 1)
        dense[slots] = values
        for texts in batches:
            scores = []
            for text in texts:
                found = features(text, spec.slots, spec.begins)
                present = np.unique(found[dense[found] != 0])
                scores.append(_sigmoid(dense[present].sum() + dense[spec.slots]))
            yield pd.Series(scores, dtype="float64")

    return score


def toxicity(
    docs: DataFrame, documents: DataFrame, labels: DataFrame, spec: Ftrl | None = None
) -> DataFrame:
    """Score ``docs`` by a model of the labelled ``documents``.

    Returns a row for each row of ``docs``: ``row`` (all its columns) and ``score``
    (0 to 1, from the whole text alone). A null or empty text scores what the
    intercept says. Without labels every text scores 0.5. Repeated rows are scored each.
    """
    spec = spec or Ftrl()
    score = scorer(train(documents, labels, spec), spec)
    small_batches(docs.sparkSession)
    return docs.select(F.struct("*").alias("row")).withColumn("score", score(F.col("row.text")))


def drop_toxic(
    docs: DataFrame, documents: DataFrame, labels: DataFrame, spec: Ftrl | None = None
) -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more; all columns stay."""
    scored = toxicity(docs, documents, labels, spec)
    return scored.where("score < 0.5 or score is null").select("row.*")
