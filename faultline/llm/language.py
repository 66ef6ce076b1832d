"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ``order`` bytes. In a context
that has been followed by ``d`` different bytes ``t`` times, a byte seen ``n`` times
has probability ``n / (t + d)`` and all others share the escape ``d / (t + d)``, after
which the context loses its oldest byte; a context never seen costs nothing, and
behind the empty context all 256 bytes are equally likely. The counts are frozen
after training, so the code length of a byte follows from its context alone. The
tree becomes a table from context and byte to the code length in every language;
a text is scored by looking up the longest entries, and by adding the escapes where
there is none. The language of the shortest code wins.

Counts come from about ``sample`` documents of each language, the documented bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import held_out, map_batches, small_batches
from faultline.session import materialise

UNKNOWN = "und"
ALL_BYTES_BITS = 8.0
AT_ONCE = 1_000_000  # bytes of a text handled in one step
_ASCII = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Ppm:
    """order: longest context; sample: documents of each language, by a hash of their
    id; rare_from: contexts of this length or more need an entry seen twice."""

    order: int = 4
    sample: int = 1500
    rare_from: int = 3


def plain(text: str) -> bytes:
    """Lower case; ASCII that is no letter becomes a space. A space stands in front."""
    return b" " + text.lower().encode("utf-8", "replace").translate(_ASCII)


def entries(body: np.ndarray, order: int) -> np.ndarray:
    """For each byte but the first, the ``order`` bytes before it and itself as one number
    under the mark of the order; places with fewer bytes before them are left out."""
    key = body[order:].astype(np.uint64)
    for back in range(1, order + 1):
        key |= body[order - back : len(body) - back].astype(np.uint64) << np.uint64(8 * back)
    return key | np.uint64(order + 1) << np.uint64(56)


def count_entries(documents: DataFrame, spec: Ppm) -> DataFrame:
    """``lang``, ``entry``, ``n`` over the sampled training documents."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text"
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # Stored, so that Spark knows its size: one row for each language, broadcast if few.
    totals = materialise(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("total")))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.join(totals, "lang").where(place * F.col("total") < spec.sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        by_lang: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            body = np.frombuffer(plain(text), np.uint8)
            made = by_lang.setdefault(lang, [])
            made.extend(
                entries(body if k else body[1:], k) for k in range(min(spec.order, len(body) - 1) + 1)
            )
        langs, keys, counts = [], [], []
        for lang, made in by_lang.items():
            key, n = np.unique(np.concatenate(made), return_counts=True)
            langs.extend([lang] * len(key))
            keys.append(key.view(np.int64))
            counts.append(n)
        return pa.RecordBatch.from_pydict(
            {"lang": langs, "entry": np.concatenate(keys), "n": np.concatenate(counts)}
        )

    counted = map_batches(chosen.select("lang", "text"), run, "lang string, entry long, n long")
    order = F.shiftrightunsigned("entry", 56) - 1
    return (
        counted.groupBy("lang", "entry").agg(F.sum("n").alias("n"))
        .where((F.col("n") > 1) | (order < spec.rare_from))
    )


def _rows(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys`` and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _shorter(keys: np.ndarray, order: int) -> np.ndarray:
    """The same entries or contexts without their oldest byte. order: that of the entries."""
    body = keys & ((np.uint64(1) << np.uint64(8 * order)) - np.uint64(1))
    return body | np.uint64(order) << np.uint64(56)


@dataclass
class Model:
    """keys: sorted entries and contexts (marked apart); bits: code lengths of entries and
    escape lengths of contexts, a column for each language."""

    langs: list[str]
    order: int
    keys: np.ndarray
    bits: np.ndarray


CONTEXT = np.uint64(1) << np.uint64(63)


def build_model(counts: pd.DataFrame, order: int) -> Model:
    """Code lengths of all entries in all languages, from the shortest contexts up."""
    langs = sorted(counts["lang"].unique())
    entry = counts["entry"].to_numpy(np.int64).view(np.uint64)
    number = counts["n"].to_numpy(np.float64)
    lang = np.searchsorted(np.array(langs, object), counts["lang"].to_numpy(object)) if langs else entry
    keys, bits = [], []
    below_keys, below = np.zeros(0, np.uint64), np.zeros((0, len(langs)))
    for k in range(order + 1):
        mine = entry >> np.uint64(56) == k + 1
        own, n, of = entry[mine], number[mine], lang[mine]
        here, row = np.unique(own, return_inverse=True)
        seen = np.zeros((len(here), len(langs)))
        np.add.at(seen, (row, of), n)
        contexts, group = np.unique(here >> np.uint64(8), return_inverse=True)
        total, distinct = np.zeros((2, len(contexts), len(langs)))
        np.add.at(total, group, seen)
        np.add.at(distinct, group, seen > 0)
        known = distinct > 0
        escape = np.zeros_like(total)
        escape[known] = -np.log2(distinct[known] / (total + distinct)[known])
        if k:
            at, there = _rows(below_keys, _shorter(here, k))
            fallback = below[at]
            assert there.all()
        else:
            fallback = np.full((len(here), len(langs)), ALL_BYTES_BITS)
        cost = escape[group] + fallback
        has = seen > 0
        cost[has] = -np.log2(seen[has] / (total + distinct)[group][has])
        below_keys, below = here, cost
        keys += [here, contexts | CONTEXT]
        bits += [cost, escape]
    joined = np.concatenate(keys)
    ranked = np.argsort(joined)
    return Model(langs, order, joined[ranked], np.concatenate(bits)[ranked].astype(np.float32))


class Table:
    """The model's keys in an open hash table, for many lookups at once."""

    def __init__(self, model: Model):
        self.model = model
        self.bits = max(4, int(len(model.keys) * 3).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.rows = np.zeros(self.mask + 1, np.int32)
        self.reach = 0
        left, home = np.arange(len(model.keys)), self._home(model.keys)
        while len(left):
            slot = (home[left] + self.reach) & self.mask
            free = self.keys[slot] == 0
            slots, first = np.unique(slot[free], return_index=True)
            placed = left[free][first]
            self.keys[slots], self.rows[slots] = model.keys[placed], placed
            left = np.setdiff1d(left, placed, assume_unique=True)
            self.reach += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * _GOLDEN >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        slot = self._home(keys)
        held = self.keys[slot]
        rows = np.where(held == keys, self.rows[slot], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held != 0))
        for step in range(1, self.reach):
            if not len(left):
                break
            slot_left = (slot[left] + step) & self.mask
            held = self.keys[slot_left]
            same = held == keys[left]
            rows[left[same]] = self.rows[slot_left[same]]
            left = left[~same & (held != 0)]
        return rows


def code_lengths(text: str, table: Table) -> np.ndarray:
    """Bits of the whole text in each language."""
    body, order = np.frombuffer(plain(text), np.uint8), table.model.order
    total = np.zeros(len(table.model.langs))
    for begin in range(1, len(body), AT_ONCE):
        total += _piece(body, begin, min(len(body), begin + AT_ONCE), order, table)
    return total


def _piece(body: np.ndarray, begin: int, end: int, order: int, table: Table) -> np.ndarray:
    """Bits of the bytes ``begin`` to ``end``, which see up to ``order`` bytes before them."""
    bits = table.model.bits
    total = np.zeros(bits.shape[1])
    places = np.arange(begin, end)
    early = places[: max(0, order - begin)]  # the first bytes have shorter contexts
    open_at = places[len(early) :]
    for k in range(order, -1, -1):
        if k < order and len(early):
            ready = early >= k
            open_at = np.concatenate([early[ready], open_at])
            early = early[~ready]
        if not len(open_at):
            continue
        if len(open_at) == end - begin:
            key = entries(body[begin - k : end], k)
        else:
            key = body[open_at].astype(np.uint64) | np.uint64(k + 1) << np.uint64(56)
            for back in range(1, k + 1):
                key |= body[open_at - back].astype(np.uint64) << np.uint64(8 * back)
        rows = table.find(key)
        known = rows >= 0
        total += bits[rows[known]].sum(axis=0, dtype=np.float64)
        missing = ~known
        open_at = open_at[missing]
        escapes = table.find(key[missing] >> np.uint64(8) | CONTEXT)
        total += bits[escapes[escapes >= 0]].sum(axis=0, dtype=np.float64)
    return total + ALL_BYTES_BITS * len(open_at)


def train(documents: DataFrame, spec: Ppm | None = None) -> Model:
    """The model's size follows from the sample, whatever the size of the table."""
    spec = spec or Ppm()
    return build_model(count_entries(documents, spec).toPandas(), spec.order)


def predictor(model: Model) -> Callable[[Column], Column]:
    """A column function: text -> (lang, score)."""

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = Table(model)
        for texts in batches:
            rows = []
            for text in texts:
                if not model.langs or not text or not any(map(str.isalpha, text)):
                    rows.append((UNKNOWN, 0.0))
                    continue
                bits = code_lengths(text, table)
                best = int(bits.argmin())
                share = 1 / np.exp2(-np.minimum(bits - bits[best], 1000)).sum()
                rows.append((model.langs[best], float(share)))
            yield pd.DataFrame(rows, columns=["lang", "score"])

    return predict


def identify(docs: DataFrame, documents: DataFrame, spec: Ppm | None = None) -> DataFrame:
    """Predict the language of ``docs`` by a model of ``documents`` (doc_id, text, lang).

    Returns a row per row: ``row`` (all columns of ``docs``), ``lang_pred`` and ``score``
    (the language's share of the probability of the text, 0 to 1). A null text, one
    without a letter, and every text if nothing could be learned, is ``und`` with score
    0. Ties go to the first language by name. Repeated rows are predicted each.
    """
    predict = predictor(train(documents, spec))
    small_batches(docs.sparkSession)
    found = docs.select(F.struct("*").alias("row")).withColumn("p", predict(F.col("row.text")))
    return found.select("row", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
