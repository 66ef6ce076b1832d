"""Benchmark passages in documents, found with a bounded number of edits.

Each benchmark item is cut into overlapping segments. Two strings within ``k``
edits share at least ``m - q + 1 - k q`` of the ``m - q + 1`` q-grams of a segment
of ``m`` bytes (the q-gram lemma), and the shared ones lie within ``k`` diagonals
of each other. So q-grams that a text shares with an item are put in diagonal bands
that overlap by ``k`` and counted for each segment; one that meets the bound in a band
is verified by an alignment banded to its diagonals. No segment within the budget is lost.

Any exact excerpt of ``segment + step - 1`` bytes of a normalised item holds a whole
segment and is found: 79 bytes by default, some 14 words. A shorter excerpt is found where
it holds a segment, from 72 bytes on; an item shorter than a segment as a whole. In any
segment a replaced word of up to seven letters is within the budget.

The benchmark is a stated query set: it is handed to the tasks in blocks of a
bounded size, one pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import small_batches
from faultline.session import materialise

Q = 8  # bytes of a q-gram, one 64-bit word


@dataclass(frozen=True)
class Passages:
    """segment: bytes; step: between segment starts; edits: share of a segment's bytes
    that may be inserted, deleted or replaced; block: benchmark bytes of one pass."""

    segment: int = 72
    step: int = 8
    edits: float = 0.1
    block: int = 4_000_000

    def budget(self, length: int) -> int:
        """Edits allowed in a segment; so few that the lemma's bound stays positive."""
        return min(int(self.edits * length), max(0, (length - Q) // Q))


def normalised(text: str | None) -> bytes:
    """Lower case, runs of white space as one space."""
    return " ".join((text or "").lower().split()).encode("utf-8", "replace")


def segments(item: bytes, spec: Passages) -> list[tuple[int, bytes]]:
    """Segments with their places; the last ends where the item ends. An item shorter
    than a q-gram has none."""
    if len(item) < Q:
        return []
    if len(item) <= spec.segment:
        return [(0, item)]
    starts = [*range(0, len(item) - spec.segment, spec.step), len(item) - spec.segment]
    return [(s, item[s : s + spec.segment]) for s in starts]


def grams(text: bytes) -> np.ndarray:
    """All q-grams of ``text`` as 64-bit words, in order."""
    total = len(text) - Q + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    made = np.empty(total, np.uint64)
    for shift in range(min(Q, total)):
        count = (len(text) - shift) // Q
        made[shift::Q] = np.frombuffer(text, "<u8", count, shift)
    return made


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SIEVE_BITS = 20
#: Candidates verified side by side.
CANDIDATES_AT_ONCE = 10_000


class Index:
    """Q-grams of all items of a block, each once, and the segments they belong to."""

    def __init__(self, items: list[tuple[int, str]], spec: Passages):
        self.spec = spec
        self.parts: list[tuple[int, int, bytes]] = []
        keys, places, owners, counts, longest = [], [], [], [], 0
        for number, (item_id, text) in enumerate(items):
            item = normalised(text)
            found = grams(item)
            keys.append(found)
            places.append(np.arange(len(found)))
            owners.append(np.full(len(found), number))
            made = segments(item, spec)
            counts.append(len(made))
            self.parts.extend((item_id, start, part) for start, part in made)
            longest = max(longest, len(item))
        empty = [np.zeros(0, np.int64)]
        key = np.concatenate(keys or [np.zeros(0, np.uint64)])
        order = np.argsort(key, kind="stable")
        self.place = np.concatenate(places or empty)[order]
        self.owner = np.concatenate(owners or empty)[order]
        self.key, first, self.times = np.unique(key[order], return_index=True, return_counts=True)
        self.first = first
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[self._cell(self.key)] = True
        self.lengths = np.array([len(p) for _, _, p in self.parts], np.int64)
        self.starts = np.array([s for _, s, _ in self.parts], np.int64)
        self.budget = np.array([spec.budget(n) for n in self.lengths.tolist()], np.int64)
        self.bound = self.lengths - Q + 1 - self.budget * Q
        # Of each item: its segments, its least bound and its largest budget.
        self.counts = np.array(counts, np.int64)
        self.heads = np.cumsum(self.counts) - self.counts
        item_of = np.repeat(np.arange(len(counts)), self.counts)
        self.least = np.full(len(counts), np.iinfo(np.int64).max)
        np.minimum.at(self.least, item_of, self.bound)
        self.most = np.zeros(len(counts), np.int64)
        np.maximum.at(self.most, item_of, self.budget)
        self.span = longest + spec.segment + 1

    @staticmethod
    def _cell(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * _GOLDEN >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)

    def _hits(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, place in the item and place in the text of each shared q-gram."""
        found = grams(text)
        at = np.flatnonzero(self.sieve[self._cell(found)])
        slot = np.searchsorted(self.key, found[at])
        slot = np.minimum(slot, len(self.key) - 1)
        same = self.key[slot] == found[at]
        at, slot = at[same], slot[same]
        times = self.times[slot]
        offsets = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        entry = np.repeat(self.first[slot], times) + offsets
        return self.owner[entry], self.place[entry], np.repeat(at, times)

    def search(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(segment, edits, start, end) of each segment that the text has within its budget,
        at the best place of each band."""
        if not len(self.key):
            return []
        owner, place, at = self._hits(text)
        chosen = (np.bincount(owner, minlength=len(self.counts)) >= self.least)[owner]
        owner, place, diagonal = owner[chosen], place[chosen], (at - place)[chosen]
        if not len(owner):
            return []
        # Bands of 2 w diagonals start every w; a match spans at most 2 k + 1 <= w.
        width = 2 * self.most[owner] + 2
        band = diagonal // width
        lowest = int(band.min()) - 1
        spread = int(band.max()) - lowest + 2
        slots = np.concatenate([owner * spread + (band - lowest), owner * spread + (band - lowest - 1)])
        # Each q-gram of an item counts once in a band.
        code = np.sort(slots * self.span + np.concatenate([place, place]))
        code = code[np.concatenate([[True], code[1:] != code[:-1]])]
        # Bands in which some stretch of a segment's length has enough of them.
        ahead = np.searchsorted(code, code + self.spec.segment - Q, "right") - np.arange(len(code))
        slots = code // self.span
        slots = np.unique(slots[ahead >= self.least[slots // spread]])
        if not len(slots):
            return []
        times = self.counts[slots // spread]
        offsets = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        part = np.repeat(self.heads[slots // spread], times) + offsets
        slots = np.repeat(slots, times)
        begin = slots * self.span + self.starts[part]
        shared = np.searchsorted(code, begin + self.lengths[part] - Q, "right")
        shared -= np.searchsorted(code, begin, "left")
        enough = shared >= self.bound[part]
        part, slots = part[enough], slots[enough]
        w = 2 * self.most[slots // spread] + 2
        # Diagonals of the item become those of the segment.
        low = (slots % spread + lowest) * w + self.starts[part]
        close = np.zeros(len(part), bool)
        for at in range(0, len(part), CANDIDATES_AT_ONCE):
            few = slice(at, at + CANDIDATES_AT_ONCE)
            close[few] = self._close(part[few], text, low[few], low[few] + 2 * w[few] - 1)
        found = []
        for part, low, w in zip(part[close].tolist(), low[close].tolist(), w[close].tolist(), strict=True):
            best = self._align(part, text, low, low + 2 * w - 1)
            if best is not None:
                found.append((part, *best))
        return found

    def _close(self, part: np.ndarray, text: bytes, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Candidates whose first 64 bytes have their budget's edits at most somewhere in the
        stretch that ``_align`` looks at: Myers' bit vectors, one candidate in each lane."""
        if not len(part):
            return np.zeros(0, bool)
        one = np.uint64(1)
        budget, lengths = self.budget[part], np.minimum(self.lengths[part], 64)
        begin = np.maximum(low - budget, 0)
        end = np.minimum(len(text), high + budget + self.lengths[part] + 1)
        distinct, lane = np.unique(part, return_inverse=True)
        masks = np.zeros((len(distinct), 256), np.uint64)
        for row, number in enumerate(distinct.tolist()):
            head = np.frombuffer(self.parts[number][2][:64], np.uint8)
            np.bitwise_or.at(masks[row], head, one << np.arange(len(head), dtype=np.uint64))
        body = np.frombuffer(text, np.uint8)
        steps = np.arange(int((end - begin).max()))
        # The masks of all bytes that will be read, a row for each step.
        seen = body[np.minimum(begin + steps[:, None], len(body) - 1)]
        rows, inside = masks[lane, seen], begin + steps[:, None] < end
        top = one << (lengths - 1).astype(np.uint64)
        plus, minus = np.full(len(part), ~np.uint64(0)), np.zeros(len(part), np.uint64)
        score, best = lengths.copy(), lengths.copy()
        for same, here in zip(rows, inside, strict=True):
            across = (((same & plus) + plus) ^ plus) | same
            up, down = minus | ~(across | plus), plus & across
            score += (up & top) != 0
            score -= (down & top) != 0
            np.minimum(best, score, out=best, where=here)
            vertical, up, down = same | minus, up << one, down << one
            plus, minus = down | ~(vertical | up), up & vertical
        return best <= budget

    def _align(self, part: int, text: bytes, low: int, high: int) -> tuple[int, int, int] | None:
        """Edits, start and end of the best place of a segment on diagonals low to high."""
        pattern, budget = self.parts[part][2], int(self.budget[part])
        low, high = low - budget, high + budget
        begin, end = max(0, low), min(len(text), high + len(pattern) + 1)
        at = text.find(pattern, begin, end)
        if at >= 0:
            return 0, at, at + len(pattern)
        if not budget:
            return None
        return banded_alignment(pattern, text, low, high, budget)


def banded_alignment(
    pattern: bytes, text: bytes, low: int, high: int, budget: int
) -> tuple[int, int, int] | None:
    """Least edits that turn a stretch of ``text`` into ``pattern``, with its start and end,
    over cells on the diagonals low to high; None beyond the budget.

    Row i holds the cells (i, i + low) to (i, i + high); a stretch may start in any
    cell of row 0. The earliest end of the least cost is taken.
    """
    width, far = high - low + 1, len(pattern) + len(text) + 1
    column = np.arange(width)
    body = np.frombuffer(text, np.uint8)
    cost = np.where((column + low >= 0) & (column + low <= len(text)), 0, far)
    start = column + low
    for i, byte in enumerate(pattern, 1):
        ends = column + low + i  # bytes of the text used up
        inside = (ends >= 0) & (ends <= len(text))
        usable = inside & (ends >= 1)
        differs = np.ones(width, np.int64)
        differs[usable] = body[ends[usable] - 1] != byte
        by_match = np.where(usable, cost + differs, far)
        by_skip = np.append(cost[1:] + 1, far)  # the pattern's byte is missing in the text
        from_match = by_match <= by_skip
        made = np.where(inside, np.where(from_match, by_match, by_skip), far)
        origin = np.where(from_match, start, np.append(start[1:], 0))
        # An extra byte of the text: along the row, the least of cost minus column.
        level = made - column
        least = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == least, column, 0))
        cost = np.where(inside, least + column, far)
        start = origin[source]
    best = int(cost.argmin())
    if cost[best] > budget:
        return None
    return int(cost[best]), int(start[best]), best + low + len(pattern)


def _blocks(benchmark: DataFrame, spec: Passages) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of bounded size; only one block is held at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = items.where(F.col("text").isNotNull()).orderBy("item_id", "text")
    block, held = [], 0
    for item_id, text in items.toLocalIterator():
        if block and held + len(text) > spec.block:
            yield block
            block, held = [], 0
        block.append((item_id, text))
        held += len(text)
    yield block


FOUND = "array<struct<item_id:long,segments:int,edits:int,start:int,end:int>>"


def _search_column(block: list[tuple[int, str]], spec: Passages):
    @F.pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(block, spec)
        for texts in batches:
            yield pd.Series([_by_item(index, normalised(t)) for t in texts])

    return search


def _by_item(index: Index, text: bytes) -> list[dict]:
    """One entry per item: distinct segments found, and the one with most edits at its best place."""
    best: dict[int | None, dict] = {}
    for part, *place in index.search(text):
        item, start, _ = index.parts[part]
        parts = best.setdefault(item, {})
        parts[start] = min(parts.get(start, place), place)
    made = []
    for item, parts in sorted(best.items(), key=lambda x: (x[0] is None, x[0])):
        edits, start, end = min(parts.values(), key=lambda p: (-p[0], p[1]))
        made.append({"item_id": item, "segments": len(parts), "edits": edits, "start": start, "end": end})
    return made


def contaminations(docs: DataFrame, benchmark: DataFrame, spec: Passages | None = None) -> DataFrame:
    """Benchmark items of which documents hold a segment: ``doc_id``, ``item_id``,
    ``segments`` (how many of the item's), ``edits`` (the most that one of these has at its
    best place: 0 if all are exact), ``start`` and ``end`` (where that one lies, in bytes of
    the normalised text).

    Null and empty texts hold nothing, and items shorter than a q-gram are never found.
    A repeated document row is reported again; items with the same id count as one.
    Rows of a null item_id are reported under null.
    """
    spec = spec or Passages()
    small_batches(docs.sparkSession)
    parts = []
    for block in _blocks(benchmark, spec):
        found = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), _search_column(block, spec)(F.col("text")).alias("found")
        )
        # Stored before the next block is fetched, so that no plan holds two of them.
        parts.append(materialise(found.where(F.size("found") > 0).select("doc_id", F.inline("found"))))
    return reduce(DataFrame.unionByName, parts)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, spec: Passages | None = None) -> DataFrame:
    """``docs`` without the rows that hold a benchmark segment; all columns stay.

    Each block of the benchmark sees what the blocks before it have left.
    """
    spec = spec or Passages()
    small_batches(docs.sparkSession)
    kept, first = docs, True
    for block in _blocks(benchmark, spec):
        if not first:
            kept = materialise(kept)
        rows = kept.select(F.struct("*").alias("row"))
        found = rows.withColumn("found", _search_column(block, spec)(F.col("row.text")))
        kept, first = found.where(F.size("found") == 0).select("row.*"), False
    return kept
