"""Byte-level BPE ids of whole texts in two tiers, and texts from ids.

A text is cut into pre-tokens by the tokenizer's pattern. A pre-token that is itself a
word of the vocabulary is resolved by a minimal perfect hash: one slot per word, found
by a few bits per word, and compared with the word stored there. Any other pre-token
is merged from its bytes, which hang together as a linked list; a heap hands out the
pair to merge next (lowest rank first, then the leftmost).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import per_process

#: Bits per key at each level of the perfect hash; more bits, fewer levels.
GAMMA = 2
#: Merged pre-tokens of each of the two generations a worker remembers (about 100 MB each).
REMEMBERED = 500_000
#: Ids decoded at once.
IDS_AT_ONCE = 1 << 20
#: Bytes of text whose pre-tokens are looked up together.
AT_ONCE = 1 << 22
#: Texts with code points below only (Latin, Greek, Cyrillic) are cut with short classes.
NARROW = 0x530

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(hashes: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash per level."""
    with np.errstate(over="ignore"):
        x = hashes ^ (np.uint64(level + 1) * _GOLDEN)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _stretches(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Rows of about ``limit`` in all at a time, a larger row by itself."""
    start = total = 0
    for at, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield slice(start, at)
            start, total = at, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class PerfectHash:
    """Slots 0 to n - 1 for n distinct words, one each.

    A level is a bit array. Words that fall alone on a bit keep it, the others go to
    the next level; a word's slot is the number of set bits before its own.
    """

    def __init__(self, words: list[bytes]):
        left, self.sizes, bits = hashes_of(words), [], []
        if len(np.unique(left)) < len(left):
            raise ValueError("Two words share a 64-bit hash, or a word is there twice.")
        while len(left):
            size = max(64, GAMMA * len(left))
            cell = (_mixed(left, len(self.sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(cell, minlength=size) == 1
            self.sizes.append(size)
            bits.append(alone)
            left = left[~alone[cell]]
        self.bits = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.rank = np.cumsum(self.bits) - self.bits
        self.words: list[bytes] = [b""] * len(words)
        for slot, word in zip(self.slots(hashes_of(words)).tolist(), words, strict=True):
            self.words[slot] = word

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot per hash, -1 for most hashes that no word has."""
        found, left, base = np.full(len(hashes), -1), np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            cell = (_mixed(hashes[left], level) % np.uint64(size)).astype(np.int64) + base
            hit = self.bits[cell]
            found[left[hit]] = self.rank[cell[hit]]
            left, base = left[~hit], base + size
        return found

    def find(self, words: list[bytes]) -> list[int]:
        """Slot per word, -1 for one that is not among them."""
        slots = self.slots(hashes_of(words)).tolist()
        return [
            s if s >= 0 and self.words[s] == w else -1 for s, w in zip(slots, words, strict=True)
        ]


@dataclass(frozen=True)
class Vocabulary:
    """A rank file and the pattern that cuts texts before its merges.

    path: lines of a base64 word and its rank, which is its id; all 256 single bytes
    must be there. pattern: may use ``\\p{L}``, ``\\p{N}``, ``\\s`` and ``\\S``.
    """

    path: str
    pattern: str = public_tokenizers.PATTERN


def _ranges(points: list[int]) -> str:
    """Code points as the inside of a character class."""
    out, start = [], 0
    for i, point in enumerate(points):
        if i + 1 == len(points) or points[i + 1] != point + 1:
            out.append(f"\\U{points[start]:08x}-\\U{point:08x}")
            start = i + 1
    return "".join(out)


def _library_classes() -> dict[str, list[int]]:
    """Which code points the tokenizer library takes for letters, numbers and spaces.

    Unicode versions differ between libraries, so the library itself is asked: with
    the bytes as its only words, the ids of a text are the bytes that the pattern matches.
    """
    import tiktoken

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    classes = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        only = tiktoken.Encoding("class", pat_str=name + "+", mergeable_ranks=single, special_tokens={})
        matched = bytes(only.encode_ordinary(every)).decode()
        classes[name] = sorted(map(ord, matched))
    return classes


def compile_pattern(pattern: str, below: int = 0x110000) -> re.Pattern:
    """``pattern`` with the library's classes written out, for texts of code points ``below``."""
    classes = {
        name: _ranges([point for point in points if point < below])
        for name, points in per_process("library classes", _library_classes).items()
    }
    out, inside = [], False
    for part in re.findall(r"\\p\{\w\}|\\.|.", pattern, re.S):
        if part in classes:
            part = classes[part] if inside else f"[{classes[part]}]"
        elif part == r"\S":
            if inside:
                raise ValueError(r"\S cannot stand in a class here")
            part = f"[^{classes[chr(92) + 's']}]"
        elif part == "[":
            inside = True
        elif part == "]":
            inside = False
        out.append(part)
    return re.compile("".join(out))


class Cutter:
    """Pre-tokens of a text: ASCII and other narrow texts by patterns with short classes."""

    def __init__(self, pattern: str):
        self.ascii, self.narrow, self.wide = (
            compile_pattern(pattern, below).findall for below in (0x80, NARROW, 0x110000)
        )
        self.is_wide = re.compile(f"[{chr(NARROW)}-{chr(0x10FFFF)}]").search

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii(text)
        return self.wide(text) if self.is_wide(text) else self.narrow(text)


class Encoder:
    """Ids of texts, equal to those of the file in the tokenizer library."""

    def __init__(self, vocabulary: Vocabulary):
        with open(vocabulary.path, "rb") as file:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError(f"{vocabulary.path} lacks single bytes")
        self.cut = Cutter(vocabulary.pattern)
        self.whole = PerfectHash(list(ranks))
        # Ids as 32-bit integers in bytes, which cost the garbage collector nothing.
        self.packed_at = [ranks[w].to_bytes(4, "little") for w in self.whole.words]
        self.byte = [ranks[bytes([b])] for b in range(256)]
        # What a word and the next one merge into, by the first and then the second.
        self.joins: list[dict[int, int]] = [{} for _ in range(max(ranks.values()) + 1)]
        for word, rank in ranks.items():
            for i in range(1, len(word)):
                if word[:i] in ranks and word[i:] in ranks:
                    self.joins[ranks[word[:i]]][ranks[word[i:]]] = rank
        self.first = [[self.joins[a].get(b, -1) for b in self.byte] for a in self.byte]
        self.merged: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token that is no word of the vocabulary."""
        size, joins, first, byte = len(word), self.joins, self.first, self.byte
        ids = [byte[b] for b in word]
        # Rank of the pair that starts at each byte, -1 for none; the last byte starts none.
        live = [first[a][b] for a, b in zip(word, word[1:], strict=False)]
        heap = [rank * size + at for at, rank in enumerate(live) if rank >= 0]
        live.append(-1)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heapify(heap)
        while heap:
            top = heappop(heap)
            rank = top // size
            at = top - rank * size
            # A pair one of whose sides has been merged since is out of date.
            if live[at] != rank:
                continue
            gone = after[at]
            ids[at] = rank
            ids[gone] = live[gone] = wider = -1
            after[at] = right = after[gone]
            if right < size:
                before[right] = at
                wider = joins[rank].get(ids[right], -1)
                if wider >= 0:
                    heappush(heap, wider * size + at)
            live[at] = wider
            left = before[at]
            if left >= 0:
                live[left] = wider = joins[ids[left]].get(rank, -1)
                if wider >= 0:
                    heappush(heap, wider * size + left)
        return [i for i in ids if i >= 0]

    def _merged(self, word: bytes) -> bytes:
        """Packed ids of a merged pre-token; what was asked for lately is remembered."""
        ids = self.merged.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                ids = np.array(self.merge(word), "<u4").tobytes()
            if len(self.merged) >= REMEMBERED:
                self.merged, self.older = {}, self.merged
            self.merged[word] = ids
        return ids

    def resolve(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of distinct pre-tokens."""
        packed, merged = self.packed_at, self._merged
        return [
            packed[slot] if slot >= 0 else merged(word)
            for slot, word in zip(self.whole.find(words), words, strict=True)
        ]

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text; null has none. A stretch of short texts is looked up at once."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
        parts = [self._encode(texts[part].to_pylist()) for part in _stretches(sizes, AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    def _encode(self, texts: list[str | None]) -> pa.ListArray:
        cut = [self.cut(t) if t else () for t in texts]
        pieces = pa.array(chain.from_iterable(cut), pa.string()).dictionary_encode()
        codes = pieces.indices.to_numpy()
        resolved = self.resolve(pieces.dictionary.cast(pa.binary()).to_pylist())
        lengths = np.fromiter(map(len, resolved), np.int64, len(resolved)) // 4
        flat = np.frombuffer(b"".join(resolved), "<i4")
        sizes = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[_spread((np.cumsum(lengths) - lengths)[codes], sizes)]
        offsets = ends[np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def encoder(vocabulary: Vocabulary) -> Encoder:
    return per_process(("byte bpe", vocabulary), lambda: Encoder(vocabulary))


class Decoder:
    """Bytes of ids: the words of the file end to end, and where each begins."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            words = {int(rank): base64.b64decode(word) for word, rank in map(bytes.split, file)}
        self.lengths = np.full(max(words) + 1, -1)
        self.lengths[list(words)] = list(map(len, words.values()))
        self.starts = np.zeros(len(self.lengths), np.int64)
        self.starts[list(words)] = np.cumsum([0, *map(len, words.values())])[:-1]
        self.joined = np.frombuffer(b"".join(words.values()), np.uint8)

    def decode(self, lists: pa.ListArray) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        parts = [self._decode(lists[part], sizes[part]) for part in _stretches(sizes, IDS_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    def _decode(self, lists: pa.ListArray, sizes: np.ndarray) -> pa.Array:
        ids = lists.flatten().to_numpy()
        lengths = self.lengths[ids]
        if len(ids) and lengths.min() < 0:
            raise ValueError(f"{ids[lengths.argmin()]} is no id of the file")
        body = self.joined[_spread(self.starts[ids], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        offsets = ends[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
        return pa.BinaryArray.from_buffers(
            pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(body)]
        )


def decoder(path: str) -> Decoder:
    return per_process(("byte bpe words", path), lambda: Decoder(path))


def ids_of(text: Column, vocabulary: Vocabulary) -> Column:
    """Ids of a text column."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return encoder(vocabulary).encode(texts)

    return ids(text)


def bytes_of(ids: Column, vocabulary: Vocabulary) -> Column:
    """The bytes that a column of ids stands for; fails at an id the file does not have."""

    @F.arrow_udf("binary")
    def decoded(lists: pa.Array) -> pa.Array:
        return decoder(vocabulary.path).decode(lists)

    return decoded(ids)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Encode every whole text of ``docs``.

    docs: needs ``text``; all columns come back in ``row``, so that no name can clash.
    Returns a row per row: ``row`` and ``ids`` (array of int, empty for a null or empty
    text). Each match of the pattern is encoded by itself; strings of special tokens are
    ordinary text. Repeated rows are encoded each; an empty table gives no rows. A
    text's ids are held in memory while it is encoded, about 50 bytes a character.
    """
    rows = docs.select(F.struct("*").alias("row"))
    return rows.withColumn("ids", ids_of(F.col("row.text"), vocabulary))


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Add ``decoded``, the bytes of ``ids``; no ids (or null) give no bytes."""
    return encoded.withColumn("decoded", bytes_of(F.col("ids"), vocabulary))
