"""Collocations from a prefix-free parse: n-grams are counted in distinct chunks only.

The words of a text and the marks between its pieces are one stream of tokens. Where a
window of three tokens hashes to zero modulo a parameter, a chunk ends after the window
and the next one begins with it. So chunks depend on content alone, begin and end with a
trigger window, hold none inside, and overlap by three tokens: every phrase of up to four
words lies in a chunk. Equal chunks are counted once with their frequency. A chunk owns
the phrases that start before its last window, so that none is counted twice.

Phrases are counted by their number of words. A phrase can only be frequent if the two
phrases it holds that are a word shorter are; a bit array of the frequent ones, of bounded
size, keeps most others out of the shuffle. What it lets through by chance is counted
like any other phrase, so that counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import materialise

#: The token between two pieces; no word holds a full stop.
MARK = "."
#: Bytes of text cut at once, and chunks whose phrases are counted at once.
AT_ONCE = 1 << 23

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PLAIN = _LOWER.translate(
    bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n\n ")
)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Phrases:
    """longest: words of a phrase. least: count of a candidate. scale: of the score.
    absorbed: a candidate goes if a longer one that holds it has this share (per cent) of
    its count. top: phrases returned per language.

    one_in: a window of tokens is a trigger with this probability. most: owned tokens after
    which a chunk is cut in any case. filter_bits: size limit of the broadcast bit array, a
    power of two (2^27: 16 MB); a smaller number of frequent phrases takes 16 bits each.
    """

    longest: int = 4
    least: int = 30
    scale: int = 2_000_000
    absorbed: int = 80
    top: int = 2000
    one_in: int = 32
    most: int = 512
    filter_bits: int = 1 << 27


# --- The parse -----------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _hashes(words: pa.Array) -> np.ndarray:
    raw = words.cast(pa.binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _tokens(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens, codes of the token stream, and the end of each text in it.

    Marks at the ends of a text and repeated marks are left out.
    """
    lists = [
        (t or "").encode().translate(_PLAIN).replace(b"\n", b" . ").split() for t in texts
    ]
    ends = np.cumsum([len(one) for one in lists])
    flat = pa.array([token for one in lists for token in one], pa.binary())
    coded = flat.cast(pa.string()).dictionary_encode()
    codes = coded.indices.to_numpy()
    mark = pc.index(coded.dictionary, MARK).as_py()
    is_mark = codes == mark if mark >= 0 else np.zeros(len(codes), bool)
    first = np.zeros(len(codes), bool)
    first[np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0]] = True
    # A mark stays if a word stands right before it in its text.
    keep = ~is_mark | (~first & ~np.concatenate([[False], is_mark[:-1]]))
    kept = np.concatenate([[0], np.cumsum(keep)])
    codes, ends = codes[keep], kept[ends]
    # A mark that ends a text goes too.
    last = ends[np.diff(ends, prepend=0) > 0] - 1
    drop = last[codes[last] == mark] if mark >= 0 else last[:0]
    stay = np.ones(len(codes), bool)
    stay[drop] = False
    kept = np.concatenate([[0], np.cumsum(stay)])
    return coded.dictionary, codes[stay], kept[ends]


def parse(texts: list[str | None], langs: pa.Array, spec: Phrases) -> pa.RecordBatch:
    """Chunks of the texts, with the number of tokens they own."""
    words, codes, ends = _tokens(texts)
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    overlap = spec.longest - 1
    n, hashed = len(codes), _hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(ends)), ends - begins)
    window = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for back in range(overlap):
            window[: n - back] = window[: n - back] * _GOLDEN + hashed[back:]
    place = np.arange(n)
    # A window that ends a text would only make a chunk of its own words.
    whole = place + overlap < ends[doc] if n else np.zeros(0, bool)
    start = whole & (_mix(window) % np.uint64(spec.one_in) == 0)
    start[begins[ends > begins]] = True
    starts = np.flatnonzero(start)
    # Long stretches without a trigger: cut every ``most`` tokens.
    gaps = np.diff(np.append(starts, n))
    starts = starts.repeat(-(-gaps // spec.most)) if n else starts
    if n:
        run = np.concatenate([[True], starts[1:] != starts[:-1]])
        nth = np.arange(len(starts)) - np.maximum.accumulate(np.where(run, np.arange(len(starts)), 0))
        starts = starts + nth * spec.most
    own_doc = doc[starts]
    owned = np.diff(np.append(starts, n))
    lengths = np.minimum(starts + owned + overlap, ends[own_doc]) - starts
    values = words.take(pa.array(codes[_spread(starts, lengths)]))
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    chunks = pc.binary_join(pa.ListArray.from_arrays(offsets, values), " ")
    return pa.RecordBatch.from_arrays(
        [langs.take(pa.array(own_doc)), chunks, pa.array(owned, pa.int32())],
        ["lang", "chunk", "owned"],
    )


def _slices(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Runs of rows of about ``limit`` in all, a larger row by itself."""
    start = total = 0
    for at, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield slice(start, at)
            start, total = at, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def chunk_table(docs: DataFrame, spec: Phrases) -> DataFrame:
    """Distinct chunks per language with their frequency ``n``, stored."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
            for part in _slices(sizes, AT_ONCE):
                rows = batch.slice(part.start, part.stop - part.start)
                yield parse(rows.column("text").to_pylist(), rows.column("lang"), spec)

    named = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    chunks = named.mapInArrow(cut, "lang string, chunk string, owned int")
    return materialise(chunks.groupBy("lang", "chunk", "owned").agg(F.count(F.lit(1)).alias("n")))


# --- Counting ------------------------------------------------------------------


def _phrase_hash(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of a language and words, from their hashes."""
    total = lang.copy()
    with np.errstate(over="ignore"):
        for word in words:
            total = _mix(total * _GOLDEN + word)
    return total


def _cells(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of a hash in an array of a power of two of bits."""
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def _passes(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both cells of a hash are set."""
    hit = np.ones(len(hashes), bool)
    for cell in _cells(hashes, len(field) * 8):
        byte = field[(cell >> np.uint64(3)).astype(np.int64)]
        hit &= (byte >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit


def count_batch(
    rows: pa.RecordBatch, size: int, field: np.ndarray | None
) -> tuple[list[pa.Array], np.ndarray]:
    """Phrases of ``size`` words that the chunks own, with the chunks' frequencies summed."""
    split = pc.split_pattern(rows.column("chunk"), " ")
    offsets = split.offsets.to_numpy()
    coded = split.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy()
    offsets = offsets - offsets[0]
    n, lengths = len(codes), np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(n) - np.repeat(offsets[:-1], lengths)
    mark = pc.index(words, MARK).as_py()
    is_word = codes != mark
    langs = rows.column("lang").dictionary_encode()
    lang = langs.indices.to_numpy()[row]
    owned = rows.column("owned").to_numpy()[row]
    room = lengths[row] - within
    starts = np.flatnonzero((within < owned) & (room >= size))
    for ahead in range(size):
        starts = starts[is_word[starts + ahead]]
    if field is not None:
        hashed, lang_hash = _hashes(words), _hashes(langs.dictionary)
        for shift in (0, 1):
            part = [hashed[codes[starts + shift + i]] for i in range(size - 1)]
            starts = starts[_passes(field, _phrase_hash(lang_hash[lang[starts]], part))]
    # Equal phrases of the batch get one number, a word at a time.
    number = lang[starts].astype(np.int64)
    for ahead in range(size):
        _, number = np.unique(number * len(words) + codes[starts + ahead], return_inverse=True)
    _, one, number = np.unique(number, return_index=True, return_inverse=True)
    counts = np.zeros(len(one), np.int64)
    np.add.at(counts, number, rows.column("n").to_numpy()[row[starts]])
    at = starts[one]
    parts = [words.take(pa.array(codes[at + ahead])) for ahead in range(size)]
    phrase = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, " ")
    return [langs.dictionary.take(pa.array(lang[at])), phrase], counts


def count_phrases(chunks: DataFrame, size: int, field: Broadcast | None) -> DataFrame:
    """Occurrences per language of all phrases of ``size`` words that the filter lets through."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if field is None else np.frombuffer(field.value, np.uint8)
        for batch in batches:
            sizes = pc.binary_length(batch.column("chunk")).to_numpy()
            for part in _slices(sizes, AT_ONCE):
                keys, counts = count_batch(
                    batch.slice(part.start, part.stop - part.start), size, known
                )
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(counts)], ["lang", "phrase", "f"]
                )

    found = chunks.mapInArrow(count, "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_field(frequent: DataFrame, spec: Phrases) -> bytes:
    """Bit array with the cells of all frequent phrases, at most ``filter_bits`` of them."""
    rows = frequent.count()
    bits = min(spec.filter_bits, max(1 << 10, 1 << (16 * rows).bit_length()))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            lang = _hashes(langs.dictionary)[langs.indices.to_numpy()]
            split = pc.split_pattern(batch.column("phrase"), " ")
            offsets = split.offsets.to_numpy()
            hashed = _hashes(split.flatten())
            size = offsets[1] - offsets[0] if len(batch) else 0
            first = offsets[:-1] - offsets[0]
            key = _phrase_hash(lang, [hashed[first + i] for i in range(size)])
            found = np.unique(np.concatenate(_cells(key, bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["cell"])

    # Whole words of the array, of which there are at most bits / 64, whatever the input.
    words = (
        frequent.mapInArrow(cells, "cell long")
        .groupBy(F.shiftright("cell", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("set"))
        .toArrow()
    )
    field = np.zeros(bits // 64, np.int64)
    field[words.column("word").to_numpy()] = words.column("set").to_numpy()
    return field.astype("<i8").tobytes()


def phrase_counts(chunks: DataFrame, spec: Phrases) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase, size, f), and the number of words per language."""
    context = chunks.sparkSession.sparkContext
    unigrams = materialise(count_phrases(chunks, 1, None))
    words = unigrams.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = every = materialise(unigrams.where(F.col("f") >= spec.least))
    every = every.withColumn("size", F.lit(1))
    for size in range(2, spec.longest + 1):
        field = context.broadcast(frequent_field(frequent, spec))
        counted = count_phrases(chunks, size, field)
        frequent = materialise(counted.where(F.col("f") >= spec.least))
        field.destroy()
        every = every.unionByName(frequent.withColumn("size", F.lit(size)))
    return materialise(every), words


# --- Scores --------------------------------------------------------------------


def _wide(column: Column) -> Column:
    """For products past 64 bits."""
    return column.cast("decimal(38,0)")


def _words(first: Column, length: Column) -> Column:
    return F.array_join(F.slice("w", first, length), " ")


def collocations(docs: DataFrame, spec: Phrases | None = None) -> DataFrame:
    """The best-scoring phrases of each language.

    docs: needs ``text`` and ``lang``; other columns are ignored. A null text is empty, a
    null language is ``und`` (like that name itself). Repeated rows count each time.
    Phrases do not cross ``.,;:!?`` or a line end. A text without words, and an empty
    table, give nothing. Texts are parsed about 8 MB at a time, a longer one at once.

    Returns ``lang``, ``rank`` (from 1, by score, count, and then the phrase's bytes),
    ``phrase``, its count ``a``, the counts ``l`` and ``r`` of the parts of its lowest
    scoring cut, ``n`` words of the language, and ``score``.
    """
    spec = spec or Phrases()
    chunks = chunk_table(docs, spec)
    counts, words = phrase_counts(chunks, spec)
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    # Each part of a candidate is itself frequent, so that it is among the counts.
    candidates = counts.where("size > 1").withColumn("w", F.split("phrase", " "))
    cuts = candidates.select(
        "lang", "phrase", F.col("f").alias("a"), "size", "w", cut
    ).select(
        "lang",
        "phrase",
        "a",
        "k",
        _words(F.lit(1), F.col("k")).alias("head"),
        _words(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"),
    )

    def part(name: str, count: str) -> DataFrame:
        return counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))

    scored = (
        cuts.join(part("head", "l"), ["lang", "head"])
        .join(part("tail", "r"), ["lang", "tail"])
        .withColumn("whole", _wide(F.col("l")) + _wide(F.col("r")))
        .withColumn("score", F.expr(f"cast(a as decimal(20,0)) * {spec.scale} div whole"))
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("least"))
    )
    # Every shorter phrase that lies in a candidate, with the largest count of such a one.
    inside = F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1),"
        " i -> array_join(slice(w, i, m), ' '))))"
    )
    holders = (
        candidates.where("size > 2")
        .select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), "f")
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longer"))
    )
    kept = (
        scored.join(materialise(holders), ["lang", "phrase"], "left")
        .where(
            F.col("longer").isNull()
            | (_wide(F.col("longer")) * 100 < _wide(F.col("least.a")) * spec.absorbed)
        )
        .select("lang", "phrase", "least.*")
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= spec.top)
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
