"""How filters overlap: what each removes, in every order they can be applied.

Flags of a text come from one scan. Whether a text occurs earlier is found in steps
that keep texts out of the shuffle where they can: each text counts up a few cells of
a counting Bloom filter; partial counts of all tasks are merged; a text that has a
cell which nothing else counted is unique for sure. Only the others are grouped by
their full text, for the least id of each. Documents are then counted by part and by
mask of failed filters, and the counts are added up per order and step.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import WORD_SPACE
from faultline.session import materialise

#: A filter is a bit of the mask, in this order.
FILTERS = "ABCDE"
REPEATED = FILTERS.index("E")
#: Cells of a segment of the sketch, all within which a text's cells lie; bits of a word.
SEGMENT_BITS, WORD_BITS = 15, 6


@dataclass(frozen=True)
class AuditRules:
    """Limits of the filters and the size of the sketch.

    A: fewer than ``least_words`` words. B: 100 * distinct words < ``distinct`` * words.
    C: 100 * capital letters A-Z > ``capitals`` * code points. D: holds one of
    ``symbols`` (inside of a character class). E: the same text has a smaller doc_id.
    cells, hashes: counters per document and how many of them a text counts up.
    most_segments: the merged sketch is broadcast and never has more segments, of 4 KB
    each (64 MB, which serves 33 million documents at 16 cells). Beyond that more unique
    texts look like repeats and are grouped too; results do not change.
    """

    least_words: int = 50
    distinct: int = 65
    capitals: int = 5
    symbols: str = "#$%&*|"
    cells: int = 16
    hashes: int = 3
    most_segments: int = 1 << 14


def text_flags(text: Column, rules: AuditRules) -> Column:
    """Mask of the filters that look at the text alone; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, WORD_SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [
        n < rules.least_words,
        100 * distinct < rules.distinct * n,
        100 * capitals > rules.capitals * F.length(text),
        text.rlike(f"[{rules.symbols}]"),
    ]
    bits = [F.when(fail, F.lit(1 << place)).otherwise(F.lit(0)) for place, fail in enumerate(fails)]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return mask


def _places(key: Column, rules: AuditRules, segments: int) -> tuple[Column, list[Column]]:
    """Segment and cells of a 64-bit hash, from bits of their own."""
    if rules.hashes * SEGMENT_BITS + (rules.most_segments - 1).bit_length() > 64:
        raise ValueError("A 64-bit hash has too few bits for so many cells and segments")
    cells = [
        F.shiftrightunsigned(key, SEGMENT_BITS * i).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
        for i in range(rules.hashes)
    ]
    rest = F.shiftrightunsigned(key, SEGMENT_BITS * rules.hashes)
    return (rest % segments).cast("int"), [c.cast("int") for c in cells]


def merged_sketch(keys: DataFrame, rules: AuditRules, segments: int) -> DataFrame:
    """Segments of the counting filter, as bits of the cells counted twice or more.

    Each task adds up its own counts before the shuffle. A text counts a cell once,
    also where two of its hashes meet.
    """
    segment, cells = _places(F.col("key"), rules, segments)
    word = F.shiftright("cell", WORD_BITS)
    bit = F.expr(f"shiftleft(1L, cell & {(1 << WORD_BITS) - 1})")
    counted = (
        keys.select(segment.alias("segment"), F.explode(F.array_distinct(F.array(*cells))).alias("cell"))
        .groupBy("segment", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .groupBy("segment", word.alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
        .groupBy("segment")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("set"))
    )
    every = F.sequence(F.lit(0), F.lit((1 << SEGMENT_BITS - WORD_BITS) - 1))
    words = F.transform(every, lambda w: F.coalesce(F.col("set")[w], F.lit(0).cast("long")))
    return counted.select("segment", words.alias("words"))


def possible_repeats(rows: DataFrame, sketch: DataFrame, rules: AuditRules, segments: int) -> DataFrame:
    """The ``rows`` (with ``key``) that the sketch does not clear as unique."""
    segment, cells = _places(F.col("key"), rules, segments)
    probed = rows.withColumn("segment", segment).join(F.broadcast(sketch), "segment")
    for cell in cells:
        place = cell.bitwiseAND(F.lit((1 << WORD_BITS) - 1))
        word = F.get("words", F.shiftright(cell, WORD_BITS))
        probed = probed.where(F.call_function("getbit", word, place) == 1)
    return probed.drop("segment", "words")


def mark_documents(docs: DataFrame, part: Column, rules: AuditRules) -> DataFrame:
    """One small row per document: id, part, mask of the filters A to D, and hashes of the text.

    The 64-bit ``key`` places a text in the sketch; ``digest`` stands for the text in joins.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        F.coalesce(part.cast("string"), F.lit("")).alias("part"),
        text_flags(F.col("text"), rules).alias("mask"),
        F.xxhash64(text).alias("key"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )


def repeat_flags(docs: DataFrame, marks: DataFrame, rules: AuditRules) -> DataFrame:
    """The stored ``marks`` with the bit of the documents whose text a smaller id has.

    Full texts are shuffled for possible repeats only, and one per task and text.
    """
    # Sized by the rows: a count that reads no column.
    needed = marks.count() * rules.cells >> SEGMENT_BITS
    segments = max(1, min(rules.most_segments, 1 << needed.bit_length()))
    sketch = materialise(merged_sketch(marks.select("key"), rules, segments))
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("key"))
    firsts = materialise(
        possible_repeats(texts, sketch, rules, segments)
        .groupBy("text")
        .agg(F.min("doc_id").alias("first"))
        .select("first", F.unhex(F.sha2("text", 256)).alias("first_digest"))
    )
    repeats = possible_repeats(marks, sketch, rules, segments)
    is_first = (F.col("doc_id") == F.col("first")) & (F.col("digest") == F.col("first_digest"))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    judged = repeats.join(firsts, is_first, "left").select(
        "doc_id",
        "part",
        F.when(later, F.col("mask").bitwiseOR(F.lit(1 << REPEATED))).otherwise(F.col("mask")).alias("mask"),
    )
    return judged.unionByName(_cleared(marks, sketch, rules, segments))


def _cleared(marks: DataFrame, sketch: DataFrame, rules: AuditRules, segments: int) -> DataFrame:
    """The rows that ``possible_repeats`` leaves out."""
    segment, cells = _places(F.col("key"), rules, segments)
    probed = marks.withColumn("segment", segment).join(F.broadcast(sketch), "segment", "left")
    alone = F.col("words").isNull()
    for cell in cells:
        place = cell.bitwiseAND(F.lit((1 << WORD_BITS) - 1))
        word = F.get("words", F.shiftright(cell, WORD_BITS))
        alone = alone | (F.call_function("getbit", word, place) == 0)
    return probed.where(alone).select("doc_id", "part", "mask")


def mask_counts(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per part and mask, and how many of them are labelled good or toxic."""
    known = materialise(
        labels.groupBy(F.col("doc_id").alias("labelled"))
        .agg(
            F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
            F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
        )
        .where("good or toxic")
    )
    joined = flagged.join(known, F.col("doc_id") == F.col("labelled"), "left")
    return joined.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("good")).alias("good"),
        F.count_if(F.col("toxic")).alias("toxic"),
    )


def order_steps(counts: DataFrame) -> DataFrame:
    """Every order and step from the counts per part and mask.

    What a step does depends only on the set of filters before it: there are 80 pairs of
    such a set and a filter, each of which stands for several orders.
    """
    size = len(FILTERS)
    pairs = [
        (before, bit, factorial(before.bit_count()) * factorial(size - 1 - before.bit_count()))
        for bit in (1 << place for place in range(size))
        for before in range(1 << size)
        if not before & bit
    ]
    choices = F.array(
        *[
            F.struct(F.lit(b).alias("before"), F.lit(f).alias("bit"), F.lit(w).alias("orders"))
            for b, f, w in pairs
        ]
    )
    mask, before, bit = F.col("mask"), F.col("before"), F.col("bit")
    passed = mask.bitwiseAND(before) == 0
    fails = mask.bitwiseAND(bit) != 0

    def total(what: str, where: Column) -> Column:
        return F.sum(F.when(where, F.col(what)).otherwise(0))

    done = (
        counts.select("*", F.inline(choices))
        .groupBy("part", "before", "bit", "orders")
        .agg(
            total("n", passed & ~fails).alias("kept"),
            total("n", passed & fails).alias("removed"),
            total("n", ~passed & fails).alias("redundant"),
            total("n", mask == bit).alias("unique_fails"),
            total("good", passed & fails).alias("good_lost"),
            total("toxic", passed & fails).alias("toxic_lost"),
        )
    )
    share = done.groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = [
        (sum(1 << FILTERS.index(f) for f in order[:at]), 1 << FILTERS.index(order[at]), "".join(order), at + 1)
        for order in permutations(FILTERS)
        for at in range(size)
    ]
    # 600 rows: five steps of 120 orders.
    named = counts.sparkSession.createDataFrame(
        steps, "before int, bit int, filter_order string, step int"
    )
    return (
        done.join(share, ["part", "bit"])
        .join(F.broadcast(named), ["before", "bit"])
        .select(
            "part",
            "filter_order",
            "step",
            "kept",
            "removed",
            "redundant",
            "unique_fails",
            "good_lost",
            "toxic_lost",
            "shapley",
        )
    )


def audit(
    docs: DataFrame, labels: DataFrame, part: str = "source", rules: AuditRules | None = None
) -> DataFrame:
    """What each filter removes at each step of each order, per part.

    docs: needs ``doc_id``, ``text`` and the column ``part``; labels: ``doc_id``,
    ``quality``, ``toxic``; other columns are ignored. A null text is empty (it fails A
    only), a null part is the empty string. A document repeats another if the other has
    an equal text and a smaller id, wherever it lies; equal ids do not repeat each other,
    and a row without id neither repeats nor is repeated. Rows that are there twice count
    twice. A document is good or toxic if any of its labels says so; labels of no
    document are ignored. An empty table gives no rows.

    Returns for every part, order (``filter_order``) and ``step`` (from 1): documents
    ``kept`` after it, ``removed`` by it, ``redundant`` (failing it, removed before),
    ``unique_fails`` (failing it alone), ``good_lost`` and ``toxic_lost`` among the
    removed, and ``shapley``, what its filter removes summed over all orders.
    """
    rules = rules or AuditRules()
    marks = materialise(mark_documents(docs, F.col(part), rules))
    counts = materialise(mask_counts(repeat_flags(docs, marks, rules), labels))
    return order_steps(counts)
