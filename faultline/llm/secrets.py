"""Secrets in texts: patterns, and strings of high entropy, by DataFrame functions only.

Entropy is measured in a window that slides over each candidate string. The
counts of the characters in the window are kept up to date by the character that
enters and the one that leaves, and with them the sum of ``c log2 c``; nothing is
counted anew. Each character class has its own threshold. Candidates on the
allow-list are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the three base kinds. A run of the last two is
#: as long as it can be, so that the least length can stand in the pattern.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12

#: Elements in a block of a running total, and code points in a block of a text.
STEP, BLOCK = 256, 4096
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


@dataclass(frozen=True)
class EntropyRule:
    """A candidate is a run of at least ``window`` characters of the alphabet. The first
    class whose pattern it matches decides; it is reported from the first to the last
    window of more entropy than the threshold. ``allowed`` suppresses candidates."""

    window: int = 20
    classes: tuple[tuple[str, float], ...] = (
        (r"^[0-9]+$", 5.0),
        (r"^[0-9a-fA-F]+$", 2.95),
        (r"^([A-Za-z]+|[A-Za-z]+([_=/-][A-Za-z]*)+)$", 4.15),
        (r"", 3.65),
    )
    allowed: tuple[str, ...] = (
        r"(?i)(example|sample|placeholder|dummy|changeme|redacted|xxxx|0123456789|abcdefgh)",
        r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
        r"^(/[A-Za-z_-]+)+/?$",
        r"^[=_/+-]+$",
    )

    @property
    def pattern(self) -> str:
        return rf"[A-Za-z0-9+/_=-]{{{self.window},}}"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row."""
    return F.transform(F.array(value), body)[0]


def _running_before(values: Column, zero: Column, add: Callable[..., Column]) -> Column:
    """What all earlier elements of ``values`` add up to, for each element.

    Runs over blocks of ``STEP`` elements, each from the total of the blocks before it, so
    that an array which grows by one element at a time never is longer than a block or than
    the number of blocks.
    """

    def grow(seen: Column, value: Column) -> Column:
        return F.array_append(seen, add(F.element_at(seen, -1), value))

    def blocked(given: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(given) - 1) / STEP).cast("int"))
        return F.transform(numbers, lambda b: F.slice(given, b * STEP + 1, STEP))

    def run(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, zero, add))
        return _let(
            F.aggregate(totals, F.array(zero), grow),
            lambda first: F.flatten(
                F.transform(
                    blocks,
                    lambda block, b: F.slice(
                        F.aggregate(block, F.array(F.get(first, b)), grow), 1, F.size(block)
                    ),
                )
            ),
        )

    return _let(values, lambda given: _let(blocked(given), run))


def _located(text: Column, pattern: str, group: int, body: Callable[..., Column]) -> Column:
    """``body(start, match, group)`` of each match. Starts follow from the lengths of
    the pieces between the matches."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def placed(given: Column) -> Column:
        def gap(i: Column) -> Column:
            return F.length(F.get(given["gaps"], i))

        lengths = F.transform(given["found"], lambda m, i: gap(i) + F.length(m))
        return _let(
            _running_before(lengths, F.lit(0), lambda total, n: total + n),
            lambda before: F.transform(
                given["found"],
                lambda m, i: body(F.get(before, i) + gap(i), m, F.get(given["inner"], i)),
            ),
        )

    everything = F.struct(found.alias("found"), gaps.alias("gaps"), inner.alias("inner"))
    return F.when(text.rlike(pattern), _let(everything, placed))


def _span(kind: str, rank: int) -> Callable[..., Column]:
    def made(start: Column, match: Column, inner: Column) -> Column:
        return F.struct(
            start.cast("int").alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            (start + F.length(match)).cast("int").alias("end"),
        )

    return made


def _none_if_empty(spans: Column) -> Column:
    return F.coalesce(spans.cast(SPAN), F.array().cast(SPAN))


def _base(text: Column, pattern: str, kind: str, rank: int, least: int = 0) -> Column:
    spans = _located(text, pattern, 0, _span(kind, rank))
    if least:
        # A match whose value is too short still takes its place.
        def judged(start: Column, match: Column, value: Column) -> Column:
            return F.when(F.length(value) >= least, _span(kind, rank)(start, match, value))

        spans = F.filter(_located(text, pattern, 1, judged), lambda s: s.isNotNull())
    return _none_if_empty(spans)


def _hot_range(candidate: Column, rule: EntropyRule) -> Column:
    """First start and last end (from 0, in the candidate) of its windows over the threshold."""
    window, size = rule.window, len(ALPHABET)
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    limit = F.lit(math.inf)
    for pattern, threshold in reversed(rule.classes):
        limit = F.when(candidate.rlike(pattern), F.lit(threshold)).otherwise(limit)
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))

    def slide(given: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            enters = F.get(given["codes"], i)
            leaves = F.coalesce(F.get(given["codes"], F.when(i >= window, i - window)), F.lit(0))
            counts = state["counts"]
            # Position 0 of the counts stands for "nothing leaves"; it is never looked at.
            both = F.transform(
                counts, lambda c, k: c + (k == enters).cast("int") - (k == leaves).cast("int")
            )
            out = F.get(counts, leaves)
            came = F.get(counts, enters) - (enters == leaves).cast("int")
            total = (
                state["total"]
                - F.when(leaves > 0, F.get(terms, out) - F.get(terms, out - 1)).otherwise(0.0)
                - F.get(terms, came)
                + F.get(terms, came + 1)
            )
            hot = (i >= window - 1) & (F.lit(math.log2(window)) - total / window > given["limit"])
            return F.struct(
                both.alias("counts"),
                total.alias("total"),
                F.when(hot & (state["first"] < 0), i - (window - 1))
                .otherwise(state["first"]).cast("int").alias("first"),
                F.when(hot, i + 1).otherwise(state["last"]).cast("int").alias("last"),
            )

        start = F.struct(
            F.array_repeat(F.lit(0), size + 1).alias("counts"),
            F.lit(0.0).alias("total"),
            F.lit(-1).alias("first"),
            F.lit(-1).alias("last"),
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(given["codes"]) - 1), start, step)

    return _let(F.struct(codes.alias("codes"), limit.alias("limit")), slide)


def _entropy(text: Column, rule: EntropyRule) -> Column:
    def judged(start: Column, match: Column, _: Column) -> Column:
        allowed = F.lit(False)
        for pattern in rule.allowed:
            allowed = allowed | match.rlike(pattern)
        span = _let(
            _hot_range(match, rule),
            lambda r: F.when(
                r["first"] >= 0,
                F.struct(
                    (start + r["first"]).cast("int").alias("start"),
                    F.lit(3).alias("rank"),
                    F.lit("entropy").alias("kind"),
                    (start + r["last"]).cast("int").alias("end"),
                ),
            ),
        )
        return F.when(~allowed, span)

    found = F.filter(_located(text, rule.pattern, 0, judged), lambda s: s.isNotNull())
    return _none_if_empty(found)


def find_secrets(docs: DataFrame, rule: EntropyRule | None = None) -> DataFrame:
    """``row`` (all columns of ``docs``) with ``base`` and ``spans``, arrays of
    (start, rank, kind, end) by start and kind, in code points, end exclusive.

    Kinds: ``assign``, ``access``, ``hex`` (the base kinds) and ``entropy``. A null
    text is empty and has no spans; rows that repeat are judged alike.
    """
    rule = rule or EntropyRule()
    text = F.coalesce(F.col("row.text"), F.lit(""))
    found = docs.select(F.struct("*").alias("row")).select(
        "row",
        F.array_sort(
            F.concat(
                _base(text, ASSIGN, "assign", 0, ASSIGN_VALUE),
                _base(text, ACCESS, "access", 1),
                _base(text, HEX, "hex", 2),
            )
        ).alias("base"),
        _entropy(text, rule).alias("more"),
    )
    return found.select(
        "row", "base", F.array_sort(F.concat("base", "more")).alias("spans")
    )


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", rule: EntropyRule | None = None) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans by one mark.

    ``n_chars``, if there is such a column, follows the text. All rows and columns stay.
    """
    text, spans = F.col("row.text"), F.col("spans")
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    ends = F.transform(spans, lambda s: s["end"])
    reached = _running_before(ends, F.lit(0), lambda most, end: F.greatest(most, end))

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        """The text from ``start`` to ``end``, of which only the blocks in question are read."""
        first, last = [F.floor(at / BLOCK).cast("int") for at in (start, end - 1)]
        one = F.substring(F.get(pieces, first), start - first * BLOCK + 1, end - start)
        more = F.concat(
            F.substring(F.get(pieces, first), start - first * BLOCK + 1, F.lit(BLOCK)),
            F.array_join(F.slice(pieces, first + 2, last - first - 1), ""),
            F.substring(F.get(pieces, last), F.lit(1), end - last * BLOCK),
        )
        return F.when(end <= start, F.lit("")).when(first == last, one).otherwise(more)

    def joined(given: Column) -> Column:
        def part(span: Column, i: Column) -> Column:
            at = F.get(given["reached"], i)
            clear = F.concat(cut(given["blocks"], at, span["start"]), F.lit(mark))
            return F.when(span["start"] >= at, clear)

        # Spans that begin within an earlier one give null, which the join leaves out.
        return F.concat(
            F.array_join(F.transform(spans, part), ""),
            cut(given["blocks"], F.array_max(ends), given["length"]),
        )

    cleaned = _let(
        F.struct(
            blocks.alias("blocks"), reached.alias("reached"), F.length(text).alias("length")
        ),
        joined,
    )
    found = find_secrets(docs, rule).withColumn("clean", F.when(F.size(spans) > 0, cleaned))
    changed = {"text": F.coalesce("clean", text)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.coalesce(F.length("clean").cast(kind), F.col("row.n_chars"))
    return found.select(
        *[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )
