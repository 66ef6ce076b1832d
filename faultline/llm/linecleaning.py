"""Line-first cleaning, by DataFrame functions only.

Each line is judged by itself: navigation, boilerplate and lines with hardly a
letter go. A document is rejected if too little of its text is left, after base
rules on the whole document have been applied.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base rules.
SPACES = " \t\n\u000b\u000c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words


#: ASCII characters that are neither letters nor white space.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())
MARK_RUN = r"[!?#*$%&|<>]{2,}"
#: Inside of character classes: white space, and all of it that is no letter.
SPACE = r"\x20\x09-\x0D"
SPACE_RUN = rf"[{SPACE}]+"
NOT_SOLID = rf"[{SPACE}\x21-\x40\x5B-\x60\x7B-\x7E]+"


@dataclass(frozen=True)
class LineRules:
    """Which lines go, whatever their length.

    menu: items, in any case; a line of nothing but those, with white space or one of
    ``|>/:`` between them, is navigation. boilerplate: a pattern without look-around.
    sentence_end: what a line of at most ``short`` words must end with. mark_runs: runs of
    doubled marks a word, from which a line goes. letters: least share of a line's
    characters that are no ASCII marks or digits. kept: least share of such characters
    that the document must keep.
    """

    menu: tuple[str, ...] = (
        "home", "about us", "about", "contact us", "contact", "login", "log in", "sign in",
        "sign up", "register", "search", "menu", "next", "previous", "back", "top", "share",
        "tweet", "print", "sitemap", "subscribe", "faq", "help",
    )
    boilerplate: str = (
        r"(?i)(?:all rights reserved|copyright (?:\(c\)|[12][0-9]{3})|lorem ipsum|"
        r"javascript (?:is|must be) (?:disabled|enabled)|enable javascript|privacy policy|cookie policy|"
        r"terms of (?:use|service)|(?:site|website) uses cookies|accept (?:all )?cookies|"
        r"licensed under|spdx-license-identifier|permission is hereby granted)"
    )
    sentence_end: str = r"[.!?:;\"'\x29\x{2026}\x{201D}\x{BB}]\s*$"
    short: int = 4
    mark_runs: float = 0.25
    letters: float = 0.5
    kept: float = 0.5

    @property
    def menu_item(self) -> str:
        """One item and what may stand after it; longer items come first."""
        items = "|".join(sorted(self.menu, key=lambda item: (-len(item), item)))
        return rf"(?:{items})(?:\s*[|>/:]\s*|\s+|$)"

    @property
    def navigation(self) -> str:
        return rf"(?i)^\s*(?:{self.menu_item})+$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN), "")


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more.

    Only a text that repeats the hash of a window sorts the windows themselves, with their
    places; one equal to a neighbour in that order is repeated, and each covers up to three
    words.
    """

    def over(w: Column, made: Callable[..., Column]) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.transform(starts, lambda i: made(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def windows(w: Column) -> Column:
        def strings() -> Column:
            return _let(over(w, lambda *three: F.concat_ws(" ", *three)), places)

        return _let(
            over(w, F.xxhash64),
            lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), strings()).otherwise(0),
        )

    def places(joined: Column) -> Column:
        ordered = F.array_sort(
            F.transform(joined, lambda j, i: F.struct(j.alias("w"), i.alias("at")))
        )

        def repeated(s: Column) -> Column:
            same = F.filter(
                F.transform(
                    s,
                    lambda x, i: F.when(
                        (x["w"] == F.get(s, i - 1)["w"]) | (x["w"] == F.get(s, i + 1)["w"]), x["at"]
                    ),
                ),
                lambda at: at.isNotNull(),
            )
            return _let(F.array_sort(same), covered)

        return _let(ordered, repeated)

    def covered(at: Column) -> Column:
        steps = F.transform(
            at, lambda a, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - a, F.lit(WINDOW)))
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    return _let(words, lambda w: F.when(F.size(w) >= WINDOW, windows(w)).otherwise(0)).cast("long")


def _filled(line: Column) -> Column:
    """Characters that are no white space."""
    return F.length(F.regexp_replace(line, SPACE_RUN, ""))


def _solid(line: Column) -> Column:
    """Characters that are neither white space nor ASCII marks or digits."""
    return F.length(F.regexp_replace(line, NOT_SOLID, ""))


def failing_line(line: Column, filled: Column, solid: Column, seen: Column, rules: LineRules) -> Column:
    """True for a line that goes. A line without a word stays; it carries no text.

    seen: whether the whole text holds ``boilerplate`` and mark ``runs`` at all.
    """
    # Items are taken off one after the other, which needs no stack for a long menu.
    rest = F.regexp_replace(line, rf"(?i)(?:^\s*|\G){rules.menu_item}", "")
    menu = line.rlike(rf"(?i)^\s*{rules.menu_item}") & (F.length(rest) == 0)
    runs = F.size(F.regexp_extract_all(line, F.lit(MARK_RUN), F.lit(0)))
    doubled = seen["runs"] & line.rlike(MARK_RUN) & (runs >= F.lit(rules.mark_runs) * F.size(words_of(line)))
    more_words = rf"^[{SPACE}]*+(?:[^{SPACE}]++[{SPACE}]++){{{rules.short}}}[^{SPACE}]"
    short = ~line.rlike(more_words) & ~line.rlike(rules.sentence_end)
    return (filled > 0) & (
        (solid < F.lit(rules.letters) * filled)
        | short
        | menu
        | (seen["boilerplate"] & line.rlike(rules.boilerplate))
        | doubled
    )


def clean_lines(docs: DataFrame, rules: LineRules | None = None) -> DataFrame:
    """Judge every row of ``docs``, by its whole text.

    Returns ``row`` (all columns of ``docs``), ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``cleaned``
    (the text without its failing lines) and ``kept`` (false if the base rules fail or
    less than ``rules.kept`` of the letters is left). A null text has no
    words and fails; repeated rows are judged alike.
    """
    rules = rules or LineRules()
    text = F.coalesce(F.col("row.text"), F.lit(""))

    def total(lines: Column, name: str) -> Column:
        return F.aggregate(lines, F.lit(0).cast("long"), lambda sum_, x: sum_ + x[name])

    def judged(lines: Column) -> Column:
        with_words = F.transform(F.filter(lines, lambda x: x["filled"] > 0), lambda x: x["line"])
        seen = F.struct(
            text.rlike(f"(?m){rules.boilerplate}").alias("boilerplate"), text.rlike(MARK_RUN).alias("runs")
        )
        kept = _let(
            seen,
            lambda s: F.filter(
                lines, lambda x: ~failing_line(x["line"], x["filled"], x["solid"], s, rules)
            ),
        )
        return F.struct(
            total(lines, "filled").alias("word_chars"),
            total(lines, "solid").alias("solid"),
            _let(with_words, lambda w: F.size(w) - F.size(F.array_distinct(w))).alias("n_dup_lines"),
            _let(
                kept,
                lambda k: F.struct(
                    total(k, "solid").alias("left"),
                    F.array_join(F.transform(k, lambda x: x["line"]), "\n").alias("cleaned"),
                ),
            ).alias("kept"),
        )

    # Each line is measured once; white space and marks end at its end.
    lines = F.transform(
        F.split(text, "\n"),
        lambda x: F.struct(
            x.alias("line"),
            _filled(x).cast("long").alias("filled"),
            _solid(x).cast("long").alias("solid"),
        ),
    )
    counted = docs.select(F.struct("*").alias("row")).select(
        "row",
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        _let(lines, judged).alias("lines"),
        _let(
            words_of(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")
            ),
        ).alias("words"),
    )
    n_words, repeated = F.col("words.n_words"), F.col("words.n_repeat_words")
    failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
    enough = F.col("lines.kept.left") >= F.lit(rules.kept) * F.col("lines.solid")
    return counted.select(
        "row",
        n_words.alias("n_words"),
        F.col("lines.word_chars").alias("word_chars"),
        "n_symbols",
        F.col("lines.n_dup_lines").cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.col("lines.kept.cleaned").alias("cleaned"),
        (~failed & enough).alias("kept"),
    )
