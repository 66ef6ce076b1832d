"""Adaptive conformal bands: each day's level depends on whether the day before was hit.

A series is folded day by day inside one expression. What the fold carries is the state of
the band; it can be stored and advanced by the days that arrive later, with the same result
as a run over all days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Band target, burn-in and residual window in days, daily step
# and limits of the adaptive level.
BAND_ALPHA, BAND_BURN, BAND_WINDOW, BAND_STEP, BAND_LIMITS = 0.20, 28, 60, 0.03, (0.01, 0.60)

SERIES = ["scope", "horizon"]
STATE = ["level", "recent", "seen", "q_low", "q_high"]


def scale(value: Column) -> Column:
    return F.greatest(F.sqrt(F.greatest(value, F.lit(0.0))), F.lit(1.0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row."""
    return F.transform(F.array(value), body)[0]


def quantile(ordered: Column, share: Column) -> Column:
    """Linear interpolation between the values of a sorted array."""
    place = share * (F.size(ordered) - 1)
    low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, high)
    return below + (above - below) * (place - F.floor(place))


def first_state() -> Column:
    return F.struct(
        F.lit(BAND_ALPHA).alias("level"),
        F.array().cast("array<double>").alias("recent"),
        F.lit(0).alias("seen"),
        F.lit(0.0).alias("q_low"),
        F.lit(0.0).alias("q_high"),
    )


def _advance(state: Column, day: Column) -> Column:
    """State after one known day, with the day's band."""
    y, predicted = day["y"], day["predicted"]
    ready = state["seen"] >= BAND_BURN

    def with_quantiles(q: Column) -> Column:
        low = F.greatest(F.lit(0.0), predicted + q["low"] * scale(predicted))
        high = predicted + q["high"] * scale(predicted)
        return _let(F.struct(low.alias("low"), high.alias("high")), lambda b: with_band(q, b))

    def with_band(q: Column, band: Column) -> Column:
        missed = F.when((band["low"] <= y) & (y <= band["high"]), 0.0).otherwise(1.0)
        moved = state["level"] + F.lit(BAND_STEP) * (F.lit(BAND_ALPHA) - missed)
        level = F.greatest(F.lit(BAND_LIMITS[0]), F.least(F.lit(BAND_LIMITS[1]), moved))
        residual = (y - predicted) / scale(predicted)
        recent = F.concat(state["recent"], F.array(residual))
        kept = F.when(
            F.size(recent) > BAND_WINDOW, F.slice(recent, -BAND_WINDOW, BAND_WINDOW)
        ).otherwise(recent)
        return F.struct(
            F.when(ready, level).otherwise(state["level"]).alias("level"),
            kept.alias("recent"),
            (state["seen"] + 1).alias("seen"),
            q["low"].alias("q_low"),
            q["high"].alias("q_high"),
            F.when(ready, band["low"]).alias("lower_bound"),
            F.when(ready, band["high"]).alias("upper_bound"),
        )

    def both(ordered: Column) -> Column:
        return F.struct(
            F.when(ready, quantile(ordered, state["level"] / 2)).otherwise(state["q_low"]).alias("low"),
            F.when(ready, quantile(ordered, 1 - state["level"] / 2)).otherwise(state["q_high"]).alias("high"),
        )

    return _let(F.array_sort(state["recent"]), lambda o: _let(both(o), with_quantiles))


def _fold(series: DataFrame, state: Column) -> DataFrame:
    """Fold the array ``days`` from ``state``; adds ``after`` and the array ``bands``."""
    start = F.struct(*[state[n].alias(n) for n in STATE], F.array().cast(
        "array<struct<lower_bound:double,upper_bound:double>>"
    ).alias("bands"))

    def step(kept: Column, day: Column) -> Column:
        def joined(after: Column) -> Column:
            band = F.struct(after["lower_bound"].alias("lower_bound"), after["upper_bound"].alias("upper_bound"))
            return F.struct(
                *[after[n].alias(n) for n in STATE],
                F.concat(kept["bands"], F.array(band)).alias("bands"),
            )

        return _let(_advance(kept, day), joined)

    folded = series.withColumn("folded", F.aggregate("days", start, step))
    after = F.struct(*[F.col(f"folded.{n}").alias(n) for n in STATE])
    return folded.select("*", after.alias("after"), F.col("folded.bands").alias("bands")).drop("folded")


def _series(chosen: DataFrame) -> DataFrame:
    """One row per series with its known days in order: as many as the calendar has."""
    known = chosen.where(F.col("y").isNotNull())
    day = F.struct("day", "candidate", F.col("y").cast("double").alias("y"), F.col("predicted").cast("double").alias("predicted"))
    return known.groupBy(*SERIES).agg(F.sort_array(F.collect_list(day)).alias("days"))


def conformal_bands(chosen: DataFrame) -> DataFrame:
    """Bands of each series of (day, y, predicted), from its first day on.

    Days of the burn-in get the first band that was computed; without one, the prediction.
    """
    folded = _fold(_series(chosen).withColumn("state", first_state()), F.col("state"))
    spread = folded.withColumn("first", F.try_element_at(
        F.filter("bands", lambda b: b["lower_bound"].isNotNull()), F.lit(1)
    )).select(
        *SERIES, "after", "first", F.inline(F.arrays_zip("days", "bands"))
    )
    predicted = F.col("days.predicted")
    return spread.select(
        *SERIES,
        F.col("days.day").alias("day"),
        F.col("days.candidate").alias("candidate"),
        F.col("days.y").alias("y"),
        predicted.alias("predicted"),
        F.coalesce("bands.lower_bound", "first.lower_bound", predicted).alias("lower_bound"),
        F.coalesce("bands.upper_bound", "first.upper_bound", predicted).alias("upper_bound"),
        F.col("bands.lower_bound").isNotNull().alias("evaluated"),
        F.col("after.q_low").alias("q_low"),
        F.col("after.q_high").alias("q_high"),
    )


def band_states(chosen: DataFrame) -> DataFrame:
    """State of each series after its known days, with the last of them."""
    folded = _fold(_series(chosen).withColumn("state", first_state()), F.col("state"))
    last = F.element_at("days", -1)
    return folded.select(
        *SERIES, last["day"].alias("last_day"), last["candidate"].alias("candidate"), "after.*"
    )


def advance_bands(states: DataFrame, arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bands of the days that have arrived since ``states``, and the states after them.

    Days up to a state's own last day are ignored, so that a repeated batch does no harm;
    a series without a state starts one.
    """
    state = F.struct(*STATE)
    before = states.select(*SERIES, F.col("last_day").alias("reached"), state.alias("state"))
    series = (
        _series(arrived)
        .join(before, SERIES, "left")
        .withColumn("state", F.coalesce("state", first_state()))
        .withColumn(
            "days",
            F.filter("days", lambda d: F.col("reached").isNull() | (d["day"] > F.col("reached"))),
        )
        .where(F.size("days") > 0)
    )
    folded = _fold(series, F.col("state"))
    last = F.element_at("days", -1)
    moved = folded.select(
        *SERIES, last["day"].alias("last_day"), last["candidate"].alias("candidate"), "after.*"
    )
    rest = states.join(moved.select(*SERIES), SERIES, "left_anti")
    bands = folded.select(*SERIES, F.inline(F.arrays_zip("days", "bands"))).select(
        *SERIES, "days.*", "bands.*"
    )
    return bands, rest.unionByName(moved)


def coverage(bands: DataFrame, first_day: str) -> DataFrame:
    """Share of evaluated days inside the band, and its mean width."""
    rows = bands.where(F.col("evaluated") & (F.col("day") >= F.lit(first_day).cast("date")))
    inside = F.col("y").between(F.col("lower_bound"), F.col("upper_bound"))
    return rows.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("days"),
        F.avg(inside.cast("int")).alias("coverage"),
        F.avg(F.col("upper_bound") - F.col("lower_bound")).alias("mean_width"),
    )


def band_limits(predicted: Column, q_low: Column, q_high: Column) -> tuple[Column, Column]:
    lower = F.greatest(predicted + q_low * scale(predicted), F.lit(0.0))
    return lower, F.greatest(predicted + q_high * scale(predicted), lower)
