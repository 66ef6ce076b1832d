"""Queries over series, features and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.functions.calendars import calendar_features
from faultline.operators import bands, bundle, forecast, gold, quality, refit, serving, series
from faultline.session import materialise, scratch_path
from faultline.sources import sinks
from workload.tables import Tables

# The series and the fits start with the data; FIRST bounds the days that are evaluated, and
# BOOSTED_FROM those on which trees are fitted anew (one fit a day, and one for all days ahead).
START, FIRST, SELECTION_END, REPORT = "1995-01-01", "2001-04-01", "2001-05-31", "2001-06-01"
BOOSTED_FROM = "2001-08-01"
#: Last day of the stored band states that ``advanced_bands`` starts from.
STORED_UNTIL = "2001-07-01"
GENERATED_AT = "2026-01-01 00:00:00"
VERSION = "volume-check"


def context(t: Tables) -> DataFrame:
    return series.series_context(t.order_silver(), START)


def features(t: Tables) -> DataFrame:
    return series.feature_frame(context(t))


def volume(t: Tables) -> DataFrame:
    return gold.daily_volume(t.order_silver())


def calendar(t: Tables) -> DataFrame:
    days = t.order_silver().select(F.col("opened_date").alias("day")).distinct()
    return days.withColumns(calendar_features(F.col("day")))


def spoiled_predictions(t: Tables) -> DataFrame:
    """Predictions with one rule of the contract broken on each of some days of the month."""
    rows = daily_predictions(t).withColumn("place", F.dayofmonth("reference_date"))
    broken = {
        "reference_date": (2, F.lit(None)),
        "generated_at": (3, F.lit(None)),
        "horizon": (4, F.lit("D+2")),
        "priority_scope": (5, F.lit("P9")),
        "predicted_incident_count": (6, F.lit(-1.0)),
        "lower_bound": (7, F.col("upper_bound") + 1),
        "upper_bound": (8, F.lit(None)),
        "model_name": (9, F.lit(" ")),
        "model_version": (10, F.lit(None)),
    }
    spoiled = rows.withColumns(
        {
            name: F.when(F.col("place") == place, value.cast(rows.schema[name].dataType)).otherwise(
                F.col(name)
            )
            for name, (place, value) in broken.items()
        }
    )
    return materialise(spoiled.unionAll(spoiled.where("place = 11")).drop("place"))


def naive_rows(t: Tables) -> DataFrame:
    """The three naive candidates on the evaluation days, one row each."""
    complete = series.complete_rows(features(t)).where(F.col("day") >= F.lit(FIRST).cast("date"))
    return series.naive_forecasts(complete).unpivot(
        ["scope", "horizon", "day", "y"], forecast.NAIVE, "candidate", "predicted"
    )


def generated():
    return F.lit(GENERATED_AT).cast("timestamp")


def stored_features(t: Tables) -> DataFrame:
    """Features written once: a few rows per day, read by several steps."""
    context_rows = series.series_context(t.order_silver(), START)
    return materialise(series.feature_frame(context_rows))


def baseline_coefficients(t: Tables) -> DataFrame:
    fitted = forecast.least_squares(
        series.baseline_features(volume(t)), "priority_scope", S.BASELINE_FEATURES, "incident_count"
    )
    return fitted.select("priority_scope", F.posexplode("coefficients").alias("place", "value"))


def learned(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features, candidates that SQL can repeat (naive and ridge), and the ridge fits; stored."""
    rows = stored_features(t)
    candidates, fits = forecast.candidate_forecasts(rows, FIRST, poisson=False)
    return rows, materialise(candidates), fits


def stored_bundle(t: Tables, selection, candidates, fits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Choose, compute bands, publish the bundle and read it back."""
    chosen = materialise(forecast.chosen_forecasts(candidates, selection))
    banded = materialise(bands.conformal_bands(chosen))
    root = scratch_path(t.spark, "bundles")
    made = bundle.build_bundle(selection, fits, banded, VERSION)
    sinks.publish_version(made.drop("model_version"), root, VERSION, "train")
    return sinks.read_current(t.spark, root), chosen, banded


def only_ridge(candidates: DataFrame) -> DataFrame:
    return candidates.where("candidate = 'ridge'").groupBy("scope", "horizon", "candidate").agg(
        F.lit(0.0).alias("selection_mae")
    )


def ridge_rows(t: Tables) -> DataFrame:
    rows = stored_features(t)
    fits = refit.ridge_parameters(refit.ridge_moments(rows, FIRST))
    return refit.predict_fits(rows, fits)


def walk_forward(t: Tables) -> DataFrame:
    rows = stored_features(t)
    ridge = refit.ridge_parameters(refit.ridge_moments(rows, FIRST))
    fits = materialise(ridge.unionByName(refit.poisson_parameters(rows, FIRST)))
    return refit.predict_fits(rows, fits)


def volume_bundle(t: Tables) -> DataFrame:
    _, candidates, fits = learned(t)
    stored, _, _ = stored_bundle(t, only_ridge(candidates), candidates, fits)
    return stored.select(
        "scope", "horizon", "candidate", "until", "kind", "intercept", "q_low", "q_high",
        F.posexplode("coefficients").alias("place", "coefficient"),
    )


def volume_forecast(t: Tables) -> DataFrame:
    """Twelve rows from the stored bundle; the fits are only read."""
    rows, candidates, fits = learned(t)
    selection = materialise(forecast.occam_select(candidates, SELECTION_END))
    stored, _, _ = stored_bundle(t, selection, candidates, fits)
    bundle.require_bundle(rows, stored)
    published = materialise(bundle.predict_volume(rows, stored, generated()))
    forecast.require_predictions(published)
    return published


def parity(t: Tables, changed: bool) -> DataFrame:
    """Prediction from the stored parameters against the last days of the walk-forward."""
    rows, candidates, fits = learned(t)
    stored, chosen, banded = stored_bundle(t, only_ridge(candidates), candidates, fits)
    if changed:
        last = len(S.LEVEL_FEATURES) - len(S.CALENDAR_FEATURES)
        hit = (F.col("scope") == "ALL") & (F.col("horizon") == "D+1")
        moved = F.transform("coefficients", lambda c, i: F.when(i < last, c + 1).otherwise(c))
        stored = stored.withColumn("coefficients", F.when(hit, moved).otherwise(F.col("coefficients")))
    published = forecast.publish_predictions(chosen, banded, rows, generated(), VERSION)
    return bundle.forecast_differences(bundle.predict_volume(rows, stored, generated()), published)


def boosted_rows(t: Tables) -> DataFrame:
    """All candidates on the days from which trees are fitted."""
    rows = stored_features(t)
    return forecast.candidate_forecasts(rows, BOOSTED_FROM, BOOSTED_FROM)[0]


def naive_chosen(t: Tables) -> DataFrame:
    rows = materialise(naive_rows(t))
    return forecast.chosen_forecasts(rows, forecast.occam_select(rows, SELECTION_END))


def advanced_bands(t: Tables) -> DataFrame:
    """Bands of the days after the stored states, a week at a time."""
    chosen = materialise(naive_chosen(t))
    cut = F.lit(STORED_UNTIL).cast("date")
    states = materialise(bands.band_states(chosen.where(F.col("day") <= cut)))
    arrived = chosen.where((F.col("day") > cut) & F.col("y").isNotNull())
    first, states = bands.advance_bands(states, arrived.where(F.col("day") <= F.date_add(cut, 7)))
    rest, _ = bands.advance_bands(materialise(states), arrived)
    return first.unionByName(rest)


def daily_predictions(t: Tables) -> DataFrame:
    """Past seven-day means as if each had been published, with bounds of a fifth."""
    value = F.bround("roll7_mean", 2)
    return features(t).where(F.col("roll7_mean").isNotNull()).select(
        F.col("day").alias("reference_date"),
        F.date_sub("day", F.col("horizon_days")).cast("timestamp").alias("generated_at"),
        "horizon",
        F.col("scope").alias("priority_scope"),
        value.alias("predicted_incident_count"),
        F.bround(value * 0.8, 2).alias("lower_bound"),
        F.bround(value * 1.2, 2).alias("upper_bound"),
        F.lit("media7").alias("model_name"),
        F.lit(VERSION).alias("model_version"),
    )


def upserted(t: Tables) -> DataFrame:
    """Current forecasts up to a day, replaced by those of the following week."""
    rows = daily_predictions(t)
    cut, day = F.lit("2001-06-30").cast("date"), F.col("reference_date")
    current = serving.latest_predictions(rows.where(day <= cut))
    batch = rows.where((day > cut) & (day <= F.date_add(cut, 7)) & (F.col("priority_scope") != "P5"))
    return sinks.upsert(current, batch, sinks.UPSERT_KEY, ["reference_date", "generated_at"])


def view_rows(t: Tables) -> DataFrame:
    actual = context(t).select(
        F.col("scope").alias("priority_scope"), F.col("day").alias("reference_date"), "y"
    )
    rows = daily_predictions(t).join(actual, ["priority_scope", "reference_date"])
    past = rows.where(F.col("y").isNotNull()).select(
        F.col("reference_date").alias("day"),
        "horizon",
        F.col("priority_scope").alias("scope"),
        F.col("predicted_incident_count").alias("predicted"),
        "y",
        "lower_bound",
        "upper_bound",
    )
    return forecast.predictions_view(
        past, rows.where(F.col("y").isNull()), with_backtest=True, horizon="D+1"
    )


def future_view(t: Tables) -> DataFrame:
    return view_rows(t).where(F.col("actual").isNull())


QUERIES = {
    "series_context": context,
    "calendar_features": calendar,
    "forecast_features": features,
    "naive_forecasts": lambda t: series.naive_forecasts(features(t)),
    "baseline_features": lambda t: series.baseline_features(volume(t)),
    "naive_metrics": lambda t: forecast.forecast_metrics(naive_rows(t), REPORT),
    "occam_select": lambda t: forecast.occam_select(naive_rows(t), SELECTION_END),
    "block_skill": lambda t: forecast.block_skill(naive_rows(t), FIRST, "media7"),
    "daily_predictions": daily_predictions,
    "prediction_contract": lambda t: quality.prediction_contract(daily_predictions(t)),
    "prediction_contract_seeded": lambda t: quality.prediction_contract(spoiled_predictions(t)),
    "latest_predictions": lambda t: serving.latest_predictions(daily_predictions(t)),
    "upsert_current": upserted,
    "predictions_view": view_rows,
    "future_predictions": future_view,
    "backtest_mae": lambda t: forecast.backtest_mae(view_rows(t)),
    "baseline_coefficients": baseline_coefficients,
    "baseline_evaluation": lambda t: forecast.baseline_evaluation(volume(t)),
    "baseline_forecast": lambda t: forecast.baseline_predictions(volume(t), generated()),
    "ridge_walk_forward": ridge_rows,
    "walk_forward": walk_forward,
    "conformal_bands": lambda t: bands.conformal_bands(naive_chosen(t)),
    "band_coverage": lambda t: bands.coverage(bands.conformal_bands(naive_chosen(t)), REPORT),
    "advanced_bands": advanced_bands,
    "volume_bundle": volume_bundle,
    "volume_forecast": volume_forecast,
    "forecast_parity": lambda t: parity(t, changed=False),
    "forecast_parity_seeded": lambda t: parity(t, changed=True),
    "boosted_metrics": lambda t: forecast.forecast_metrics(boosted_rows(t), BOOSTED_FROM),
}
