"""Forecast runs: training publishes a stored model, the daily run only predicts from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import bands, bundle, forecast, refit, series
from faultline.session import materialise
from faultline.sources import sinks


@dataclass(frozen=True)
class Periods:
    """Days of the protocol: series start, first forecast, end of selection, report start,
    and the first day on which boosted trees are refitted (None: no trees)."""

    start: str
    first: str
    selection_end: str
    report: str
    boosted_from: str | None = None


def features_of(spark: SparkSession, root: str, start: str) -> DataFrame:
    incidents = spark.read.parquet(f"{root}/silver")
    return materialise(series.feature_frame(series.series_context(incidents, start)))


def train(spark: SparkSession, root: str, periods: Periods, generated_at: Column, version: str) -> DataFrame:
    """Walk forward, choose, fit, and publish the bundle once its forecasts equal the walk-forward's.

    Candidates are compared up to the end of selection; the bundle holds each chosen one's
    final fit, and the trees if a series chose them.
    """
    features = features_of(spark, root, periods.start)
    every, fits = forecast.candidate_forecasts(features, periods.first, periods.boosted_from)
    candidates = materialise(every)
    selection = materialise(forecast.occam_select(candidates, periods.selection_end))
    chosen = materialise(forecast.chosen_forecasts(candidates, selection))
    banded = materialise(bands.conformal_bands(chosen))
    made = materialise(bundle.build_bundle(selection, fits, banded, version))
    trees = None
    if not made.where("kind = 'gbt'").isEmpty():
        trees = refit.fit_trees(refit.tree_rows(features).where(F.col("y").isNotNull()))
        trees.write().overwrite().save(f"{root}/volume/trees/{version}")
    bundle.require_bundle(features, made)
    published = forecast.publish_predictions(chosen, banded, features, generated_at, version)
    bundle.require_parity(bundle.predict_volume(features, made, generated_at, trees), published)
    sinks.write_table(forecast.forecast_metrics(candidates, periods.report), f"{root}/volume/metrics")
    sinks.write_table(bands.coverage(banded, periods.report), f"{root}/volume/coverage")
    sinks.write_table(banded, f"{root}/volume/backtest")
    sinks.write_table(bands.band_states(chosen), f"{root}/volume/band_states")
    sinks.publish_version(made.drop("model_version"), f"{root}/volume/bundle", version, version)
    return made


def predict(spark: SparkSession, root: str, start: str, generated_at: Column) -> DataFrame:
    """The daily run: twelve rows from the current bundle, checked and then made current."""
    features = features_of(spark, root, start)
    stored = materialise(sinks.read_current(spark, f"{root}/volume/bundle"))
    bundle.require_bundle(features, stored)
    version, trees = stored.first()["model_version"], None
    if not stored.where("kind = 'gbt'").isEmpty():
        trees = GBTRegressionModel.load(f"{root}/volume/trees/{version}")
    predictions = materialise(bundle.predict_volume(features, stored, generated_at, trees))
    forecast.require_predictions(predictions)
    sinks.publish_version(
        predictions.drop("model_version"), f"{root}/volume/predictions", version, version
    )
    return predictions


def run(spark: SparkSession, root: str, periods: Periods, generated_at: Column, version: str) -> DataFrame:
    """Train and predict at once."""
    train(spark, root, periods, generated_at, version)
    return predict(spark, root, periods.start, generated_at)
