"""Volume forecasts: baseline, candidates, selection, bands and published rows.

A series holds one row per day. The series are the unit of parallel work
(scope by horizon), and each is bounded by the calendar, never by the number
of incidents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.operators import linear, refit
from faultline.operators.bands import band_limits
from faultline.operators.quality import require_clean, require_continuous
from faultline.operators.series import baseline_features, complete_rows, naive_forecasts
from faultline.session import materialise

HOLDOUT_DAYS = 60
# Candidates from simple to complex, and the tolerance in which
# the simpler one wins.
COMPLEXITY_ORDER = ["naive7", "media7", "ultimo", "ridge", "poisson_off", "gbt"]
NAIVE = COMPLEXITY_ORDER[:3]
TOLERANCE = 0.05


# --- Baseline: least squares on seven features -------------------------------


def least_squares(rows: DataFrame, key: str, names: list[str], target: str) -> DataFrame:
    """Coefficients per key, intercept first.

    Spark sums the products of every pair of columns; what is left per key is one small
    symmetric system. A column that is a combination of those before it gets zero.
    """
    columns = [F.lit(1.0), *[F.col(n).cast("double") for n in names]]
    sums = linear.moment_sums(columns, F.col(target).cast("double"), F.lit(True), F.sum)
    summed = rows.groupBy(key).agg(*[column.alias(name) for name, column in sums.items()])
    size = len(columns)
    systems = summed.select(
        key,
        linear.matrix("s", size).alias("xx"),
        linear.vector("sy", size).alias("xy"),
        # Columns of unlike size are brought to one scale.
        F.array(*[F.sqrt(F.greatest(F.col(f"s_{i}_{i}"), F.lit(1e-300))) for i in range(size)]).alias("scale"),
    )

    def at(i: Column) -> Column:
        return F.get("scale", i)

    scaled = F.transform("xx", lambda row, i: F.transform(row, lambda v, j: v / at(i) / at(j)))
    right = F.transform("xy", lambda v, i: v / at(i))
    solved = systems.withColumn("solution", linear.solve(scaled, right))
    return solved.select(key, F.transform("solution", lambda v, i: v / at(i)).alias("coefficients"))


def _linear(names: list[str], coefficients: Column) -> Column:
    total = coefficients[0]
    for place, name in enumerate(names, start=1):
        total = total + coefficients[place] * F.col(name)
    return total


def baseline_evaluation(volume: DataFrame, holdout: int = HOLDOUT_DAYS) -> DataFrame:
    """Error on the last days of a model fitted on the days before; one row per scope.

    The residual quantiles give the bounds of the published baseline.
    """
    features = baseline_features(volume)
    newest = Window.partitionBy("priority_scope").orderBy(F.desc("reference_date"))
    placed = features.withColumn("back", F.row_number().over(newest))
    fitted = least_squares(
        placed.where(F.col("back") > holdout),
        "priority_scope",
        S.BASELINE_FEATURES,
        "incident_count",
    )
    predicted = F.greatest(_linear(S.BASELINE_FEATURES, F.col("coefficients")), F.lit(0.0))
    error = F.col("incident_count") - F.col("predicted")
    return (
        placed.where(F.col("back") <= holdout)
        .join(fitted, "priority_scope")
        .withColumn("predicted", predicted)
        .groupBy("priority_scope")
        .agg(
            F.avg(F.abs(error)).alias("mae"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            F.percentile(error, F.lit(0.10)).alias("residual_low"),
            F.percentile(error, F.lit(0.90)).alias("residual_high"),
        )
    )


def recursive_forecast(volume: DataFrame, coefficients: DataFrame, steps: int = 7) -> DataFrame:
    """Seven steps in which each prediction joins the history; days 1 and 7 come out.

    The history that matters is the last 28 values, folded as an array inside
    one SQL expression.
    """
    newest = Window.partitionBy("priority_scope").orderBy(F.desc("reference_date"))
    tail = (
        volume.withColumn("back", F.row_number().over(newest))
        .groupBy("priority_scope")
        .agg(
            F.max("reference_date").alias("last_day"),
            F.count(F.lit(1)).cast("double").alias("length"),
            F.sort_array(
                F.collect_list(
                    F.when(
                        F.col("back") <= 28,
                        F.struct("reference_date", F.col("incident_count").cast("double").alias("y")),
                    )
                )
            ).alias("tail"),
        )
        .withColumn("history", F.transform("tail", lambda entry: entry["y"]))
    )

    def mean(history: Column, days: int) -> Column:
        part = F.slice(history, -days, days)
        return F.aggregate(part, F.lit(0.0), lambda a, b: a + b) / F.lit(float(days))

    def step(history: Column, number: Column) -> Column:
        angle = F.weekday(F.date_add("last_day", number)) * (2 * 3.141592653589793 / 7)
        values = [
            F.lit(1.0),
            F.col("length") + number - 1,
            F.element_at(history, -1),
            F.element_at(history, -7),
            mean(history, 7),
            mean(history, 28),
            F.sin(angle),
            F.cos(angle),
        ]
        total = F.lit(0.0)
        for place, value in enumerate(values):
            total = total + F.col("coefficients")[place] * value
        return F.concat(history, F.array(F.greatest(total, F.lit(0.0))))

    folded = tail.join(coefficients, "priority_scope").withColumn(
        "extended",
        F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("history"), step),
    )
    kept = F.array(
        *[
            F.struct(
                F.lit(name).alias("horizon"),
                F.date_add("last_day", days).alias("reference_date"),
                F.element_at("extended", days - steps - 1).alias("predicted"),
            )
            for name, days in S.HORIZONS.items()
        ]
    )
    return folded.select("priority_scope", F.inline(kept))


def baseline_predictions(
    volume: DataFrame, generated_at: Column, version: str = "linear-lag-baseline-v1"
) -> DataFrame:
    """The baseline under the full forecast contract."""
    require_continuous(volume)
    fitted = least_squares(
        baseline_features(volume), "priority_scope", S.BASELINE_FEATURES, "incident_count"
    )
    errors = baseline_evaluation(volume).select("priority_scope", "residual_low", "residual_high")
    value = F.col("predicted")
    low = F.greatest(value + F.least("residual_low", F.lit(0.0)), F.lit(0.0))
    return (
        recursive_forecast(volume, fitted)
        .join(errors, "priority_scope")
        .select(
            "reference_date",
            generated_at.alias("generated_at"),
            "horizon",
            "priority_scope",
            F.bround(value, 2).alias("predicted_incident_count"),
            F.bround(low, 2).alias("lower_bound"),
            F.bround(value + F.greatest("residual_high", F.lit(0.0)), 2).alias("upper_bound"),
            F.lit("linear_lag").alias("model_name"),
            F.lit(version).alias("model_version"),
        )
    )


# --- Candidates and walk-forward ---------------------------------------------


def candidate_forecasts(
    features: DataFrame,
    first_day: str,
    boosted_from: str | None = None,
    poisson: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Predictions of every candidate as rows, with the actual value; and the stored fits.

    Each learned candidate is refitted for each day from ``first_day`` on; boosted trees only
    from the day ``boosted_from`` on (None: not at all), which is what bounds their cost.
    """
    complete = complete_rows(features).where(F.col("day") >= F.lit(first_day).cast("date"))
    every = naive_forecasts(complete).unpivot(
        ["scope", "horizon", "day"], NAIVE, "candidate", "predicted"
    )
    fits = refit.ridge_parameters(refit.ridge_moments(features, first_day))
    if poisson:
        fits = fits.unionByName(refit.poisson_parameters(features, first_day))
    fits = materialise(fits)
    every = every.unionByName(refit.predict_fits(features, fits))
    if boosted_from is not None:
        every = every.unionByName(refit.boosted_forecasts(features, boosted_from))
    actual = complete.select("scope", "horizon", "day", "y")
    return every.join(actual, ["scope", "horizon", "day"]), fits


# --- Selection and metrics ---------------------------------------------------


def occam_select(forecasts: DataFrame, selection_end: str, tolerance: float = TOLERANCE) -> DataFrame:
    """The simplest candidate within the tolerance of the best, per series.

    Only days up to ``selection_end`` are looked at.
    """
    order = F.array(*[F.lit(name) for name in COMPLEXITY_ORDER])
    errors = (
        forecasts.where(
            F.col("y").isNotNull() & (F.col("day") <= F.lit(selection_end).cast("date"))
        )
        .groupBy("scope", "horizon", "candidate")
        .agg(F.avg(F.abs(F.col("y") - F.col("predicted"))).alias("selection_mae"))
        .withColumn("place", F.array_position(order, F.col("candidate")))
    )
    series = Window.partitionBy("scope", "horizon")
    close = F.col("selection_mae") <= F.min("selection_mae").over(series) * (1 + tolerance)
    first = F.row_number().over(series.orderBy("place"))
    return (
        errors.withColumn("close", close)
        .where("close")
        .withColumn("first", first)
        .where(F.col("first") == 1)
        .select("scope", "horizon", "candidate", "selection_mae")
    )


def forecast_metrics(forecasts: DataFrame, first_day: str) -> DataFrame:
    """MAE, RMSE and sMAPE of every candidate, and skill against the naive ones."""
    y, p = F.col("y"), F.col("predicted")
    error = F.abs(y - p)
    measured = (
        forecasts.where(y.isNotNull() & (F.col("day") >= F.lit(first_day).cast("date")))
        .groupBy("scope", "horizon", "candidate")
        .agg(
            F.count(F.lit(1)).alias("days"),
            F.avg(error).alias("mae"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            (F.avg(error * 2 / (F.abs(y) + F.abs(p) + 1e-9)) * 100).alias("smape"),
        )
    )
    series = Window.partitionBy("scope", "horizon")

    def skill(reference: Column) -> Column:
        return F.when(reference > 1e-9, 1 - F.col("mae") / reference)

    naive = F.min(F.when(F.col("candidate").isin(NAIVE), F.col("mae"))).over(series)
    weekly = F.min(F.when(F.col("candidate") == "naive7", F.col("mae"))).over(series)
    return measured.withColumns(
        {"skill_vs_best_naive": skill(naive), "skill_vs_naive7": skill(weekly)}
    )


def block_skill(forecasts: DataFrame, first_day: str, candidate: str, blocks: int = 6) -> DataFrame:
    """Skill against the weekly naive forecast in equal blocks of days."""
    rows = forecasts.where(
        F.col("y").isNotNull() & (F.col("day") >= F.lit(first_day).cast("date"))
    )
    series = Window.partitionBy("scope", "horizon", "candidate")
    place = F.row_number().over(series.orderBy("day")) - 1
    size = F.count(F.lit(1)).over(series)
    error = F.abs(F.col("y") - F.col("predicted"))

    def mae(name: str) -> Column:
        return F.avg(F.when(F.col("candidate") == name, error))

    return (
        rows.withColumn("block", F.floor(place * blocks / size) + 1)
        .groupBy("scope", "horizon", "block")
        .agg(mae(candidate).alias("mae"), mae("naive7").alias("naive7_mae"))
        .withColumn("skill", 1 - F.try_divide("mae", "naive7_mae"))
    )


def chosen_forecasts(forecasts: DataFrame, selection: DataFrame) -> DataFrame:
    return forecasts.join(selection.drop("selection_mae"), ["scope", "horizon", "candidate"])


def publish_predictions(
    chosen: DataFrame, bands: DataFrame, features: DataFrame, generated_at: Column, version: str
) -> DataFrame:
    """One row per scope and horizon for the day that lies the horizon ahead."""
    quantiles = bands.groupBy("scope", "horizon").agg(
        F.max_by("q_low", "day").alias("q_low"), F.max_by("q_high", "day").alias("q_high")
    )
    targets = features.select("scope", "horizon", "horizon_days", "day", "last_day")
    future = chosen.join(targets, ["scope", "horizon", "day"]).where(
        F.col("day") == F.date_add("last_day", F.col("horizon_days"))
    )
    value = F.col("predicted")
    lower, upper = band_limits(value, F.col("q_low"), F.col("q_high"))
    return future.join(quantiles, ["scope", "horizon"]).select(
        F.col("day").alias("reference_date"),
        generated_at.alias("generated_at"),
        "horizon",
        F.col("scope").alias("priority_scope"),
        F.bround(value, 2).alias("predicted_incident_count"),
        F.bround(F.least(lower, value), 2).alias("lower_bound"),
        F.bround(F.greatest(upper, value), 2).alias("upper_bound"),
        F.col("candidate").alias("model_name"),
        F.lit(version).alias("model_version"),
    )


def predictions_view(
    backtest: DataFrame,
    future: DataFrame,
    with_backtest: bool = False,
    scope: str | None = None,
    horizon: str | None = None,
) -> DataFrame:
    """Published rows, with the backtest rows on request; one scope or horizon on request."""
    ahead = future.select(
        "reference_date",
        "horizon",
        F.col("priority_scope").alias("scope"),
        F.col("predicted_incident_count").alias("predicted"),
        F.lit(None).cast("double").alias("actual"),
        "lower_bound",
        "upper_bound",
    )
    past = backtest.select(
        F.col("day").alias("reference_date"),
        "horizon",
        "scope",
        "predicted",
        F.col("y").alias("actual"),
        "lower_bound",
        "upper_bound",
    )
    rows = past.unionByName(ahead) if with_backtest else ahead
    for name, wanted in (("scope", scope), ("horizon", horizon)):
        if wanted is not None:
            rows = rows.where(F.col(name) == wanted)
    return rows


def backtest_mae(rows: DataFrame) -> DataFrame:
    known = rows.where(F.col("actual").isNotNull())
    return known.agg(
        F.count(F.lit(1)).alias("days"),
        F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae"),
    )


def require_predictions(predictions: DataFrame) -> None:
    from faultline.operators.quality import prediction_contract

    require_clean(prediction_contract(predictions))
