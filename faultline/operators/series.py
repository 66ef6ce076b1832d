"""Daily series of root events and the features of the volume forecast.

A series has one row per day and scope, so everything below the first
aggregation is as small as the calendar, whatever the number of incidents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.functions.calendars import calendar_features
from faultline.functions.text import scope_array, trimmed
from faultline.operators.gold import active_items
from faultline.operators.quality import require_columns

AHEAD = 7
SERIES_REQUIRED = [
    "incident_id",
    "opened_at",
    "priority_code",
    "configuration_item",
    "parent_incident_id",
]


def root_events(silver: DataFrame) -> DataFrame:
    """Incidents that are not part of another one's cascade."""
    return silver.where(trimmed(F.col("parent_incident_id")).isNull())


def series_context(
    silver: DataFrame, start, scopes: dict[str, int | None] | None = None
) -> DataFrame:
    """Root events per day and scope from ``start`` on, with active items.

    Observed days without events count zero; the last ``AHEAD`` rows are the
    days to forecast, with ``y`` unknown and active items carried forward.
    """
    require_columns(silver, SERIES_REQUIRED)
    scopes = S.FORECAST_SCOPES if scopes is None else scopes
    first = F.lit(start).cast("date")
    dated = silver.where(F.col("opened_at").isNotNull() & (F.to_date("opened_at") >= first))
    counted = (
        root_events(dated)
        .groupBy(F.to_date("opened_at").alias("day"), "priority_code")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("day", F.explode(scope_array(F.col("priority_code"), scopes)).alias("scope"), "n")
        .groupBy("day", "scope")
        .agg(F.sum("n").alias("n"))
    )
    last = dated.agg(F.max(F.to_date("opened_at")).alias("last_day"))
    days = last.where(F.col("last_day").isNotNull()).select(
        "last_day",
        F.explode(
            F.sequence(first, F.date_add("last_day", AHEAD), F.expr("interval 1 day"))
        ).alias("day"),
    )
    grid = days.select(
        "last_day", "day", F.explode(F.array(*[F.lit(s) for s in scopes])).alias("scope")
    )
    observed = F.col("day") <= F.col("last_day")
    items = active_items(dated, AHEAD)
    return (
        grid.join(counted, ["day", "scope"], "left")
        .join(items, "day", "left")
        .select(
            "scope",
            "day",
            "last_day",
            F.when(observed, F.coalesce("n", F.lit(0)).cast("double")).alias("y"),
            F.coalesce("active_items", F.lit(0.0)).alias("active_items"),
        )
    )


def _full_window(column: Column, size: int, window, how=F.avg) -> Column:
    """A rolling value that exists only when the window has no gap."""
    frame = window.rowsBetween(-(size - 1), 0)
    return F.when(F.count(column).over(frame) == size, how(column).over(frame))


def feature_frame(context: DataFrame, horizons: dict[str, int] | None = None) -> DataFrame:
    """Level, exposure and calendar features per scope, day and horizon.

    Nothing newer than ``horizon_days`` before the day is read.
    """
    horizons = S.HORIZONS if horizons is None else horizons
    ordered = Window.partitionBy("scope").orderBy("day")
    base = context.withColumns(
        {
            "seas_lag7": F.lag("y", 7).over(ordered),
            "seas_lag14": F.lag("y", 14).over(ordered),
            "trend": (F.row_number().over(ordered) - 1).cast("double"),
            **{f"y_lag{h}": F.lag("y", h).over(ordered) for h in horizons.values()},
            **{f"items_lag{h}": F.lag("active_items", h).over(ordered) for h in horizons.values()},
            **calendar_features(F.col("day")),
        }
    )
    choices = F.array(
        *[
            F.struct(
                F.lit(name).alias("horizon"),
                F.lit(days).alias("horizon_days"),
                F.col(f"y_lag{days}").alias("last"),
                F.col(f"items_lag{days}").alias("exp_last"),
            )
            for name, days in horizons.items()
        ]
    )
    unfolded = base.select("*", F.inline(choices))
    each = Window.partitionBy("scope", "horizon").orderBy("day")
    rolled = unfolded.withColumns(
        {
            "roll7_mean": _full_window(F.col("last"), 7, each),
            "roll7_std": _full_window(F.col("last"), 7, each, F.stddev_samp),
            "roll28_mean": _full_window(F.col("last"), 28, each),
            "exp_roll7": _full_window(F.col("exp_last"), 7, each),
        }
    )
    rates = rolled.withColumns(
        {
            "r_last": F.try_divide("last", "exp_last"),
            "r_roll7": F.try_divide("roll7_mean", "exp_roll7"),
            "r_seas7": F.try_divide("seas_lag7", "exp_roll7"),
        }
    )
    names = dict.fromkeys([*S.LEVEL_FEATURES, *S.RATE_FEATURES])
    return rates.select("scope", "horizon", "horizon_days", "day", "last_day", "y", *names)


def complete_rows(features: DataFrame) -> DataFrame:
    """Rows without a gap in any feature."""
    names = dict.fromkeys([*S.LEVEL_FEATURES, *S.RATE_FEATURES])
    return features.dropna(subset=list(names))


def naive_forecasts(features: DataFrame) -> DataFrame:
    """Same weekday last week, mean of the last seven days, last day; never below zero."""

    def floor(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.greatest(F.col(name), F.lit(0.0)))

    return features.select(
        "scope",
        "horizon",
        "day",
        "y",
        floor("seas_lag7").alias("naive7"),
        floor("roll7_mean").alias("media7"),
        floor("last").alias("ultimo"),
    )


def baseline_features(volume: DataFrame) -> DataFrame:
    """Trend, lags, rolling means of the previous day and weekday angle."""
    ordered = Window.partitionBy("priority_scope").orderBy("reference_date")
    count = F.col("incident_count").cast("double")
    angle = F.weekday("reference_date") * (2 * 3.141592653589793 / 7)
    base = volume.select(
        "priority_scope",
        "reference_date",
        count.alias("incident_count"),
        (F.row_number().over(ordered) - 1).cast("double").alias("trend"),
        F.lag(count, 1).over(ordered).alias("lag_1"),
        F.lag(count, 7).over(ordered).alias("lag_7"),
        F.sin(angle).alias("dow_sin"),
        F.cos(angle).alias("dow_cos"),
    )
    rolled = base.withColumns(
        {
            "rolling_7": _full_window(F.col("lag_1"), 7, ordered),
            "rolling_28": _full_window(F.col("lag_1"), 28, ordered),
        }
    )
    return rolled.dropna().select(
        "priority_scope", "reference_date", "incident_count", *S.BASELINE_FEATURES
    )
