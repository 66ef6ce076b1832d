"""Temporal analysis of the daily series.

All inputs hold one row per day and scope, so the windows and exact medians
below never see more rows than the calendar has days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.functions.calendars import weekday_name

BEFORE, AFTER = "before", "after"


def _sums(names: list[str]) -> list[Column]:
    return [F.sum(name).alias(name) for name in names]


def _shares(frame: DataFrame) -> DataFrame:
    return frame.withColumns(
        {
            "monitoring_share": F.try_divide("monitoring_incident_count", "incident_count"),
            "no_intervention_share": F.try_divide("no_intervention_count", "incident_count"),
        }
    )


def daily_features(volume: DataFrame) -> DataFrame:
    """Rolling means over up to 7 and 30 rows, and calendar labels."""
    ordered = Window.partitionBy("priority_scope").orderBy("reference_date")
    number = F.weekday("reference_date")
    return volume.withColumns(
        {
            "rolling_mean_7": F.avg("incident_count").over(ordered.rowsBetween(-6, 0)),
            "rolling_mean_30": F.avg("incident_count").over(ordered.rowsBetween(-29, 0)),
            "day_of_week_number": number,
            "day_of_week": weekday_name(F.col("reference_date")),
            "year_month": F.date_format("reference_date", "yyyy-MM"),
            "is_weekend": number >= 5,
        }
    )


def monthly_summary(features: DataFrame) -> DataFrame:
    grouped = features.groupBy("year_month", "priority_scope").agg(
        F.count_distinct("reference_date").alias("observed_days"),
        F.avg("incident_count").alias("average_daily_incidents"),
        *_sums(S.VOLUME_COUNTS),
    )
    return _shares(grouped)


def weekday_summary(features: DataFrame) -> DataFrame:
    return features.groupBy("day_of_week_number", "day_of_week", "priority_scope").agg(
        F.count("reference_date").alias("observed_days"),
        F.sum("incident_count").alias("total_incidents"),
        F.avg("incident_count").alias("average_incidents"),
        F.median("incident_count").alias("median_incidents"),
        F.max("incident_count").alias("maximum_incidents"),
    )


def peak_days(features: DataFrame, top_n: int = 10) -> DataFrame:
    """Busiest days per scope; on ties the earliest day comes first."""
    order = Window.partitionBy("priority_scope").orderBy(F.desc("incident_count"), "reference_date")
    return (
        features.withColumn("peak_rank", F.row_number().over(order))
        .where(F.col("peak_rank") <= top_n)
        .select("priority_scope", "peak_rank", "reference_date", *S.VOLUME_COUNTS)
    )


def regime_comparison(features: DataFrame, start, cutoff) -> DataFrame:
    """Behaviour from ``start`` on, before and after ``cutoff``."""
    day = F.col("reference_date")
    chosen = features.where(day >= F.lit(start).cast("date"))
    regime = F.when(day < F.lit(cutoff).cast("date"), F.lit(BEFORE)).otherwise(AFTER)
    grouped = chosen.groupBy("priority_scope", regime.alias("regime")).agg(
        F.count("reference_date").alias("observed_days"),
        F.avg("incident_count").alias("average_daily_incidents"),
        F.median("incident_count").alias("median_daily_incidents"),
        F.stddev_samp("incident_count").alias("standard_deviation"),
        F.percentile("incident_count", F.lit(0.95)).alias("p95_daily_incidents"),
        F.max("incident_count").alias("maximum_daily_incidents"),
        *_sums(S.VOLUME_COUNTS),
    )
    return _shares(grouped)


def regime_ratio(comparison: DataFrame) -> DataFrame:
    """Mean after over mean before, four decimals; null without a base."""

    def mean(regime: str) -> Column:
        return F.max(F.when(F.col("regime") == regime, F.col("average_daily_incidents")))

    return comparison.groupBy("priority_scope").agg(
        F.bround(F.try_divide(mean(AFTER), mean(BEFORE)), 4).alias("after_before_ratio")
    )


def zero_days(features: DataFrame) -> DataFrame:
    return features.groupBy("priority_scope").agg(
        F.count_if(F.col("incident_count") == 0).alias("zero_incident_days")
    )


def temporal_report(features: DataFrame, start, cutoff) -> DataFrame:
    """Headline rows per scope: span, zero days and regime ratio."""
    spans = features.groupBy("priority_scope").agg(
        F.min("reference_date").alias("reference_date_min"),
        F.max("reference_date").alias("reference_date_max"),
        F.count(F.lit(1)).alias("daily_rows"),
        F.count_distinct("year_month").alias("monthly_rows"),
    )
    ratios = regime_ratio(regime_comparison(features, start, cutoff))
    return spans.join(zero_days(features), "priority_scope").join(ratios, "priority_scope", "left")


def series_anatomy(volume: DataFrame) -> DataFrame:
    """Level, spread, lag correlation and weekend share of each series."""
    ordered = Window.partitionBy("priority_scope").orderBy("reference_date")
    count = F.col("incident_count").cast("double")
    lagged = volume.withColumns(
        {"y": count, "y1": F.lag(count, 1).over(ordered), "y7": F.lag(count, 7).over(ordered)}
    )
    weekend = F.weekday("reference_date") >= 5

    def correlation(name: str) -> Column:
        # Not corr(): a constant series has no correlation, and must not fail.
        paired = F.when(F.col(name).isNotNull(), F.col("y"))
        spread = F.stddev_pop(paired) * F.stddev_pop(name)
        return F.try_divide(F.covar_pop(paired, name), spread)

    return lagged.groupBy("priority_scope").agg(
        F.avg("y").alias("mean"),
        F.stddev_samp("y").alias("std"),
        F.try_divide(F.stddev_samp("y"), F.avg("y")).alias("cv"),
        F.try_divide(F.var_samp("y"), F.avg("y")).alias("variance_to_mean"),
        correlation("y1").alias("acf_1"),
        correlation("y7").alias("acf_7"),
        F.try_divide(F.avg(F.when(weekend, F.col("y"))), F.avg(F.when(~weekend, F.col("y")))).alias(
            "weekend_to_weekday"
        ),
    )


def regime_decomposition(volume: DataFrame, start, cutoff) -> DataFrame:
    """After / before ratio of the daily mean, by origin and by eligibility."""
    day = F.col("reference_date")
    late = day >= F.lit(cutoff).cast("date")
    cuts = {
        "all": F.col("incident_count"),
        "manual": F.col("incident_count") - F.col("monitoring_incident_count"),
        "monitoring": F.col("monitoring_incident_count"),
        "kpi_eligible": F.col("entered_kpi_count"),
    }
    pairs = F.array(
        *[F.struct(F.lit(k).alias("cut"), v.cast("double").alias("y")) for k, v in cuts.items()]
    )
    return (
        volume.where((F.col("priority_scope") == "ALL") & (day >= F.lit(start).cast("date")))
        .select(late.alias("late"), F.inline(pairs))
        .groupBy("cut")
        .agg(
            F.avg(F.when(~F.col("late"), F.col("y"))).alias("mean_before"),
            F.avg(F.when(F.col("late"), F.col("y"))).alias("mean_after"),
        )
        .withColumn("ratio", F.try_divide("mean_after", "mean_before"))
    )


def dedup_effect(every: DataFrame, roots: DataFrame) -> DataFrame:
    """Peak and variability of the raw series against root events only."""

    def profile(volume: DataFrame, suffix: str) -> DataFrame:
        return volume.groupBy("priority_scope").agg(
            F.max("incident_count").alias(f"maximum_{suffix}"),
            F.try_divide(F.stddev_samp("incident_count"), F.avg("incident_count")).alias(
                f"cv_{suffix}"
            ),
        )

    return profile(every, "raw").join(profile(roots, "root"), "priority_scope", "left")
