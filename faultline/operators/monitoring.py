"""Operational comparisons and alert rules over the gold tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schema as S

# A regime is (label, first day or None, day after the last or None), in order.
Regime = tuple[str, date | None, date | None]


def _day(value) -> Column:
    return F.lit(value).cast("date")


def regimes_between(regimes: list[Regime], start: date, end: date) -> list[str]:
    """Labels of the regimes an interval touches, in order."""
    return [
        label
        for label, first, stop in regimes
        if (stop is None or start < stop) and (first is None or end >= first)
    ]


def regime_days(volume: DataFrame, regimes: list[Regime], scope: str = "ALL") -> DataFrame:
    """Days and incidents of a series in each regime it touches."""
    day, label = F.col("reference_date"), None
    for name, first, stop in regimes:
        inside = F.lit(True)
        if first is not None:
            inside = inside & (day >= _day(first))
        if stop is not None:
            inside = inside & (day < _day(stop))
        label = (F if label is None else label).when(inside, F.lit(name))
    return (
        volume.where(F.col("priority_scope") == scope)
        .groupBy(label.alias("regime"))
        .agg(F.count(F.lit(1)).alias("days"), F.sum("incident_count").alias("incident_count"))
    )


def period_over_period(
    volume: DataFrame, start: date, end: date, regimes: list[Regime]
) -> DataFrame:
    """Totals of a period against the equally long one before it, per scope.

    The change is left out when the two do not lie in one and the same regime.
    """
    days = (end - start).days + 1
    before_end = start - timedelta(days=1)
    before_start = before_end - timedelta(days=days - 1)
    current = regimes_between(regimes, start, end)
    previous = regimes_between(regimes, before_start, before_end)
    comparable = len(current) == 1 and current == previous
    day = F.col("reference_date")
    now, then = day.between(_day(start), _day(end)), day < _day(start)
    count = F.col("incident_count")
    sums = (
        volume.where(day.between(_day(before_start), _day(end)))
        .groupBy("priority_scope")
        .agg(
            F.coalesce(F.sum(F.when(now, count)), F.lit(0)).alias("incident_count"),
            F.coalesce(F.sum(F.when(then, count)), F.lit(0)).alias("previous_count"),
            F.coalesce(F.sum(F.when(now, F.col("kpi_breach_count"))), F.lit(0)).alias(
                "kpi_breach_count"
            ),
            F.count_if(then).alias("previous_days"),
        )
    )
    change = (F.col("incident_count") - F.col("previous_count")) * 100 / F.col("previous_count")
    usable = F.lit(comparable) & (F.col("previous_days") > 0) & (F.col("previous_count") > 0)
    return sums.select(
        "priority_scope",
        "incident_count",
        (F.col("incident_count") / days).alias("daily_average"),
        "previous_count",
        "kpi_breach_count",
        F.lit(comparable).alias("comparable"),
        F.when(usable, change).alias("change_pct"),
    )


# Severities in order, and the one a forecast alert has per horizon.
SEVERITIES = ["crítico", "sério", "atenção"]
FORECAST_SEVERITY = {"D+1": "crítico", "D+7": "sério"}


def alert_rules(
    volume: DataFrame,
    predictions: DataFrame,
    scores: DataFrame,
    start: date,
    end: date,
    scope: str = "ALL",
    forecast_threshold_pct: float = 0,
    attention_score: int = 25,
) -> DataFrame:
    """Active alerts, most severe first.

    ``predictions`` holds the current forecast per scope and horizon, and
    ``scores`` the current score per incident. Each rule is one aggregate.
    """
    day = F.col("reference_date")
    mine = volume.where(F.col("priority_scope") == scope)
    days = (end - start).days + 1
    mean = mine.where(day.between(_day(start), _day(end))).agg(
        (F.coalesce(F.sum("incident_count"), F.lit(0)) / days).alias("mean")
    )
    ceiling = mean.select(F.col("mean") * (1 + forecast_threshold_pct / 100)).scalar()
    base = mean.scalar()
    forecasts = (
        predictions.where(F.col("priority_scope") == scope)
        .where((base > 0) & (F.col("predicted_incident_count") > ceiling))
        .select(
            F.when(F.col("horizon") == "D+1", F.lit(FORECAST_SEVERITY["D+1"]))
            .otherwise(FORECAST_SEVERITY["D+7"])
            .alias("severity"),
            F.concat(F.lit("forecast_above_mean "), "horizon").alias("rule"),
            F.col("predicted_incident_count").cast("double").alias("value"),
        )
    )
    level, score = F.col("risk_level"), F.col("risk_score")
    counted = scores.agg(
        F.count_if(level == S.RISK_LEVELS[-1]).alias("critical"),
        F.count_if(score >= attention_score).alias("above"),
    ).select(
        F.inline(
            F.array(
                F.struct(
                    F.lit("crítico").alias("severity"),
                    F.lit("critical_incidents").alias("rule"),
                    F.col("critical").cast("double").alias("value"),
                ),
                F.struct(
                    F.lit("atenção").alias("severity"),
                    F.lit("score_above_threshold").alias("rule"),
                    F.col("above").cast("double").alias("value"),
                ),
            )
        )
    )
    last = volume.agg(F.max("reference_date")).scalar()
    breaches = mine.where(day.between(F.date_sub(last, 6), last)).agg(
        F.lit("sério").alias("severity"),
        F.lit("recent_breaches").alias("rule"),
        F.coalesce(F.sum("kpi_breach_count"), F.lit(0)).cast("double").alias("value"),
    )
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return (
        forecasts.unionByName(counted)
        .unionByName(breaches)
        .where(F.col("value") > 0)
        .withColumn("severity_rank", rank)
        .orderBy("severity_rank", "rule")
    )
