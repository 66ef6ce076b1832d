"""Operational risk score: 80 % prediction, 15 % priority, 5 % team load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.functions.ordering import (
    count_points,
    quantile_columns,
    running_before,
    score_levels,
)
from faultline.functions.text import lookup

WEIGHTS = {"predictive_risk_index": 0.80, "priority_impact": 0.15, "operational_pressure": 0.05}


def risk_score(index: Column, impact: Column, pressure: Column) -> Column:
    """Whole points, half up, from 0 to 100."""
    blend = index * 0.80 + impact * 0.15 + pressure * 0.05
    points = F.floor(blend * 100 + 0.5)
    return F.least(F.greatest(points, F.lit(0)), F.lit(100)).cast("long")


def risk_level(score: Column) -> Column:
    level = None
    for name, ceiling in S.LEVEL_CEILINGS.items():
        level = (F if level is None else level).when(score <= ceiling, F.lit(name))
    return level.otherwise(S.RISK_LEVELS[-1])


def priority_impact(code: Column) -> Column:
    impact = lookup(code.try_cast("int"), S.PRIORITY_IMPACT, default=0.0)
    return F.coalesce(impact, F.lit(0.0))


def operational_pressure(load: Column, reference: Column) -> Column:
    share = F.coalesce(load.cast("double"), F.lit(0.0)) / F.greatest(reference, F.lit(1.0))
    return F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))


def recommended_action(level: Column) -> Column:
    return lookup(level, S.RECOMMENDED_ACTIONS)


def pressure_reference(training: DataFrame) -> DataFrame:
    """95th percentile of the team load in training, at least 1."""
    load = F.col("assigned_group_incidents_previous_1d").cast("long")
    levels = {"load_block": F.floor(load / 1024), "load": load}
    return quantile_columns(
        training, "assigned_group_incidents_previous_1d", {"p95": 0.95}, levels
    ).select(F.greatest(F.coalesce("p95", F.lit(1.0)), F.lit(1.0)).alias("pressure_reference_p95"))


def predictive_index(
    scores: DataFrame, reference: DataFrame, name: str = "breach_probability"
) -> DataFrame:
    """Add the share of reference values at or below each probability.

    Both sides are counted per distinct value and ordered together, so no row
    is compared with another and nothing is broadcast.
    """
    finite = F.col(name).isNotNull() & ~F.isnan(name)
    levels = score_levels(F.col(name), "p")
    sides = (
        reference.where(finite)
        .select(*[c.alias(n) for n, c in levels.items()], F.lit(1).alias("n"))
        .unionAll(scores.select(*[c.alias(n) for n, c in levels.items()], F.lit(0).alias("n")))
    )
    counted = count_points(sides, {name: F.col(name) for name in levels}, {"n": F.col("n")})
    size = reference.where(finite).agg(F.count(F.lit(1))).scalar()
    placed = running_before(counted, list(levels), ["n"]).select(
        "p",
        F.least((F.col("before_n") + F.col("n")) / size, F.lit(1.0)).alias("predictive_risk_index"),
    )
    # A row per distinct probability, so as large as the scores: never sent through the driver.
    return scores.join(placed.hint("merge"), scores[name] == placed["p"], "left").drop("p")


def operational_scores(scored: DataFrame, pressure_p95: float | Column) -> DataFrame:
    """Impact, pressure, score, level and advice from index and features."""
    reference = pressure_p95 if isinstance(pressure_p95, Column) else F.lit(float(pressure_p95))
    parts = scored.withColumns(
        {
            "priority_impact": priority_impact(F.col("priority_code")),
            "operational_pressure": operational_pressure(
                F.col("assigned_group_incidents_previous_1d"), reference
            ),
        }
    )
    points = parts.withColumn("risk_score", risk_score(*[F.col(name) for name in WEIGHTS]))
    levelled = points.withColumn("risk_level", risk_level(F.col("risk_score")))
    return levelled.withColumn("recommended_action", recommended_action(F.col("risk_level")))
