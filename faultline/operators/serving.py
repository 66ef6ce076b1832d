"""Views over published scores and forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.functions.text import normalize_level
from faultline.sources.sinks import newest_per_key


def latest_scores(scores: DataFrame) -> DataFrame:
    """Newest score per incident, with the level in the house vocabulary."""
    newest = newest_per_key(scores, ["incident_id"], ["scored_at", "model_version"])
    return newest.withColumn("risk_level", normalize_level(F.col("risk_level")))


def latest_predictions(predictions: DataFrame, scope: str | None = None) -> DataFrame:
    """Newest forecast per scope and horizon."""
    chosen = predictions if scope is None else predictions.where(F.col("priority_scope") == scope)
    order = ["reference_date", "generated_at", "model_version"]
    return newest_per_key(chosen, ["priority_scope", "horizon"], order)


def risk_distribution(scores: DataFrame) -> DataFrame:
    """Scores per level, with zero for a level nobody has."""
    spark = scores.sparkSession
    levels = spark.createDataFrame(list(enumerate(S.RISK_LEVELS)), "place int, risk_level string")
    counted = scores.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counted, "risk_level", "left").select(
        "place", "risk_level", F.coalesce("n", F.lit(0)).alias("incident_count")
    )


def risk_summary(scores: DataFrame) -> DataFrame:
    level = F.col("risk_level")
    return scores.agg(
        F.avg("risk_score").alias("average_score"),
        F.count_if(level.isin(S.ALERT_LEVELS)).alias("high_or_critical"),
        F.count_if(level == S.RISK_LEVELS[-1]).alias("critical"),
    )


def attention_list(scores: DataFrame, minimum_score: int) -> DataFrame:
    """Incidents at a high level or above a score, riskiest first."""
    wanted = F.col("risk_level").isin(S.ALERT_LEVELS) | (F.col("risk_score") >= minimum_score)
    return scores.where(wanted).orderBy(F.desc("risk_score"), "incident_id")


def risk_queue(
    scores: DataFrame, levels: Sequence[str] = (), text: str = "", limit: int = 50
) -> DataFrame:
    """The riskiest incidents of some levels whose id contains a text, in any case."""
    chosen = scores.where(F.col("risk_level").isin(list(levels))) if levels else scores
    if text.strip():
        chosen = chosen.where(F.lower("incident_id").contains(text.strip().lower()))
    return chosen.orderBy(F.desc("risk_score"), "incident_id").limit(limit)


def top_scores(scores: DataFrame, limit: int = 10) -> DataFrame:
    order = [F.desc("risk_score"), F.desc("breach_probability"), F.asc("incident_id")]
    return scores.orderBy(*order).limit(limit)
