"""Daily volume, daily breakdown and the small aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.functions.calendars import calendar_between
from faultline.functions.text import critical_group, or_token, scope_array
from faultline.operators.quality import require_columns


def _base(silver: DataFrame) -> DataFrame:
    """Fields of a dated incident that the aggregates read."""
    require_columns(silver, S.GOLD_REQUIRED)

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("long")

    return silver.where(F.col("opened_at").isNotNull()).select(
        F.to_date("opened_at").alias("reference_date"),
        "priority_code",
        F.lit(1).cast("long").alias("incident_count"),
        flag(F.col("entered_kpi_source")).alias("entered_kpi_count"),
        flag(F.col("kpi_breached_source")).alias("kpi_breach_count"),
        flag(F.col("opened_by") == S.MONITORING).alias("monitoring_incident_count"),
        flag(F.col("status") == S.NO_INTERVENTION).alias("no_intervention_count"),
        *[or_token(F.col(name)).alias(name) for name in S.BREAKDOWN_DIMENSIONS if name != "critical_group"],
        critical_group(F.col("product"), F.col("category"), F.col("priority_code")).alias(
            "critical_group"
        ),
    )


def calendar_scopes(daily: DataFrame, scopes: dict[str, int | None]) -> DataFrame:
    """Every day of the span for every scope. As small as the calendar is."""
    span = daily.agg(
        F.min("reference_date").alias("first"), F.max("reference_date").alias("last")
    )
    days = calendar_between(span, "first", "last", "reference_date")
    names = F.array(*[F.lit(name) for name in scopes])
    return days.select("reference_date", F.explode(names).alias("priority_scope"))


def daily_volume(silver: DataFrame, scopes: dict[str, int | None] | None = None) -> DataFrame:
    """Counts per day and scope, zero-filled from the first day to the last.

    Days are counted per priority first: the map-side totals are all that is
    shuffled, and the scopes and the calendar are built from those totals.
    """
    scopes = S.GOLD_SCOPES if scopes is None else scopes
    per_priority = (
        _base(silver)
        .groupBy("reference_date", "priority_code")
        .agg(*[F.sum(name).alias(name) for name in S.VOLUME_COUNTS])
    )
    counted = (
        per_priority.withColumn(
            "priority_scope", F.explode(scope_array(F.col("priority_code"), scopes))
        )
        .groupBy(*S.VOLUME_KEY)
        .agg(*[F.sum(name).alias(name) for name in S.VOLUME_COUNTS])
    )
    return (
        calendar_scopes(per_priority, scopes)
        .join(counted, S.VOLUME_KEY, "left")
        .select(
            *S.VOLUME_KEY, *[F.coalesce(name, F.lit(0)).alias(name) for name in S.VOLUME_COUNTS]
        )
    )


def daily_breakdown(silver: DataFrame, scopes: dict[str, int | None] | None = None) -> DataFrame:
    """Counts per day, scope and value of six dimensions, from one scan.

    Each incident is unfolded into its dimensions once and counted map-side by
    priority; scopes are unfolded from those counts.
    """
    scopes = S.GOLD_SCOPES if scopes is None else scopes
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("dimension_name"), F.col(name).alias("dimension_value"))
            for name in S.BREAKDOWN_DIMENSIONS
        ]
    )
    sums = [F.sum(name).alias(name) for name in S.BREAKDOWN_COUNTS]
    fine = (
        _base(silver)
        .select("reference_date", "priority_code", *S.BREAKDOWN_COUNTS, F.inline(pairs))
        .groupBy("reference_date", "dimension_name", "dimension_value", "priority_code")
        .agg(*sums)
    )
    return (
        fine.withColumn("priority_scope", F.explode(scope_array(F.col("priority_code"), scopes)))
        .groupBy(*S.BREAKDOWN_KEY)
        .agg(*sums)
    )


def cascade_sizes(silver: DataFrame) -> DataFrame:
    """Incidents hanging off each parent."""
    return (
        silver.where(or_token(F.col("parent_incident_id")) != S.MISSING)
        .groupBy(F.trim("parent_incident_id").alias("parent_incident_id"))
        .agg(F.count(F.lit(1)).alias("cascade_size"))
    )


RANKING_METRICS = ["incident_count", "kpi_breach_count", "breach_rate_pct"]


# Presets of the serving layer, as days back from the newest day.
PERIOD_DAYS = {"7d": 7, "14d": 14, "30d": 30}


def in_period(
    frame: DataFrame,
    preset: str = "14d",
    column: str = "reference_date",
    regime_start: str | None = None,
    first: str | None = None,
    last: str | None = None,
) -> DataFrame:
    """Rows of a period, clamped to the days of the table.

    preset: ``7d``, ``14d`` or ``30d`` back from the newest day, ``regime`` (from
    ``regime_start`` on) or ``custom`` (``first`` to ``last``; what is left open is
    the table's own end).
    """
    day = F.col(column)
    if preset in PERIOD_DAYS:
        newest = frame.agg(F.max(column)).scalar()
        return frame.where(day >= F.date_sub(newest, PERIOD_DAYS[preset] - 1))
    begin, end = {"regime": (regime_start, None), "custom": (first, last)}[preset]
    kept = frame if begin is None else frame.where(day >= F.lit(begin).cast("date"))
    return kept if end is None else kept.where(day <= F.lit(end).cast("date"))


def breakdown_ranking(
    breakdown: DataFrame,
    start,
    end,
    scope: str,
    dimension: str,
    limit: int,
    metric: str = "incident_count",
    min_entered_kpi: int = 0,
    exclude_missing: bool = False,
) -> DataFrame:
    """Top values of one dimension in a period. Ties end with the value itself."""
    if metric not in RANKING_METRICS:
        raise ValueError(f"Unknown ranking metric: {metric}")
    chosen = breakdown.where(
        F.col("reference_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        & (F.col("priority_scope") == scope)
        & (F.col("dimension_name") == dimension)
    )
    if exclude_missing:
        chosen = chosen.where(~F.col("dimension_value").contains(S.MISSING))
    totals = (
        chosen.groupBy("dimension_value")
        .agg(*[F.sum(name).alias(name) for name in S.BREAKDOWN_COUNTS])
        .where(F.col("entered_kpi_count") >= min_entered_kpi)
        .withColumn(
            "breach_rate_pct",
            F.try_divide(F.col("kpi_breach_count") * 100.0, F.col("entered_kpi_count")),
        )
    )
    return totals.orderBy(
        F.desc_nulls_last(metric),
        F.desc("kpi_breach_count"),
        F.desc("incident_count"),
        F.asc("dimension_value"),
    ).limit(limit)


def normalize_volume(volume: DataFrame) -> DataFrame:
    """Serving form: a date, and zero for null counts."""
    return volume.select(
        F.to_date("reference_date").alias("reference_date"),
        "priority_scope",
        *[F.coalesce(F.col(n).cast("long"), F.lit(0)).alias(n) for n in S.VOLUME_COUNTS],
    )


def normalize_breakdown(breakdown: DataFrame) -> DataFrame:
    return breakdown.select(
        F.to_date("reference_date").alias("reference_date"),
        *[F.coalesce(name, F.lit("N/A")).alias(name) for name in S.BREAKDOWN_KEY[1:]],
        *[F.coalesce(F.col(n).cast("long"), F.lit(0)).alias(n) for n in S.BREAKDOWN_COUNTS],
    )


def active_items(silver: DataFrame, until: int = 0) -> DataFrame:
    """Distinct items per day, carried ``until`` days past the last.

    Distinct pairs are formed before the days are counted, so a busy day is
    spread over many tasks.
    """
    daily = (
        silver.where(F.col("opened_at").isNotNull())
        .select(F.to_date("opened_at").alias("day"), "configuration_item")
        .distinct()
        .groupBy("day")
        .agg(F.count("configuration_item").alias("active_items"))
    )
    span = daily.agg(
        F.min("day").alias("first"),
        F.max("day").alias("observed"),
        F.date_add(F.max("day"), until).alias("last"),
    )
    days = F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("day")
    filled = (
        span.where(F.col("first").isNotNull())
        .select("observed", days)
        .join(daily, "day", "left")
        .withColumn(
            "active_items",
            F.when(F.col("day") <= F.col("observed"), F.coalesce("active_items", F.lit(0))),
        )
    )
    # One row per calendar day: the window is as small as the calendar.
    known = F.last("active_items", ignorenulls=True).over(
        Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    )
    return filled.select("day", known.cast("double").alias("active_items"))
