"""Cleaning and derived columns of one incident record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.functions.text import lookup, trimmed

# Accepted date layouts, day first; days, months and hours may have one digit.
DATE_LAYOUTS = [
    "d/M/yyyy H:mm[:ss][.SSSSSS]",
    "d/M/yyyy",
    "yyyy-M-d H:mm[:ss][.SSSSSS]",
    "yyyy-M-d'T'H:mm[:ss][.SSSSSS]",
    "yyyy-M-d",
]


def rename_columns(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed(S.COLUMN_MAP)


def rename_for_serving(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed(S.SERVING_COLUMN_MAP)


def parse_date(column: Column) -> Column:
    """Day-first timestamp; text in no known layout is null."""
    text = trimmed(column)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)) for layout in DATE_LAYOUTS])


def parse_duration(column: Column) -> Column:
    """Whole seconds, half to even; no number, an infinite or too large one is null."""
    number = trimmed(column).try_cast("double")
    return F.bround(F.nanvl(number, F.lit(None))).try_cast("long")


def clean(bronze: DataFrame) -> DataFrame:
    """English names, trimmed text, parsed dates and duration."""
    renamed = rename_columns(bronze)
    kinds = dict(renamed.dtypes)

    def cleaned(name: str) -> Column:
        column = F.col(name)
        if name in S.DATE_COLUMNS:
            return column if kinds[name].startswith("timestamp") else parse_date(column)
        if name == "duration_seconds":
            return parse_duration(column)
        return trimmed(column) if name in S.TEXT_COLUMNS else column

    return renamed.select(*[cleaned(name).alias(name) for name in renamed.columns])


def derive_identity(frame: DataFrame) -> DataFrame:
    """Priority code and label, source flags, record flags and service limit."""
    raw = F.col("priority_raw")
    code = F.nullif(F.regexp_extract(raw, "^([1-5])", 1), F.lit("")).cast("long")
    yes_no = {"SIM": True, "NAO": False}
    return frame.withColumns(
        {
            "priority_code": code,
            "priority_label": F.element_at(F.split(raw, " - ", 2), -1),
            "entered_kpi_source": lookup(F.col("entered_kpi_raw"), yes_no),
            "kpi_breached_source": lookup(F.col("kpi_breached_raw"), yes_no),
            "has_parent_incident": F.col("parent_incident_id").isNotNull(),
            "is_no_intervention": F.col("status") == S.NO_INTERVENTION,
            "is_monitoring_opened": F.col("opened_by") == S.MONITORING,
            "sla_limit_seconds": lookup(code, S.SLA_SECONDS).cast("long"),
        }
    )


def derive_calendar(frame: DataFrame) -> DataFrame:
    opened = F.col("opened_at")
    return frame.withColumns(
        {
            "duration_hours": F.col("duration_seconds") / 3600,
            "opened_date": F.to_date(opened),
            "opened_year": F.year(opened).cast("long"),
            "opened_month": F.month(opened).cast("long"),
            "opened_day_of_week": F.weekday(opened).cast("long"),
            "opened_hour": F.hour(opened).cast("long"),
        }
    )


def derive_duration_audit(frame: DataFrame) -> DataFrame:
    """Compare the stated duration with the one the dates give."""
    finished = F.coalesce("resolved_at", "closed_at")
    spent = (F.unix_micros(finished) - F.unix_micros("opened_at")) / 1e6
    gap = F.abs(F.col("duration_seconds") - spent)
    return frame.withColumns(
        {
            "calculated_duration_seconds": spent,
            "duration_difference_seconds": gap,
            "duration_mismatch": F.coalesce(gap > 2, F.lit(False)),
        }
    )


def derive_kpi_rules(frame: DataFrame) -> DataFrame:
    """Recalculate both indicators and flag where the source differs."""
    entry = (
        F.coalesce(F.col("priority_code").isin(1, 2, 3), F.lit(False))
        & ~F.col("has_parent_incident")
        & ~F.col("is_no_intervention")
    )
    duration, limit = F.col("duration_seconds"), F.col("sla_limit_seconds")
    recalculated = frame.withColumns(
        {
            "entered_kpi_recalculated_raw": F.when(entry, F.lit("SIM")).when(~entry, F.lit("NAO")),
            "kpi_breached_recalculated_raw": F.when(entry & (duration <= limit), F.lit("NAO"))
            .when(entry & (duration > limit), F.lit("SIM"))
            .otherwise("N/A"),
        }
    )
    return recalculated.withColumns(
        {
            f"{name}_rule_mismatch": F.col(f"{name}_raw") != F.col(f"{name}_recalculated_raw")
            for name in ("entered_kpi", "kpi_breached")
        }
    )


def derive(cleaned: DataFrame) -> DataFrame:
    """All derived columns; the record is never moved, so no shuffle."""
    return derive_kpi_rules(derive_duration_audit(derive_calendar(derive_identity(cleaned))))


def build_silver(bronze: DataFrame) -> DataFrame:
    return derive(clean(bronze))


def etl_columns(raw: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """Columns the warehouse load adds to a raw record."""
    return raw.withColumns(
        {
            "incident_id": F.col("Número"),
            "priority_code": F.left("Prioridade", F.lit(1)),
            "is_monitoring": F.lower(F.trim("`Aberto por`")) == S.MONITORING.lower(),
            "is_no_intervention": F.lower(F.trim("Status")) == S.NO_INTERVENTION.lower(),
            "processed_at": F.current_timestamp() if processed_at is None else processed_at,
        }
    )
