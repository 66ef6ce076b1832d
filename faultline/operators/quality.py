"""Quality checks: a table of violation counts, and a raise-on-violation helper.

Every check table has one row per rule, so reading it on the driver is bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.functions.text import coerce_flag, trimmed


class ContractError(ValueError):
    """Data that a later step must not use."""


def missing_columns(frame: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(frame.columns))


def unexpected_columns(frame: DataFrame, allowed: Iterable[str]) -> list[str]:
    return sorted(set(frame.columns) - set(allowed))


def require_columns(frame: DataFrame, required: Iterable[str]) -> None:
    missing = missing_columns(frame, required)
    if missing:
        raise ContractError(f"Missing columns: {missing}")


def schema_difference(frame: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Names missing from and unexpected in ``frame``, as rows."""
    rows = [(name, "missing") for name in missing_columns(frame, expected)]
    rows += [(name, "unexpected") for name in unexpected_columns(frame, expected)]
    return frame.sparkSession.createDataFrame(rows, "column_name string, problem string")


def violation(condition: Column) -> Column:
    """Number of rows that break a rule; unknown does not."""
    return F.coalesce(F.count_if(condition), F.lit(0))


def null_count(names: Iterable[str]) -> Column:
    total = F.lit(0)
    for name in names:
        total = total + F.count_if(F.col(name).isNull())
    return total


def tidy(one_row: DataFrame, key: str = "check_name", value: str = "violations") -> DataFrame:
    """A one-row frame of counts as (name, count) rows."""
    return one_row.unpivot([], one_row.columns, key, value)


def duplicate_rows(frame: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Rows after the first of each key, as one count. Null keys count too."""
    repeated = frame.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return repeated.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(name))


def require_clean(checks: DataFrame, keys: Sequence[str] = ("check_name",)) -> None:
    """Raise when any rule of a check table is broken."""
    broken = checks.where(F.col("violations") > 0).collect()
    if broken:
        found = {" ".join(str(row[key]) for key in keys): row["violations"] for row in broken}
        raise ContractError(f"Violations: {found}")


BLOCKING = [
    "mandatory_nulls",
    "duplicate_incident_ids",
    "invalid_incident_ids",
    "closed_before_opened",
    "negative_duration",
]
WARNING = [
    "resolved_after_closed",
    "duration_mismatch",
    "subcategory_without_category",
    "entered_kpi_rule_mismatch",
    "kpi_breached_rule_mismatch",
]


def silver_checks(silver: DataFrame) -> DataFrame:
    """Five blocking and five warning counts."""
    col = F.col
    counts = silver.agg(
        null_count(S.MANDATORY_COLUMNS).alias("mandatory_nulls"),
        violation(~F.coalesce(col("incident_id").rlike(r"^INC\d{7}$"), F.lit(False))).alias(
            "invalid_incident_ids"
        ),
        violation(col("closed_at") < col("opened_at")).alias("closed_before_opened"),
        violation(col("duration_seconds") < 0).alias("negative_duration"),
        violation(col("resolved_at") > col("closed_at")).alias("resolved_after_closed"),
        violation(col("duration_mismatch")).alias("duration_mismatch"),
        violation(col("subcategory").isNotNull() & col("category").isNull()).alias(
            "subcategory_without_category"
        ),
        violation(col("entered_kpi_rule_mismatch")).alias("entered_kpi_rule_mismatch"),
        violation(col("kpi_breached_rule_mismatch")).alias("kpi_breached_rule_mismatch"),
    )
    repeated = duplicate_rows(silver, ["incident_id"], "duplicate_incident_ids")
    return (
        tidy(counts)
        .unionByName(tidy(repeated))
        .withColumn(
            "severity",
            F.when(F.col("check_name").isin(BLOCKING), F.lit("blocking")).otherwise("warning"),
        )
    )


def quality_status(checks: DataFrame) -> DataFrame:
    """One row: failed, passed_with_warnings or passed."""
    blocking = F.sum(F.when(F.col("severity") == "blocking", F.col("violations")).otherwise(0))
    return checks.agg(
        F.when(blocking > 0, F.lit("failed"))
        .when(F.sum("violations") > 0, F.lit("passed_with_warnings"))
        .otherwise("passed")
        .alias("quality_status")
    )


def quality_gate(checks: DataFrame) -> str:
    """Status of a silver check table; a failed one stops the run."""
    status = quality_status(checks).first()["quality_status"]
    if status == "failed":
        require_clean(checks.where(F.col("severity") == "blocking"))
    return status


def null_profile(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """Null percentage per column in one pass."""
    shares = [
        F.round(F.avg(F.col(name).isNull().cast("int")) * 100, 3).alias(name) for name in names
    ]
    return tidy(frame.agg(*shares), "column_name", "null_percentage")


def value_distribution(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """Value counts of several columns in one pass; nulls are left out."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("column_name"), F.col(name).cast("string").alias("value"))
            for name in names
        ]
    )
    return (
        frame.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("incident_count"))
    )


def monthly_volume(silver: DataFrame) -> DataFrame:
    return (
        silver.where(F.col("opened_at").isNotNull())
        .groupBy(F.date_format("opened_at", "yyyy-MM").alias("year_month"))
        .agg(F.count(F.lit(1)).alias("incident_count"))
    )


def gold_checks(
    silver: DataFrame,
    volume: DataFrame,
    breakdown: DataFrame,
    scopes: dict[str, int | None] | None = None,
) -> DataFrame:
    """Keys, nulls, signs and reconciliation of the gold tables."""
    negative = [F.count_if(F.col(name) < 0) for name in S.VOLUME_COUNTS]
    slim = [F.count_if(F.col(name) < 0) for name in S.BREAKDOWN_COUNTS]
    failed = reconciliation(silver, volume, scopes).agg(
        (F.count_if(~F.col("matches")) > 0).cast("long").alias("reconciliation_failed")
    )
    negatives = (
        volume.agg(sum(negative[1:], negative[0]).alias("n"))
        .unionAll(breakdown.agg(sum(slim[1:], slim[0]).alias("n")))
        .agg(F.sum("n").alias("negative_counts"))
    )
    parts = [
        duplicate_rows(volume, S.VOLUME_KEY, "daily_duplicate_keys"),
        duplicate_rows(breakdown, S.BREAKDOWN_KEY, "breakdown_duplicate_keys"),
        volume.agg(null_count(S.VOLUME_KEY + S.VOLUME_COUNTS).alias("daily_null_values")),
        breakdown.agg(
            null_count(S.BREAKDOWN_KEY + S.BREAKDOWN_COUNTS).alias("breakdown_null_values")
        ),
        negatives,
        failed,
    ]
    result = tidy(parts[0])
    for part in parts[1:]:
        result = result.unionByName(tidy(part))
    return result


def reconciliation(
    silver: DataFrame, volume: DataFrame, scopes: dict[str, int | None] | None = None
) -> DataFrame:
    """Rows in the source against incidents in gold, per scope."""
    scopes = S.GOLD_SCOPES if scopes is None else scopes
    dated = silver.where(F.col("opened_at").isNotNull())
    counts = [
        (F.count(F.lit(1)) if code is None else F.count_if(F.col("priority_code") == code)).alias(
            scope
        )
        for scope, code in scopes.items()
    ]
    source = tidy(dated.agg(*counts), "priority_scope", "source_count")
    gold = volume.groupBy("priority_scope").agg(F.sum("incident_count").alias("gold_count"))
    compared = source.join(gold, "priority_scope", "left").withColumn(
        "gold_count", F.coalesce("gold_count", F.lit(0))
    )
    return compared.withColumn("matches", F.col("source_count") == F.col("gold_count"))


def volume_contract(volume: DataFrame, scopes: Sequence[str] = tuple(S.GOLD_SCOPES)) -> DataFrame:
    """Rules a daily series must meet before it is analysed."""
    require_columns(volume, S.VOLUME_KEY + S.VOLUME_COUNTS)
    rules = [
        violation(F.col("reference_date").isNull()).alias("invalid_dates"),
        violation(~F.col("priority_scope").isin(list(scopes))).alias("unexpected_scopes"),
    ]
    for name in S.VOLUME_COUNTS:
        number = F.col(name).try_cast("double")
        rules.append(violation(number.isNull()).alias(f"invalid_{name}"))
        rules.append(violation(number < 0).alias(f"negative_{name}"))
    empty = volume.agg((F.count(F.lit(1)) == 0).cast("long").alias("empty_table"))
    return (
        tidy(volume.agg(*rules))
        .unionByName(tidy(duplicate_rows(volume, S.VOLUME_KEY, "duplicate_keys")))
        .unionByName(tidy(empty))
    )


def continuous_series(volume: DataFrame) -> DataFrame:
    """Repeated and missing days of each scope."""
    first, last = F.min("reference_date"), F.max("reference_date")
    days = F.count_distinct("reference_date")
    return volume.groupBy("priority_scope").agg(
        (F.count("reference_date") - days).alias("duplicate_days"),
        (F.datediff(last, first) + 1 - days).cast("long").alias("missing_days"),
    )


def require_continuous(volume: DataFrame) -> None:
    broken = continuous_series(volume).withColumn(
        "violations", F.col("duplicate_days") + F.col("missing_days")
    )
    require_clean(broken, ["priority_scope"])


def risk_input_checks(silver: DataFrame, require_targets: bool = True) -> DataFrame:
    """Rules the incident table must meet before features are built."""
    require_columns(silver, S.RISK_REQUIRED)
    eligible = F.coalesce(F.col(S.ELIGIBLE), F.lit(False))
    rules = [
        violation(F.col("incident_id").isNull()).alias("null_incident_id"),
        violation(F.col("opened_at").isNull()).alias("invalid_opened_at"),
    ]
    if require_targets:
        rules += [
            (F.count_if(eligible) == 0).cast("long").alias("no_eligible_rows"),
            violation(eligible & F.col(S.TARGET).isNull()).alias("eligible_without_target"),
        ]
    repeated = duplicate_rows(
        silver.where(F.col("incident_id").isNotNull()), ["incident_id"], "duplicate_incident_id"
    )
    return tidy(silver.agg(*rules)).unionByName(tidy(repeated))


def require_no_leakage(features: Sequence[str]) -> None:
    forbidden = sorted(set(features) & set(S.LEAKAGE_COLUMNS))
    if forbidden:
        raise ContractError(f"Features forbidden by leakage: {forbidden}")


def leakage_report(frame: DataFrame) -> DataFrame:
    """Which of the columns of ``frame`` may never be a feature."""
    rows = [(name, name in S.LEAKAGE_COLUMNS) for name in frame.columns]
    return frame.sparkSession.createDataFrame(rows, "column_name string, forbidden boolean")


def _blank(name: str) -> Column:
    return trimmed(F.col(name)).isNull()


def risk_score_rules() -> dict[str, Column]:
    """Condition under which a score row breaks each rule."""
    from faultline.operators.scoring import risk_level, risk_score

    def outside(name: str, top: float) -> Column:
        number = F.col(name).try_cast("double")
        return F.coalesce(~number.between(0, top), F.lit(True))

    score = F.bround(F.col("risk_score").try_cast("double")).cast("long")
    level = F.lower(F.trim("risk_level"))
    parts = ["predictive_risk_index", "priority_impact", "operational_pressure"]
    formula = risk_score(*[F.col(name).try_cast("double") for name in parts])
    return {
        "null_incident_id": _blank("incident_id"),
        "invalid_scored_at": F.col("scored_at").isNull(),
        "null_model_version": _blank("model_version"),
        "breach_probability_range": outside("breach_probability", 1),
        **{f"{name}_range": outside(name, 1) for name in parts},
        "risk_score_range": outside("risk_score", 100),
        "risk_level_domain": F.coalesce(~level.isin(S.RISK_LEVELS), F.lit(True)),
        "risk_score_formula": score != formula,
        "risk_level_band": level != risk_level(score),
        "empty_top_risk_factors": _blank("top_risk_factors"),
        "empty_recommended_action": _blank("recommended_action"),
    }


RISK_SCORE_KEY = ["incident_id", "scored_at", "model_version"]


def risk_score_contract(scores: DataFrame) -> DataFrame:
    require_columns(scores, S.RISK_SCORE_SCHEMA.names)
    rules = [violation(rule).alias(name) for name, rule in risk_score_rules().items()]
    return tidy(scores.agg(*rules)).unionByName(
        tidy(duplicate_rows(scores, RISK_SCORE_KEY, "duplicate_keys"))
    )


PREDICTION_KEY = ["reference_date", "horizon", "priority_scope", "model_version"]


def prediction_contract(predictions: DataFrame) -> DataFrame:
    """Rules of a forecast table."""
    require_columns(predictions, S.PREDICTION_SCHEMA.names)
    names = ["predicted_incident_count", "lower_bound", "upper_bound"]
    value, low, high = [F.col(name).try_cast("double") for name in names]

    def outside(name: str, domain: Iterable[str]) -> Column:
        return F.coalesce(~F.upper(F.trim(name)).isin(list(domain)), F.lit(True))

    rules = {
        "invalid_reference_date": F.col("reference_date").isNull(),
        "invalid_generated_at": F.col("generated_at").isNull(),
        "horizon_domain": outside("horizon", S.HORIZONS),
        "priority_scope_domain": outside("priority_scope", S.FORECAST_SCOPES),
        **{
            f"negative_{name}": F.coalesce(number < 0, F.lit(True))
            for name, number in zip(names, [value, low, high], strict=True)
        },
        "interval_order": (low > value) | (high < value) | (low > high),
        "empty_model_name": _blank("model_name"),
        "empty_model_version": _blank("model_version"),
    }
    return tidy(
        predictions.agg(*[violation(rule).alias(name) for name, rule in rules.items()])
    ).unionByName(tidy(duplicate_rows(predictions, PREDICTION_KEY, "duplicate_keys")))


def label_audit(silver: DataFrame) -> DataFrame:
    """How often source and recalculated indicators differ; one row per rule."""
    eligible = coerce_flag(silver, S.ELIGIBLE)
    positive = eligible & coerce_flag(silver, S.TARGET)
    counts, rows = [], []
    for name in ("entered_kpi_rule_mismatch", "kpi_breached_rule_mismatch"):
        present = name in silver.columns
        flag = coerce_flag(silver, name) if present else None

        def count(condition: Column | None) -> Column:
            return F.count_if(condition) if present else F.lit(None).cast("long")

        counts += [
            count(flag).alias(f"{name}_total"),
            count(flag & eligible if present else None).alias(f"{name}_eligible"),
            count(flag & positive if present else None).alias(f"{name}_positive"),
        ]
        rows.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.lit(present).alias("column_present"),
                F.col(f"{name}_total").alias("mismatches_total"),
                F.col(f"{name}_eligible").alias("mismatches_eligible"),
                F.col(f"{name}_positive").alias("mismatches_among_positive_targets"),
            )
        )
    totals = silver.agg(
        F.count_if(eligible).alias("eligible_rows"),
        F.count_if(positive).alias("positive_targets"),
        *counts,
    )
    return totals.select("eligible_rows", "positive_targets", F.inline(F.array(*rows)))


def same_ids(left: DataFrame, right: DataFrame, key: str = "incident_id") -> DataFrame:
    """Rows by id that one side has more of than the other, in both directions.

    Zero twice means that both sides hold the same ids, each as often.
    """
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    more = sides.groupBy(key).agg((F.sum("l") - F.sum("r")).alias("more"))
    nothing = F.lit(0).cast("long")
    return more.agg(
        F.coalesce(F.sum(F.greatest("more", nothing)), nothing).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("more"), nothing)), nothing).alias("only_right"),
    )
