"""Queries over risk features, metrics, scores and the fitted model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.operators import explain, history, metrics, model, quality, scoring, serving
from faultline.session import materialise, scratch_path
from workload.tables import Tables

SCORED_AT = "2026-01-01 00:00:00"
PROTOCOL = model.Protocol(
    fold_first="2024-01-08",
    fold_last="2024-01-15",
    train_end="2024-01-21",
    test_start="2024-01-22",
    unit="week",
    version="risk-logistic-check",
)


def features(t: Tables) -> DataFrame:
    return history.risk_features(t.event_silver(), check=False)


def prior_counts(t: Tables) -> DataFrame:
    names = [n for n in S.HISTORICAL_FEATURES if "_incidents_" in n]
    return history.history_features(t.event_silver()).select("incident_id", *names)


def known_outcomes(t: Tables) -> DataFrame:
    names = [n for n in S.HISTORICAL_FEATURES if "_incidents_" not in n]
    return history.history_features(t.event_silver()).select("incident_id", *names)


def split(t: Tables) -> DataFrame:
    return history.temporal_split(
        t.event_silver(), PROTOCOL.train_end, PROTOCOL.test_start, PROTOCOL.unit
    )


def training(t: Tables) -> DataFrame:
    marked = history.temporal_split(
        features(t), PROTOCOL.train_end, PROTOCOL.test_start, PROTOCOL.unit
    )
    # Written once: several passes read the training rows.
    return materialise(marked.where(F.col("dataset_split") == "pretest_train"))


def indexed(t: Tables) -> DataFrame:
    """Stand-in probabilities placed in the distribution of the first half of the month."""
    rows = t.labelled_scores()
    early = rows.where(F.col("opened_at") < F.lit("2024-01-15").cast("timestamp"))
    return scoring.predictive_index(rows, early, "probability")


def stand_in_scores(t: Tables) -> DataFrame:
    """Complete score rows from the stand-in probability, without a fitted model."""
    loads = history.history_features(t.event_silver()).select(
        "incident_id", "assigned_group_incidents_previous_1d"
    )
    # A row per incident on both sides: neither is sent through the driver.
    points = scoring.operational_scores(indexed(t).join(loads.hint("merge"), "incident_id"), 40.0)
    return points.withColumns(
        {
            "scored_at": F.lit(SCORED_AT).cast("timestamp"),
            "model_version": F.lit("stand-in"),
            "breach_probability": F.col("probability"),
            "top_risk_factors": F.lit("prioridade"),
        }
    ).select(*S.RISK_SCORE_SCHEMA.names)


def event_number() -> Column:
    return F.substring("incident_id", 4, 20).cast("long")


def spoiled_silver(t: Tables) -> DataFrame:
    """Incidents with every rule of the risk input broken somewhere."""
    number = event_number()
    rows = t.event_silver().withColumn("number", number)
    broken = {
        "incident_id": F.when(F.col("number") % 11 != 3, F.col("incident_id")),
        "opened_at": F.when(F.col("number") % 13 != 5, F.col("opened_at")),
        S.TARGET: F.when(F.col("number") % 7 != 2, F.col(S.TARGET)),
    }
    spoiled = rows.withColumns(broken)
    return materialise(spoiled.unionAll(spoiled.where(F.col("number") % 17 == 4)).drop("number"))


def spoiled_scores(t: Tables) -> DataFrame:
    """Scores with every rule of the contract broken in rows of its own."""
    rows = stand_in_scores(t).withColumn("number", event_number())

    def where(rest: int, name: str, value) -> dict[str, Column]:
        kept = F.col(name)
        return {name: F.when(F.col("number") % 31 == rest, value.cast(rows.schema[name].dataType)).otherwise(kept)}

    broken = (
        where(1, "scored_at", F.lit(None))
        | where(2, "model_version", F.lit("  "))
        | where(3, "breach_probability", F.lit(1.5))
        | where(4, "predictive_risk_index", F.lit(-0.25))
        | where(5, "priority_impact", F.lit(None))
        | where(6, "operational_pressure", F.lit(2.0))
        | where(7, "risk_score", F.lit(101))
        | where(8, "risk_level", F.lit("unknown"))
        | where(10, "top_risk_factors", F.lit(""))
        | where(11, "recommended_action", F.lit(" "))
    )
    no_id = F.when(F.col("number") % 31 != 9, F.col("incident_id"))
    spoiled = rows.withColumns({**broken, "incident_id": no_id})
    repeated = spoiled.where(F.col("number") % 31 == 12)
    return materialise(spoiled.unionAll(repeated).drop("number"))


def audited(t: Tables) -> DataFrame:
    return quality.label_audit(t.order_silver())


def trained(t: Tables) -> tuple[DataFrame, model.RiskModel]:
    rows = materialise(features(t))
    return rows, model.train(rows, PROTOCOL)


def fitted_coefficients(t: Tables) -> DataFrame:
    rows = model.with_label(training(t))
    encoder = model.Encoder.fit(rows)
    fitted = model.fit_logistic(encoder.transform(rows))
    values = [(i, float(v)) for i, v in enumerate(fitted.coefficients)]
    return t.spark.createDataFrame(
        [*values, (-1, float(fitted.intercept))], "position int, coefficient double"
    )


def out_of_fold(t: Tables) -> DataFrame:
    return trained(t)[1].validation


def test_rows(rows: DataFrame, fitted: model.RiskModel) -> DataFrame:
    marked = history.temporal_split(rows, PROTOCOL.train_end, PROTOCOL.test_start, PROTOCOL.unit)
    test = marked.where(F.col("dataset_split") == "final_test")
    # Written once: ranks and sizes below must see the same scores.
    return materialise(model.with_label(fitted.probability(test)))


def model_metrics(t: Tables) -> DataFrame:
    rows, fitted = trained(t)
    return metrics.classification_metrics(
        test_rows(rows, fitted), "breach_probability", "label", fitted.threshold
    )


def latest_scores(t: Tables) -> DataFrame:
    rows, fitted = trained(t)
    return model.score_latest(fitted, rows, F.lit(SCORED_AT).cast("timestamp"))


def saved_model_scores(t: Tables) -> DataFrame:
    """Scores of a model that was stored and read back: zero rows may differ."""
    rows, fitted = trained(t)
    path = scratch_path(t.spark, "model")
    model.save(fitted, path)
    at = F.lit(SCORED_AT).cast("timestamp")
    first = model.score_latest(fitted, rows, at)
    second = model.score_latest(model.load(t.spark, path), rows, at)
    return quality.same_ids(
        first.select(F.concat_ws("|", "incident_id", "risk_score").alias("incident_id")),
        second.select(F.concat_ws("|", "incident_id", "risk_score").alias("incident_id")),
    )


def new_incident_scores(t: Tables) -> DataFrame:
    """The incidents of the last day scored as if they had just arrived."""
    _, fitted = trained(t)
    silver = t.event_silver()
    last = silver.agg(F.max(F.to_date("opened_at"))).scalar()
    new = silver.where(F.to_date("opened_at") == last)
    past = silver.where(F.to_date("opened_at") < last)
    return model.score_new(fitted, past, new, F.lit(SCORED_AT).cast("timestamp"))


def explained(t: Tables) -> DataFrame:
    rows, fitted = trained(t)
    cohort = history.latest_cohort(rows)
    return fitted.explained(cohort).select("incident_id", "top_risk_factors")


def bounded_cohort(t: Tables) -> DataFrame:
    """Cohort rows whose features from 30 days of history differ from those of all of it."""
    silver = t.event_silver()
    # Written once: the cohort's day and its rows are read in passes of their own.
    bounded, full = history.latest_features(silver), history.latest_cohort(materialise(features(t)))
    both = [frame.select(*full.columns) for frame in (bounded, full)]
    one, two = [materialise(frame) for frame in both]
    differing = one.exceptAll(two).count() + two.exceptAll(one).count()
    return one.agg(F.count(F.lit(1)).alias("cohort_rows")).withColumn("differing", F.lit(differing))


def clusters(t: Tables) -> DataFrame:
    rows, fitted = trained(t)
    result = model.cluster_protocol(rows, fitted, PROTOCOL)
    return result.withColumn("breach_rates", F.to_json("breach_rates"))


def challenger(t: Tables) -> DataFrame:
    rows, fitted = trained(t)
    return model.challenger_protocol(rows, fitted, PROTOCOL)


def p(build):
    return lambda t: build(t.labelled_scores(), "probability", "label")


QUERIES = {
    "prior_counts": prior_counts,
    "known_outcomes": known_outcomes,
    "risk_features": features,
    "risk_input_checks": lambda t: quality.risk_input_checks(t.event_silver()),
    "risk_input_checks_seeded": lambda t: quality.risk_input_checks(spoiled_silver(t)),
    "temporal_split": lambda t: split(t).select("incident_id", "dataset_split"),
    "split_summary": lambda t: history.split_summary(split(t)),
    "label_audit": audited,
    "latest_cohort": lambda t: history.latest_cohort(t.event_silver()).select("incident_id"),
    "bounded_cohort": bounded_cohort,
    "breach_rate_by_priority": lambda t: history.breach_rate_by_priority(t.order_silver()),
    "monthly_breach_rate": lambda t: history.monthly_breach_rate(t.order_silver()),
    "pressure_reference": lambda t: scoring.pressure_reference(training(t)),
    "typical_values": lambda t: explain.typical_table(training(t)),
    "category_table": lambda t: model.category_table(training(t)).select(
        "feature", "category", "n", "place"
    ),
    "numeric_table": lambda t: model.numeric_table(training(t)),
    "classification_metrics": lambda t: metrics.classification_metrics(
        t.labelled_scores(), "probability", "label", 0.5
    ),
    "precision_recall_curve": p(metrics.precision_recall_curve),
    "topk_metrics": p(metrics.topk_metrics),
    "lift_by_decile": p(metrics.lift_by_bin),
    "threshold_table": p(metrics.threshold_table),
    "threshold_select": lambda t: metrics.select_threshold(
        metrics.threshold_table(t.labelled_scores(), "probability", "label")
    ),
    "probability_summary": lambda t: metrics.probability_summary(
        t.labelled_scores(), "probability"
    ),
    "predictive_index": lambda t: indexed(t).select("incident_id", "predictive_risk_index"),
    "risk_scores": stand_in_scores,
    # Written once: rules and keys are counted in passes of their own.
    "risk_score_contract": lambda t: quality.risk_score_contract(materialise(stand_in_scores(t))),
    "risk_score_contract_seeded": lambda t: quality.risk_score_contract(spoiled_scores(t)),
    "risk_distribution": lambda t: serving.risk_distribution(stand_in_scores(t)),
    "risk_summary": lambda t: serving.risk_summary(stand_in_scores(t)),
    "attention_list": lambda t: serving.attention_list(stand_in_scores(t), 70),
    "risk_queue": lambda t: serving.risk_queue(
        stand_in_scores(t), levels=["alto", "moderado"], text="inc00"
    ),
    "top_scores": lambda t: serving.top_scores(stand_in_scores(t)),
    "fitted_coefficients": fitted_coefficients,
    "out_of_fold": out_of_fold,
    "model_metrics": model_metrics,
    "model_topk": lambda t: metrics.topk_metrics(test_rows(*trained(t)), "breach_probability", "label"),
    "latest_scores": latest_scores,
    "saved_model_scores": saved_model_scores,
    "new_incident_scores": new_incident_scores,
    "explanations": explained,
    "cluster_evaluation": clusters,
    "challenger_metrics": challenger,
}
