"""Ranking and classification metrics of a probability against a 0 / 1 label.

Everything rests on counts per distinct score in score order, so equal scores
collapse before the shuffle and the order never sits in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.ordering import (
    count_points,
    exact_quantiles,
    micros,
    present,
    quantile_columns,
    running_before,
    score_levels,
)

MICROS_PER_HOUR = 3_600_000_000


def score_histogram(frame: DataFrame, score: str, label: str) -> DataFrame:
    """Rows and positives per distinct score, and those strictly above it."""
    levels = score_levels(F.col(score))
    counted = count_points(frame, levels, {"n": F.lit(1), "pos": F.col(label)})
    return running_before(counted, list(levels), ["n", "pos"], descending=True)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(precision * recall * 2, precision + recall)


def classification_metrics(
    frame: DataFrame, score: str, label: str, threshold: float | Column
) -> DataFrame:
    """Confusion counts, precision, recall, F1, Brier, ROC AUC, average precision."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    n, pos, p = F.col("n"), F.col("pos"), F.col("score")
    neg, above = n - pos, F.col("before_pos")
    neg_above = F.col("before_n") - above
    zero = F.lit(0)
    sums = score_histogram(frame, score, label).agg(
        F.sum(F.when(p >= cut, pos).otherwise(zero)).alias("true_positive"),
        F.sum(F.when(p >= cut, neg).otherwise(zero)).alias("false_positive"),
        F.sum(F.when(p < cut, pos).otherwise(zero)).alias("false_negative"),
        F.sum(F.when(p < cut, neg).otherwise(zero)).alias("true_negative"),
        F.sum(pos * F.pow(1 - p, F.lit(2)) + neg * p * p).alias("squared"),
        F.sum(pos.cast("double") * (neg_above + neg / 2)).alias("misordered"),
        F.sum(pos * ((above + pos) / (F.col("before_n") + n))).alias("stepped"),
        F.sum(n).alias("total"),
        F.sum(pos).alias("positives"),
    )
    tp, fp, fn = [F.col(c) for c in ("true_positive", "false_positive", "false_negative")]
    total, positives = F.col("total"), F.col("positives").cast("double")
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return sums.select(
        cut.alias("threshold"),
        F.try_divide("stepped", positives).alias("pr_auc"),
        (1 - F.try_divide(F.col("misordered"), positives * (total - positives))).alias("roc_auc"),
        (F.col("squared") / total).alias("brier_score"),
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
        "true_negative",
        "false_positive",
        "false_negative",
        "true_positive",
    )


def precision_recall_curve(frame: DataFrame, score: str, label: str) -> DataFrame:
    """One point per distinct score, used as a threshold."""
    hits = F.col("before_pos") + F.col("pos")
    chosen = F.col("before_n") + F.col("n")
    positives = frame.agg(F.sum(F.col(label).cast("long"))).scalar()
    return score_histogram(frame, score, label).select(
        F.col("score").alias("threshold"),
        (hits / chosen).alias("precision"),
        F.try_divide(hits, positives).alias("recall"),
    )


def global_rank(frame: DataFrame, score: str, opened: str, key: str) -> DataFrame:
    """Add ``position``: 0 for the highest score, ties by opening time and id.

    Ties are split by hour, so also one score shared by many rows is ordered
    in parts.
    """
    levels = {
        **score_levels(-F.col(score), "descending"),
        "tie_hour": F.floor(micros(F.col(opened)) / MICROS_PER_HOUR),
        "tie": F.struct(micros(F.col(opened)).alias("at"), F.col(key).alias("id")),
    }
    points = present(frame.withColumns(levels).withColumn("n", F.lit(1)), list(levels))
    return (
        running_before(points, list(levels), ["n"])
        .withColumnRenamed("before_n", "position")
        .drop("n", *levels)
    )


def _ranked_labels(frame: DataFrame, score: str, label: str, opened: str, key: str) -> DataFrame:
    slim = frame.select(
        F.col(score).alias("p"), F.col(label).cast("long").alias("y"), opened, key
    )
    return global_rank(slim, "p", opened, key)


def topk_metrics(
    frame: DataFrame,
    score: str,
    label: str,
    opened: str = "opened_at",
    key: str = "incident_id",
    fractions: Sequence[float] = (0.05, 0.10, 0.20, 0.30),
) -> DataFrame:
    """Precision, recall and lift when the riskiest share of rows is reviewed."""
    if not all(0 < fraction <= 1 for fraction in fractions):
        raise ValueError("Every fraction must lie in (0, 1].")
    size = frame.agg(F.count(F.lit(1))).scalar()
    sizes = [F.greatest(F.ceil(size * F.lit(float(f))), F.lit(1)) for f in fractions]
    found = [
        F.coalesce(F.sum(F.when(F.col("position") < k, F.col("y"))), F.lit(0)) for k in sizes
    ]
    sums = _ranked_labels(frame, score, label, opened, key).agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("y"), F.lit(0)).alias("positives"),
        F.array(
            *[
                F.struct(F.lit(float(f)).alias("requested_fraction"), hits.alias("positives_found"))
                for f, hits in zip(fractions, found, strict=True)
            ]
        ).alias("cuts"),
    )
    cuts = sums.where(F.col("total") > 0).select("total", "positives", F.inline("cuts"))
    k = F.greatest(F.ceil(F.col("total") * F.col("requested_fraction")), F.lit(1))
    precision = F.col("positives_found") / k
    return cuts.select(
        "requested_fraction",
        k.alias("rows_reviewed"),
        (k / F.col("total")).alias("actual_fraction"),
        "positives_found",
        precision.alias("precision_at_k"),
        _ratio(F.col("positives_found"), F.col("positives")).alias("recall_at_k"),
        _ratio(precision, F.col("positives") / F.col("total")).alias("lift_vs_base_rate"),
    )


def lift_by_bin(
    frame: DataFrame,
    score: str,
    label: str,
    opened: str = "opened_at",
    key: str = "incident_id",
    bins: int = 10,
) -> DataFrame:
    """Lift and cumulative recall in equal bins of falling risk."""
    if bins < 2:
        raise ValueError("At least two bins are needed.")
    size = frame.agg(F.count(F.lit(1))).scalar()
    number = F.least(F.floor(F.col("position") * bins / size) + 1, F.lit(bins))
    grouped = (
        _ranked_labels(frame, score, label, opened, key)
        .groupBy(number.alias("decile"))
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum("y").alias("positives"),
            F.avg("y").alias("precision"),
            F.min("p").alias("probability_min"),
            F.max("p").alias("probability_max"),
        )
    )
    # One row per bin from here on.
    every = Window.orderBy("decile").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    so_far = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    positives = F.sum("positives").over(every)
    base = positives / F.sum("row_count").over(every)
    return grouped.select(
        "decile",
        "row_count",
        "positives",
        "precision",
        _ratio(F.col("precision"), base).alias("lift_vs_base_rate"),
        _ratio(F.sum("positives").over(so_far), positives).alias("cumulative_recall"),
        "probability_min",
        "probability_max",
    )


# Thresholds that are always tried, and the quantiles added to them.
FIXED_THRESHOLDS = [number / 100 for number in range(1, 51)] + [0.6]
QUANTILE_RANGE = (0.70, 0.995, 40)


def threshold_table(frame: DataFrame, score: str, label: str) -> DataFrame:
    """Precision, recall and F1 of every candidate threshold.

    Candidates are placed in the score order as points without weight; no
    candidate is compared with the rows one by one.
    """
    low, high, steps = QUANTILE_RANGE
    shares = {f"q{i}": low + (high - low) * i / (steps - 1) for i in range(steps)}
    quantiles = exact_quantiles(frame, score, shares, score_levels(F.col(score)))
    fixed = frame.sparkSession.createDataFrame([(t,) for t in FIXED_THRESHOLDS], "score double")
    candidates = quantiles.select(F.col("value").alias("score")).unionAll(fixed)
    rows = frame.select(
        F.col(score).alias("score"),
        F.col(label).cast("long").alias("pos"),
        F.lit(1).alias("n"),
        F.lit(0).alias("candidate"),
    )
    marks = candidates.select("score", F.lit(0).cast("long"), F.lit(0), F.lit(1))
    levels = score_levels(F.col("score"))
    sums = {name: F.col(name) for name in ("n", "pos", "candidate")}
    counted = count_points(rows.unionAll(marks), levels, sums)
    placed = running_before(counted, list(levels), ["n", "pos"], descending=True)
    positives = frame.agg(F.sum(F.col(label).cast("long"))).scalar()
    hits = F.col("before_pos") + F.col("pos")
    measured = placed.where(F.col("candidate") > 0).select(
        F.col("score").alias("threshold"),
        _ratio(hits, F.col("before_n") + F.col("n")).alias("precision"),
        _ratio(hits, positives).alias("recall"),
    )
    return measured.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def select_threshold(table: DataFrame, minimum_recall: float = 0.70) -> DataFrame:
    """Best precision among thresholds with enough recall, else best F1."""
    enough = F.col("recall") >= minimum_recall

    def first(a: str, b: str) -> Column:
        return F.when(enough, F.col(a)).otherwise(F.col(b))

    return table.orderBy(
        F.desc(enough.cast("int")),
        F.desc(first("precision", "f1")),
        F.desc(first("f1", "recall")),
        F.desc(first("threshold", "precision")),
        F.desc("threshold"),
    ).limit(1)


def probability_summary(frame: DataFrame, score: str) -> DataFrame:
    shares = {"minimum": 0.0, "p05": 0.05, "p50": 0.5, "p95": 0.95, "maximum": 1.0}
    quantiles = quantile_columns(frame, score, shares, score_levels(F.col(score)))
    return quantiles.withColumn("mean", frame.agg(F.avg(score)).scalar())
