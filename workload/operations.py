"""Queries over monitoring, snapshots, sinks and streams."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.functions.calendars import weekday_name
from faultline.operators import gold, model, monitoring, serving, snapshots
from faultline.session import materialise, scratch_path
from faultline.sources import sinks
from faultline.streaming import alerts, arrivals
from workload import forecasts, risk
from workload.tables import Tables

REGIMES = [
    ("base", None, date(1998, 1, 1)),
    ("transition", date(1998, 1, 1), date(2000, 1, 1)),
    ("current", date(2000, 1, 1), None),
]
STARTED, ENDED = date(2001, 3, 1), date(2001, 5, 31)


def volume(t: Tables) -> DataFrame:
    return gold.daily_volume(t.order_silver())


def comparison(start: date, end: date):
    return lambda t: monitoring.period_over_period(volume(t), start, end, REGIMES)


def alert_rules(t: Tables) -> DataFrame:
    current = serving.latest_predictions(forecasts.daily_predictions(t))
    return monitoring.alert_rules(
        volume(t), current, risk.stand_in_scores(t), STARTED, ENDED, attention_score=70
    )


def score_history(t: Tables) -> DataFrame:
    """Three versions of the scores, the newest with levels in other spellings."""
    # Written once: each version reads the scores.
    scores = materialise(risk.stand_in_scores(t))
    number = F.substring("incident_id", 4, 20).cast("long")
    second = scores.where(number % 2 == 0).withColumns(
        {
            "scored_at": F.col("scored_at") + F.expr("interval 1 day"),
            "risk_score": F.col("risk_score") + 1,
        }
    )
    third = scores.where(number % 3 == 0).withColumns(
        {
            "scored_at": F.col("scored_at") + F.expr("interval 2 days"),
            "risk_level": F.upper("risk_level"),
        }
    )
    return scores.unionByName(second).unionByName(third)


def latest_scores(t: Tables) -> DataFrame:
    return serving.latest_scores(score_history(t)).select(
        "incident_id", "scored_at", "risk_score", "risk_level"
    )


# Snapshots of the order table, seen as one record per path.
ORDER_FIELDS = ["o_orderkey", "o_custkey", "o_orderstatus"]


def order_manifest(t: Tables, version: int = 0) -> DataFrame:
    """The table after ``version`` rounds of changes and deletes."""
    k = F.col("o_orderkey")
    orders = t.read("orders")
    if version >= 1:
        orders = orders.where(k % 10 != 0).withColumn(
            "o_orderstatus", F.when(k % 7 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
        )
    if version >= 2:
        orders = orders.where(k % 11 != 0).withColumn(
            "o_orderstatus", F.when(k % 5 == 0, F.lit("Y")).otherwise(F.col("o_orderstatus"))
        )
    if version == 0:
        orders = orders.where(k % 13 != 0)
    return snapshots.record_manifest(orders, F.concat(F.lit("orders/"), k), ORDER_FIELDS)


def snapshot_history(t: Tables) -> DataFrame:
    """One snapshot per day of the event stream, a full one every sixth day."""
    first = t.read("events").agg(F.min(F.to_date("ts"))).scalar()
    place = F.datediff("day", first)
    return (
        t.read("events")
        .select(F.to_date("ts").alias("day"))
        .distinct()
        .select(
            F.date_format("day", "yyyyMMdd").alias("snapshot_id"),
            F.when(place % 6 == 0, F.lit("full")).otherwise("incremental").alias("mode"),
            (F.col("day").cast("timestamp") + F.expr("interval 3 hours")).alias("created_at"),
        )
    )


def retention(t: Tables) -> DataFrame:
    history = snapshot_history(t)
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return snapshots.expired(history, now, 10, "20240105")


def snapshot_changes(t: Tables) -> DataFrame:
    return snapshots.manifest_diff(order_manifest(t), order_manifest(t, 1))


def replayed(t: Tables) -> DataFrame:
    """Full, then two incremental snapshots: the state after the last one."""
    return snapshots.replay(*recorded(t))


def recorded(t: Tables) -> tuple[DataFrame, DataFrame]:
    made = [
        ("s0", "full", datetime(2024, 1, 1)),
        ("s1", "incremental", datetime(2024, 1, 2)),
        ("s2", "incremental", datetime(2024, 1, 3)),
    ]
    history = t.spark.createDataFrame(made, "snapshot_id string, mode string, created_at timestamp")
    entries, previous = None, None
    for version, (snapshot, mode, _) in enumerate(made):
        current = order_manifest(t, version)
        part = snapshots.snapshot_entries(mode, previous, current).withColumn(
            "snapshot_id", F.lit(snapshot)
        )
        entries = part if entries is None else entries.unionByName(part)
        previous = current
    return history, entries


def replay_parity(t: Tables) -> DataFrame:
    """Paths that differ between the replayed state and the table itself: none."""
    state = snapshots.replay(*recorded(t))
    return snapshots.manifest_diff(order_manifest(t, 2), state).agg(
        F.count(F.lit(1)).alias("differences")
    )


def integrity(t: Tables) -> DataFrame:
    failures = snapshots.integrity_failures(order_manifest(t), order_manifest(t, 1))
    return failures.select("archive_path", "reason")


def table_manifest(t: Tables) -> DataFrame:
    return snapshots.table_manifest(t.read("lineitem")).drop("fingerprint")


def file_manifest(t: Tables) -> DataFrame:
    return snapshots.file_manifest(t.spark, {"tables": t.folder})


def partitioned_run(t: Tables) -> DataFrame:
    """Two runs appended under their days; the second is read back."""
    path = scratch_path(t.spark, "runs")
    rows = gold.daily_volume(t.order_silver())
    sinks.write_run(rows, path, "priority_scope", "run-1")
    sinks.write_run(rows.where(F.col("incident_count") > 5), path, "priority_scope", "run-2")
    stored = t.spark.read.parquet(path).where(F.col("run_id") == "run-2")
    return stored.select("reference_date", "priority_scope", "run_id", "incident_count")


def versioned(t: Tables) -> DataFrame:
    """Two versions published; readers see the second."""
    root = scratch_path(t.spark, "published")
    # Written once: both versions read the scores.
    scores = materialise(risk.stand_in_scores(t).select("incident_id", "risk_score"))
    sinks.publish_version(scores, root, "v1", "run-1")
    sinks.publish_version(scores.where(F.col("risk_score") > 50), root, "v2", "run-2")
    return sinks.read_current(t.spark, root)


def replaced(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "serving")
    rows = gold.normalize_volume(volume(t))
    sinks.replace_table(rows, root, "run-1")
    sinks.replace_table(rows.where(F.col("priority_scope") == "P2"), root, "run-2")
    return sinks.read_current(t.spark, root).drop("model_version")


def csv_export(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "export")
    weekday = weekday_name(F.col("reference_date")).alias("day_of_week")
    rows = volume(t).select("reference_date", "priority_scope", weekday, "incident_count")
    sinks.write_csv(rows, path, ["reference_date", "priority_scope"])
    return t.spark.read.csv(path, header=True)


def run_audit(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "audit")
    for name in ("region", "nation", "orders"):
        sinks.append_run(t.spark, path, name, "check", "load", t.read(name).count())
    return sinks.recent_runs(t.spark, path, 2).select("run_id", "action", "processed_records")


def published(t: Tables) -> str:
    """Alert messages of all stand-in scores, written by the stream."""
    source, out = scratch_path(t.spark, "scores"), scratch_path(t.spark, "alerts")
    risk.stand_in_scores(t).write.parquet(source)
    query = alerts.publish_stream(t.spark, source, out, scratch_path(t.spark, "publish-state"))
    query.awaitTermination()
    return out


def alert_messages(t: Tables) -> DataFrame:
    rows = t.spark.read.text(published(t))
    return rows.select(
        F.get_json_object("value", "$.incident_id").alias("incident_id"),
        F.get_json_object("value", "$.event_type").alias("event_type"),
        F.get_json_object("value", "$.risk_level").alias("risk_level"),
        F.get_json_object("value", "$.risk_score").cast("long").alias("risk_score"),
        F.size(F.json_object_keys("value")).alias("fields"),
    )


def spoiled(t: Tables) -> str:
    """The same messages, some of them damaged in a known way."""
    out = scratch_path(t.spark, "spoiled")
    rows = t.spark.read.text(published(t))
    number = F.substring(F.get_json_object("value", "$.incident_id"), 4, 20).cast("long")
    value = F.col("value")
    rows.select(
        F.when(number % 10 == 1, F.concat(F.lit("{invalid-"), value))
        .when(number % 10 == 2, F.regexp_replace(value, '^\\{', '{"extra":1,'))
        .when(number % 10 == 5, F.regexp_replace(value, '"risk_score":', '"risk_score":10'))
        .when(number % 10 == 6, F.regexp_replace(value, '"model_version":"[^"]*",', ""))
        .otherwise(value)
        .alias("value")
    ).write.text(out)
    return out


def consumed(t: Tables) -> tuple[str, str]:
    valid, dead = scratch_path(t.spark, "valid"), scratch_path(t.spark, "dead")
    query = alerts.consume_stream(
        t.spark, spoiled(t), valid, dead, scratch_path(t.spark, "consume-state")
    )
    query.awaitTermination()
    return valid, dead


def valid_alerts(t: Tables) -> DataFrame:
    return t.spark.read.parquet(consumed(t)[0]).select("incident_id", "risk_score", "risk_level")


def dead_letters(t: Tables) -> DataFrame:
    dead = t.spark.read.parquet(consumed(t)[1])
    return dead.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("messages"))


def arrived(t: Tables, score, batches: int = 3) -> DataFrame:
    """All event incidents as they come: openings without outcome and, when they close, again.

    Files arrive in batches, days in order; ``score`` of each batch's features is returned.
    """
    silver = t.event_silver()
    instant = F.when(F.col("arrival") == arrivals.CLOSED, F.col("closed_at")).otherwise(F.col("opened_at"))
    kinds = {name: silver.schema[name].dataType for name in ("closed_at", S.TARGET)}
    opened = silver.withColumns({n: F.lit(None).cast(kind) for n, kind in kinds.items()})
    rows = materialise(
        opened.withColumn("arrival", F.lit(arrivals.OPENED))
        .unionByName(
            silver.where(F.col("closed_at").isNotNull()).withColumn("arrival", F.lit(arrivals.CLOSED))
        )
        .withColumn("arrived_on", F.to_date(instant))
    )
    first, last = rows.agg(F.min("arrived_on"), F.max("arrived_on")).first()
    days = (last - first).days + 1 if first else 1
    # A row without a day arrives with the first batch.
    place = F.coalesce(F.floor(F.datediff("arrived_on", F.lit(first)) * batches / days), F.lit(0))
    names = ("arriving", "state", "scored", "arrival-checkpoint")
    source, state, out, checkpoint = [scratch_path(t.spark, name) for name in names]
    for batch in range(batches):
        rows.where(place == batch).write.mode("append").parquet(source)
        arrivals.arrival_stream(
            t.spark, source, rows.schema, score, state, out, checkpoint
        ).awaitTermination()
    return t.spark.read.parquet(out).drop("batch")


def arrival_features(t: Tables) -> DataFrame:
    """The history features of every opening, counted from the stream's state."""
    return arrived(t, lambda found: found.select("incident_id", *S.HISTORICAL_FEATURES))


def incremental_scores(t: Tables) -> DataFrame:
    """Scores of all eligible rows, from raw openings and closings that arrive in batches."""
    fitted = risk.trained(t)[1]
    at = F.lit(risk.SCORED_AT).cast("timestamp")

    def score(found: DataFrame) -> DataFrame:
        return model.score(fitted, found.where(F.col(S.ELIGIBLE)), at, check=False)

    return arrived(t, score).select("incident_id", "risk_score", "risk_level")


QUERIES = {
    "period_over_period": comparison(STARTED, ENDED),
    "period_across_regimes": comparison(date(2000, 1, 1), date(2000, 6, 30)),
    "regime_days": lambda t: monitoring.regime_days(volume(t), REGIMES),
    "alert_rules": alert_rules,
    "latest_score_per_incident": latest_scores,
    "snapshot_diff": snapshot_changes,
    "mode_select": lambda t: snapshots.mode_history(snapshot_history(t)),
    "retention": retention,
    "replay": replayed,
    "replay_parity": replay_parity,
    "integrity_check": integrity,
    "table_manifest": table_manifest,
    "file_manifest": file_manifest,
    "partitioned_run": partitioned_run,
    "versioned_publish": versioned,
    "replace_table": replaced,
    "csv_export": csv_export,
    "run_audit": run_audit,
    "alert_messages": alert_messages,
    "valid_alerts": valid_alerts,
    "dead_letters": dead_letters,
    "arrival_features": arrival_features,
    "incremental_scores": incremental_scores,
}
