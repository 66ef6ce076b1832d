"""The daily data run: raw table to silver, gold, warehouse and snapshot manifest."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.operators import gold, quality, silver, snapshots, temporal, warehouse
from faultline.session import materialise
from faultline.sources import raw, sinks
from faultline.sources.tables import read_optional


def ingest(
    spark: SparkSession, source: str, root: str, kind: str = "csv", ingested_at: Column | None = None
) -> str:
    """Bronze and silver tables with the quality report; returns the status."""
    table = raw.read_raw(spark, source, kind)
    stamped = (
        raw.with_text_provenance(table, ingested_at)
        if kind == "csv"
        else raw.with_provenance(table, ingested_at)
    )
    sinks.write_table(stamped, f"{root}/bronze")
    sinks.write_table(silver.build_silver(spark.read.parquet(f"{root}/bronze")), f"{root}/silver")
    checks = quality.silver_checks(spark.read.parquet(f"{root}/silver"))
    sinks.write_table(checks, f"{root}/reports/silver")
    return quality.quality_gate(spark.read.parquet(f"{root}/reports/silver"))


def _publish(checked: dict[str, DataFrame], root: str, run_id: str) -> None:
    """Make tables current that were written and checked before."""
    for name, table in checked.items():
        sinks.replace_table(table, f"{root}/{name}", run_id)


def build_gold(
    spark: SparkSession,
    root: str,
    scopes: dict[str, int | None] | None = None,
    run_id: str | None = None,
) -> None:
    """Both gold tables; they become current only after their checks have passed."""
    incidents = spark.read.parquet(f"{root}/silver")
    built = {
        "volume": materialise(gold.daily_volume(incidents, scopes)),
        "breakdown": materialise(gold.daily_breakdown(incidents, scopes)),
    }
    quality.require_clean(quality.gold_checks(incidents, *built.values(), scopes))
    ordered = {
        "volume": built["volume"].orderBy("reference_date", "priority_scope"),
        "breakdown": built["breakdown"].orderBy(*S.BREAKDOWN_KEY),
    }
    _publish(ordered, f"{root}/gold", run_id or uuid.uuid4().hex)


def gold_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return (
        sinks.read_current(spark, f"{root}/gold/volume").drop("model_version"),
        sinks.read_current(spark, f"{root}/gold/breakdown").drop("model_version"),
    )


def analyse(
    spark: SparkSession, root: str, start, cutoff, scopes: dict[str, int | None] | None = None
) -> None:
    """The temporal tables as CSV exports; the volume must hold the run's scopes, no others."""
    volume, _ = gold_tables(spark, root)
    quality.require_clean(quality.volume_contract(volume, list(scopes or S.GOLD_SCOPES)))
    features = temporal.daily_features(volume)
    exports = {
        "daily_features": (features, S.VOLUME_KEY),
        "monthly": (temporal.monthly_summary(features), ["year_month", "priority_scope"]),
        "weekday": (
            temporal.weekday_summary(features),
            ["priority_scope", "day_of_week_number"],
        ),
        "peaks": (temporal.peak_days(features), ["priority_scope", "peak_rank"]),
        "regimes": (
            temporal.regime_comparison(features, start, cutoff),
            ["priority_scope", "regime"],
        ),
        "report": (temporal.temporal_report(features, start, cutoff), ["priority_scope"]),
    }
    for name, (table, order) in exports.items():
        sinks.write_csv(table, f"{root}/analysis/{name}", order)


def build_star(spark: SparkSession, root: str, run_id: str | None = None) -> None:
    """The seven warehouse tables; current only without null keys, duplicates or orphans."""
    store = warehouse.build_warehouse(spark.read.parquet(f"{root}/silver"))
    stored = warehouse.Warehouse(**{n: materialise(t) for n, t in store.tables().items()})
    quality.require_clean(warehouse.validate_warehouse(stored))
    _publish(stored.tables(), f"{root}/warehouse", run_id or uuid.uuid4().hex)


HISTORY = "snapshot_id string, mode string, created_at timestamp"
ENTRIES = "archive_path string, sha256 string, change string, snapshot_id string"
MANIFEST = "archive_path string, size_bytes long, sha256 string"


def snapshot(
    spark: SparkSession,
    root: str,
    areas: list[str],
    now: datetime | None = None,
    requested: str = "auto",
    retention_days: int = 30,
) -> str:
    """Record what changed in some areas since the last snapshot; returns the mode taken.

    Entries are written under the snapshot's id, then the history row, then the manifest
    the next run compares with. The state replayed from all entries must be the present
    one. Snapshots past retention are listed; deleting them is the caller's.
    """
    folder, now = f"{root}/snapshots", now or datetime.now()
    name = f"{now:%Y%m%d%H%M%S}"
    history = materialise(read_optional(spark, f"{folder}/history", HISTORY))
    mode = snapshots.select_mode(requested, history, now)
    current = materialise(
        snapshots.file_manifest(spark, {area: f"{root}/{area}" for area in areas})
    )
    previous = materialise(read_optional(spark, f"{folder}/manifest", MANIFEST))
    recorded = snapshots.snapshot_entries(mode, previous, current)
    recorded.write.mode("overwrite").parquet(f"{folder}/entries/snapshot_id={name}")
    row = spark.createDataFrame([(name, mode, now)], HISTORY)
    entries = spark.read.schema(ENTRIES).parquet(f"{folder}/entries")
    state = snapshots.replay(history.unionByName(row), entries)
    if snapshots.manifest_diff(state, current).limit(1).count():
        raise quality.ContractError(f"Replaying the snapshots up to {name} does not give the files")
    row.write.mode("append").parquet(f"{folder}/history")
    sinks.write_table(current, f"{folder}/manifest")
    late = snapshots.expired(history.unionByName(row), F.lit(now), retention_days, name)
    sinks.write_table(late, f"{folder}/expired")
    return mode
