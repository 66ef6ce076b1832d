"""Queries over cleaning, quality, gold tables, temporal analysis and warehouse."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType

from faultline import schema as S
from faultline.functions import text
from faultline.operators import gold, quality, series, silver, temporal, warehouse
from faultline.session import materialise, scratch_path
from faultline.sources import raw as raw_source
from faultline.sources import sinks, tables
from workload.tables import Tables

START, CUTOFF = "1998-01-01", "2000-01-01"
LOADED_AT = "2026-01-01 00:00:00"


def raw_scan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "raw")
    sinks.write_csv(t.raw(), path)
    return raw_source.read_raw(t.spark, path)


def raw_round_trip(t: Tables) -> DataFrame:
    return silver.build_silver(raw_scan(t)).select("incident_id", "opened_at", "duration_seconds")


def bronze_provenance(t: Tables) -> DataFrame:
    at = F.lit(LOADED_AT).cast("timestamp")
    return raw_source.with_provenance(t.read("orders"), at).select(
        "o_orderkey", "_source_file", "_source_row_number", "_ingested_at_utc"
    )


def text_provenance(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "orders-text")
    # Several files; each holds every eighth block of keys in order.
    slim = t.read("orders").select("o_orderkey", (F.col("o_orderkey") % 8).alias("part"))
    sorted_files = slim.repartition(8, "part").sortWithinPartitions("part", "o_orderkey")
    sorted_files.write.partitionBy("part").csv(path, header=True)
    stored = t.spark.read.schema("o_orderkey long, part int").csv(path, header=True)
    return raw_source.with_text_provenance(stored).select(
        "o_orderkey", "part", "_source_row_number"
    )


def spoiled_volume(t: Tables) -> DataFrame:
    """The volume with broken rows on certain days of the month, for the contracts to find."""
    rows, day = materialise(volume(t)), F.dayofmonth("reference_date")
    spoiled = rows.where(day != 11).withColumns(
        {
            "reference_date": F.when(day != 9, F.col("reference_date")),
            "priority_scope": F.when(day == 7, F.lit("ZZ")).otherwise(F.col("priority_scope")),
            "incident_count": F.when(day == 3, -1 - F.col("incident_count")).otherwise(
                F.col("incident_count")
            ),
        }
    )
    return spoiled.unionByName(rows.where(day == 5))


def dirty_raw(t: Tables) -> DataFrame:
    """Dates in every layout, durations that are no numbers, quoted line breaks."""
    key = F.col("o_orderkey")
    at = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + key * 7919 % 86400)
    layouts = ["d/M/yyyy H:mm:ss", "d/M/yyyy", "dd/MM/yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ss",
               "yyyy-MM-dd HH:mm:ss'.250'", "yyyy-M-d H:mm:ss", "'  'dd/MM/yyyy HH:mm:ss' '"]
    shown = F.lit("31/02/2025 25:00")
    for i, layout in enumerate(layouts):
        shown = F.when(key % 8 == i, F.date_format(at, layout)).otherwise(shown)
    numbers = ["NaN", "inf", "-Infinity", "1e300", "ten", "2.5", " 3.5 "]
    duration = F.when(key % 9 == 7, key.cast("string")).otherwise((-key).cast("string"))
    for i, number in enumerate(numbers):
        duration = F.when(key % 9 == i, F.lit(number)).otherwise(duration)
    named = dict.fromkeys(S.COLUMN_MAP, F.lit("x")) | {
        "Número": key.cast("string"),
        "Aberto": shown,
        "Duração": duration,
        "Descrição resumida": F.concat(F.lit("line "), key, F.lit('\nand "'), key, F.lit('"')),
    }
    path = scratch_path(t.spark, "dirty")
    made = t.read("orders").select(*[named[c].alias(c) for c in S.COLUMN_MAP])
    sinks.write_csv(made, path)
    read = raw_source.read_raw(t.spark, path, multi_line=True)
    return silver.clean(read).select(
        F.col("incident_id").cast("long").alias("order_key"),
        "opened_at",
        "duration_seconds",
        F.col("short_description").alias("description"),
    )


def parquet_scan(t: Tables) -> DataFrame:
    wanted = ["o_orderkey", "o_orderpriority", "not_there"]
    return tables.read_available(t.spark, f"{t.folder}/orders.parquet", wanted)


def optional_artifact(t: Tables) -> DataFrame:
    scores = tables.read_optional(t.spark, f"{t.folder}/no_scores.parquet", S.RISK_SCORE_SCHEMA)
    found = scores.select("incident_id", "risk_score")
    return t.order_silver().select("incident_id").join(found, "incident_id", "left")


def cleaned(*names: str):
    def build(t: Tables) -> DataFrame:
        return silver.clean(t.raw()).select("incident_id", *names)

    return build


def derived(*names: str):
    def build(t: Tables) -> DataFrame:
        return t.order_silver().select("incident_id", *names)

    return build


def rename_for_serving(t: Tables) -> DataFrame:
    renamed = silver.rename_for_serving(t.raw())
    return renamed.select("incident_number", "Grupo_designado", "Incidente_Pai", "KPI_Violado")


def etl_derive(t: Tables) -> DataFrame:
    at = F.lit(LOADED_AT).cast("timestamp")
    names = ["incident_id", "priority_code", "is_monitoring", "is_no_intervention", "processed_at"]
    trimmed = t.raw().withColumn("Prioridade", F.trim("Prioridade"))
    return silver.etl_columns(trimmed, at).select(*names)


def missing_token(t: Tables) -> DataFrame:
    return t.order_silver().select(
        "incident_id",
        text.or_token(F.col("product")).alias("product"),
        text.or_token(F.col("category"), S.NOT_INFORMED).alias("category"),
    )


def critical_group(t: Tables) -> DataFrame:
    key = text.critical_group(F.col("product"), F.col("category"), F.col("priority_code"))
    return t.order_silver().select("incident_id", key.alias("critical_group"))


def coerce_flag(t: Tables) -> DataFrame:
    frame = t.order_silver()
    return frame.select(
        "incident_id",
        text.coerce_flag(frame, "entered_kpi_raw").alias("from_text"),
        text.coerce_flag(frame, "kpi_breached_source").alias("from_boolean"),
        text.coerce_flag(frame, "opened_hour").alias("from_number"),
    )


LEVEL_TEXTS = ["Crítico ", "HIGH", "médio", "Moderate", "low", " Alto", "other"]


def normalize_level(t: Tables) -> DataFrame:
    level = text.lookup(F.col("event_id") % 8, dict(enumerate(LEVEL_TEXTS)))
    return t.read("events").select("event_id", text.normalize_level(level).alias("risk_level"))


def leakage_audit(t: Tables) -> DataFrame:
    frame = t.order_silver()
    filled = quality.tidy(
        frame.agg(*[F.count(name).alias(name) for name in frame.columns]),
        "column_name",
        "filled_rows",
    )
    return filled.join(quality.leakage_report(frame), "column_name")


def layer_table(t: Tables) -> DataFrame:
    """A layer table written, written over with fewer rows, and read back."""
    path, rows = scratch_path(t.spark, "layer"), t.order_silver().select("incident_id", "opened_at")
    sinks.write_table(rows, path)
    sinks.write_table(rows.where(F.month("opened_at") <= 6), path, ["opened_at"])
    return t.spark.read.parquet(path)


def schema_difference(t: Tables) -> DataFrame:
    """Columns of the silver table against the expected ones, with the rows that have a value."""
    silver_rows = t.order_silver()
    frame = silver_rows.withColumn("extra", F.col("product")).drop("status")
    filled = quality.tidy(
        frame.agg(*[F.count(n).alias(n) for n in frame.columns]), "column_name", "filled_rows"
    )
    difference = quality.schema_difference(frame, silver_rows.columns)
    return difference.join(filled, "column_name", "left")


def gate(t: Tables) -> DataFrame:
    """What the gate says of the silver table, and of one with a broken row each month."""
    rows = t.order_silver()
    first = F.dayofmonth("opened_at") == 1
    broken = rows.withColumn("incident_id", F.when(first, F.lit("?")).otherwise(F.col("incident_id")))
    parts = []
    for name, frame in (("clean", rows), ("broken", broken)):
        checks = materialise(quality.silver_checks(frame))
        try:
            answer = quality.quality_gate(checks)
        except quality.ContractError:
            answer = "stopped"
        found = checks.where("check_name = 'invalid_incident_ids'").select("violations")
        parts.append(found.select(F.lit(name).alias("table"), F.lit(answer).alias("gate"), "violations"))
    return parts[0].unionByName(parts[1])


def volume(t: Tables) -> DataFrame:
    return gold.daily_volume(t.order_silver())


def breakdown(t: Tables) -> DataFrame:
    return gold.daily_breakdown(t.order_silver())


def features(t: Tables) -> DataFrame:
    return temporal.daily_features(volume(t))


def ranking(metric: str, **options):
    def build(t: Tables) -> DataFrame:
        return gold.breakdown_ranking(
            breakdown(t), "1998-01-01", "1999-12-31", "ALL", metric=metric, **options
        )

    return build


def gold_checks(t: Tables) -> DataFrame:
    return quality.gold_checks(t.order_silver(), volume(t), breakdown(t))


def reconciliation(t: Tables) -> DataFrame:
    return quality.reconciliation(t.order_silver(), volume(t))


def dedup_effect(t: Tables) -> DataFrame:
    roots = gold.daily_volume(series.root_events(t.order_silver()))
    return temporal.dedup_effect(volume(t), roots)


def period_filter(t: Tables) -> DataFrame:
    return gold.in_period(volume(t), "custom", first="1998-01-01", last="1998-03-31")


def period_presets(t: Tables) -> DataFrame:
    """Days and incidents of each preset."""
    rows = materialise(volume(t))
    parts = [
        gold.in_period(rows, preset, regime_start=CUTOFF)
        .groupBy("priority_scope")
        .agg(F.count(F.lit(1)).alias("days"), F.sum("incident_count").alias("incident_count"))
        .withColumn("preset", F.lit(preset))
        for preset in (*gold.PERIOD_DAYS, "regime", "custom")
    ]
    return reduce(DataFrame.unionByName, parts)


def store(t: Tables) -> warehouse.Warehouse:
    return warehouse.build_warehouse(t.order_silver())


def spoiled_store(t: Tables) -> warehouse.Warehouse:
    """A warehouse with lost keys, unknown members, repeated rows and an empty dimension."""
    made = store(t)
    number = F.substring("incident_id", 4, 20).cast("long")
    keys = {
        "sk_produto": F.when(number % 19 != 3, F.col("sk_produto")),
        "sk_grupo": F.when(number % 23 == 4, F.lit(-1)).otherwise(F.col("sk_grupo")),
    }
    fact = made.fato_incidente.withColumns(keys)
    fact = fact.unionAll(fact.where(number % 29 == 5))
    priority = made.dim_prioridade
    twice = priority.where("priority_code = 2").withColumn(
        "sk_prioridade", (F.col("sk_prioridade") + 100).cast(priority.schema["sk_prioridade"].dataType)
    )
    return replace(
        made,
        fato_incidente=materialise(fact),
        dim_prioridade=priority.unionAll(twice),
        dim_categoria=made.dim_categoria.where(F.lit(False)),
    )


def measured(dimension: str, columns: list[str], measures, top: int | None = None):
    return lambda t: warehouse.measure_by(store(t), dimension, columns, measures(), top)



def dimension(name: str):
    return lambda t: warehouse.dimension_tables(t.order_silver())[name]


def narrowed(t: Tables) -> DataFrame:
    types = warehouse.SERVING_TYPES["fato_incidente"]
    return warehouse.narrow_types(store(t).fato_incidente, types)


def narrow_dimensions(t: Tables) -> DataFrame:
    """Values that the narrow types of the dimensions would lose: the item keys as bytes do."""
    made, parts = store(t).tables(), []
    for name, types in warehouse.SERVING_TYPES.items():
        if name != "fato_incidente":
            narrow = warehouse.narrow_types(made[name], types)
            assert all(narrow.schema[c].dataType == kind for c, kind in types.items())
            losses = warehouse.narrowing_losses(made[name], types)
            parts.append(losses.select(F.lit(name).alias("tabela"), "column_name", "lost_values"))
    item = {"sk_item_configuracao": ByteType()}
    losses = warehouse.narrowing_losses(made["dim_item_configuracao"], item)
    parts.append(losses.select(F.lit("as_byte").alias("tabela"), "column_name", "lost_values"))
    return reduce(DataFrame.unionByName, parts)


def narrowing_losses(t: Tables) -> DataFrame:
    types = warehouse.SERVING_TYPES["fato_incidente"]
    wide = store(t).fato_incidente.withColumn("qtd_incidente", F.col("sk_item_configuracao"))
    return warehouse.narrowing_losses(wide, types)


def silver_status(t: Tables) -> DataFrame:
    return quality.quality_status(quality.silver_checks(t.order_silver()))


def weekday_summary(t: Tables) -> DataFrame:
    return temporal.weekday_summary(features(t))


QUERIES = {
    "daily_volume": volume,
    "daily_volume_all_scopes": lambda t: gold.daily_volume(t.order_silver(), S.FORECAST_SCOPES),
    "daily_breakdown": breakdown,
    "raw_scan": raw_scan,
    "raw_round_trip": raw_round_trip,
    "bronze_provenance": bronze_provenance,
    "text_provenance": text_provenance,
    "dirty_raw": dirty_raw,
    "parquet_scan": parquet_scan,
    "optional_artifact": optional_artifact,
    "rename_columns": lambda t: silver.rename_columns(t.raw()),
    "rename_for_serving": rename_for_serving,
    "clean_text": cleaned(*[name for name in S.TEXT_COLUMNS if name != "incident_id"]),
    "parse_dates": cleaned(*S.DATE_COLUMNS),
    "parse_duration": cleaned("duration_seconds"),
    "priority_parse": derived("priority_code", "priority_label"),
    "flag_map": derived("entered_kpi_source", "kpi_breached_source"),
    "derived_flags": derived("has_parent_incident", "is_no_intervention", "is_monitoring_opened"),
    "sla_lookup": derived("priority_code", "sla_limit_seconds"),
    "calendar_parts": derived(
        "opened_date",
        "opened_year",
        "opened_month",
        "opened_day_of_week",
        "opened_hour",
        "duration_hours",
    ),
    "duration_audit": derived(
        "calculated_duration_seconds", "duration_difference_seconds", "duration_mismatch"
    ),
    "kpi_rule_recalc": derived("entered_kpi_recalculated_raw", "kpi_breached_recalculated_raw"),
    "rule_mismatch": derived("entered_kpi_rule_mismatch", "kpi_breached_rule_mismatch"),
    "etl_derive": etl_derive,
    "missing_token": missing_token,
    "critical_group": critical_group,
    "coerce_flag": coerce_flag,
    "normalize_level": normalize_level,
    "leakage_audit": leakage_audit,
    "layer_table": layer_table,
    "schema_difference": schema_difference,
    "quality_gate": gate,
    "silver_checks": lambda t: quality.silver_checks(t.order_silver()),
    "quality_status": silver_status,
    "null_profile": lambda t: quality.null_profile(t.order_silver(), list(S.COLUMN_MAP.values())),
    "value_distribution": lambda t: quality.value_distribution(
        t.order_silver(), ["priority_raw", "status", "entered_kpi_raw", "kpi_breached_raw"]
    ),
    "monthly_volume": lambda t: quality.monthly_volume(t.order_silver()),
    "duplicate_keys": lambda t: quality.duplicate_rows(
        t.order_silver(), ["assigned_group", "configuration_item"], "duplicate_keys"
    ),
    "gold_checks": gold_checks,
    "reconciliation": reconciliation,
    "volume_contract": lambda t: quality.volume_contract(volume(t)),
    "volume_contract_seeded": lambda t: quality.volume_contract(spoiled_volume(t)),
    "gold_checks_seeded": lambda t: quality.gold_checks(
        t.order_silver(), spoiled_volume(t), materialise(breakdown(t))
    ),
    "continuous_series_seeded": lambda t: quality.continuous_series(spoiled_volume(t)),
    "continuous_series": lambda t: quality.continuous_series(volume(t)),
    "serving_volume": lambda t: gold.normalize_volume(volume(t)),
    "serving_breakdown": lambda t: gold.normalize_breakdown(breakdown(t)),
    "period_filter": period_filter,
    "period_presets": period_presets,
    "narrow_dimensions": narrow_dimensions,
    "root_events": lambda t: series.root_events(t.order_silver()).select("incident_id", "opened_at"),
    "cascade_sizes": lambda t: gold.cascade_sizes(t.order_silver()),
    "active_items": lambda t: gold.active_items(t.order_silver(), 7),
    "ranking_by_volume": ranking("incident_count", dimension="assigned_group", limit=10),
    "ranking_by_breaches": ranking(
        "kpi_breach_count", dimension="product", limit=10, exclude_missing=True
    ),
    "ranking_by_rate": ranking(
        "breach_rate_pct", dimension="configuration_item", limit=20, min_entered_kpi=3
    ),
    "rolling_means": features,
    "monthly_summary": lambda t: temporal.monthly_summary(features(t)),
    "weekday_summary": weekday_summary,
    "peak_days": lambda t: temporal.peak_days(features(t)),
    "regime_comparison": lambda t: temporal.regime_comparison(features(t), START, CUTOFF),
    "regime_ratio": lambda t: temporal.regime_ratio(
        temporal.regime_comparison(features(t), START, CUTOFF)
    ),
    "zero_days": lambda t: temporal.zero_days(features(t)),
    "temporal_report": lambda t: temporal.temporal_report(features(t), START, CUTOFF),
    "series_anatomy": lambda t: temporal.series_anatomy(volume(t)),
    "regime_decomposition": lambda t: temporal.regime_decomposition(volume(t), START, CUTOFF),
    "dedup_effect": dedup_effect,
    "dim_time": lambda t: warehouse.dim_time(t.order_silver()),
    "dim_priority": dimension("dim_prioridade"),
    "dim_product": dimension("dim_produto"),
    "dim_category": dimension("dim_categoria"),
    "dim_group": dimension("dim_grupo"),
    "dim_item": dimension("dim_item_configuracao"),
    "fact_incident": lambda t: store(t).fato_incidente,
    "warehouse_checks": lambda t: warehouse.validate_warehouse(store(t)),
    "warehouse_checks_seeded": lambda t: warehouse.validate_warehouse(spoiled_store(t)),
    "orphan_check": lambda t: warehouse.orphans(store(t)),
    "table_counts": lambda t: warehouse.table_counts(store(t)),
    "grain_check": lambda t: warehouse.grain(store(t)),
    "incidents_by_priority": measured(
        "dim_prioridade", ["priority_code", "priority_label"], warehouse.incident_count
    ),
    "incidents_by_year": measured("dim_tempo", ["ano"], warehouse.incident_count),
    "top_products": measured("dim_produto", ["produto"], warehouse.incident_count, 10),
    "top_groups": measured("dim_grupo", ["grupo"], warehouse.incident_count, 10),
    "kpi_by_priority": measured("dim_prioridade", ["priority_label"], warehouse.kpi_counts),
    "star_join": lambda t: warehouse.star(store(t)),
    "incident_summary": lambda t: warehouse.fact_size(store(t)),
    "narrow_types": narrowed,
    "narrowing_losses": narrowing_losses,
}
