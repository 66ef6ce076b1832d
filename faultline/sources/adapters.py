"""Incident records derived from an order table or an event stream.

Both give the nineteen source fields, typed and with English names; the
integer formulas make every record reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.functions.text import lookup


def _incident_id(number: Column) -> Column:
    return F.format_string("INC%07d", number)


def _shift(at: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(at) + seconds.cast("long") * 1_000_000)


def incidents_from_orders(orders: DataFrame, customer: DataFrame, *extra: str) -> DataFrame:
    """Day-grain incidents; ``extra`` names order columns to carry along."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    code = F.substring("o_orderpriority", 1, 1).cast("int")
    buyers = customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    joined = orders.join(buyers, "o_custkey", "left")
    grouped = c % 10 >= 6
    opened = _shift(
        F.col("o_orderdate").cast("timestamp"), (k % 24) * 3600 + (k % 60) * 60
    )
    facts = joined.select(
        *extra,
        k.alias("k"),
        _incident_id(k).alias("incident_id"),
        F.concat(
            F.substring("o_orderpriority", 1, 1),
            F.lit(" - "),
            F.expr("substring(o_orderpriority, 3)"),
        ).alias("priority_raw"),
        F.when(grouped, F.col("c_mktsegment")).alias("product"),
        F.when(grouped, F.concat(F.lit("cat"), c % 7)).alias("category"),
        F.when(grouped, F.concat(F.lit("sub"), c % 13)).alias("subcategory"),
        F.concat(F.lit("Team"), F.col("c_nationkey") % 17).alias("assigned_group"),
        F.concat(F.lit("IC"), c).alias("configuration_item"),
        opened.alias("opened_at"),
        ((k * 7919) % 50000).alias("duration_seconds"),
        F.when(k % 5 > 0, F.concat(F.lit("code"), k % 4)).alias("closure_code"),
        F.concat(F.lit("Incidente "), F.col("o_orderpriority")).alias("short_description"),
        F.when(k % 7 > 0, F.when(k % 2 == 0, F.lit("Definitiva")).otherwise("Contorno")).alias(
            "solution_type"
        ),
        F.when(F.col("o_orderstatus") == "O", F.lit(S.MONITORING))
        .otherwise("Manual")
        .alias("opened_by"),
        F.when(k % 8 == 0, _incident_id(k - k % 100 + 1)).alias("parent_incident_id"),
        F.when((F.col("o_orderstatus") == "P") & (code >= 4), F.lit(S.NO_INTERVENTION))
        .otherwise("Encerrado")
        .alias("status"),
        code.alias("code"),
    )
    duration = F.col("duration_seconds")
    resolved = F.col("k") % 3 == 0
    late = F.when(resolved, F.lit(600)).otherwise(F.lit(0)) + F.when(
        F.col("k") % 250 == 1, F.lit(3)
    ).otherwise(F.lit(0))
    entered = (
        (F.col("code") <= 3)
        & F.col("parent_incident_id").isNull()
        & (F.col("status") != S.NO_INTERVENTION)
    )
    flip = F.col("k") % 500 == 0
    breached = duration > lookup(F.col("code"), S.SLA_SECONDS)
    return facts.select(
        *extra,
        *[name for name in S.COLUMN_MAP.values() if name in facts.columns],
        F.when(resolved, _shift(F.col("opened_at"), duration)).alias("resolved_at"),
        _shift(F.col("opened_at"), duration + late).alias("closed_at"),
        F.when(entered != flip, F.lit("SIM")).otherwise("NAO").alias("entered_kpi_raw"),
        F.when(~entered & ~flip, F.lit("N/A"))
        .when(F.coalesce(breached, F.lit(False)) != flip, F.lit("SIM"))
        .otherwise("NAO")
        .alias("kpi_breached_raw"),
    ).select(*extra, *S.COLUMN_MAP.values())


def raw_from_orders(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """The same incidents as untyped text under the source header.

    Dates are day first, every fourth text is padded and missing is blank.
    """
    typed = incidents_from_orders(orders, customer, "o_orderkey")
    padded = F.col("o_orderkey") % 4 == 0

    def as_text(name: str) -> Column:
        if name in S.DATE_COLUMNS:
            text = F.date_format(name, "dd/MM/yyyy HH:mm:ss")
        else:
            text = F.col(name).cast("string")
            if name in S.TEXT_COLUMNS:
                text = F.when(padded, F.concat(F.lit("  "), text, F.lit(" "))).otherwise(text)
        return F.coalesce(text, F.lit(""))

    return typed.select(*[as_text(name).alias(raw) for raw, name in S.COLUMN_MAP.items()])


def incidents_from_events(events: DataFrame) -> DataFrame:
    """Microsecond-grain incidents from an event stream."""
    e, u = F.col("event_id"), F.col("user_id")
    code = e % 5 + 1
    opened = F.col("ts").cast("timestamp")
    duration = F.floor(F.col("value") * 100)
    eligible = code <= 3
    breached = duration > lookup(code, S.SLA_SECONDS)
    return events.select(
        _incident_id(e).alias("incident_id"),
        F.concat(code, F.lit(" - Nivel "), code).alias("priority_raw"),
        F.when(u % 4 != 0, F.concat(F.lit("prod"), u % 5)).alias("product"),
        F.col("event_type").alias("category"),
        F.concat(F.lit("sub"), u % 3).alias("subcategory"),
        F.concat(F.lit("Team"), u % 17).alias("assigned_group"),
        F.concat(F.lit("IC"), u).alias("configuration_item"),
        opened.alias("opened_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        _shift(opened, duration).alias("closed_at"),
        duration.alias("duration_seconds"),
        F.lit(None).cast("string").alias("closure_code"),
        F.concat(F.lit("Evento "), F.col("event_type")).alias("short_description"),
        F.lit(None).cast("string").alias("solution_type"),
        F.when(e % 3 == 0, F.lit(S.MONITORING)).otherwise("Manual").alias("opened_by"),
        F.lit(None).cast("string").alias("parent_incident_id"),
        F.lit("Encerrado").alias("status"),
        F.when(eligible, F.lit("SIM")).otherwise("NAO").alias("entered_kpi_raw"),
        F.when(~eligible, F.lit("N/A"))
        .when(breached, F.lit("SIM"))
        .otherwise("NAO")
        .alias("kpi_breached_raw"),
    )
