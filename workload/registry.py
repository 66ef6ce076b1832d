"""Every registered query, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload import forecasts, incidents, operations, risk
from workload.tables import Tables, portable


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {}
    for module in (incidents, risk, forecasts, operations):
        named |= module.QUERIES

    def runner(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return portable(build(Tables(spark, folder)))

        return run

    return {name: runner(build) for name, build in named.items()}
