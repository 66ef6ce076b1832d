"""Inputs of the registered queries: the test tables and the incidents made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import schema as S
from faultline.operators.silver import derive
from faultline.sources import adapters


class Tables:
    """Lazy frames over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def order_incidents(self) -> DataFrame:
        return adapters.incidents_from_orders(self.read("orders"), self.read("customer"))

    def order_silver(self) -> DataFrame:
        return derive(self.order_incidents())

    def raw(self) -> DataFrame:
        return adapters.raw_from_orders(self.read("orders"), self.read("customer"))

    def event_silver(self) -> DataFrame:
        return derive(adapters.incidents_from_events(self.read("events")))

    def labelled_scores(self) -> DataFrame:
        """Eligible event incidents with a reproducible stand-in probability."""
        number = F.substring("incident_id", 4, 20).cast("long")
        return (
            self.event_silver()
            .where(F.col(S.ELIGIBLE))
            .select(
                "incident_id",
                "opened_at",
                "priority_code",
                ((number * 7919) % 10007 / F.lit(10007.0)).alias("probability"),
                F.col(S.TARGET).cast("int").alias("label"),
            )
        )


def portable(frame: DataFrame) -> DataFrame:
    """Dates and times as text, small integers as long, doubles to six places."""

    def shown(field: T.StructField):
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            column = F.round(column.cast("double"), 6)
        elif isinstance(kind, T.IntegralType):
            column = column.cast("long")
        return column.alias(field.name)

    return frame.select(*[shown(field) for field in frame.schema])
