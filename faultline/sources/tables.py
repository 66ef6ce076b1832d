"""Readers of stored layer tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_available(spark: SparkSession, path: str, wanted: Sequence[str]) -> DataFrame:
    """Only the wanted columns that the stored table has."""
    stored = spark.read.parquet(path)
    return stored.select(*[name for name in wanted if name in stored.columns])


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table, or an empty one of the agreed schema when it is absent."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_serving(
    spark: SparkSession, url: str, table: str, order: Sequence[str], **options: str
) -> DataFrame:
    """A serving table over JDBC in a fixed order.

    Pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` to read it in parallel.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    return reader.options(**options).load().orderBy(*order)
