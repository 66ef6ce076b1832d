"""Writers: layer tables, exports, run partitions, serving tables, pointers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.operators.quality import ContractError
from faultline.sources.tables import read_optional


def write_table(frame: DataFrame, path: str, sort: Sequence[str] = ()) -> None:
    """Overwrite a layer table; ``sort`` orders the rows within its files."""
    ordered = frame.sortWithinPartitions(*sort) if sort else frame
    ordered.write.mode("overwrite").parquet(path)


def write_csv(frame: DataFrame, path: str, sort: Sequence[str] = (), separator: str = ",") -> None:
    """Export with a header, globally sorted when ``sort`` is given.

    Texts are kept as they are, outer blanks included.
    """
    ordered = frame.orderBy(*sort) if sort else frame
    ordered.write.mode("overwrite").csv(
        path,
        header=True,
        sep=separator,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_run(frame: DataFrame, path: str, date_column: str, run_id: str) -> None:
    """Write one run under ``<date_column>=/run_id=``; a repeated run replaces itself.

    Rows of one partition come together first, split only where they are many.
    """
    stamped = frame.withColumn("run_id", F.lit(run_id)).hint("rebalance", date_column, "run_id")
    writer = stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(date_column, "run_id").parquet(path)


def replace_serving(frame: DataFrame, url: str, table: str, **options: str) -> None:
    """Replace all rows of a serving table over JDBC, keeping its definition."""
    writer = frame.write.mode("overwrite").format("jdbc").option("url", url)
    writer.option("dbtable", table).option("truncate", "true").option("batchsize", "5000").options(
        **options
    ).save()


POINTER_SCHEMA = "version string, run_id string, path string, published_at timestamp"


def publish_version(frame: DataFrame, root: str, version: str, run_id: str) -> str:
    """Write a version in full, then append the pointer that makes it current."""
    path = f"{root}/version={version}/run={run_id}"
    frame.withColumn("model_version", F.lit(version)).write.mode("errorifexists").parquet(path)
    pointer = frame.sparkSession.createDataFrame([(version, run_id, path)], "version string, run_id string, path string")
    pointer.withColumn("published_at", F.current_timestamp()).write.mode("append").parquet(
        f"{root}/current"
    )
    return path


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The table the newest pointer names; fails when the versions differ."""
    pointer = (
        spark.read.schema(POINTER_SCHEMA)
        .parquet(f"{root}/current")
        .orderBy(F.desc("published_at"), F.desc("run_id"))
        .first()
    )
    frame = spark.read.parquet(pointer["path"])
    other = frame.where(~F.col("model_version").eqNullSafe(F.lit(pointer["version"]))).limit(1)
    if other.count():
        raise ContractError(f"The table at {pointer['path']} is not version {pointer['version']}")
    return frame


def replace_table(frame: DataFrame, root: str, run_id: str) -> None:
    """Swap a whole lake table: readers see the old rows or the new, never a mix."""
    publish_version(frame, root, "replace", run_id)


def newest_per_key(frame: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; combined map-side, so no key is sorted whole."""
    newest = F.max_by(F.struct(*[f"`{name}`" for name in frame.columns]), F.struct(*order))
    return frame.groupBy(*key).agg(newest.alias("row")).select("row.*")


def upsert(
    current: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Rows of ``batch`` replace those of ``current`` with the same key."""
    marked = current.withColumn("_batch", F.lit(0)).unionByName(batch.withColumn("_batch", F.lit(1)))
    return newest_per_key(marked, key, ["_batch", *order]).drop("_batch")


UPSERT_KEY = ["priority_scope", "horizon"]


def append_run(
    spark: SparkSession, path: str, run_id: str, app_env: str, action: str, processed: int
) -> None:
    """Add one row to the run log."""
    row = spark.createDataFrame(
        [(run_id, app_env, action, processed)],
        "run_id string, app_env string, action string, processed_records long",
    )
    row.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def recent_runs(spark: SparkSession, path: str, limit: int) -> DataFrame:
    log = read_optional(spark, path, S.RUN_AUDIT_SCHEMA)
    return log.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)
