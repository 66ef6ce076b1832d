"""Snapshot protection as table operations on file or record manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from datetime import datetime, timedelta

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from faultline.operators.quality import ContractError

KEEP_MARKER = ".gitkeep"
ONE_VALUE = 256 << 20


def file_manifest(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """Path, size and SHA-256 of every file under the sources.

    A file of at most ``ONE_VALUE`` bytes is hashed as one value by Spark's reader; a
    larger one is streamed through the hash in a task, as no row can hold it.
    """
    parts = None
    for name, root in sources.items():
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(root)
            .where(~F.col("path").endswith(KEEP_MARKER))
        )
        tail = F.element_at(F.split("path", f"{root.rstrip('/')}/", 2), -1)
        for chosen, digest in (
            (F.col("length") <= ONE_VALUE, F.sha2("content", 256)),
            (F.col("length") > ONE_VALUE, streamed_sha256("path")),
        ):
            part = files.where(chosen).select(
                F.concat(F.lit(f"{name}/"), tail).alias("archive_path"),
                F.col("length").alias("size_bytes"),
                digest.alias("sha256"),
            )
            parts = part if parts is None else parts.unionByName(part)
    return parts


@F.pandas_udf(StringType())
def streamed_sha256(paths: pd.Series) -> pd.Series:
    """Hash of files of any size, a few megabytes at a time."""

    def digest(path: str) -> str:
        system, name = fs.FileSystem.from_uri(path)
        made = hashlib.sha256()
        with system.open_input_stream(name, compression=None) as file:
            while chunk := file.read(4 << 20):
                made.update(chunk)
        return made.hexdigest()

    return paths.map(digest)


def missing_sources(spark: SparkSession, sources: dict[str, str]) -> list[str]:
    """Names of the sources whose folder does not exist."""
    absent = []
    for name, root in sources.items():
        try:
            spark.read.format("binaryFile").load(root)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            absent.append(name)
    return absent


def row_hash(names: Sequence[str]) -> Column:
    """SHA-256 of a record; null and empty text stay different."""
    return F.sha2(F.to_json(F.struct(*[f"`{n}`" for n in names]), {"ignoreNullFields": "false"}), 256)


def record_manifest(frame: DataFrame, key: Column, names: Sequence[str]) -> DataFrame:
    """One manifest row per record of a table, keyed by ``key``."""
    text = F.to_json(F.struct(*[f"`{n}`" for n in names]), {"ignoreNullFields": "false"})
    return frame.select(
        key.alias("archive_path"), F.length(text).cast("long").alias("size_bytes"),
        row_hash(names).alias("sha256"),
    )


def table_manifest(frame: DataFrame) -> DataFrame:
    """Rows and an order-free fingerprint of each file of a stored table.

    Every row is hashed where it is read and the hashes are added up, so files
    of any size are covered and only totals are shuffled.
    """
    names = [f"`{name}`" for name in frame.columns]
    hashed = frame.select(
        F.col("_metadata.file_name").alias("archive_path"),
        F.xxhash64(*names).cast("decimal(38,0)").alias("h"),
    )
    return hashed.groupBy("archive_path").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("h").cast("string").alias("fingerprint")
    )


def manifest_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Added, changed and deleted paths between two manifests."""
    old = previous.select("archive_path", F.col("sha256").alias("old_sha256"))
    both = old.join(current.select("archive_path", "sha256"), "archive_path", "full_outer")
    change = (
        F.when(F.col("old_sha256").isNull(), F.lit("added"))
        .when(F.col("sha256").isNull(), F.lit("deleted"))
        .when(F.col("sha256") != F.col("old_sha256"), F.lit("changed"))
    )
    return both.select("archive_path", "sha256", change.alias("change")).where("change IS NOT NULL")


def snapshot_entries(mode: str, previous: DataFrame, current: DataFrame) -> DataFrame:
    """What a snapshot records: everything, or what is new, changed or gone."""
    if mode == "full":
        return current.select("archive_path", "sha256", F.lit("added").alias("change"))
    return manifest_diff(previous, current)


def select_mode(
    requested: str, history: DataFrame, now: datetime, full_interval_days: int = 7
) -> str:
    """Full when asked, when there is none yet, or when the last one is too old."""
    if requested == "full":
        return "full"
    last_full = history.where(F.col("mode") == "full").agg(F.max("created_at")).first()[0]
    if requested == "incremental":
        if last_full is None:
            raise ContractError("An incremental snapshot needs an earlier full one.")
        return "incremental"
    overdue = last_full is None or now - last_full >= timedelta(days=full_interval_days)
    return "full" if overdue else "incremental"


def mode_history(history: DataFrame, full_interval_days: int = 7) -> DataFrame:
    """The mode an automatic run would take at the time of each entry."""
    # One row per snapshot ever taken, so one window over all is small.
    earlier = Window.orderBy("created_at").rowsBetween(Window.unboundedPreceding, -1)
    full_at = F.when(F.col("mode") == "full", F.col("created_at"))
    last_full = F.max(full_at).over(earlier)
    due = last_full.isNull() | (
        F.col("created_at") >= last_full + F.make_dt_interval(days=F.lit(full_interval_days))
    )
    return history.withColumn(
        "automatic_mode", F.when(due, F.lit("full")).otherwise("incremental")
    )


def expired(
    history: DataFrame, now: Column, retention_days: int, current_id: str
) -> DataFrame:
    """Snapshots past retention, except the current one and the latest full one."""
    latest_full = (
        history.where(F.col("mode") == "full")
        .agg(F.max_by("snapshot_id", F.struct("created_at", "snapshot_id")))
        .scalar()
    )
    cutoff = now - F.make_dt_interval(days=F.lit(retention_days))
    return history.where(
        (F.col("created_at") < cutoff)
        & (F.col("snapshot_id") != current_id)
        & ~F.col("snapshot_id").eqNullSafe(latest_full)
    ).select("snapshot_id", "mode", "created_at")


def replay(history: DataFrame, entries: DataFrame) -> DataFrame:
    """Final state: the latest full snapshot and every later incremental one.

    The newest entry of each path wins; paths last deleted are left out.
    ``history`` has one row per snapshot, ``entries`` one per path and snapshot.
    """
    start = history.where(F.col("mode") == "full").agg(F.max("created_at")).scalar()
    applied = history.where(F.col("created_at") >= start).select("snapshot_id", "created_at")
    newest = F.max_by(
        F.struct("sha256", "change"), F.struct("created_at", "snapshot_id")
    ).alias("last")
    return (
        entries.join(applied, "snapshot_id")
        .groupBy("archive_path")
        .agg(newest)
        .where(F.col("last.change") != "deleted")
        .select("archive_path", "last.sha256")
    )


def integrity_failures(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected paths that are missing or whose checksum differs."""
    found = actual.select("archive_path", F.col("sha256").alias("actual_sha256"))
    wanted = expected.select("archive_path", F.col("sha256").alias("expected_sha256"))
    reason = F.when(F.col("actual_sha256").isNull(), F.lit("missing")).when(
        F.col("actual_sha256") != F.col("expected_sha256"), F.lit("checksum_mismatch")
    )
    return (
        wanted.join(found, "archive_path", "left")
        .withColumn("reason", reason)
        .where("reason IS NOT NULL")
    )
