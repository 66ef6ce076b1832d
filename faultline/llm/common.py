"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once; long documents then stay well under 100 MB.
BATCH_ROWS = 500

#: What separates words in every operator here.
WORD_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of one Arrow batch, so that a task never holds a partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_batches(
    frame: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """Apply ``function`` to each Arrow batch, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    small_batches(frame.sparkSession)
    return frame.mapInArrow(run, schema)


def per_process(key: Any, build: Callable[[], Any]) -> Any:
    """One object per Python worker process.

    Code that is shipped by value gets new module globals in each task, so the
    object hangs on the interpreter. It must follow from ``key`` alone.
    """
    kept = sys.__dict__.setdefault("_kept_per_process", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]


def held_out(doc_id: Column) -> Column:
    """True for the rows nothing is learned from; also for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0)) == 0
