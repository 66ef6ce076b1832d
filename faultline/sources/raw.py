"""Reading the raw incident table and recording where each row came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.functions.ordering import running_before
from faultline.operators.quality import ContractError, missing_columns, unexpected_columns

FIRST_ROW = 2  # the header is row 1


def require_source_header(frame: DataFrame) -> DataFrame:
    """Trim the header, require exactly the known columns, fix their order."""
    trimmed = frame.toDF(*[name.strip() for name in frame.columns])
    missing = missing_columns(trimmed, S.COLUMN_MAP)
    extra = unexpected_columns(trimmed, S.COLUMN_MAP)
    if missing or extra:
        raise ContractError(f"Invalid header. Missing: {missing}; unexpected: {extra}")
    return trimmed.select(*[f"`{name}`" for name in S.COLUMN_MAP])


def read_raw(
    spark: SparkSession, path: str, kind: str = "csv", multi_line: bool = False
) -> DataFrame:
    """The raw table as text; types are given by the cleaning step.

    multi_line: quoted texts may hold line breaks. A file is then one block, so large
    tables come as many files; row numbers hold either way.
    """
    if kind == "csv":
        frame = spark.read.csv(
            path, header=True, inferSchema=False, multiLine=multi_line, escape='"'
        )
    else:
        frame = spark.read.format(kind).load(path)
    return require_source_header(frame)


def _stamp(frame: DataFrame, name: Column, number: Column, ingested_at: Column | None) -> DataFrame:
    now = F.current_timestamp() if ingested_at is None else ingested_at
    return frame.withColumns(
        {"_source_file": name, "_source_row_number": number, "_ingested_at_utc": now}
    )


def with_provenance(frame: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """File name, row number in the file (from 2) and load time of a Parquet scan.

    The reader itself knows the row number, so nothing is shuffled or counted.
    """
    number = F.col("_metadata.row_index") + FIRST_ROW
    return _stamp(frame, F.col("_metadata.file_name"), number, ingested_at)


def with_text_provenance(frame: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """The same for text files, whose reader has no row numbers.

    A row is numbered inside its file block by reading order; the rows of the
    blocks before it come from a running total over one row per block.
    """
    block = {
        "_path": F.col("_metadata.file_path"),
        "_block": F.col("_metadata.file_block_start"),
        "_name": F.col("_metadata.file_name"),
        "_read": F.monotonically_increasing_id(),
    }
    placed = frame.withColumns(block)
    blocks = placed.groupBy("_path", "_block").agg(
        F.count(F.lit(1)).alias("n"), F.min("_read").alias("_first")
    )
    starts = running_before(blocks, ["_block"], ["n"], ["_path"]).drop("n")
    numbered = placed.join(starts, ["_path", "_block"])
    number = F.col("before_n") + F.col("_read") - F.col("_first") + FIRST_ROW
    stamped = _stamp(numbered, F.col("_name"), number, ingested_at)
    return stamped.drop("_path", "_block", "_name", "_read", "_first", "before_n")
