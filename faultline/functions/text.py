"""Text, flag and lookup expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import schema as S


def trimmed(column: Column) -> Column:
    """Text without outer blanks; empty text is null."""
    return F.nullif(F.trim(column.cast("string")), F.lit(""))


def or_token(column: Column, token: str = S.MISSING) -> Column:
    """Trimmed text, with ``token`` for null or blank."""
    return F.coalesce(trimmed(column), F.lit(token))


def lookup(column: Column, table: dict, default=None) -> Column:
    """Value of a small fixed table as a chained condition; no match gives ``default``."""
    result = None
    for key, value in table.items():
        result = (F if result is None else result).when(column == F.lit(key), F.lit(value))
    return result if default is None else result.otherwise(F.lit(default))


def priority_name(code: Column) -> Column:
    return F.coalesce(F.concat(F.lit("P"), code.cast("string")), F.lit(S.MISSING))


def critical_group(product: Column, category: Column, code: Column) -> Column:
    return F.concat_ws(" | ", or_token(product), or_token(category), priority_name(code))


# Texts that mean true.
TRUE_TEXTS = ["true", "1", "sim", "yes", "y"]


def coerce_flag(frame: DataFrame, name: str) -> Column:
    """A yes / no column of any type as a boolean that is never null."""
    column, kind = F.col(name), frame.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        flag = column
    elif isinstance(kind, T.NumericType):
        flag = column != 0
    else:
        flag = F.lower(F.trim(column.cast("string"))).isin(TRUE_TEXTS)
    return F.coalesce(flag, F.lit(False))


def normalize_level(column: Column) -> Column:
    """Risk level in the house vocabulary, whatever its case, accents or language."""
    plain = F.translate(F.lower(F.trim(column)), "áéíóúç", "aeiouc")
    return F.coalesce(lookup(plain, S.LEVEL_SYNONYMS), plain, F.lit(""))


def scope_array(code: Column, scopes: dict[str, int | None]) -> Column:
    """Every scope a row of this priority counts towards."""
    members = [
        F.lit(name) if wanted is None else F.when(code == wanted, F.lit(name))
        for name, wanted in scopes.items()
    ]
    return F.array_compact(F.array(*members))
