"""Running totals, ranks and exact quantiles over data of any size.

A running total over one key is a serial job if the key holds a large part of
the rows. Here the order is split into levels, coarse to fine (day, second,
microsecond). Each level only runs over the totals of its own parent, so no
window holds more rows than a parent has children, and the totals come from
map-side aggregation. A count over a moving span ``[t - w, t)`` is then the
difference of two running totals, which is linear, while a frame that moves at
both ends re-reads the whole frame for each row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import materialise

MICROS_PER_SECOND = 1_000_000
MICROS_PER_DAY = 86_400 * MICROS_PER_SECOND


def micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def time_levels(at: Column) -> dict[str, Column]:
    """Day, second and microsecond of an instant given in microseconds."""
    return {
        "at_day": F.floor(at / MICROS_PER_DAY).cast("long"),
        "at_second": F.floor(at / MICROS_PER_SECOND).cast("long"),
        "at": at,
    }


def score_levels(score: Column, name: str = "score") -> dict[str, Column]:
    """A probability split as 1/1024, 1/1048576 and itself."""
    return {
        f"{name}_coarse": F.floor(score * 1024).cast("long"),
        f"{name}_fine": F.floor(score * 1048576).cast("long"),
        name: score,
    }


def present(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows with a value in every named column, in the form joins would infer."""
    for name in names:
        frame = frame.where(F.col(name).isNotNull())
    return frame


def count_points(
    frame: DataFrame,
    levels: dict[str, Column],
    values: dict[str, Column],
    keys: Sequence[str] = (),
) -> DataFrame:
    """One row per key and place in the order, with the sums of ``values``.

    Equal places are added up before anything is shuffled. Rows without a key
    or a place are left out here, once: otherwise each later join would push
    its own null filter down and the scan could not be shared.
    """
    names = [*keys, *levels]
    placed = frame.select(
        *keys,
        *[column.alias(name) for name, column in levels.items()],
        *[column.cast("long").alias(name) for name, column in values.items()],
    )
    placed = present(placed, names)
    return placed.groupBy(*names).agg(*[F.sum(name).alias(name) for name in values])


def running_before(
    points: DataFrame,
    levels: Sequence[str],
    values: Sequence[str],
    keys: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``before_<value>``: the sum over all points strictly earlier in the order.

    ``points`` holds one row per key and level combination, without nulls
    there, as ``count_points`` makes them. One shuffle per level serves both
    the running total inside a parent and the totals of the parents.
    """
    keys, levels = list(keys), list(levels)
    parents, last = keys + levels[:-1], F.col(levels[-1])
    within = (
        Window.partitionBy(*parents)
        .orderBy(last.desc() if descending else last.asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    if parents:
        points = points.repartition(*parents)
    local = points.withColumns(
        {f"before_{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values}
    )
    if len(levels) == 1:
        return local
    totals = points.groupBy(*parents).agg(*[F.sum(v).alias(v) for v in values])
    above = running_before(totals, levels[:-1], values, keys, descending).select(
        *parents, *[F.col(f"before_{v}").alias(f"above_{v}") for v in values]
    )
    # By a merge: planned from the size of compressed files, the points would be sent through
    # the driver.
    return (
        local.join(above.hint("merge"), parents)
        .withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"above_{v}") for v in values})
        .drop(*[f"above_{v}" for v in values])
    )


def value_levels(value: Column) -> dict[str, Column]:
    """Levels of any numbers: blocks of 1,024, then parts of 1/4,096, then the value.
    A block of counts has at most 1,024 parts, and all rates within [0, 1] have 4,097."""
    return {"block": F.floor(value / 1024), "part": F.floor(value * 4096), "v": value}


def exact_quantiles(
    frame: DataFrame,
    value: str,
    probabilities: dict[str, float],
    levels: dict[str, Column],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Linear-interpolated quantiles: one row per key and entry of ``probabilities``.

    Columns are the keys, ``quantile`` (its name) and ``value``. Equal values
    are counted before anything moves; the ranks come from ``running_before``.
    ``levels`` must end with the value itself.
    """
    keys = list(keys)
    counted = count_points(frame.where(F.col(value).isNotNull()), levels, {"n": F.lit(1)}, keys)
    ranked = running_before(counted, list(levels), ["n"], keys)
    if keys:
        sizes = ranked.groupBy(*keys).agg(F.sum("n").alias("size"))
        ranked = ranked.join(sizes, keys)
    else:
        ranked = ranked.withColumn("size", counted.agg(F.sum("n")).scalar())
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("quantile"),
                ((F.col("size") - 1) * F.lit(float(share))).alias("place"),
            )
            for name, share in probabilities.items()
        ]
    )
    first, end = F.col("before_n"), F.col("before_n") + F.col("n")
    low, high = F.floor(F.col("place")), F.ceil(F.col("place"))
    is_low, is_high = (first <= low) & (low < end), (first <= high) & (high < end)
    last = F.col(list(levels)[-1]).cast("double")
    # Only the quantiles that a value takes part in are unfolded.
    taken = F.filter(
        wanted,
        lambda w: ((first <= F.floor(w["place"])) & (F.floor(w["place"]) < end))
        | ((first <= F.ceil(w["place"])) & (F.ceil(w["place"]) < end)),
    )
    found = (
        ranked.select(*keys, last.alias("v"), "before_n", "n", F.inline(taken))
        .groupBy(*keys, "quantile")
        .agg(
            F.max(F.when(is_low, F.col("v"))).alias("below"),
            F.max(F.when(is_high, F.col("v"))).alias("above"),
            F.max(F.col("place") - low).alias("part"),
        )
    )
    return found.select(
        *keys,
        "quantile",
        (F.col("below") + (F.col("above") - F.col("below")) * F.col("part")).alias("value"),
    )


def quantile_columns(
    frame: DataFrame,
    value: str,
    probabilities: dict[str, float],
    levels: dict[str, Column],
    keys: Sequence[str] = (),
) -> DataFrame:
    """The same with one column per quantile."""
    rows = exact_quantiles(frame, value, probabilities, levels, keys)
    picked = [
        F.max(F.when(F.col("quantile") == name, F.col("value"))).alias(name)
        for name in probabilities
    ]
    return rows.groupBy(*keys).agg(*picked) if keys else rows.agg(*picked)


def sequential_keys(frame: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number the rows 1..n in ``order`` without bringing them into one task.

    The rows are range-partitioned and written once, so that their positions
    stay fixed; the offsets per part are a table of one row per partition.
    """
    placed = materialise(
        frame.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    ).withColumns(
        {
            "_part": F.shiftright("_place", 33),
            "_offset": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    starts = running_before(sizes, ["_part"], ["n"]).select("_part", "before_n")
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("before_n") + F.col("_offset") + 1)
        .drop("_place", "_part", "_offset", "before_n")
    )
