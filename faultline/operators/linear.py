"""Small linear systems as column expressions: sums of products, and their solution.

Sums are plain aggregates, so they work per group and over a window alike. A system has a
row and a column for each feature, whatever the number of rows that were summed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pivot below this share of the largest diagonal value counts as zero.
SMALLEST_PIVOT = 1e-13


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row."""
    return F.transform(F.array(value), body)[0]


def moment_sums(
    x: list[Column], y: Column, known: Column, total: Callable[[Column], Column]
) -> dict[str, Column]:
    """Count, sums and sums of products of the rows where ``known`` holds.

    total: how to sum a column, ``F.sum`` or a sum over a window. Returned by name: ``n``,
    ``s_i``, ``s_i_j`` for i <= j, ``sy`` and ``sy_i``.
    """
    one = F.when(known, F.lit(1.0))
    sums = {"n": total(one), "sy": total(F.when(known, y))}
    for i, left in enumerate(x):
        sums[f"s_{i}"] = total(F.when(known, left))
        sums[f"sy_{i}"] = total(F.when(known, left * y))
        for j in range(i, len(x)):
            sums[f"s_{i}_{j}"] = total(F.when(known, left * x[j]))
    return sums


def vector(prefix: str, size: int) -> Column:
    return F.array(*[F.col(f"{prefix}_{i}") for i in range(size)])


def matrix(prefix: str, size: int) -> Column:
    """The symmetric matrix whose upper half lies in columns ``prefix_i_j``."""
    return F.array(
        *[
            F.array(*[F.col(f"{prefix}_{min(i, j)}_{max(i, j)}") for j in range(size)])
            for i in range(size)
        ]
    )


def solve(system: Column, right: Column) -> Column:
    """Solution of a symmetric system without negative eigenvalues, by elimination.

    An unknown whose pivot vanishes is a combination of those before it, or free: it gets
    zero. All values are arrays of double.
    """
    size = F.size(right)
    most = F.array_max(F.transform(system, lambda row, i: F.abs(row[i])))
    augmented = F.zip_with(system, right, lambda row, value: F.concat(row, F.array(value)))

    def eliminate(limit: Column) -> Column:
        def step(state: Column, k: Column) -> Column:
            def reduced(pivot: Column) -> Column:
                unit = F.transform(pivot, lambda value: value / pivot[k])
                return F.when(
                    F.abs(pivot[k]) <= limit,
                    F.transform(state, lambda row, i: F.when(i == k, F.transform(row, lambda _: F.lit(0.0))).otherwise(row)),
                ).otherwise(
                    _let(
                        unit,
                        lambda u: F.transform(
                            state,
                            lambda row, i: F.when(i == k, u).otherwise(
                                F.zip_with(row, u, lambda a, b: a - b * row[k])
                            ),
                        ),
                    )
                )

            return _let(state[k], reduced)

        return F.aggregate(F.sequence(F.lit(0), size - 1), augmented, step)

    solved = _let(most * F.lit(SMALLEST_PIVOT), eliminate)
    return F.transform(solved, lambda row: F.element_at(row, -1))


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, value: total + value)
