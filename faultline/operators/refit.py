"""Learned candidates, refitted for each day on the days before it.

A *fit* is one series and one day: it knows the rows of the series before that day. All
fits of a candidate advance together, as rows of a table: ridge regression follows from
running sums, Poisson regression takes one grouped aggregation per Newton step, and
boosted trees of different days are fitted by concurrent MLlib jobs.

The fit of the day after the last known one is the final fit; its parameters can be stored
and predict later days without fitting anything (``operators/bundle.py``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.operators import linear
from faultline.operators.series import complete_rows
from faultline.session import materialise

RIDGE_PENALTY = 5.0
POISSON_PENALTY = 1e-4
# Least exposure, and limits of the exponent.
LEAST_EXPOSURE, EXPONENT = 1e-6, 30.0
NEWTON_STEPS, NEWTON_DONE = 50, 1e-9
#: A move below this that no longer halves is at the limit of the numbers' precision.
NEWTON_LIMIT = 1e-5
#: A column whose variance is below this share of its mean square is constant.
CONSTANT = 1e-12
#: Parameters of a fit: those of ``parameter_rows``.
PARAMETERS = (
    "scope string, horizon string, until date, candidate string, kind string, constant double, "
    "intercept double, means array<double>, deviations array<double>, coefficients array<double>"
)


def _doubles(names: list[str]) -> list[Column]:
    return [F.col(n).cast("double") for n in names]


def _past(total: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """An aggregate over the earlier days of the series."""
    window = Window.partitionBy("scope", "horizon").orderBy("day")
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    return lambda column: total(column).over(earlier)


def _evaluated(first_day: str) -> Column:
    return F.col("day") >= F.lit(first_day).cast("date")


def spread(size: int) -> tuple[Column, Column]:
    """Means and population deviations from the sums; a constant column has deviation 0."""
    means = F.transform(linear.vector("s", size), lambda s: s / F.col("n"))
    squares = F.transform(
        F.array(*[F.col(f"s_{i}_{i}") for i in range(size)]), lambda s: s / F.col("n")
    )
    deviations = F.zip_with(
        squares,
        means,
        lambda square, mean: F.when(
            square - mean * mean > square * F.lit(CONSTANT), F.sqrt(square - mean * mean)
        ).otherwise(F.lit(0.0)),
    )
    return means, deviations


def ridge_moments(features: DataFrame, first_day: str) -> DataFrame:
    """A fit per row: sums over the earlier days of the series, one window for all of them."""
    x, y = _doubles(S.LEVEL_FEATURES), F.col("y")
    rows = complete_rows(features)
    sums = linear.moment_sums(x, y, y.isNotNull(), _past(F.sum))
    known = F.when(y.isNotNull(), y)
    # The sums are running; only the fits that are asked for leave their task.
    return rows.select(
        "scope",
        "horizon",
        F.col("day").alias("until"),
        *[column.alias(name) for name, column in sums.items()],
        _past(F.min)(known).alias("least"),
        _past(F.max)(known).alias("most"),
    ).where(F.col("until") >= F.lit(first_day).cast("date"))


def ridge_parameters(moments: DataFrame) -> DataFrame:
    """Ridge regression on standardised columns, solved per fit.

    With centred sums C and c the coefficients of the plain columns solve
    ``(C + penalty * variances) b = c``.
    """
    size = len(S.LEVEL_FEATURES)
    means, deviations = spread(size)
    # Series are few: the days are what can be solved side by side.
    fits = moments.repartition("scope", "horizon", "until").select(
        "scope",
        "horizon",
        "until",
        "n",
        "sy",
        "least",
        "most",
        means.alias("means"),
        deviations.alias("deviations"),
        linear.matrix("s", size).alias("squares"),
        linear.vector("sy", size).alias("products"),
    )
    mean_y = F.col("sy") / F.col("n")

    def at(name: str, i: Column) -> Column:
        return F.get(F.col(name), i)

    def entry(value: Column, i: Column, j: Column) -> Column:
        centred = value - F.col("n") * at("means", i) * at("means", j)
        penalty = F.lit(RIDGE_PENALTY) * at("deviations", i) * at("deviations", i)
        plain = F.when(i == j, centred + penalty).otherwise(centred)
        return F.when((at("deviations", i) == 0) | (at("deviations", j) == 0), 0.0).otherwise(plain)

    system = F.transform("squares", lambda row, i: F.transform(row, lambda v, j: entry(v, i, j)))
    right = F.transform(
        "products",
        lambda value, i: F.when(at("deviations", i) == 0, 0.0).otherwise(
            value - at("means", i) * F.col("sy")
        ),
    )
    solved = fits.withColumn("coefficients", linear.solve(system, right))
    return parameter_rows(solved, "ridge", mean_y)


def parameter_rows(solved: DataFrame, candidate: str, intercept: Column) -> DataFrame:
    """Fits under one schema. A series without days, or of one value, predicts a constant."""
    empty = F.coalesce(F.col("n"), F.lit(0.0)) == 0
    constant = F.when(empty, 0.0).when(F.col("least") == F.col("most"), F.col("least"))
    plain = constant.isNull()
    return solved.select(
        "scope",
        "horizon",
        "until",
        F.lit(candidate).alias("candidate"),
        F.when(plain, candidate).otherwise("constant").alias("kind"),
        constant.alias("constant"),
        F.when(plain, intercept).alias("intercept"),
        *[F.when(plain, F.col(n)).alias(n) for n in ("means", "deviations", "coefficients")],
    )


def predicted() -> Column:
    """The prediction of a row of features that has been joined with its parameters."""

    def linear_term(names: list[str]) -> Column:
        # What was constant while fitting has no coefficient.
        centred = F.zip_with(F.array(*_doubles(names)), F.col("means"), lambda x, m: x - m)
        return F.col("intercept") + linear.dot(F.col("coefficients"), centred)

    exponent = F.greatest(F.least(linear_term(S.RATE_FEATURES), F.lit(EXPONENT)), F.lit(-EXPONENT))
    exposure = F.greatest(F.col("exp_roll7"), F.lit(LEAST_EXPOSURE))
    value = (
        F.when(F.col("kind") == "constant", F.col("constant"))
        .when(F.col("kind") == "ridge", linear_term(S.LEVEL_FEATURES))
        .when(F.col("kind") == "poisson_off", F.exp(exponent) * exposure)
    )
    return F.greatest(value, F.lit(0.0))


def predict_fits(features: DataFrame, parameters: DataFrame) -> DataFrame:
    """Each fit's prediction of its own day; the final fit predicts all days from its own on."""
    rows = complete_rows(features).alias("x")
    last = F.max("until").over(Window.partitionBy("scope", "horizon", "candidate"))
    fits = parameters.withColumn("last", last).alias("p")
    same = (
        (F.col("x.scope") == F.col("p.scope"))
        & (F.col("x.horizon") == F.col("p.horizon"))
        & (F.col("x.day") == F.col("p.until"))
    )
    return (
        rows.join(fits, same)
        .select("x.*", *[f"p.{n}" for n in ("candidate", "kind", "constant", "intercept", "means", "deviations", "coefficients")])
        .select("scope", "horizon", "day", "candidate", predicted().alias("predicted"))
    )


# --- Poisson regression of rates ---------------------------------------------


def _poisson_start(features: DataFrame, first_day: str) -> DataFrame:
    """Fits with means, deviations, total exposure, and the mean rate as first intercept."""
    size, y = len(S.RATE_FEATURES), F.col("y")
    known = y.isNotNull()
    exposure = F.greatest(F.col("exp_roll7"), F.lit(LEAST_EXPOSURE))
    sums = {"n": _past(F.sum)(F.when(known, F.lit(1.0)))}
    for i, x in enumerate(_doubles(S.RATE_FEATURES)):
        sums[f"s_{i}"] = _past(F.sum)(F.when(known, x))
        sums[f"s_{i}_{i}"] = _past(F.sum)(F.when(known, x * x))
    fits = (
        complete_rows(features)
        .select(
            "scope",
            "horizon",
            F.col("day").alias("until"),
            *[column.alias(name) for name, column in sums.items()],
            _past(F.sum)(F.when(known, exposure)).alias("weight"),
            _past(F.sum)(F.when(known, y)).alias("total"),
            _past(F.min)(F.when(known, y)).alias("least"),
            _past(F.max)(F.when(known, y)).alias("most"),
        )
        .where(F.col("until") >= F.lit(first_day).cast("date"))
    )
    means, deviations = spread(size)
    start = F.log(F.greatest(F.col("total") / F.col("weight"), F.lit(1e-12)))
    return fits.select(
        "scope",
        "horizon",
        "until",
        "n",
        "weight",
        # All rates are zero if all counts are.
        F.when(F.col("total") == 0, 0.0).otherwise(F.col("least")).alias("least"),
        F.when(F.col("total") == 0, 0.0).otherwise(F.col("most")).alias("most"),
        means.alias("means"),
        deviations.alias("deviations"),
        F.concat(F.array(start), F.array_repeat(F.lit(0.0), size)).alias("beta"),
    )


def _weighted_sums(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Slope ``g_i`` and second derivatives ``h_i_j`` of every fit at its ``beta``.

    A task adds up its own days for all fits of their series; one aggregation adds up the
    tasks. The fits are broadcast: evaluated days times series, which the calendar bounds.
    """
    size = len(S.RATE_FEATURES) + 1
    upper = np.triu_indices(size)
    known: dict[tuple, list] = {}
    for fit in fits.select("scope", "horizon", "until", "weight", "means", "deviations", "beta").collect():
        known.setdefault((fit["scope"], fit["horizon"]), []).append(fit)
    shared = fits.sparkSession.sparkContext.broadcast(known)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for key, days in frame.groupby(["scope", "horizon"]):
                x, y = np.stack(days["x"]), days["y"].to_numpy()
                exposure, day = days["exposure"].to_numpy(), days["day"].to_numpy()
                for fit in shared.value.get(key, ()):
                    past = day < fit["until"]
                    if not past.any():
                        continue
                    # A column that has been constant takes no part.
                    varies = np.array(fit["deviations"]) > 0
                    z = np.column_stack([np.ones(past.sum()), (x[past] - fit["means"]) * varies])
                    exponent = np.clip(z @ np.array(fit["beta"]), -EXPONENT, EXPONENT)
                    mu = exposure[past] / fit["weight"] * np.exp(exponent)
                    slope = z.T @ (mu - y[past] / fit["weight"])
                    curve = ((z * mu[:, None]).T @ z)[upper]
                    yield pa.RecordBatch.from_pylist(
                        [{**dict(zip(("scope", "horizon"), key, strict=True)), "until": fit["until"],
                          "sums": np.concatenate([slope, curve]).tolist()}],
                        pa.schema([("scope", pa.string()), ("horizon", pa.string()), ("until", pa.date32()),
                                   ("sums", pa.list_(pa.float64()))]),
                    )

    parts = rows.mapInArrow(add_up, "scope string, horizon string, until date, sums array<double>")
    names = [f"g_{i}" for i in range(size)] + [f"h_{i}_{j}" for i, j in zip(*upper, strict=True)]
    totals = [F.sum(F.col("sums")[place]).alias(name) for place, name in enumerate(names)]
    return parts.groupBy("scope", "horizon", "until").agg(*totals)


def _newton_step(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """One Newton step of every fit. ``beta`` holds the intercept and the coefficients of
    the centred columns; ``far`` comes back as the largest move on standardised ones."""
    size, key = len(S.RATE_FEATURES) + 1, ["scope", "horizon", "until"]
    summed = _weighted_sums(rows, fits).select(
        *key, linear.matrix("h", size).alias("curve"), linear.vector("g", size).alias("slope")
    )
    spread_of = F.concat(F.array(F.lit(0.0)), F.col("deviations"))

    def penalty(i: Column) -> Column:
        return F.lit(POISSON_PENALTY) * F.get(spread_of, i) * F.get(spread_of, i)

    system = F.transform(
        "curve", lambda row, i: F.transform(row, lambda v, j: F.when(i == j, v + penalty(i)).otherwise(v))
    )
    slope = F.transform("slope", lambda v, i: v + penalty(i) * F.get("beta", i))
    sizes = F.concat(F.array(F.lit(1.0)), F.col("deviations"))
    return (
        fits.join(summed, key)
        .withColumn("move", linear.solve(system, slope))
        .withColumn("beta", F.zip_with("beta", "move", lambda b, m: b - m))
        .withColumn("far", F.array_max(F.zip_with("move", sizes, lambda m, d: F.abs(m * d))))
        .drop("curve", "slope", "move")
    )


def poisson_parameters(features: DataFrame, first_day: str) -> DataFrame:
    """Log-linear rates with exposure weights, all fits by Newton steps side by side.

    Each step is one aggregation over the days of the fits that still move; those that stand
    still drop out. A step's result is stored, so that none is ever computed twice.
    """
    rows = materialise(
        complete_rows(features)
        .where(F.col("y").isNotNull())
        .select(
            "scope",
            "horizon",
            "day",
            "y",
            F.greatest(F.col("exp_roll7"), F.lit(LEAST_EXPOSURE)).alias("exposure"),
            F.array(*_doubles(S.RATE_FEATURES)).alias("x"),
        )
        # Every day meets the fits after it: the work is the product, however few the rows.
        .repartition(features.sparkSession.sparkContext.defaultParallelism, "day")
    )
    start = materialise(_poisson_start(features, first_day))
    varies = F.coalesce(F.col("least") != F.col("most"), F.lit(False))
    done, moving = [start.where(~varies)], start.where(varies)
    moving = moving.withColumn("before", F.lit(float("inf")))
    still = (F.col("far") < NEWTON_DONE) | (
        (F.col("far") < NEWTON_LIMIT) & (F.col("far") > F.col("before") / 2)
    )
    for _ in range(NEWTON_STEPS):
        if moving.isEmpty():
            break
        stepped = materialise(_newton_step(rows, moving))
        done.append(stepped.where(still).drop("far", "before"))
        moving = stepped.where(~still).drop("before").withColumnRenamed("far", "before")
    every = moving.drop("before")
    for part in done:
        every = every.unionByName(part)
    solved = every.withColumn("coefficients", F.slice("beta", 2, len(S.RATE_FEATURES)))
    return parameter_rows(solved, "poisson_off", F.col("beta")[0])


# --- Boosted trees -----------------------------------------------------------

# Trees, depth, rows of a leaf, step.
TREES, DEPTH, LEAF, RATE = 250, 3, 15, 0.08
#: Fits that run side by side in the cluster.
SIDE_BY_SIDE = 8
TREE_FEATURES = ["scope_number", "horizon_days", *S.LEVEL_FEATURES]


def tree_rows(features: DataFrame) -> DataFrame:
    """Complete rows with the feature vector of the trees, which all series share."""
    scopes = F.array(*[F.lit(s) for s in S.FORECAST_SCOPES])
    numbered = complete_rows(features).withColumn(
        "scope_number", F.array_position(scopes, F.col("scope")).cast("double")
    )
    plain = numbered.select("scope", "horizon", "day", "y", *[
        F.col(n).cast("double").alias(n) for n in TREE_FEATURES
    ])
    return VectorAssembler(inputCols=TREE_FEATURES, outputCol="vector").transform(plain).select(
        "scope", "horizon", "day", "y", "vector"
    )


def fit_trees(rows: DataFrame, trees: int = TREES) -> GBTRegressionModel:
    """Boosted trees on all known rows, with squared loss."""
    return GBTRegressor(
        featuresCol="vector",
        labelCol="y",
        predictionCol="value",
        maxIter=trees,
        maxDepth=DEPTH,
        minInstancesPerNode=LEAF,
        stepSize=RATE,
        seed=0,
        maxBins=64,
    ).fit(rows)


def boosted_forecasts(features: DataFrame, first_day: str, trees: int = TREES) -> DataFrame:
    """Boosted trees over all series together, refitted for each evaluated day.

    Days after the last known one share the final fit. Fits of different days are
    independent jobs, a few at a time; each has all its trees. ``first_day`` bounds how
    many days are evaluated, and with them the fits.
    """
    rows = materialise(tree_rows(features))
    known = rows.where(F.col("y").isNotNull())
    last = known.agg(F.max("day")).first()[0]
    asked = rows.where(_evaluated(first_day)).select("day").distinct().orderBy("day")
    # One entry per evaluated day of the calendar.
    days = [row["day"] for row in asked.collect()]
    past = [day for day in days if last is not None and day <= last]
    ahead = [day for day in days if last is None or day > last]

    def predict(chosen: list) -> DataFrame | None:
        train = known.where(F.col("day") < F.lit(chosen[0]))
        now = rows.where(F.col("day").isin(chosen))
        if train.isEmpty():
            return materialise(_named(now.withColumn("value", F.lit(0.0))))
        return materialise(_named(fit_trees(train, trees).transform(now)))

    groups = [[day] for day in past] + ([ahead] if ahead else [])
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        parts = list(pool.map(predict, groups))
    if not parts:
        return _named(rows.where("false").withColumn("value", F.lit(0.0)))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def _named(scored: DataFrame) -> DataFrame:
    return scored.select(
        "scope",
        "horizon",
        "day",
        F.lit("gbt").alias("candidate"),
        F.greatest(F.col("value"), F.lit(0.0)).alias("predicted"),
    )
