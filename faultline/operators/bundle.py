"""A stored forecast model: one row of parameters per series, and prediction from it.

The daily run joins the features of the target day with the parameters and evaluates one
expression; nothing is fitted. Training stores a new version and leaves the old one alone.
"""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.operators import refit
from faultline.operators.bands import band_limits
from faultline.operators.quality import ContractError

KEY = ["scope", "horizon"]
#: Which feature each naive candidate repeats.
NAIVE_FEATURE = {"naive7": "seas_lag7", "media7": "roll7_mean", "ultimo": "last"}
FITTED = ["kind", "constant", "intercept", "means", "deviations", "coefficients"]
BUNDLE_SCHEMA = (
    "scope string, horizon string, candidate string, until date, kind string, constant double, "
    "intercept double, means array<double>, deviations array<double>, coefficients array<double>, "
    "q_low double, q_high double, model_version string"
)


def build_bundle(
    selection: DataFrame, parameters: DataFrame, bands: DataFrame, version: str
) -> DataFrame:
    """Parameters of the chosen candidate of each series, with its band's last quantiles.

    parameters: fits of the learned candidates; the newest one of a series is stored.
    """
    final = parameters.groupBy(*KEY, "candidate").agg(
        F.max_by(F.struct("until", *FITTED), "until").alias("fit")
    )
    quantiles = bands.groupBy(*KEY).agg(
        F.max_by("q_low", "day").alias("q_low"), F.max_by("q_high", "day").alias("q_high")
    )
    chosen = selection.select(*KEY, "candidate")
    return (
        chosen.join(final, [*KEY, "candidate"], "left")
        .join(quantiles, KEY, "left")
        .select(
            *KEY,
            "candidate",
            "fit.until",
            F.coalesce("fit.kind", "candidate").alias("kind"),
            *[f"fit.{n}" for n in FITTED[1:]],
            F.coalesce("q_low", F.lit(0.0)).alias("q_low"),
            F.coalesce("q_high", F.lit(0.0)).alias("q_high"),
            F.lit(version).alias("model_version"),
        )
    )


def target_rows(features: DataFrame) -> DataFrame:
    """The row of each series that lies its horizon after the last known day."""
    return features.where(F.col("day") == F.date_add("last_day", F.col("horizon_days")))


def require_bundle(features: DataFrame, bundle: DataFrame) -> None:
    """Every series has one component of a known kind, and complete features on its day."""
    names = list(dict.fromkeys([*S.LEVEL_FEATURES, *S.RATE_FEATURES]))
    targets = target_rows(features).withColumn(
        "complete", F.forall(F.array(*[F.col(n).isNotNull() for n in names]), lambda known: known)
    )
    components = bundle.groupBy(*KEY).agg(F.count(F.lit(1)).alias("components"), F.first("kind").alias("kind"))
    known = [*NAIVE_FEATURE, "constant", "ridge", "poisson_off", "gbt"]
    found = (
        targets.join(components, KEY, "left")
        .agg(
            F.count_if(F.coalesce("components", F.lit(0)) != 1).alias("without_one_component"),
            F.count_if(~F.col("kind").isin(known)).alias("unknown_kind"),
            F.count_if(~F.col("complete")).alias("incomplete_features"),
        )
        .first()
        .asDict()
    )
    if any(found.values()):
        raise ContractError(f"The bundle does not serve these features: {found}")


def bundle_value() -> Column:
    """The value of a row of features that has been joined with its component."""
    naive = F.lit(None).cast("double")
    for kind, feature in NAIVE_FEATURE.items():
        naive = F.when(F.col("kind") == kind, F.greatest(F.col(feature), F.lit(0.0))).otherwise(naive)
    return F.coalesce(naive, refit.predicted())


def predict_volume(
    features: DataFrame,
    bundle: DataFrame,
    generated_at: Column,
    trees: GBTRegressionModel | None = None,
) -> DataFrame:
    """One row per scope and horizon under the forecast contract, without any fit.

    trees: the stored trees, needed if a component was chosen to be boosted.
    """
    rows = target_rows(features).join(bundle, KEY)
    value = bundle_value()
    if trees is not None:
        boosted = trees.transform(
            refit.tree_rows(target_rows(features)).select(*KEY, "day", "y", "vector")
        ).select(*KEY, F.greatest(F.col("value"), F.lit(0.0)).alias("boosted"))
        rows = rows.join(boosted, KEY, "left")
        value = F.when(F.col("kind") == "gbt", F.col("boosted")).otherwise(value)
    valued = rows.withColumn("value", value)
    lower, upper = band_limits(F.col("value"), F.col("q_low"), F.col("q_high"))
    return valued.select(
        F.col("day").alias("reference_date"),
        generated_at.alias("generated_at"),
        "horizon",
        F.col("scope").alias("priority_scope"),
        F.bround("value", 2).alias("predicted_incident_count"),
        F.bround(F.least(lower, F.col("value")), 2).alias("lower_bound"),
        F.bround(F.greatest(upper, F.col("value")), 2).alias("upper_bound"),
        F.col("candidate").alias("model_name"),
        "model_version",
    )


def forecast_differences(left: DataFrame, right: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Forecasts that only one side has, and those that differ by more than ``tolerance``.

    Compared are value and bounds, and exactly the model's name and version.
    """
    key = ["reference_date", "horizon", "priority_scope"]
    values = ["predicted_incident_count", "lower_bound", "upper_bound"]
    exact = ["model_name", "model_version"]

    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(*key, F.struct(*values, *exact).alias(name))

    far = F.lit(False)
    for name in values:
        # Rounded values of a hair's difference are not apart.
        apart = F.abs(F.col(f"one.{name}") - F.col(f"two.{name}")) > F.lit(tolerance + 1e-9)
        far = far | F.coalesce(apart, ~F.col(f"one.{name}").eqNullSafe(F.col(f"two.{name}")))
    for name in exact:
        far = far | ~F.col(f"one.{name}").eqNullSafe(F.col(f"two.{name}"))
    both = side(left, "one").join(side(right, "two"), key, "full")
    return both.agg(
        F.count_if(F.col("two").isNull()).alias("only_left"),
        F.count_if(F.col("one").isNull()).alias("only_right"),
        F.count_if(F.col("one").isNotNull() & F.col("two").isNotNull() & far).alias("differing"),
    )


def require_parity(left: DataFrame, right: DataFrame, tolerance: float = 0.01) -> None:
    found = forecast_differences(left, right, tolerance).first().asDict()
    if any(found.values()):
        raise ContractError(f"Forecasts differ: {found}")
