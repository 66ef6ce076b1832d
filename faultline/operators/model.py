"""Breach-risk model: preprocessing, logistic fit, calibration and scoring."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.functions.ordering import quantile_columns, value_levels
from faultline.operators import explain, fits, history, metrics, scoring
from faultline.operators.quality import (
    ContractError,
    require_clean,
    require_no_leakage,
    risk_score_contract,
)
from faultline.session import materialise

INVERSE_PENALTY = 0.01
MAX_CATEGORIES = 100
SEED = 42
CLIP = 1e-6


def prepare(frame: DataFrame) -> DataFrame:
    """Categories as text with a token for missing, numbers as double."""
    texts = {
        n: F.coalesce(F.col(n).cast("string"), F.lit(S.MISSING)) for n in S.CATEGORICAL_FEATURES
    }
    numbers = {n: F.col(n).cast("double") for n in S.NUMERIC_FEATURES}
    return frame.withColumns({f"x_{n}": c for n, c in {**texts, **numbers}.items()})


def category_table(training: DataFrame, limit: int = MAX_CATEGORIES) -> DataFrame:
    """Categories that get a column of their own, per feature.

    A feature with more than ``limit`` categories keeps the ``limit - 1`` most
    frequent, ties in text order; the rest share one column. The ranking keeps
    only that many rows per partition before anything is shuffled.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("feature"), F.col(f"x_{n}").alias("category"))
            for n in S.CATEGORICAL_FEATURES
        ]
    )
    counted = (
        prepare(training)
        .select(F.inline(pairs))
        .groupBy("feature", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "category")
    ranked = counted.withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= limit + 1
    )
    sizes = ranked.groupBy("feature").agg(F.max("place").alias("size"))
    kept = F.when(F.col("size") > limit, F.lit(limit - 1)).otherwise(F.lit(limit))
    return ranked.join(sizes, "feature").where(F.col("place") <= kept)


def numeric_table(training: DataFrame) -> DataFrame:
    """Median, mean and population deviation of each numeric feature, after
    the median has filled the gaps."""
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"))
            for n in S.NUMERIC_FEATURES
        ]
    )
    long = training.select(F.inline(pairs))
    levels = value_levels(F.col("value"))
    medians = quantile_columns(long, "value", {"median": 0.5}, levels, ["feature"])
    # An entry per feature, so that the rows are unfolded for the medians only; the deviation
    # merges partial moments, so large values lose no digits.
    entries = F.map_from_entries(F.collect_list(F.struct("feature", "median")))
    known = medians.agg(entries.alias("medians")).scalar()

    def summed_up(name: str) -> Column:
        median = F.coalesce(F.try_element_at("medians", F.lit(name)), F.lit(0.0))
        filled = F.coalesce(F.col(name).cast("double"), median)
        return F.struct(
            F.lit(name).alias("feature"),
            F.max(median).alias("median"),
            F.avg(filled).alias("mean"),
            F.stddev_pop(filled).alias("deviation"),
        )

    every = F.array(*[summed_up(name) for name in S.NUMERIC_FEATURES])
    summed = training.withColumn("medians", known).agg(F.count(F.lit(1)).alias("n"), every.alias("every"))
    return summed.where(F.col("n") > 0).select(F.inline("every"))


@dataclass(frozen=True)
class Encoder:
    """Fitted preprocessing: a few hundred parameters, kept on the driver."""

    categories: dict[str, list[str]]
    numbers: dict[str, tuple[float, float, float]]
    pooled: frozenset[str]

    @classmethod
    def fit(cls, training: DataFrame, limit: int = MAX_CATEGORIES) -> Encoder:
        categories: dict[str, list[str]] = {}
        pooled = set()
        # At most ``limit`` rows per feature, and one per numeric feature.
        for row in category_table(training, limit).orderBy("feature", "place").collect():
            categories.setdefault(row["feature"], []).append(row["category"])
            if row["size"] > limit:
                pooled.add(row["feature"])
        numbers = {
            row["feature"]: (row["median"], row["mean"], row["deviation"])
            for row in numeric_table(training).collect()
        }
        return cls(categories, numbers, frozenset(pooled))

    def transform(self, frame: DataFrame, output: str = "features") -> DataFrame:
        """Standardised numbers and one-hot categories as one vector.

        A value never seen goes to the shared column, or to no column when
        the feature has none.
        """
        ready = prepare(frame)
        scaled = {}
        for name in S.NUMERIC_FEATURES:
            median, mean, deviation = self.numbers[name]
            value = F.coalesce(F.col(f"x_{name}"), F.lit(median)) - F.lit(mean)
            scaled[f"x_{name}"] = value / F.lit(deviation if deviation > 0 else 1.0)
        ready = ready.withColumns(scaled)
        names = list(S.CATEGORICAL_FEATURES)
        for n in names:
            ready = StringIndexerModel.from_labels(
                self.categories[n], f"x_{n}", f"i_{n}", handleInvalid="keep"
            ).transform(ready)
        for shared in (True, False):
            chosen = [n for n in names if (n in self.pooled) == shared]
            if chosen:
                encoder = OneHotEncoder(
                    inputCols=[f"i_{n}" for n in chosen],
                    outputCols=[f"o_{n}" for n in chosen],
                    dropLast=not shared,
                )
                ready = encoder.fit(ready).transform(ready)
        columns = [f"x_{n}" for n in S.NUMERIC_FEATURES] + [f"o_{n}" for n in names]
        assembled = VectorAssembler(inputCols=columns, outputCol=output).transform(ready)
        return assembled.drop(*[c for c in assembled.columns if c[:2] in ("x_", "i_", "o_")])


    def terms(self, weights: Sequence[float]) -> dict[str, Callable[[Column], Column]]:
        """For each feature, what a value adds to a linear model with these weights."""

        def number(weight: float, median: float, mean: float, deviation: float):
            scale = weight / (deviation if deviation > 0 else 1.0)
            return lambda c: (F.coalesce(c.cast("double"), F.lit(median)) - F.lit(mean)) * F.lit(scale)

        def category(added: dict[str, float], other: float):
            known = F.create_map(*[F.lit(x) for pair in added.items() for x in pair])
            return lambda c: F.coalesce(
                F.try_element_at(known, F.coalesce(c.cast("string"), F.lit(S.MISSING))), F.lit(other)
            )

        made, at = {}, 0
        for name in S.NUMERIC_FEATURES:
            made[name] = number(float(weights[at]), *self.numbers[name])
            at += 1
        for name in S.CATEGORICAL_FEATURES:
            values = self.categories[name]
            added = {v: float(weights[at + i]) for i, v in enumerate(values)}
            at += len(values)
            other = float(weights[at]) if name in self.pooled else 0.0
            at += name in self.pooled
            made[name] = category(added, other)
        return made


def with_label(frame: DataFrame) -> DataFrame:
    return frame.withColumn("label", F.col(S.TARGET).cast("double"))


def class_sizes(frame: DataFrame) -> tuple[int, int]:
    row = frame.agg(F.count("label").alias("n"), F.sum("label").alias("positives")).first()
    return int(row["n"]), int(row["positives"] or 0)


def fit_logistic(
    frame: DataFrame,
    inverse_penalty: float = INVERSE_PENALTY,
    balanced: bool = True,
    features: str = "features",
    iterations: int = 1500,
) -> LogisticRegressionModel:
    """L2 logistic regression; weights make both classes count the same.

    The summed loss plus half the squared coefficients over ``inverse_penalty`` has one
    minimum, found in some eight passes over the rows.
    """
    n, positives = class_sizes(frame)
    if not 0 < positives < n:
        raise ContractError("Training rows of both classes are needed.")
    shares = (n / (2.0 * (n - positives)), n / (2.0 * positives)) if balanced else (1.0, 1.0)
    odds = 0.0 if balanced else math.log(positives / (n - positives))
    weights, intercept = fits.newton_logistic(
        fits.pack(frame, features), shares, odds, 1.0 / inverse_penalty, iterations
    )
    fitted = LogisticRegressionModel._create_from_java_class(
        "org.apache.spark.ml.classification.LogisticRegressionModel",
        f"LogisticRegression_{uuid.uuid4().hex[:12]}", Vectors.dense(weights), intercept,
    )
    return fitted.setFeaturesCol(features)


def positive_probability(model, frame: DataFrame, name: str = "raw_probability") -> DataFrame:
    scored = model.transform(frame)
    return scored.withColumn(name, vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction"
    )


def logit(probability: Column) -> Column:
    clipped = F.least(F.greatest(probability, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.log(clipped / (1 - clipped))


@dataclass(frozen=True)
class Calibrator:
    """Platt scaling: a logistic curve over the logit of the raw probability."""

    slope: float
    intercept: float

    @classmethod
    def fit(cls, frame: DataFrame, probability: str = "raw_probability") -> Calibrator:
        inputs = frame.withColumn("logit", logit(F.col(probability)))
        assembled = VectorAssembler(inputCols=["logit"], outputCol="logits").transform(inputs)
        model = fit_logistic(assembled, 1.0, balanced=False, features="logits")
        return cls(float(model.coefficients[0]), float(model.intercept))

    def apply(self, probability: Column) -> Column:
        return 1 / (1 + F.exp(-(logit(probability) * self.slope + self.intercept)))


def periods_of(first, last, spark, unit: str) -> list:
    """Start of every period from ``first`` to ``last``, a short list."""
    bounds = spark.range(1).select(
        *[
            F.date_trunc(unit, F.lit(d).cast("timestamp")).cast("date").alias(n)
            for n, d in (("first", first), ("last", last))
        ]
    )
    step = F.expr(f"interval 1 {unit}")
    days = bounds.select(F.explode(F.sequence("first", "last", step)).alias("period"))
    return [row["period"] for row in days.collect()]


def out_of_fold(eligible: DataFrame, first, last, unit: str = "month") -> DataFrame:
    """Score each period with a model of all earlier ones.

    The loop runs over a few periods; every fit and every score is a Spark
    job. A period is skipped when it, or what lies before it, has one class.
    """
    labelled = with_label(eligible)
    period = F.date_trunc(unit, F.col("opened_at")).cast("date")
    parts = []
    for start in periods_of(first, last, eligible.sparkSession, unit):
        before, during = labelled.where(period < start), labelled.where(period == start)
        sizes = [class_sizes(part) for part in (before, during)]
        if not all(0 < positives < n for n, positives in sizes):
            continue
        encoder = Encoder.fit(before)
        model = fit_logistic(encoder.transform(before))
        scored = positive_probability(model, encoder.transform(during)).select(
            "incident_id", "opened_at", F.lit(start).alias("period"), "label", "raw_probability"
        )
        parts.append(scored)
    if not parts:
        raise ContractError("No period has training and validation rows of both classes.")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return materialise(result)


@dataclass(frozen=True)
class RiskModel:
    """Everything needed to score new incidents."""

    version: str
    encoder: Encoder
    model: LogisticRegressionModel
    calibrator: Calibrator
    reference: DataFrame
    threshold: float
    pressure_p95: float
    typical: dict[str, object]
    validation: DataFrame = field(repr=False)

    def probability(self, frame: DataFrame, name: str = "breach_probability") -> DataFrame:
        raw = positive_probability(self.model, self.encoder.transform(frame)).drop("features")
        calibrated = self.calibrator.apply(F.col("raw_probability"))
        return raw.withColumn(name, calibrated).drop("raw_probability")

    def explained(self, frame: DataFrame) -> DataFrame:
        """``frame`` with ``top_risk_factors``, worked out in the row."""
        terms = self.encoder.terms(self.model.coefficients.toArray().tolist())
        return explain.linear_factors(
            frame, self.typical, terms, self.model.intercept, self.calibrator.apply
        )


@dataclass(frozen=True)
class Protocol:
    """Periods of the training protocol."""

    fold_first: str
    fold_last: str
    train_end: str
    test_start: str
    unit: str = "month"
    version: str = "risk-logistic"


def train(features: DataFrame, protocol: Protocol) -> RiskModel:
    """Out-of-fold calibration, threshold, then the final fit up to the cut."""
    require_no_leakage(S.MODEL_FEATURES)
    split = history.temporal_split(
        features, protocol.train_end, protocol.test_start, protocol.unit
    )
    eligible = history.eligible_rows(split)
    training = eligible.where(F.col("dataset_split") == "pretest_train")
    folds = out_of_fold(eligible, protocol.fold_first, protocol.fold_last, protocol.unit)
    calibrator = Calibrator.fit(folds)
    calibrated = folds.withColumn(
        "breach_probability", calibrator.apply(F.col("raw_probability"))
    )
    table = metrics.threshold_table(calibrated, "breach_probability", "label")
    encoder = Encoder.fit(training)
    return RiskModel(
        version=protocol.version,
        encoder=encoder,
        model=fit_logistic(encoder.transform(with_label(training))),
        calibrator=calibrator,
        reference=calibrated.select("breach_probability"),
        threshold=metrics.select_threshold(table).first()["threshold"],
        pressure_p95=scoring.pressure_reference(training).first()["pressure_reference_p95"],
        typical=explain.typical_values(training),
        validation=calibrated,
    )


def score(
    model: RiskModel, features: DataFrame, scored_at: Column | None = None, check: bool = True
) -> DataFrame:
    """Score, level, factors and advice for each row of ``features``."""
    # Written once: the index reads the probabilities in passes of their own, and each would
    # count the features again.
    probability = materialise(
        model.probability(model.explained(features)).select(
            "incident_id", "priority_code", "assigned_group_incidents_previous_1d",
            "breach_probability", "top_risk_factors",
        )
    )
    placed = scoring.predictive_index(probability, model.reference)
    points = scoring.operational_scores(placed, model.pressure_p95)
    now = F.current_timestamp() if scored_at is None else scored_at
    result = (
        points.withColumns({"scored_at": now, "model_version": F.lit(model.version)})
        .select(*S.RISK_SCORE_SCHEMA.names)
    )
    if check:
        result = materialise(result)
        require_clean(risk_score_contract(result))
    return result


def score_latest(
    model: RiskModel, features: DataFrame, scored_at: Column | None = None
) -> DataFrame:
    """Score the newest cohort; every cohort row must come back once."""
    cohort = history.latest_cohort(features)
    scores = score(model, cohort, scored_at)
    if scores.count() != cohort.count():
        raise ContractError("Scored rows differ from the cohort.")
    return scores


def score_new(model: RiskModel, past: DataFrame, new: DataFrame, scored_at=None) -> DataFrame:
    """Score incidents that are not in the history yet, against that history."""
    both = past.unionByName(new, allowMissingColumns=True)
    features = history.risk_features(both, require_targets=False, asked=new)
    return score(model, features, scored_at)


def evaluate_clusters(
    training: DataFrame,
    validation: DataFrame,
    baseline_average_precision: float,
    counts: Sequence[int] = (2, 3, 4, 5),
    seed: int = SEED,
) -> DataFrame:
    """Whether a cluster label would help the model; one row per cluster count.

    Clusters are fitted and judged on all rows; the label of the best is added to
    the model as one-hot columns.
    """
    judge = ClusteringEvaluator(featuresCol="features", distanceMeasure="squaredEuclidean")
    results, models = [], {}
    for count in counts:
        fitted = KMeans(k=count, seed=seed, featuresCol="features").fit(training)
        labelled = fitted.transform(training)
        rates = labelled.groupBy("prediction").agg(F.avg("label").alias("rate")).collect()
        silhouette = judge.evaluate(labelled) if len(rates) > 1 else -1.0
        shown = {str(row["prediction"]): row["rate"] for row in rates}
        results.append((count, float(silhouette), shown))
        models[count] = fitted
    best = max(results, key=lambda item: item[1])
    final = models[best[0]]

    def augmented(frame: DataFrame) -> DataFrame:
        labelled = final.transform(frame).withColumnsRenamed({"prediction": "cluster"})
        flags = [(F.col("cluster") == i).cast("double").alias(f"cluster_{i}") for i in range(best[0])]
        return VectorAssembler(
            inputCols=["features", *[f"cluster_{i}" for i in range(best[0])]], outputCol="wide"
        ).transform(labelled.select("*", *flags))

    model = fit_logistic(augmented(training), 1.0, features="wide")
    scored = positive_probability(model, augmented(validation))
    precision = metrics.classification_metrics(scored, "raw_probability", "label", 0.5).first()
    gain = precision["pr_auc"] - baseline_average_precision
    useful = best[1] >= 0.10 and gain >= 0.005
    rows = [(*result, result[0] == best[0], gain, useful) for result in results]
    return training.sparkSession.createDataFrame(
        rows,
        "clusters int, silhouette double, breach_rates map<string, double>, selected boolean, "
        "average_precision_gain double, use_as_feature boolean",
    )


CHALLENGER_LAYERS = ((64, 32), (128, 64, 32))


def train_challenger(
    training: DataFrame, validation: DataFrame, layers=CHALLENGER_LAYERS, iterations: int = 50
):
    """Neural-net challenger with the best validation average precision.

    It is reported beside the champion and never used to score.
    """
    rows = fits.pack(training)
    width = fits.width_of(rows)
    shapes = [[width, *hidden, 2] for hidden in layers]
    one = training.select("label", "features").limit(1)

    def net(shape: list[int], **start) -> MultilayerPerceptronClassificationModel:
        """The model of MLlib with the weights it starts from."""
        return MultilayerPerceptronClassifier(layers=shape, seed=SEED, maxIter=0, **start).fit(one)

    starts = [net(shape).weights.toArray() for shape in shapes]
    found = fits.fit_nets(rows, shapes, starts, iterations)
    best = None
    for hidden, shape, weights in zip(layers, shapes, found, strict=True):
        fitted = net(shape, initialWeights=Vectors.dense(weights))
        # Written once: metrics and calibration read the scores.
        scored = materialise(positive_probability(fitted, validation).drop("features"))
        row = metrics.classification_metrics(scored, "raw_probability", "label", 0.5).first()
        if best is None or row["pr_auc"] > best[0]:
            best = (row["pr_auc"], hidden, fitted, scored)
    return best


def split_in_time(training: DataFrame, share: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Earlier and later training rows: the instant that closes ``share`` of them divides.

    Rows of one instant stay on one side.
    """
    instant = F.unix_micros("opened_at")
    levels = {"day": F.floor(instant / 86_400_000_000), "v": instant}
    # Exact, and no window holds more than the instants of a day.
    cut = quantile_columns(training.withColumn("v", instant), "v", {"cut": share}, levels).first()
    edge = F.lit(cut["cut"] if cut else None)
    return training.where(instant <= edge), training.where(instant > edge)


def _protocol_rows(features: DataFrame, protocol: Protocol) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fitting and validation rows from within the training period, and the test rows."""
    split = history.temporal_split(
        features, protocol.train_end, protocol.test_start, protocol.unit
    )
    training = with_label(split.where(F.col("dataset_split") == "pretest_train"))
    fit, validation = split_in_time(training)
    return fit, validation, with_label(split.where(F.col("dataset_split") == "final_test"))


def cluster_protocol(features: DataFrame, model: RiskModel, protocol: Protocol) -> DataFrame:
    """Cluster counts compared inside the training period; no test row is seen.

    The gain is measured against the out-of-fold average precision of the champion.
    """
    fit, validation, _ = _protocol_rows(features, protocol)
    encoder = Encoder.fit(fit)
    base = metrics.classification_metrics(model.validation, "breach_probability", "label", 0.5)
    ready = [materialise(encoder.transform(part)) for part in (fit, validation)]
    return evaluate_clusters(*ready, base.first()["pr_auc"])


def challenger_protocol(features: DataFrame, model: RiskModel, protocol: Protocol) -> DataFrame:
    """Metrics of the challenger on the test rows, looked at once.

    It is fitted on the earlier training rows; choice, calibration and threshold come
    from the later ones.
    """
    fit, validation, test = _protocol_rows(features, protocol)
    encoder = Encoder.fit(fit)
    fit, validation, test = (materialise(encoder.transform(x)) for x in (fit, validation, test))
    _, hidden, net, scored = train_challenger(fit, validation)
    calibrator = Calibrator.fit(scored)

    def calibrated(frame: DataFrame) -> DataFrame:
        return materialise(frame.withColumn("p", calibrator.apply(F.col("raw_probability"))))

    table = metrics.threshold_table(calibrated(scored), "p", "label")
    threshold = metrics.select_threshold(table).first()["threshold"]
    tested = calibrated(positive_probability(net, test))
    return metrics.classification_metrics(tested, "p", "label", threshold).withColumn(
        "hidden_layers", F.lit(str(hidden))
    )


def save(model: RiskModel, root: str) -> None:
    """Store a model as MLlib and parameter tables under ``root``."""
    spark = model.reference.sparkSession
    PipelineModel([model.model]).write().overwrite().save(f"{root}/classifier")
    model.reference.write.mode("overwrite").parquet(f"{root}/reference")
    rows = [
        (n, i, c, n in model.encoder.pooled)
        for n, values in model.encoder.categories.items()
        for i, c in enumerate(values)
    ]
    spark.createDataFrame(
        rows, "feature string, place int, category string, pooled boolean"
    ).write.mode("overwrite").parquet(f"{root}/categories")
    spark.createDataFrame(
        [(n, *values) for n, values in model.encoder.numbers.items()],
        "feature string, median double, mean double, deviation double",
    ).write.mode("overwrite").parquet(f"{root}/numbers")
    spark.createDataFrame(
        [(n, None if v is None else str(v)) for n, v in model.typical.items()],
        "feature string, value string",
    ).write.mode("overwrite").parquet(f"{root}/typical")
    c = model.calibrator
    spark.createDataFrame(
        [(model.version, c.slope, c.intercept, model.threshold, model.pressure_p95)],
        "version string, slope double, intercept double, threshold double, pressure_p95 double",
    ).write.mode("overwrite").parquet(f"{root}/parameters")


def load(spark, root: str) -> RiskModel:
    categories: dict[str, list[str]] = {}
    pooled = set()
    for row in spark.read.parquet(f"{root}/categories").orderBy("feature", "place").collect():
        categories.setdefault(row["feature"], []).append(row["category"])
        if row["pooled"]:
            pooled.add(row["feature"])
    numbers = {
        row["feature"]: (row["median"], row["mean"], row["deviation"])
        for row in spark.read.parquet(f"{root}/numbers").collect()
    }
    typical = {
        row["feature"]: explain.parse_typical(row["feature"], row["value"])
        for row in spark.read.parquet(f"{root}/typical").collect()
    }
    one = spark.read.parquet(f"{root}/parameters").first()
    reference = spark.read.parquet(f"{root}/reference")
    return RiskModel(
        version=one["version"],
        encoder=Encoder(categories, numbers, frozenset(pooled)),
        model=PipelineModel.load(f"{root}/classifier").stages[0],
        calibrator=Calibrator(one["slope"], one["intercept"]),
        reference=reference,
        threshold=one["threshold"],
        pressure_p95=one["pressure_p95"],
        typical=typical,
        validation=reference,
    )
