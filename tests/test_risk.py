"""Risk features, score formula, contracts, metrics and explanations."""

import numpy as np
import pytest
from support import at, rows
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import schema as S
from faultline.functions.ordering import (
    count_points,
    quantile_columns,
    running_before,
    score_levels,
    sequential_keys,
)
from faultline.operators import explain, fits, history, metrics, model, quality, scoring, serving
from faultline.session import materialise

SCHEMA = (
    "incident_id string, opened_at timestamp, closed_at timestamp, priority_code long, "
    "product string, category string, subcategory string, assigned_group string, "
    "configuration_item string, opened_by string, entered_kpi_source boolean, "
    "kpi_breached_source boolean"
)


def incident(number, opened, closed, breached, group="team-a", eligible=True):
    return (f"INC{number:07d}", opened, closed, 2, "p1", "c1", "s1", group, "ci-1", "Manual",
            eligible, breached)


@pytest.fixture(scope="module")
def three(spark):
    return spark.createDataFrame(
        [
            incident(1, at("2025-01-01T00:00"), at("2025-01-01T02:00"), False),
            incident(2, at("2025-01-02T00:00"), at("2025-01-02T03:00"), True),
            incident(3, at("2025-01-02T00:00"), at("2025-01-02T04:00"), False),
        ],
        SCHEMA,
    )


def test_simultaneous_incidents_do_not_see_each_other(three):
    got = rows(history.risk_features(three), "incident_id")
    names = history.risk_features(three).columns
    for name, expected in (
        ("assigned_group_incidents_previous_1d", [0, 1, 1]),
        ("assigned_group_known_outcomes_previous_30d", [0, 1, 1]),
        ("assigned_group_breaches_previous_30d", [0, 0, 0]),
        ("assigned_group_breach_rate_previous_30d", [None, 0.0, 0.0]),
    ):
        assert [row[names.index(name)] for row in got] == expected


def test_duplicate_ids_are_refused(three):
    with pytest.raises(quality.ContractError, match="duplicate_incident_id"):
        history.risk_features(three.unionByName(three.limit(1)))


def brute_force(data):
    """Counts by definition, one pair of incidents at a time."""
    second = 1_000_000
    day = 86_400 * second
    out = {}
    for ident, opened, _, group, _, _ in data:
        mine = [d for d in data if d[3] == group]
        out[ident] = tuple(
            sum(opened - days * day <= d[1] < opened for d in mine) for days in (1, 7, 30)
        ) + (
            sum(d[4] and opened - 30 * day <= d[2] < opened for d in mine),
            sum(d[4] and d[5] and opened - 30 * day <= d[2] < opened for d in mine),
        )
    return out


def test_history_equals_brute_force_with_a_hot_and_a_null_key(spark):
    rng = np.random.default_rng(7)
    start = 1_735_689_600_000_000
    data = []
    for i in range(400):
        # Whole hours, so that many instants coincide; the null key is the largest group.
        opened = start + int(rng.integers(0, 60 * 24)) * 3_600_000_000
        closed = opened + int(rng.integers(0, 72)) * 3_600_000_000
        group = None if i % 2 else f"g{i % 5}"
        data.append((f"INC{i:07d}", opened, closed, group, bool(rng.random() < 0.7),
                     bool(rng.random() < 0.4)))
    frame = spark.createDataFrame(
        data, "incident_id string, o long, c long, assigned_group string, e boolean, b boolean"
    ).select(
        "incident_id",
        F.timestamp_micros("o").alias("opened_at"),
        F.timestamp_micros("c").alias("closed_at"),
        "assigned_group",
        F.lit("p").alias("product"),
        F.lit(None).cast("string").alias("category"),
        F.lit(2).cast("long").alias("priority_code"),
        F.col("e").alias(S.ELIGIBLE),
        F.when(F.col("e"), F.col("b")).alias(S.TARGET),
    )
    expected = brute_force(data)
    got = history.history_features(frame).collect()
    assert len(got) == 400
    for row in got:
        assert (
            row["assigned_group_incidents_previous_1d"],
            row["assigned_group_incidents_previous_7d"],
            row["assigned_group_incidents_previous_30d"],
            row["assigned_group_known_outcomes_previous_30d"],
            row["assigned_group_breaches_previous_30d"],
        ) == expected[row["incident_id"]]


def test_history_plan_is_linear_and_shares_its_scan(three, spark):
    plan = history.history_features(three)._jdf.queryExecution().optimizedPlan().toString()
    assert "rangeframe" not in plan.lower()
    physical = history.history_features(three)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in physical


def test_history_joins_no_row_with_the_running_totals(three):
    plan = history.history_features(three)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    # Only the totals of whole parts of a day are joined, with those of the days.
    assert joins and all("cell_day" in line for line in joins)


def test_look_backs_are_neither_unfolded_nor_sent_through_the_driver(three):
    found = history.history_features(three)._jdf.queryExecution()
    plan = found.optimizedPlan().toString()
    # One row per incident and key column is dealt; only those columns are unfolded.
    above = plan[: plan.index("MapInArrow")]
    assert "Generate" not in above and "Window" not in above
    # Totals of the parts of a day, of any number of keys, are merged.
    assert "Broadcast" not in found.executedPlan().toString()


@pytest.mark.parametrize("size", [3, 50])
def test_look_backs_over_many_batches(spark, size):
    """Instants that coincide, also on other days, are cut by the batches anywhere."""
    rng = np.random.default_rng(size)
    day, names = 86_400_000_000, ["a", "b", None]
    data = [
        (f"INC{i:07d}", int(rng.integers(0, 40)) * day + int(rng.integers(0, 4)) * 1_000,
         names[int(rng.integers(0, 3))])
        for i in range(300)
    ]
    frame = spark.createDataFrame(data, "incident_id string, o long, assigned_group string").select(
        "incident_id", F.timestamp_micros("o").alias("opened_at"), "assigned_group",
        F.timestamp_micros(F.col("o") + day).alias("closed_at"), F.lit("p").alias("product"),
        F.lit(None).cast("string").alias("category"), F.lit(2).cast("long").alias("priority_code"),
        F.lit(True).alias(S.ELIGIBLE), (F.col("o") % 2000 == 0).alias(S.TARGET),
    )
    expected = brute_force([(i, o, o + day, g, True, o % 2000 == 0) for i, o, g in data])
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(setting, str(size))
    try:
        got = history.history_features(frame).collect()
    finally:
        spark.conf.unset(setting)
    kinds = [f"assigned_group_incidents_previous_{d}d" for d in (1, 7, 30)] + [
        "assigned_group_known_outcomes_previous_30d", "assigned_group_breaches_previous_30d"
    ]
    assert {r["incident_id"]: tuple(r[n] for n in kinds) for r in got} == expected


def test_one_row_per_incident_is_found(three, monkeypatch):
    """Not one for each kind of key: rows found are shuffled once more, by incident."""
    found = []
    monkeypatch.setattr(history, "_moved", lambda frame: found.append(frame) or frame)
    history.history_features(three)
    assert found[0].count() == 3


@pytest.mark.parametrize("size", [4, 10_000])
def test_all_kinds_are_counted_side_by_side(spark, size):
    """Keys of different kinds share texts, parts of the day and batches; days are also negative."""
    rng = np.random.default_rng(11)
    day, names = 86_400_000_000, ["a", "b", "c", None]
    data = [
        (f"INC{i:07d}", int(rng.integers(-9, 9)) * day + int(rng.integers(0, 3)) * 599_999_999,
         *[names[int(rng.integers(0, 4))] for _ in range(3)], int(rng.integers(1, 3)))
        for i in range(200)
    ]
    frame = spark.createDataFrame(
        data, "incident_id string, o long, assigned_group string, product string, category string, priority_code long"
    ).select(
        "incident_id", F.timestamp_micros("o").alias("opened_at"), "assigned_group", "product", "category",
        "priority_code", F.lit(None).cast("timestamp").alias("closed_at"),
        F.lit(True).alias(S.ELIGIBLE), F.lit(True).alias(S.TARGET),
    )
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(setting, str(size))
    try:
        got = {r["incident_id"]: r for r in history.history_features(frame).collect()}
    finally:
        spark.conf.unset(setting)
    spans = [("assigned_group", 2, 1), ("assigned_group", 2, 30), ("product", 3, 7), ("category", 4, 7), ("priority", 5, 7)]
    for own in data:
        for name, at, days in spans:
            counted = sum(d[at] == own[at] and own[1] - days * day <= d[1] < own[1] for d in data)
            assert got[own[0]][f"{name}_incidents_previous_{days}d"] == counted


def test_history_of_asked_ids_counts_all_rows(three):
    some = three.where("incident_id <> 'INC0000002'")
    got = rows(history.history_features(three, some), "incident_id")
    assert got == [r for r in rows(history.history_features(three), "incident_id") if r[0] != "INC0000002"]
    assert len(got) == 2


def test_tables_of_incidents_are_not_broadcast(three):
    found = history.with_history(three, history.history_features(three))
    placed = scoring.predictive_index(
        found.withColumn("p", F.rand(1)), found.select(F.rand(2).alias("p")), "p"
    )
    for frame, key in ((found, "incident_id"), (placed, "normalizenanandzero")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert any("SortMergeJoin" in line and key in line for line in plan.splitlines())
        assert not any("BroadcastHashJoin" in line and key in line for line in plan.splitlines())


def test_running_totals_by_level(spark):
    frame = spark.range(1000).select((F.col("id") % 97 / 97.0).alias("p"))
    counted = count_points(frame, score_levels(F.col("p")), {"n": F.lit(1)})
    got = rows(running_before(counted, ["score_coarse", "score_fine", "score"], ["n"]), "score")
    seen = 0
    for row in got:
        assert row[4] == seen
        seen += row[3]
    assert seen == 1000


def test_exact_quantiles_equal_numpy(spark):
    values = np.random.default_rng(1).random(501)
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    row = quantile_columns(frame, "v", {"a": 0.05, "b": 0.5, "c": 0.995}, score_levels(F.col("v"))).first()
    assert np.allclose([row["a"], row["b"], row["c"]], np.quantile(values, [0.05, 0.5, 0.995]))


def test_sequential_keys(spark):
    frame = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    got = rows(sequential_keys(frame, [F.asc("v")], "k"), "v")
    assert [r[0] + 1 for r in got] == [r[1] for r in got]


def test_score_formula(spark):
    frame = spark.createDataFrame(
        [(0.0, 0.0, 0.0), (0.74, 0.8, 0.6), (1.0, 1.0, 1.0)], "i double, m double, p double"
    )
    score = scoring.risk_score(F.col("i"), F.col("m"), F.col("p"))
    assert rows(frame.select(score.alias("s"), scoring.risk_level(score))) == [
        (0, "baixo"), (74, "alto"), (100, "crítico"),
    ]


def test_predictive_index_counts_the_reference(spark):
    reference = spark.createDataFrame([(v,) for v in (0.1, 0.2, 0.2, 0.4)], "breach_probability double")
    scores = spark.createDataFrame([(0.05,), (0.2,), (0.9,)], "breach_probability double")
    got = rows(scoring.predictive_index(scores, reference), "breach_probability")
    assert [r[1] for r in got] == [0.0, 0.75, 1.0]


SCORE = dict(
    incident_id="INC1234567", scored_at=at("2026-08-09T12:00:00"), model_version="v2",
    breach_probability=0.025, predictive_risk_index=0.74, priority_impact=0.80,
    operational_pressure=0.60, risk_score=74, risk_level="alto", top_risk_factors="x",
    recommended_action="y",
)


def score_frame(spark, *changes):
    data = [tuple({**SCORE, **change}[n] for n in S.RISK_SCORE_SCHEMA.names) for change in changes]
    return spark.createDataFrame(data, S.RISK_SCORE_SCHEMA)


def test_score_contract_accepts(spark):
    quality.require_clean(quality.risk_score_contract(score_frame(spark, {})))


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({"risk_score": 120}, "risk_score_range"),
        ({"breach_probability": 1.5}, "breach_probability_range"),
        ({"predictive_risk_index": 1.2}, "predictive_risk_index_range"),
        ({"risk_score": 73}, "risk_score_formula"),
        ({"risk_level": "crítico"}, "risk_level_band"),
        ({"top_risk_factors": " "}, "empty_top_risk_factors"),
        ({"scored_at": None}, "invalid_scored_at"),
    ],
)
def test_score_contract_refuses(spark, change, rule):
    with pytest.raises(quality.ContractError, match=rule):
        quality.require_clean(quality.risk_score_contract(score_frame(spark, change)))


def test_score_contract_refuses_repeated_keys(spark):
    with pytest.raises(quality.ContractError, match="duplicate_keys"):
        quality.require_clean(quality.risk_score_contract(score_frame(spark, {}, {})))


def labelled(spark, y, p):
    data = [(f"i{n:03d}", at("2025-01-01"), a, b) for n, (a, b) in enumerate(zip(y, p, strict=True))]
    return spark.createDataFrame(data, "incident_id string, opened_at timestamp, y int, p double")


def test_top_k(spark):
    frame = labelled(spark, [1, 0, 1, 0, 0], [0.9, 0.8, 0.7, 0.2, 0.1])
    row = metrics.topk_metrics(frame, "p", "y", fractions=[0.40]).first()
    assert (row["rows_reviewed"], row["positives_found"]) == (2, 1)
    assert (row["precision_at_k"], row["recall_at_k"]) == (0.5, 0.5)
    assert row["lift_vs_base_rate"] == pytest.approx(1.25)


def test_lift_by_decile(spark):
    p = [0.99, 0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30, 0.20, 0.10]
    got = metrics.lift_by_bin(labelled(spark, [1, 0, 0, 0, 0, 1, 0, 0, 0, 0], p), "p", "y").orderBy("decile").collect()
    assert len(got) == 10
    first = got[0]
    assert (first["positives"], first["precision"], first["lift_vs_base_rate"]) == (1, 1.0, 5.0)
    assert first["cumulative_recall"] == 0.5 and got[-1]["cumulative_recall"] == 1.0


def test_ranking_metrics_equal_numpy_with_heavy_ties(spark):
    rng = np.random.default_rng(3)
    n = 300
    y = (rng.random(n) < 0.2).astype(int)
    p = np.where(rng.random(n) < 0.4, 0.5, np.round(rng.random(n), 2))
    frame = labelled(spark, y.tolist(), p.tolist())
    order = np.lexsort((np.arange(n), -p))
    got = metrics.topk_metrics(frame, "p", "y").orderBy("requested_fraction").collect()
    for row in got:
        k = row["rows_reviewed"]
        assert row["positives_found"] == y[order][:k].sum()
    row = metrics.classification_metrics(frame, "p", "y", 0.5).first()
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    steps = [(y[p >= t].sum() / (p >= t).sum()) * (y[p == t].sum() / y.sum()) for t in np.unique(p)]
    assert row["roc_auc"] == pytest.approx(auc)
    assert row["pr_auc"] == pytest.approx(sum(steps))
    assert row["brier_score"] == pytest.approx(((p - y) ** 2).mean())


def encoded(spark, x, y):
    data = [(float(b), Vectors.dense(a)) for a, b in zip(x, y, strict=True)]
    return spark.createDataFrame(data, ["label", "features"])


def test_logistic_fit_minimises_the_summed_loss(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=200) > 0.8).astype(float)
    fitted = model.fit_logistic(encoded(spark, x, y), 0.5)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta = np.zeros(4)
    z = np.column_stack([np.ones(len(x)), x])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-z @ beta))
        ridge = np.array([0, 1, 1, 1]) / 0.5
        gradient = z.T @ (weight * (mu - y)) + ridge * beta
        beta -= np.linalg.solve((z.T * (weight * mu * (1 - mu))) @ z + np.diag(ridge), gradient)
    assert np.allclose([fitted.intercept, *fitted.coefficients], beta, atol=1e-5)


def jobs_of(spark, name, run):
    """What ``run`` returns, and the number of jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("balanced", [True, False])
def test_logistic_fit_takes_few_passes(spark, balanced):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 6)) * np.array([1, 1, 1, 30, 0.03, 0])
    x[:, 2] = x[:, 1] + 0.01 * rng.normal(size=300)
    y = (x[:, 1] + 10 * x[:, 4] + rng.normal(size=300) > 1.5).astype(float)
    frame = encoded(spark, x, y)
    fitted, jobs = jobs_of(spark, f"logistic-{balanced}", lambda: model.fit_logistic(frame, 100.0, balanced))
    assert jobs <= 50
    beta = np.array([fitted.intercept, *fitted.coefficients])
    weight = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum()))) if balanced else np.ones(300)
    z = np.column_stack([np.ones(300), x])
    slope = z.T @ (weight * (1 / (1 + np.exp(-z @ beta)) - y)) + np.array([0, *[1] * 6]) / 100 * beta
    assert np.abs(slope).max() < 1e-6


def test_rows_are_packed_with_all_that_vectors_hold(spark):
    vectors = [Vectors.sparse(4, [1, 3], [2.0, -1.0]), Vectors.dense([1, 0, 0, 5]), Vectors.sparse(4, [], [])]
    frame = spark.createDataFrame([(float(i == 1), v) for i, v in enumerate(vectors)], ["label", "features"])
    packed = fits.pack(frame)
    assert fits.width_of(packed) == 4

    def work(label, share, dense):
        return np.concatenate([dense.sum(axis=0), label @ dense, [len(label), share.sum()]])

    found = fits.totals(packed, 4, work)
    parts = frame.rdd.getNumPartitions()
    assert found[:9].tolist() == [1, 2, 0, 4, 1, 0, 0, 5, 3]
    # The rows of a task, fewer than a stack, count as one.
    assert found[9] == pytest.approx(min(parts, 3))
    with pytest.raises(Exception, match="must not be null"):
        fits.pack(frame.withColumn("label", F.when(F.col("label") == 1, 1.0)))


def test_nets_are_those_of_mllib_and_share_their_passes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.where(rng.random((700, 5)) < 0.4, rng.normal(size=(700, 5)), 0)
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0.1).astype(float)
    # Parts that are not whole stacks, and both forms of vectors.
    data = [(float(b), Vectors.dense(a) if i % 2 else Vectors.sparse(5, dict(enumerate(a))))
            for i, (a, b) in enumerate(zip(x, y, strict=True))]
    frame = materialise(spark.createDataFrame(data, ["label", "features"]).repartition(3))
    shapes = [[5, 4, 2], [5, 6, 3, 2]]
    wanted, starts = [
        [MultilayerPerceptronClassifier(layers=shape, seed=1, maxIter=n).fit(frame).weights.toArray()
         for shape in shapes] for n in (8, 0)
    ]
    passes = []
    count = fits.totals
    monkeypatch.setattr(fits, "totals", lambda *given: passes.append(1) or count(*given))
    packed, alone = fits.pack(frame), []
    for shape, start in zip(shapes, starts, strict=True):
        fits.fit_nets(packed, [shape], [start], 8)
        alone.append(len(passes) - sum(alone))
    got = fits.fit_nets(packed, shapes, starts, 8)
    for a, b in zip(got, wanted, strict=True):
        assert np.allclose(a, b, atol=1e-7)
    assert len(passes) - sum(alone) == max(alone) >= 9


def test_challenger_is_mllibs_net_with_its_scores_stored(spark):
    frame = model.with_label(feature_rows(spark, 120))
    ready = materialise(model.Encoder.fit(frame).transform(frame))
    _, hidden, net, scored = model.train_challenger(ready, ready, ((3,), (4, 2)), 3)
    assert hidden in ((3,), (4, 2)) and net.getLayers()[1:-1] == list(hidden)
    assert scored.count() == 120 and "raw_probability" in scored.columns
    wanted = MultilayerPerceptronClassifier(layers=net.getLayers(), seed=model.SEED, maxIter=3).fit(ready)
    assert np.allclose(net.weights.toArray(), wanted.weights.toArray(), atol=1e-7)
    # Scores are stored: what reads them does not run the net again.
    assert scored._jdf.queryExecution().optimizedPlan().toString().startswith("Relation")


def feature_rows(spark, count=60):
    rng = np.random.default_rng(11)
    data = []
    for i in range(count):
        load = int(rng.integers(0, 40))
        breached = bool(load > 25 or rng.random() < 0.1)
        data.append((f"INC{i:07d}", at(f"2025-01-{1 + i % 28:02d}T{i % 24:02d}:00"), True, breached,
                     2 + i % 2, f"p{i % 4}", f"c{i % 3}", "s", f"g{i % 5}", f"ci{i % 7}", "Manual",
                     i % 24, i % 7, 1, int(i % 7 >= 5), load, load * 2, load * 3, 5, 1,
                     None if i % 6 == 0 else 0.2, load, load, load))
    kinds = {n: T.StringType() for n in S.CATEGORICAL_FEATURES} | {"priority_code": T.LongType()}
    kinds |= {n: T.LongType() for n in S.NUMERIC_FEATURES}
    kinds["assigned_group_breach_rate_previous_30d"] = T.DoubleType()
    fields = [T.StructField("incident_id", T.StringType()), T.StructField("opened_at", T.TimestampType()),
              T.StructField(S.ELIGIBLE, T.BooleanType()), T.StructField(S.TARGET, T.BooleanType())]
    fields += [T.StructField(n, kinds[n]) for n in S.MODEL_FEATURES]
    return spark.createDataFrame(data, T.StructType(fields))


def test_encoder_pools_rare_categories_and_accepts_unknown_ones(spark):
    frame = feature_rows(spark)
    encoder = model.Encoder.fit(frame, limit=4)
    assert "configuration_item" in encoder.pooled and len(encoder.categories["configuration_item"]) == 3
    unknown = frame.limit(1).withColumns(
        {"configuration_item": F.lit("new"), "product": F.lit("new"), "category": F.lit(None).cast("string")}
    )
    vector = encoder.transform(unknown).first()["features"].toArray()
    sizes = [len(encoder.categories[n]) + (n in encoder.pooled) for n in S.CATEGORICAL_FEATURES]
    assert len(vector) == len(S.NUMERIC_FEATURES) + sum(sizes)
    start = len(S.NUMERIC_FEATURES)
    parts = {}
    for name, size in zip(S.CATEGORICAL_FEATURES, sizes, strict=True):
        parts[name] = vector[start:start + size]
        start += size
    assert parts["configuration_item"][-1] == 1 and parts["configuration_item"].sum() == 1
    assert parts["product"].sum() == 0 and parts["category"].sum() == 0


def test_numeric_scaling_uses_the_population(spark):
    frame = feature_rows(spark)
    encoder = model.Encoder.fit(frame)
    values = np.array([r[0] for r in rows(frame.select("assigned_group_incidents_previous_1d"))], float)
    median, mean, deviation = encoder.numbers["assigned_group_incidents_previous_1d"]
    assert np.allclose([median, mean, deviation], [np.median(values), values.mean(), values.std()])
    assert encoder.numbers["assigned_group_breach_rate_previous_30d"][0] == 0.2


def test_numbers_are_unfolded_for_their_medians_only(spark):
    frame = feature_rows(spark, 30)
    got = {r["feature"]: r for r in model.numeric_table(frame).collect()}
    assert set(got) == set(S.NUMERIC_FEATURES)
    for name in S.NUMERIC_FEATURES:
        known = [None if r[0] is None else float(r[0]) for r in rows(frame.select(name))]
        median = float(np.median([v for v in known if v is not None]))
        filled = np.array([median if v is None else v for v in known])
        wanted = [median, filled.mean(), filled.std()]
        assert np.allclose([got[name][c] for c in ("median", "mean", "deviation")], wanted)
    # A constant column has no deviation at all, also if its value has no exact double.
    constant = frame.withColumn("assigned_group_breach_rate_previous_30d", F.lit(0.1))
    named = model.numeric_table(constant).where("feature = 'assigned_group_breach_rate_previous_30d'")
    assert named.first()["deviation"] == 0.0
    # Without a known value numbers are filled by 0; without rows there is nothing.
    unknown = frame.withColumn("is_weekend", F.lit(None).cast("long"))
    row = model.numeric_table(unknown).where("feature = 'is_weekend'").first()
    assert (row["median"], row["mean"], row["deviation"]) == (0.0, 0.0, 0.0)
    assert model.numeric_table(frame.limit(0)).count() == 0
    stored = materialise(frame)
    # The medians are a subquery, whose leaves are not counted.
    assert model.numeric_table(stored)._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_scores_read_their_features_once(spark, monkeypatch):
    frame = feature_rows(spark, 240)
    protocol = model.Protocol("2025-01-13", "2025-01-20", "2025-01-20", "2025-01-27", "week", "t1")
    fitted = model.train(frame, protocol)
    seen = []
    index = scoring.predictive_index
    monkeypatch.setattr(scoring, "predictive_index", lambda *given: seen.append(given[0]) or index(*given))
    scores = model.score(fitted, frame, check=False)
    assert scores.count() == 240
    # The index reads the probabilities in several passes.
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().startswith("Relation")


def test_drops_are_written_once(spark):
    """Thirteen of them in one generated method are too long for the JVM to compile."""
    frame = feature_rows(spark, 6)
    encoder = model.Encoder.fit(frame)
    width = len(encoder.transform(frame).first()["features"])
    terms = encoder.terms(np.linspace(-1, 1, width).tolist())
    typical = explain.typical_values(frame)
    found = explain.linear_factors(frame, typical, terms, -0.5, lambda p: p)
    assert found.columns == [*frame.columns, "top_risk_factors"]
    plan = found.select("top_risk_factors")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EXP(") <= 3

    def probability(rows_):
        total = F.lit(-0.5)
        for name, term in terms.items():
            total = total + term(F.col(name))
        return rows_.withColumn("breach_probability", 1 / (1 + F.exp(-total)))

    wanted = explain.top_factors(frame, typical, probability)
    assert rows(found.select("incident_id", "top_risk_factors"), "incident_id") == rows(wanted, "incident_id")
    assert any(r[0] != S.NO_FACTOR for r in rows(found.select("top_risk_factors")))


def test_factors_name_what_lowers_the_probability(spark):
    frame = feature_rows(spark, 6)
    typical = explain.typical_values(frame) | {"assigned_group_incidents_previous_1d": 0.0,
                                               "product_incidents_previous_7d": 0.0}

    def probability(rows_):
        value = (F.col("assigned_group_incidents_previous_1d") + F.col("product_incidents_previous_7d")) / 100.0
        return rows_.withColumn("breach_probability", value)

    got = {r[0]: r[1] for r in rows(explain.top_factors(frame, typical, probability))}
    source = {r["incident_id"]: r for r in frame.collect()}
    for ident, text in got.items():
        load = source[ident]["assigned_group_incidents_previous_1d"]
        if load == 0:
            assert text == S.NO_FACTOR
        else:
            # Equal drops: the later feature of the list comes first.
            assert text == (
                f"volume do produto nos 7 dias anteriores: {load}; "
                f"carga da equipe nas 24h anteriores: {load}"
            )


def test_model_end_to_end(spark, tmp_path):
    frame = feature_rows(spark, 240)
    protocol = model.Protocol("2025-01-13", "2025-01-20", "2025-01-20", "2025-01-27", "week", "t1")
    fitted = model.train(frame, protocol)
    scores = model.score_latest(fitted, frame, F.lit("2025-02-01").cast("timestamp"))
    assert scores.columns == S.RISK_SCORE_SCHEMA.names and scores.count() > 0
    # The terms of the row give what fourteen copies of it through the model give.
    inside = fitted.explained(frame).select("incident_id", "top_risk_factors")
    unfolded = explain.top_factors(frame, fitted.typical, fitted.probability)
    assert rows(inside, "incident_id") == rows(unfolded, "incident_id")
    model.save(fitted, str(tmp_path / "m"))
    again = model.score_latest(model.load(spark, str(tmp_path / "m")), frame, F.lit("2025-02-01").cast("timestamp"))
    assert rows(scores, "incident_id") == rows(again, "incident_id")


def test_validation_lies_after_fitting_and_before_the_test(spark):
    frame = feature_rows(spark, 240)
    protocol = model.Protocol("2025-01-13", "2025-01-20", "2025-01-20", "2025-01-27", "week", "t1")
    fit, validation, test = model._protocol_rows(frame, protocol)
    edges = [part.agg(F.min("opened_at"), F.max("opened_at")).first() for part in (fit, validation, test)]
    assert edges[0][1] < edges[1][0] and edges[1][1] < edges[2][0]
    assert abs(fit.count() - 3 * validation.count()) <= 4


def test_features_of_the_cohort_need_thirty_days(spark):
    from faultline.operators.silver import derive

    raw = spark.createDataFrame(
        [
            (f"INC{i:07}", f"{i % 4 + 1} - x", f"p{i % 3}", f"c{i % 2}", "s", f"g{i % 3}", f"i{i % 5}",
             at(f"2025-0{i % 4 + 1}-{i % 27 + 1:02}T{i % 24:02}:00:00"),
             at(f"2025-0{i % 4 + 1}-{i % 27 + 1:02}T{i % 24:02}:30:00") if i % 5 else at("2025-04-20T00:00:00"),
             1800, "Manual", None, "Encerrado", "SIM", "SIM" if i % 3 else "NAO")
            for i in range(800)
        ],
        "incident_id string, priority_raw string, product string, category string, subcategory string, "
        "assigned_group string, configuration_item string, opened_at timestamp, closed_at timestamp, "
        "duration_seconds long, opened_by string, parent_incident_id string, status string, "
        "entered_kpi_raw string, kpi_breached_raw string",
    ).withColumn("resolved_at", F.lit(None).cast("timestamp"))
    silver = derive(raw)
    bounded = history.latest_features(silver)
    full = history.latest_cohort(history.risk_features(silver, check=False))
    assert bounded.count() > 0
    assert rows(bounded, "incident_id") == rows(full, "incident_id")


def test_serving_views(spark):
    scores = score_frame(spark, {}, {"risk_score": 20, "risk_level": "LOW", "scored_at": at("2026-08-10T00:00:00")})
    newest = serving.latest_scores(scores).collect()
    assert len(newest) == 1 and newest[0]["risk_level"] == "baixo"
    counts = rows(serving.risk_distribution(score_frame(spark, {})), "place")
    assert [r[2] for r in counts] == [0, 0, 1, 0]
