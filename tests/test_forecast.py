"""Series, baseline, candidates, bands and the forecast contract."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from support import at, rows
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.functions.calendars import black_friday, easter_sunday, is_holiday
from faultline.operators import bands, bundle, forecast, linear, quality, refit, series
from faultline.session import materialise

RNG = np.random.default_rng(17)
START = date(2025, 1, 1)
DAYS = 150
COUNTS = RNG.poisson(20 + 6 * np.sin(np.arange(DAYS) * 2 * np.pi / 7))


@pytest.fixture(scope="module")
def volume(spark):
    data = [(START + timedelta(days=i), "ALL", int(n), 0, 0, 0, 0) for i, n in enumerate(COUNTS)]
    return spark.createDataFrame(data, S.VOLUME_SCHEMA)


@pytest.fixture(scope="module")
def incidents(spark):
    data = []
    for i, n in enumerate(COUNTS):
        for j in range(int(n)):
            opened = at(f"{START + timedelta(days=i)}T{j % 24:02d}:00")
            parent = "INC0000001" if j % 10 == 9 else (" " if j % 2 else None)
            data.append((f"INC{len(data):07d}", opened, 2 + j % 3, f"CI{j}", parent))
    return spark.createDataFrame(
        data,
        "incident_id string, opened_at timestamp, priority_code long, configuration_item string, "
        "parent_incident_id string",
    )


def test_calendar(spark):
    days = spark.createDataFrame(
        [(date(y, 6, 1),) for y in (2000, 2019, 2024, 2025, 2038)], "d date"
    )
    got = [r[0] for r in rows(days.select(easter_sunday(F.year("d")), "d"), "d")]
    assert got == [date(2000, 4, 23), date(2019, 4, 21), date(2024, 3, 31), date(2025, 4, 20), date(2038, 4, 25)]
    # 2024-11-01 is a Friday: the fourth Friday is the 22nd, not the 29th.
    got = [r[0] for r in rows(days.select(black_friday(F.col("d")), "d"), "d")]
    assert got[2:4] == [date(2024, 11, 22), date(2025, 11, 28)]
    marks = spark.createDataFrame(
        [(date(2023, 11, 20),), (date(2024, 11, 20),), (date(2025, 4, 18),), (date(2025, 4, 19),)], "d date"
    )
    assert [r[0] for r in rows(marks.select(is_holiday(F.col("d")), "d"), "d")] == [False, True, True, False]


def test_series_counts_root_events_and_looks_ahead(incidents):
    got = series.series_context(incidents, "2025-01-01").where("scope = 'ALL'")
    values = [r["y"] for r in got.orderBy("day").collect()]
    roots = [sum(1 for j in range(int(n)) if j % 10 != 9) for n in COUNTS]
    assert values[:DAYS] == roots and values[DAYS:] == [None] * series.AHEAD


def pandas_features(y, horizon):
    s = pd.Series(y, dtype=float)
    shifted = s.shift(horizon)
    return pd.DataFrame({
        "seas_lag7": s.shift(7), "seas_lag14": s.shift(14), "last": shifted,
        "roll7_mean": shifted.rolling(7).mean(), "roll7_std": shifted.rolling(7).std(),
        "roll28_mean": shifted.rolling(28).mean(),
    })


def test_features_equal_pandas(incidents):
    frame = series.feature_frame(series.series_context(incidents, "2025-01-01"))
    for name, days in S.HORIZONS.items():
        got = frame.where((F.col("scope") == "ALL") & (F.col("horizon") == name)).orderBy("day").toPandas()
        expected = pandas_features(got["y"], days)
        for column in expected:
            np.testing.assert_allclose(got[column].astype(float), expected[column], equal_nan=True)


def design(y):
    s = pd.Series(y, dtype=float)
    dow = np.array([(START + timedelta(days=i)).weekday() for i in range(len(s))])
    frame = pd.DataFrame({
        "trend": np.arange(len(s), dtype=float), "lag_1": s.shift(1), "lag_7": s.shift(7),
        "rolling_7": s.shift(1).rolling(7).mean(), "rolling_28": s.shift(1).rolling(28).mean(),
        "dow_sin": np.sin(2 * np.pi * dow / 7), "dow_cos": np.cos(2 * np.pi * dow / 7), "y": s,
    }).dropna()
    return np.column_stack([np.ones(len(frame)), frame[S.BASELINE_FEATURES]]), frame["y"].to_numpy()


def test_baseline_equals_least_squares(volume):
    x, y = design(COUNTS)
    expected = np.linalg.lstsq(x, y, rcond=None)[0]
    fitted = forecast.least_squares(series.baseline_features(volume), "priority_scope", S.BASELINE_FEATURES, "incident_count")
    assert np.allclose(fitted.first()["coefficients"], expected, atol=1e-6)

    train, test = slice(None, -60), slice(-60, None)
    beta = np.linalg.lstsq(x[train], y[train], rcond=None)[0]
    error = y[test] - np.clip(x[test] @ beta, 0, None)
    row = forecast.baseline_evaluation(volume).first()
    assert row["mae"] == pytest.approx(np.abs(error).mean())
    assert row["rmse"] == pytest.approx(np.sqrt((error**2).mean()))

    past = [float(n) for n in COUNTS]
    for step in range(1, 8):
        dow = (START + timedelta(days=DAYS - 1 + step)).weekday()
        vector = [1.0, len(past), past[-1], past[-7], np.mean(past[-7:]), np.mean(past[-28:]),
                  np.sin(2 * np.pi * dow / 7), np.cos(2 * np.pi * dow / 7)]
        past.append(max(0.0, float(np.dot(vector, expected))))
    got = {r["horizon"]: r["predicted"] for r in forecast.recursive_forecast(volume, fitted).collect()}
    assert got["D+1"] == pytest.approx(past[DAYS]) and got["D+7"] == pytest.approx(past[-1])


def test_baseline_meets_the_contract(volume):
    out = forecast.baseline_predictions(volume, F.lit("2026-01-01").cast("timestamp"))
    assert out.columns == S.PREDICTION_SCHEMA.names and out.count() == 2
    forecast.require_predictions(out)


def numpy_ridge(x, y, row):
    deviation = x.std(0)
    z = (x - x.mean(0)) / np.where(deviation > 0, deviation, 1)
    beta = np.linalg.solve(z.T @ z + 5 * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return y.mean() + ((row - x.mean(0)) / np.where(deviation > 0, deviation, 1)) @ beta


def numpy_poisson(x, rate, weight, row):
    mean, deviation = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    z = np.column_stack([np.ones(len(x)), (x - mean) / deviation])
    weight, penalty = weight / weight.sum(), np.r_[0, np.full(x.shape[1], 1e-4)]
    beta = np.r_[np.log(weight @ rate), np.zeros(x.shape[1])]
    for _ in range(60):
        mu = np.exp(z @ beta)
        curve = (z * (weight * mu)[:, None]).T @ z + np.diag(penalty + 1e-12)
        beta -= np.linalg.solve(curve, z.T @ (weight * (mu - rate)) + penalty * beta)
    return np.exp(np.r_[1, (row - mean) / deviation] @ beta)


@pytest.fixture(scope="module")
def features(spark, incidents):
    return materialise(series.feature_frame(series.series_context(incidents, "2025-01-01")))


def test_fits_equal_separate_refits(features):
    first = "2025-04-10"
    ridge = refit.ridge_parameters(refit.ridge_moments(features, first))
    poisson = refit.poisson_parameters(features, first)
    got = {
        (r["scope"], r["horizon"], r["day"], r["candidate"]): r["predicted"]
        for r in refit.predict_fits(features, ridge.unionByName(poisson)).collect()
    }
    complete = series.complete_rows(features).toPandas()
    checked = 0
    for (scope, horizon), one in complete.groupby(["scope", "horizon"]):
        one = one.sort_values("day")
        for day in [d for d in one["day"] if d >= date.fromisoformat(first)][::9]:
            past = one[(one["day"] < day) & one["y"].notna()]
            row, y = one[one["day"] == day].iloc[0], past["y"].to_numpy(float)
            if (y == y[0]).all():
                expected = [y[0], y[0]]
            else:
                exposure = past["exp_roll7"].clip(lower=1e-6).to_numpy(float)
                expected = [
                    max(0, numpy_ridge(past[S.LEVEL_FEATURES].to_numpy(float), y, row[S.LEVEL_FEATURES].to_numpy(float))),
                    numpy_poisson(past[S.RATE_FEATURES].to_numpy(float), y / exposure, exposure,
                                  row[S.RATE_FEATURES].to_numpy(float)) * row["exp_roll7"],
                ]
            for kind, value in zip(("ridge", "poisson_off"), expected):
                assert got[scope, horizon, day, kind] == pytest.approx(value, abs=1e-8)
                checked += 1
    assert checked > 100


def test_system_with_vanishing_pivots(spark):
    frame = spark.createDataFrame(
        [([[4.0, 2.0, 0.0], [2.0, 1.0, 0.0], [0.0, 0.0, 0.0]], [2.0, 1.0, 0.0]),
         ([[2.0, 1.0, 0.0], [1.0, 3.0, 1.0], [0.0, 1.0, 4.0]], [1.0, 2.0, 3.0])],
        "a array<array<double>>, b array<double>",
    )
    got = [r[0] for r in frame.select(linear.solve(F.col("a"), F.col("b"))).collect()]
    assert got[0] == [0.5, 0.0, 0.0]
    expected = np.linalg.solve([[2, 1, 0], [1, 3, 1], [0, 1, 4]], [1, 2, 3])
    assert np.allclose(got[1], expected)


def test_walk_forward_reads_only_the_past(features):
    one = features.where("scope = 'P2' AND horizon = 'D+1'")
    cut = F.col("day") <= F.lit(START + timedelta(days=100))

    def learned(frame):
        ridge = refit.ridge_parameters(refit.ridge_moments(frame, "2025-03-15"))
        fits = ridge.unionByName(refit.poisson_parameters(frame, "2025-03-15"))
        return rows(refit.predict_fits(frame, fits).where(cut), "day", "candidate")

    full, short = learned(one), learned(one.where(cut))
    assert [r[:4] for r in full] == [r[:4] for r in short] and len(full) > 20
    assert np.allclose([r[4] for r in full], [r[4] for r in short], atol=1e-9)


def test_forecast_end_to_end(features):
    every, fits = forecast.candidate_forecasts(features, "2025-03-15")
    every = materialise(every)
    selection = forecast.occam_select(every, "2025-04-30")
    assert selection.count() == 12
    chosen = materialise(forecast.chosen_forecasts(every, selection))
    banded = materialise(bands.conformal_bands(chosen))
    generated = F.lit("2026-01-01").cast("timestamp")
    out = forecast.publish_predictions(chosen, banded, features, generated, "v")
    got = out.collect()
    assert len(got) == 12
    assert {r["reference_date"] for r in got} == {
        START + timedelta(days=DAYS), START + timedelta(days=DAYS + 6),
    }
    forecast.require_predictions(out)
    constant = [r for r in got if r["priority_scope"] == "P1"]
    assert all(r["predicted_incident_count"] == 0 for r in constant)
    for kind in ("chosen", "ridge", "poisson_off"):
        picked = selection if kind == "chosen" else (
            every.where(F.col("candidate") == kind).groupBy("scope", "horizon", "candidate").agg(F.lit(0.0).alias("selection_mae"))
        )
        mine = forecast.chosen_forecasts(every, picked)
        mine_banded = materialise(bands.conformal_bands(mine))
        stored = materialise(bundle.build_bundle(picked, fits, mine_banded, "v"))
        assert stored.select(*[c.split(" ")[0] for c in bundle.BUNDLE_SCHEMA.split(", ")]).count() == 12
        bundle.require_bundle(features, stored)
        published = forecast.publish_predictions(mine, mine_banded, features, generated, "v")
        predicted = bundle.predict_volume(features, stored, generated)
        bundle.require_parity(predicted, published)
        if kind == "ridge":
            moved = stored.withColumn("intercept", F.when((F.col("scope") == "P3") & (F.col("horizon") == "D+7"), F.col("intercept") + 0.5).otherwise(F.col("intercept")))
            found = bundle.forecast_differences(bundle.predict_volume(features, moved, generated), published)
            assert found.first().asDict() == {"only_left": 0, "only_right": 0, "differing": 1}
            fewer = predicted.where("priority_scope <> 'P2'")
            assert bundle.forecast_differences(fewer, published).first()["only_right"] == 2
            assert bundle.forecast_differences(published, fewer).first()["only_left"] == 2
            with pytest.raises(quality.ContractError):
                bundle.require_parity(fewer, published)
            with pytest.raises(quality.ContractError, match="without_one_component"):
                bundle.require_bundle(features, stored.where("scope <> 'P2'"))


def test_trees_follow_a_step_and_read_only_the_past(features):
    first = features.agg(F.date_sub(F.max("day"), 9)).first()[0]
    whole = refit.boosted_forecasts(features, first.isoformat(), trees=3)
    cut = F.lit(first).cast("date")
    blind = features.withColumn("y", F.when(F.col("day") <= cut, F.col("y")))
    early = refit.boosted_forecasts(blind, first.isoformat(), trees=3)
    assert rows(early.where(F.col("day") == cut), "scope", "horizon") == rows(
        whole.where(F.col("day") == cut), "scope", "horizon"
    )
    assert {r[0] for r in whole.select("candidate").distinct().collect()} == {"gbt"}
    level = {r["scope"]: r["m"] for r in whole.groupBy("scope").agg(F.avg("predicted").alias("m")).collect()}
    assert level["ALL"] > level["P2"] > level["P1"] - 1e-9


def test_occam_prefers_the_simpler(spark):
    data = [("ALL", "D+1", START, c, 100.0, 100.0 + e) for c, e in
            (("naive7", 10.6), ("media7", 10.4), ("ultimo", 20.0), ("ridge", 10.0))]
    frame = spark.createDataFrame(
        data, "scope string, horizon string, day date, candidate string, y double, predicted double"
    )
    assert forecast.occam_select(frame, "2025-12-31").first()["candidate"] == "media7"


def banded_series(spark):
    n, rng = 130, np.random.default_rng(3)
    y = {"D+1": rng.poisson(30, n).astype(float), "D+7": rng.poisson(3, n).astype(float)}
    predicted = {"D+1": np.full(n, 30.0), "D+7": rng.random(n) * 5}
    data = [
        ("ALL", h, START + timedelta(days=i), "c", float(y[h][i]), float(predicted[h][i])) for h in y for i in range(n)
    ]
    frame = spark.createDataFrame(data, "scope string, horizon string, day date, candidate string, y double, predicted double")
    return frame, y, predicted


def test_bands_adapt_day_by_day(spark):
    frame, ys, predictions = banded_series(spark)
    short = frame.where(F.col("day") < F.lit(START + timedelta(days=20))).withColumn("scope", F.lit("P1"))
    got = bands.conformal_bands(frame.union(short)).toPandas().sort_values("day")
    for horizon, y in ys.items():
        p = predictions[horizon]
        one = got[(got["scope"] == "ALL") & (got["horizon"] == horizon)].reset_index(drop=True)
        spread = np.maximum(1, np.sqrt(p))
        level, residuals = 0.2, (y - p) / spread
        for day in range(28, len(y)):
            low, high = np.quantile(residuals[max(0, day - 60):day], [level / 2, 1 - level / 2])
            low, high = max(0, p[day] + low * spread[day]), p[day] + high * spread[day]
            assert one["lower_bound"][day] == pytest.approx(low)
            assert one["upper_bound"][day] == pytest.approx(high)
            level = np.clip(level + 0.03 * (0.2 - (not low <= y[day] <= high)), 0.01, 0.60)
        assert (one["lower_bound"][:28] == one["lower_bound"][28]).all()
        assert not one["evaluated"][:28].any() and one["evaluated"][28:].all()
    burn = got[got["scope"] == "P1"]
    assert len(burn) == 40 and (burn["lower_bound"] == burn["predicted"]).all()


@pytest.mark.parametrize("cuts", [[10, 40, 41], [64], [100, 129]])
def test_bands_advance_from_their_state(spark, cuts):
    frame, _, _ = banded_series(spark)
    full = bands.conformal_bands(frame)
    at_day = [F.lit(START + timedelta(days=c)) for c in cuts]
    states = materialise(bands.band_states(frame.where(F.col("day") < at_day[0])))
    parts = []
    for after in [*at_day[1:], F.lit(START + timedelta(days=999))]:
        # A batch may repeat days that the state has seen.
        part, states = bands.advance_bands(states, frame.where(F.col("day") < after))
        states = materialise(states)
        parts.append(part)
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    key = ["horizon", "day"]
    mine = every.where("lower_bound IS NOT NULL").select(*key, "lower_bound", "upper_bound")
    whole = full.where(F.col("evaluated") & (F.col("day") >= at_day[0])).select(*key, "lower_bound", "upper_bound")
    assert rows(mine, *key) == rows(whole, *key)
    assert rows(states, "horizon") == rows(bands.band_states(frame).select(*states.columns), "horizon")


ROW = dict(reference_date=date(2026, 1, 1), generated_at=at("2026-08-30T12:00:00"), horizon="D+1",
           priority_scope="P4", predicted_incident_count=367.0, lower_bound=300.25,
           upper_bound=433.75, model_name="ultimo", model_version="v")


def prediction_frame(spark, *changes):
    data = [tuple({**ROW, **c}[n] for n in S.PREDICTION_SCHEMA.names) for c in changes]
    return spark.createDataFrame(data, S.PREDICTION_SCHEMA)


def test_prediction_contract_accepts(spark):
    quality.require_clean(quality.prediction_contract(prediction_frame(spark, {})))


@pytest.mark.parametrize(
    ("changes", "rule"),
    [
        ([{"horizon": "D+30"}], "horizon_domain"),
        ([{"priority_scope": "P6"}], "priority_scope_domain"),
        ([{"predicted_incident_count": -10.0}], "negative_predicted"),
        ([{"lower_bound": 400.0}], "interval_order"),
        ([{"model_name": " "}], "empty_model_name"),
        ([{}, {}], "duplicate_keys"),
    ],
)
def test_prediction_contract_refuses(spark, changes, rule):
    with pytest.raises(quality.ContractError, match=rule):
        quality.require_clean(quality.prediction_contract(prediction_frame(spark, *changes)))


def test_fitted_features_start_with_the_data(spark):
    from workload import forecasts
    from workload.tables import Tables

    tables = Tables(spark, "/root/testdata/sf0.001")
    first = tables.order_silver().agg(F.min("opened_date")).first()[0]
    assert forecasts.stored_features(tables).agg(F.min("day")).first()[0] <= first
