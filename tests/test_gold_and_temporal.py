"""Gold tables and temporal analysis on small fixtures."""

from datetime import date, timedelta

import pytest
from support import at, rows
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.operators import gold, monitoring, quality, temporal

SILVER = [
    ("INC0000001", at("2025-01-01T08:00"), 2, "Grupo A", "Produto A", "Categoria 1", "CI-1",
     "INC-PARENT-1", True, True, "Manual", "Encerrado"),
    ("INC0000002", at("2025-01-01T09:00"), 3, "Grupo A", None, "Categoria 2", "CI-2", None,
     True, False, "Monitoramento", "Encerrado"),
    ("INC0000003", at("2025-01-03T10:00"), 4, "Grupo B", "Produto B", None, None,
     "INC-PARENT-2", False, None, "Monitoramento", "Sem Intervenção"),
    ("INC0000004", at("2025-01-03T11:00"), 2, "Grupo B", "Produto A", "Categoria 1", "CI-1",
     "INC-PARENT-1", True, False, "Manual", "Encerrado"),
]
SCHEMA = (
    "incident_id string, opened_at timestamp, priority_code long, assigned_group string, "
    "product string, category string, configuration_item string, parent_incident_id string, "
    "entered_kpi_source boolean, kpi_breached_source boolean, opened_by string, status string"
)


@pytest.fixture(scope="module")
def incidents(spark):
    return spark.createDataFrame(SILVER, SCHEMA)


@pytest.fixture(scope="module")
def volume(incidents):
    return gold.daily_volume(incidents)


@pytest.fixture(scope="module")
def breakdown(incidents):
    return gold.daily_breakdown(incidents)


def test_daily_volume_has_no_gap(volume):
    got = {(r[0].isoformat(), r[1]): r[2:] for r in rows(volume)}
    assert len(got) == 9
    assert got["2025-01-01", "ALL"] == (2, 2, 1, 1, 0)
    assert got["2025-01-02", "ALL"] == (0, 0, 0, 0, 0)
    assert got["2025-01-03", "ALL"] == (2, 1, 0, 1, 1)
    assert sum(v[0] for (_, s), v in got.items() if s == "P2") == 2
    assert sum(v[0] for (_, s), v in got.items() if s == "P3") == 1


def test_breakdown_values(breakdown):
    got = {(r[0].isoformat(), *r[1:4]): r[4:] for r in rows(breakdown)}
    assert got["2025-01-01", "product", S.MISSING, "P3"][0] == 1
    assert got["2025-01-01", "assigned_group", "Grupo A", "ALL"][0] == 2
    key = ("2025-01-01", "critical_group", "Produto A | Categoria 1 | P2", "ALL")
    assert got[key] == (1, 1, 1)
    parents = [v[0] for k, v in got.items() if k[2:] == ("INC-PARENT-1", "ALL")]
    assert sum(parents) == 2


def test_gold_report_passes(incidents, volume, breakdown):
    checks = quality.gold_checks(incidents, volume, breakdown)
    assert len(checks.collect()) == 6
    quality.require_clean(checks)
    got = {r["priority_scope"]: (r["source_count"], r["gold_count"])
           for r in quality.reconciliation(incidents, volume).collect()}
    assert got == {"ALL": (4, 4), "P2": (2, 2), "P3": (1, 1)}


def test_reconciliation_fails_when_rows_are_lost(incidents, volume, breakdown):
    lost = volume.where(F.col("reference_date") != F.lit("2025-01-01").cast("date"))
    with pytest.raises(quality.ContractError, match="reconciliation_failed"):
        quality.require_clean(quality.gold_checks(incidents, lost, breakdown))


def test_missing_gold_column_is_refused(incidents):
    with pytest.raises(quality.ContractError, match="opened_by"):
        gold.daily_volume(incidents.drop("opened_by"))


def test_ranking_options(breakdown):
    ranked = gold.breakdown_ranking(
        breakdown, "2025-01-01", "2025-01-03", "ALL", "product", 5, "breach_rate_pct",
        exclude_missing=True,
    )
    assert [(r["dimension_value"], r["breach_rate_pct"]) for r in ranked.collect()] == [
        ("Produto A", 50.0), ("Produto B", None),
    ]
    with pytest.raises(ValueError, match="metric"):
        gold.breakdown_ranking(breakdown, "2025-01-01", "2025-01-03", "ALL", "product", 5, "x")


def test_active_items_are_carried_forward(incidents):
    got = rows(gold.active_items(incidents, 2), "day")
    assert [r[1] for r in got] == [2.0, 0.0, 1.0, 1.0, 1.0]


DAILY = {"ALL": [10, 12, 8, 100, 120, 110], "P2": [2, 3, 1, 20, 25, 22], "P3": [4, 5, 3, 40, 45, 42]}


@pytest.fixture(scope="module")
def series(spark):
    start = date(2025, 8, 29)
    data = [
        (start + timedelta(days=i), scope, n, n // 2, int(n >= 100), n // 3, n // 4)
        for scope, counts in DAILY.items()
        for i, n in enumerate(counts)
    ]
    return spark.createDataFrame(data, S.VOLUME_SCHEMA)


@pytest.fixture(scope="module")
def features(series):
    return temporal.daily_features(series)


def test_rolling_means(features):
    got = rows(
        features.where("priority_scope = 'ALL'").select(
            "reference_date", "rolling_mean_7", "day_of_week", "is_weekend"
        ),
        "reference_date",
    )
    assert [r[1] for r in got[:4]] == [10, 11, 10, 32.5]
    assert got[0][2] == "Sexta" and got[1][3] is True


def test_monthly_and_weekday(features):
    monthly = {(r["year_month"], r["priority_scope"]): r
               for r in temporal.monthly_summary(features).collect()}
    assert len(monthly) == 6
    august = monthly["2025-08", "ALL"]
    assert (august["incident_count"], august["observed_days"]) == (30, 3)
    days = {r["day_of_week"] for r in temporal.weekday_summary(features).collect()}
    assert days == set(S.WEEKDAY_LABELS) - {"Quinta"}


def test_peaks(features):
    top = rows(temporal.peak_days(features, 2).where("priority_scope = 'ALL'"), "peak_rank")
    assert len(top) == 2 and top[0][1] == 1 and top[0][3] == 120


def test_regimes(features):
    table = temporal.regime_comparison(features, "2025-01-01", "2025-09-01")
    got = {r["regime"]: r for r in table.where("priority_scope = 'ALL'").collect()}
    assert (got["before"]["average_daily_incidents"], got["before"]["observed_days"]) == (10, 3)
    assert (got["after"]["average_daily_incidents"], got["after"]["observed_days"]) == (110, 3)
    ratio = {r[0]: r[1] for r in rows(temporal.regime_ratio(table))}
    assert ratio["ALL"] == 11.0


def test_duplicate_days_are_refused(series):
    with pytest.raises(quality.ContractError, match="duplicate_keys"):
        quality.require_clean(quality.volume_contract(series.unionByName(series.limit(1))))
    quality.require_clean(quality.volume_contract(series))


def test_gaps_are_refused(series):
    quality.require_continuous(series)
    with pytest.raises(quality.ContractError, match="ALL"):
        quality.require_continuous(series.where("incident_count <> 8"))


REGIMES = [("old", None, date(2025, 9, 1)), ("new", date(2025, 9, 1), None)]


def test_regimes_between():
    assert monitoring.regimes_between(REGIMES, date(2025, 8, 1), date(2025, 8, 31)) == ["old"]
    assert monitoring.regimes_between(REGIMES, date(2025, 8, 31), date(2025, 9, 1)) == ["old", "new"]


def test_change_is_left_out_across_regimes(series):
    inside = monitoring.period_over_period(series, date(2025, 9, 3), date(2025, 9, 3), REGIMES)
    got = {r["priority_scope"]: r for r in inside.collect()}
    assert got["ALL"]["comparable"] and round(got["ALL"]["change_pct"], 4) == round(-1000 / 120, 4)
    across = monitoring.period_over_period(series, date(2025, 9, 1), date(2025, 9, 3), REGIMES)
    assert all(r["change_pct"] is None and not r["comparable"] for r in across.collect())


def test_anatomy_of_a_constant_series(series):
    flat = series.withColumn("incident_count", F.lit(3).cast("long"))
    row = temporal.series_anatomy(flat).first()
    assert row["std"] == 0 and row["acf_1"] is None and row["mean"] == 3
