"""The three runs, end to end on a small raw table."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.operators import model
from faultline.plans import daily, risk, volume
from faultline.sources import sinks


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lake")
    rng = np.random.default_rng(23)
    data = []
    for i in range(1200):
        opened = date(2025, 1, 1) + timedelta(days=i % 120)
        hour, priority = int(rng.integers(0, 20)), int(rng.integers(1, 6))
        seconds = int(rng.integers(600, 50_000))
        entered = priority <= 3
        late = seconds > S.SLA_SECONDS[priority]
        closed = f"{opened + timedelta(days=1):%d/%m/%Y} 00:00:00"
        data.append((
            f"INC{i:07d}", f"{priority} - Nivel", f"p{i % 4}", f"c{i % 3}", "s", f"Team{i % 5}",
            f"IC{i % 40}", f"{opened:%d/%m/%Y} {hour:02d}:00:00", "", closed,
            str(seconds), "", "d", "", "Manual", "", "Encerrado",
            "SIM" if entered else "NAO", ("SIM" if late else "NAO") if entered else "N/A",
        ))
    sinks.write_csv(spark.createDataFrame(data, S.RAW_SCHEMA), str(folder / "raw"))
    return str(folder)


def test_daily_run(spark, root):
    status = daily.ingest(spark, f"{root}/raw", root)
    assert status == "passed_with_warnings"
    bronze = spark.read.parquet(f"{root}/bronze")
    assert bronze.select("_source_file", "_source_row_number").distinct().count() == 1200
    daily.build_gold(spark, root, S.FORECAST_SCOPES)
    daily.analyse(spark, root, "2025-01-01", "2025-03-01", S.FORECAST_SCOPES)
    assert spark.read.csv(f"{root}/analysis/monthly", header=True).count() == 24
    daily.build_star(spark, root)
    assert sinks.read_current(spark, f"{root}/warehouse/fato_incidente").count() == 1200
    areas = ["gold", "warehouse"]
    assert daily.snapshot(spark, root, areas, datetime(2025, 6, 1)) == "full"
    assert spark.read.parquet(f"{root}/snapshots/manifest").count() > 9
    assert daily.snapshot(spark, root, areas, datetime(2025, 6, 2)) == "incremental"
    assert spark.read.parquet(f"{root}/snapshots/entries/snapshot_id=20250602000000").count() == 0
    sinks.write_table(spark.range(3), f"{root}/gold/more")
    assert daily.snapshot(spark, root, areas, datetime(2025, 6, 3)) == "incremental"
    added = spark.read.parquet(f"{root}/snapshots/entries/snapshot_id=20250603000000")
    assert {r.change for r in added.select("change").collect()} == {"added"}
    assert daily.snapshot(spark, root, areas, datetime(2025, 7, 20)) == "full"
    late = spark.read.parquet(f"{root}/snapshots/expired")
    assert sorted(r.snapshot_id[:8] for r in late.collect()) == ["20250601", "20250602", "20250603"]


def test_risk_run(spark, root):
    protocol = model.Protocol("2025-03-01", "2025-03-31", "2025-03-31", "2025-04-01", "month", "r1")
    risk.train_and_publish(spark, root, protocol)
    assert risk.current_model(spark, root).version == "r1"
    at = F.lit("2025-05-01").cast("timestamp")
    scored = risk.score_and_alert(spark, root, "run-1", at)
    assert scored > 0
    # The same run again replaces itself, alerts included.
    assert risk.score_and_alert(spark, root, "run-1", at) == scored
    assert spark.read.parquet(f"{root}/risk/scores").count() == scored
    assert sinks.read_current(spark, f"{root}/risk/serving").count() == scored
    alerts = spark.read.text(f"{root}/risk/alerts/run_id=run-1").select("value")
    assert alerts.count() == alerts.distinct().count()


def test_volume_run(spark, root):
    periods = volume.Periods("2025-01-01", "2025-02-15", "2025-03-15", "2025-03-16")
    out = volume.run(spark, root, periods, F.lit("2025-05-01").cast("timestamp"), "v1")
    assert out.count() == 12
    assert sinks.read_current(spark, f"{root}/volume/predictions").count() == 12
