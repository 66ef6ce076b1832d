"""Warehouse, sinks, snapshots, alerts and the registered queries."""

import hashlib
from datetime import datetime
from functools import reduce

import pytest
from support import at, rows
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.operators import history, silver, snapshots, warehouse
from faultline.operators.quality import ContractError
from faultline.session import materialise
from faultline.sources import sinks
from faultline.streaming import alerts, arrivals
from test_ingestion import RAW


@pytest.fixture(scope="module")
def store(spark):
    incidents = silver.build_silver(spark.createDataFrame(RAW, S.RAW_SCHEMA))
    unlabelled = incidents.limit(1).withColumns(
        {"incident_id": F.lit("INC0000009"), "priority_code": F.lit(None).cast("long"),
         "priority_label": F.lit(None).cast("string")}
    )
    return warehouse.build_warehouse(incidents.unionByName(unlabelled))


def test_scratch_tables_are_cleared(spark, monkeypatch):
    from faultline import session

    # Tables of other tests stay.
    monkeypatch.setattr(session, "_made", [])
    stored = session.materialise(spark.range(5))
    assert stored.count() == 5
    assert session.clear_scratch(spark) == 1 and session.clear_scratch(spark) == 0
    with pytest.raises(Exception, match="FILE_NOT_EXIST|FileNotFound|does not exist"):
        stored.select(F.sum("id")).collect()


def test_dimensions(store):
    assert rows(store.dim_prioridade, "sk_prioridade") == [
        (1, 2, "Alta"), (2, 3, "Média"), (3, 4, "Baixa"), (4, None, None),
    ]
    assert rows(store.dim_produto, "sk_produto") == [(1, "Não informado"), (2, "dns"), (3, "mail")]
    assert rows(store.dim_tempo.select("sk_tempo", "dia_semana", "semana_ano", "fim_semana"), "sk_tempo") == [
        (20250214, 5, 7, False), (20250215, 6, 7, True), (20250216, 7, 7, True),
    ]


def test_null_priority_finds_its_member(store):
    assert rows(store.fato_incidente.where("incident_id = 'INC0000009'").select("sk_prioridade")) == [(4,)]
    checks = {r[0]: r[1] for r in rows(warehouse.validate_warehouse(store))}
    assert len(checks) == 21 and not any(checks.values())


def test_orphans_are_counted(store):
    broken = warehouse.Warehouse(**{**store.tables(), "dim_produto": store.dim_produto.where("sk_produto > 1")})
    assert {r[0]: r[1] for r in rows(warehouse.orphans(broken))}["dim_produto"] == 1


def test_star_query(store):
    got = rows(warehouse.star(store), "incident_id")
    assert len(got) == 4 and [r[2] for r in got] == [None, "Alta", "Média", "Baixa"]


def test_version_pointer(spark, tmp_path):
    root = str(tmp_path / "m")
    sinks.publish_version(spark.range(3), root, "v1", "r1")
    sinks.publish_version(spark.range(5), root, "v2", "r2")
    assert sinks.read_current(spark, root).count() == 5
    other = spark.range(1).withColumn("model_version", F.lit("v9"))
    other.write.mode("overwrite").parquet(f"{root}/version=v2/run=r2")
    with pytest.raises(ContractError, match="v2"):
        sinks.read_current(spark, root)


def test_upsert_keeps_one_row_per_key(spark):
    current = spark.createDataFrame([("P2", "D+1", 1), ("P3", "D+1", 2)], "priority_scope string, horizon string, v int")
    batch = spark.createDataFrame([("P2", "D+1", 9)], current.schema)
    assert rows(sinks.upsert(current, batch, sinks.UPSERT_KEY), "priority_scope") == [("P2", "D+1", 9), ("P3", "D+1", 2)]


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert sinks.recent_runs(spark, path, 5).count() == 0
    for name in ("a", "b"):
        sinks.append_run(spark, path, name, "test", "load", 3)
    assert [r[0] for r in sinks.recent_runs(spark, path, 1).select("run_id").collect()] == ["b"]


def manifest(spark, **files):
    return spark.createDataFrame(list(files.items()), "archive_path string, sha256 string")


def test_snapshot_diff_and_replay(spark):
    first = manifest(spark, a="1", b="1", c="1")
    second = manifest(spark, a="2", c="1", d="1")
    assert rows(snapshots.manifest_diff(first, second).select("archive_path", "change"), "archive_path") == [
        ("a", "changed"), ("b", "deleted"), ("d", "added"),
    ]
    history = spark.createDataFrame(
        [("s0", "full", at("2025-01-01")), ("s1", "incremental", at("2025-01-02"))],
        "snapshot_id string, mode string, created_at timestamp",
    )
    entries = snapshots.snapshot_entries("full", None, first).withColumn("snapshot_id", F.lit("s0")).unionByName(
        snapshots.snapshot_entries("incremental", first, second).withColumn("snapshot_id", F.lit("s1"))
    )
    assert rows(snapshots.replay(history, entries), "archive_path") == rows(second, "archive_path")
    failures = snapshots.integrity_failures(second, manifest(spark, a="x", c="1"))
    assert rows(failures.select("archive_path", "reason"), "archive_path") == [
        ("a", "checksum_mismatch"), ("d", "missing"),
    ]


def test_large_files_are_streamed(spark, tmp_path, monkeypatch):
    (tmp_path / "small").write_bytes(b"abc")
    (tmp_path / "large").write_bytes(b"x" * 5000)
    monkeypatch.setattr(snapshots, "ONE_VALUE", 100)
    got = rows(snapshots.file_manifest(spark, {"a": str(tmp_path)}), "archive_path")
    assert got == [
        ("a/large", 5000, hashlib.sha256(b"x" * 5000).hexdigest()),
        ("a/small", 3, hashlib.sha256(b"abc").hexdigest()),
    ]


def test_snapshot_mode_and_retention(spark):
    kind = "snapshot_id string, mode string, created_at timestamp"
    empty = spark.createDataFrame([], kind)
    now = datetime(2025, 2, 1)
    assert snapshots.select_mode("auto", empty, now) == "full"
    with pytest.raises(ContractError):
        snapshots.select_mode("incremental", empty, now)
    history = spark.createDataFrame(
        [("f1", "full", at("2025-01-01")), ("i1", "incremental", at("2025-01-02")), ("f2", "full", at("2025-01-10"))],
        kind,
    )
    assert snapshots.select_mode("auto", history, datetime(2025, 1, 12)) == "incremental"
    assert snapshots.select_mode("auto", history, now) == "full"
    old = snapshots.expired(history, F.lit(now), 7, "i1")
    assert [r[0] for r in rows(old)] == ["f1"]


def test_file_manifest(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("abc")
    (tmp_path / "x" / ".gitkeep").write_text("")
    got = rows(snapshots.file_manifest(spark, {"src": str(tmp_path / "x")}))
    assert got == [("src/a.txt", 3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")]
    assert snapshots.missing_sources(spark, {"x": str(tmp_path / "x"), "y": str(tmp_path / "y")}) == ["y"]


LEVELS = [("INC-LOW", 18, "baixo"), ("INC-MOD", 42, "moderado"), ("INC-HIGH", 68, "alto"), ("INC-CRITICAL", 92, " CRÍTICO")]


@pytest.fixture(scope="module")
def scores(spark):
    data = [(i, at("2026-08-09T12:00:00"), "v2", 0.5, 0.5, 0.5, 0.5, s, level, "f", "a") for i, s, level in LEVELS]
    return spark.createDataFrame(data, S.RISK_SCORE_SCHEMA)


def test_only_high_levels_alert(scores):
    events = alerts.alert_events(scores)
    assert [r[0] for r in rows(events, "key")] == ["INC-CRITICAL", "INC-HIGH"]
    assert alerts.alert_events(scores.limit(0)).count() == 0
    parsed = alerts.accepted(alerts.parsed_events(events))
    assert [(r["incident_id"], r["risk_level"]) for r in parsed.orderBy("incident_id").collect()] == [
        ("INC-CRITICAL", "crítico"), ("INC-HIGH", "alto"),
    ]


GOOD = (
    '{"event_type":"ola_risk_alert","incident_id":"I","scored_at":"2026-08-09T12:00:00Z",'
    '"model_version":"v","breach_probability":0.5,"risk_score":70,"risk_level":"alto",'
    '"top_risk_factors":"","recommended_action":"a"}'
)


@pytest.mark.parametrize(
    ("old", "new", "reason"),
    [
        ("", "", None),
        ('"event_type":"ola_risk_alert",', "", None),
        ("{", "{invalid-json", "not_json"),
        ("{", '{"extra":1,', "unknown_field"),
        ('"model_version":"v",', "", "missing_field"),
        ("0.5", "1.5", "breach_probability"),
        (":70", ":101", "risk_score"),
        ('"alto"', '"baixo"', "risk_level"),
        ("ola_risk_alert", "other", "event_type"),
        ("2026-08-09T12:00:00Z", "soon", "scored_at"),
        ('"incident_id":"I"', '"incident_id":""', "empty_text"),
        (":70", ':"many"', "not_json"),
    ],
)
def test_messages_are_checked(spark, old, new, reason):
    frame = spark.createDataFrame([(GOOD.replace(old, new, 1) if old else GOOD,)], "value string")
    assert alerts.parsed_events(frame).first()["reject_reason"] == reason


def test_streams_publish_and_split(spark, scores, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("scores", "out", "state"))
    scores.write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        alerts.publish_stream(spark, source, out, state).awaitTermination()
    assert spark.read.text(out).count() == 2
    broken = spark.createDataFrame([("{broken",)], "value string")
    inbox = str(tmp_path / "inbox")
    spark.read.text(out).unionByName(broken).write.text(inbox)
    valid, dead = str(tmp_path / "valid"), str(tmp_path / "dead")
    alerts.consume_stream(spark, inbox, valid, dead, str(tmp_path / "state2")).awaitTermination()
    assert spark.read.parquet(valid).count() == 2
    assert [r["reject_reason"] for r in spark.read.parquet(dead).collect()] == ["not_json"]


def test_every_checked_query_is_registered():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_facts_join_dimensions_without_nested_loops(store):
    plan = store.fato_incidente._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stream_scores_every_eligible_row(spark):
    from workload import operations, risk
    from workload.tables import Tables

    tables = Tables(spark, "/root/testdata/sf0.001")
    wanted = risk.features(tables).where(F.col(S.ELIGIBLE)).select("incident_id")
    got = operations.incremental_scores(tables).select("incident_id")
    assert rows(got, "incident_id") == rows(wanted, "incident_id")
    assert wanted.count() > 0


def arriving(spark, count=240):
    """Silver rows over 60 days, half of them in one team, with equal and absent instants."""
    i, start = F.col("id"), F.lit("2024-01-01").cast("timestamp")
    opened = F.timestamp_seconds(F.unix_timestamp(start) + F.floor(i / 2) * 43_200)
    eligible = i % 3 != 0
    return spark.range(count).select(
        F.format_string("INC%07d", "id").alias("incident_id"),
        F.when(i != 7, opened).alias("opened_at"),
        F.when(i % 5 != 0, F.timestamp_seconds(F.unix_timestamp(opened) + i * 5_000)).alias("closed_at"),
        (1 + i % 5).alias("priority_code"),
        F.when(i % 4 != 0, F.lit("p")).alias("product"),
        F.concat(F.lit("c"), i % 3).alias("category"),
        F.lit("s").alias("subcategory"),
        F.when(i % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), i % 7)).alias("assigned_group"),
        F.lit("ci").alias("configuration_item"),
        F.lit("Manual").alias("opened_by"),
        eligible.alias(S.ELIGIBLE),
        F.when(eligible & (i % 5 != 0), i % 2 == 0).alias(S.TARGET),
    )


@pytest.mark.parametrize("batches", [1, 4])
def test_state_gives_the_features_of_all_history(spark, tmp_path, batches):
    """Any split in the order of time, a repeated batch and an empty one."""
    silver = arriving(spark)
    opened = silver.withColumn("closed_at", F.lit(None).cast("timestamp")).withColumn(
        S.TARGET, F.lit(None).cast("boolean")
    )
    come = opened.select("*", F.lit("opened").alias("arrival"), F.col("opened_at").alias("on")).unionByName(
        silver.where(F.col("closed_at").isNotNull()).select(
            "*", F.lit("closed").alias("arrival"), F.col("closed_at").alias("on")
        )
    )
    place = F.coalesce(F.floor(F.datediff("on", F.lit("2024-01-01")) * batches / 80), F.lit(0))
    come = materialise(come.withColumn("place", F.least(place, F.lit(batches - 1))))
    state, parts = str(tmp_path / "state"), []
    for number in range(batches):
        rows_of = come.where(F.col("place") == number)
        for _ in range(2):
            part = arrivals.arriving_features(rows_of, state, number)
        parts.append(part)
    names = ["incident_id", *S.HISTORICAL_FEATURES]
    empty = arrivals.arriving_features(come.where(F.lit(False)), state, batches)
    assert empty.count() == 0
    got = reduce(lambda a, b: a.unionByName(b), parts).select(*names)
    wanted = history.history_features(silver).where("incident_id <> 'INC0000007'").select(*names)
    assert rows(got, "incident_id") == rows(wanted, "incident_id")
    assert got.count() == 239
