"""Three raw incidents through cleaning, derived columns and quality checks."""

import pytest
from support import at, rows
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.functions.text import coerce_flag, normalize_level
from faultline.operators import quality, silver
from faultline.sources import raw, sinks, tables

def record(number, **fields):
    """A raw record; what is not named is blank."""
    known = dict.fromkeys(S.COLUMN_MAP, "") | {"Número": f"INC{number:07}"} | fields
    return tuple(known[name] for name in S.COLUMN_MAP)


RAW = [
    record(
        41,
        **{
            "Prioridade": "2 - Alta", "Produto": "mail", "Categoria": "queue", "Subcategoria": "delay",
            "Grupo designado": "night", "Item de configuração": "mx-7", "Aberto": "14/02/2025 08:00:00",
            "Resolvido": "14/02/2025 09:00:00", "Encerrado": "14/02/2025 09:10:00", "Duração": "3600",
            "Descrição resumida": "slow mail", "Aberto por": "Manual", "Status": "Encerrado", "Entrou para KPI?": "SIM", "KPI Violado?": "NAO",
        },
    ),
    record(
        42,
        **{
            "Prioridade": "3 - Média", "Produto": "dns", "Categoria": "zone", "Subcategoria": "transfer",
            "Grupo designado": "day", "Item de configuração": "ns-1", "Aberto": "15/02/2025 10:00:00",
            "Encerrado": "15/02/2025 11:00:00", "Duração": "3600", "Descrição resumida": "zone stale", "Aberto por": "Monitoramento",
            "Incidente Pai": "INC0000041", "Status": "Encerrado Automaticamente",
            "Entrou para KPI?": "NAO", "KPI Violado?": "N/A",
        },
    ),
    record(
        43,
        **{
            "Prioridade": "4 - Baixa", "Grupo designado": "day", "Item de configuração": "ns-2",
            "Aberto": "16/02/2025 23:00:00", "Encerrado": "16/02/2025 23:10:00", "Duração": "600", "Descrição resumida": "probe",
            "Aberto por": "Monitoramento", "Status": "Sem Intervenção",
            "Entrou para KPI?": "NAO", "KPI Violado?": "N/A",
        },
    ),
]


@pytest.fixture(scope="module")
def incidents(spark):
    return spark.createDataFrame(RAW, S.RAW_SCHEMA)


@pytest.fixture(scope="module")
def built(incidents):
    return silver.build_silver(incidents)


def test_codes_labels_and_limits(built):
    got = rows(
        built.select("incident_id", "priority_code", "priority_label", "sla_limit_seconds"),
        "incident_id",
    )
    assert [row[1:] for row in got] == [
        (2, "Alta", 14400),
        (3, "Média", 43200),
        (4, "Baixa", 86400),
    ]


def test_rules_are_recalculated(built):
    got = rows(
        built.select(
            "incident_id",
            "entered_kpi_recalculated_raw",
            "kpi_breached_recalculated_raw",
            "entered_kpi_rule_mismatch",
            "kpi_breached_rule_mismatch",
            "duration_mismatch",
        ),
        "incident_id",
    )
    assert [row[1:] for row in got] == [
        ("SIM", "NAO", False, False, False),
        ("NAO", "N/A", False, False, False),
        ("NAO", "N/A", False, False, False),
    ]
    assert rows(built.select("kpi_breached_raw"), "incident_id")[1] == ("N/A",)


def test_quality_report_passes(built):
    checks = quality.silver_checks(built)
    assert all(row[1] == 0 for row in rows(checks.select("check_name", "violations")))
    assert rows(quality.quality_status(checks)) == [("passed",)]
    assert quality.quality_gate(checks) == "passed"


def test_broken_rows_stop_the_run(built):
    doubled = built.unionByName(built.limit(1))
    with pytest.raises(quality.ContractError, match="duplicate_incident_ids"):
        quality.quality_gate(quality.silver_checks(doubled))


def test_bad_values_become_null(incidents):
    spoiled = incidents.withColumns({"Aberto": F.lit("nope"), "Duração": F.lit("x")})
    cleaned = silver.clean(spoiled)
    assert rows(cleaned.select("opened_at", "duration_seconds").distinct()) == [(None, None)]


def test_durations_that_are_no_numbers(incidents):
    for text in ("NaN", "inf", "-Infinity", "1e300", "ten", " "):
        frame = incidents.limit(1).withColumn("Duração", F.lit(text))
        assert rows(silver.clean(frame).select("duration_seconds")) == [(None,)]


def test_dates_in_every_layout(incidents):
    shown = {
        "1/2/2025 8:05:00": "2025-02-01T08:05:00",
        "01/02/2025 08:05": "2025-02-01T08:05:00",
        "1/2/2025": "2025-02-01T00:00:00",
        "2025-02-01T08:05:00": "2025-02-01T08:05:00",
        "2025-02-01 08:05:00.250": "2025-02-01T08:05:00.250000",
        "2025-2-1": "2025-02-01T00:00:00",
    }
    for text, expected in shown.items():
        frame = incidents.limit(1).withColumn("Aberto", F.lit(text))
        assert rows(silver.clean(frame).select("opened_at")) == [(at(expected),)]
    frame = incidents.limit(1).withColumn("Aberto", F.lit("31/02/2025"))
    assert rows(silver.clean(frame).select("opened_at")) == [(None,)]


def test_quoted_line_breaks(spark, tmp_path, incidents):
    told = incidents.withColumn("Descrição resumida", F.lit('two\n"lines"'))
    sinks.write_csv(told, str(tmp_path / "q"))
    read = raw.read_raw(spark, str(tmp_path / "q"), multi_line=True)
    assert {r[0] for r in rows(read.select("`Descrição resumida`"))} == {'two\n"lines"'}
    assert read.count() == 3


def test_a_repeated_run_replaces_itself(spark, tmp_path):
    path, frame = str(tmp_path / "runs"), spark.createDataFrame([("a", 1), ("b", 2)], "d string, incident_id int")
    for run in ("r1", "r1", "r2"):
        sinks.write_run(frame, path, "d", run)
    stored = spark.read.parquet(path)
    assert stored.where("run_id = 'r1'").count() == 2 and stored.count() == 4
    assert rows(quality.same_ids(frame, stored.where("run_id = 'r1'"))) == [(0, 0)]
    assert rows(quality.same_ids(frame, stored)) == [(0, 2)]


def test_duration_rounds_half_to_even(incidents):
    for text, expected in (("2.5", 2), ("3.5", 4), ("-0.5", 0)):
        frame = incidents.limit(1).withColumn("Duração", F.lit(text))
        assert rows(silver.clean(frame).select("duration_seconds")) == [(expected,)]


def test_header_must_match(spark, incidents):
    padded = incidents.toDF(*[f" {name} " for name in incidents.columns])
    assert raw.require_source_header(padded).columns == list(S.COLUMN_MAP)
    with pytest.raises(quality.ContractError, match="Missing"):
        raw.require_source_header(incidents.drop("Status"))
    with pytest.raises(quality.ContractError, match="unexpected"):
        raw.require_source_header(incidents.withColumn("Extra", F.lit(1)))


def test_csv_round_trip(spark, incidents, tmp_path):
    sinks.write_csv(incidents, str(tmp_path / "raw"))
    back = silver.build_silver(raw.read_raw(spark, str(tmp_path / "raw")))
    assert back.exceptAll(silver.build_silver(incidents)).count() == 0


def test_row_numbers_start_at_two(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "p"))
    stored = raw.with_provenance(spark.read.parquet(str(tmp_path / "p")))
    assert [r[0] for r in rows(stored.select("_source_row_number"), "id")] == [2, 3, 4, 5, 6]


def test_row_numbers_of_split_text_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(2000).coalesce(1).write.csv(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        stored = raw.with_text_provenance(spark.read.schema("id long").csv(path))
        got = rows(stored.select("id", "_source_row_number"), "id")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i, i + 2) for i in range(2000)]


def test_optional_table_is_empty(spark, tmp_path):
    frame = tables.read_optional(spark, str(tmp_path / "none"), S.RISK_SCORE_SCHEMA)
    assert frame.count() == 0 and frame.columns == S.RISK_SCORE_SCHEMA.names


def test_flags_of_any_type(spark):
    frame = spark.createDataFrame(
        [("sim", 1, True), ("No", 0, False), (None, None, None)], "t string, n int, b boolean"
    )
    got = frame.select(*[coerce_flag(frame, n).alias(n) for n in ("t", "n", "b")])
    assert rows(got) == [(True,) * 3, (False,) * 3, (False,) * 3]


def test_level_synonyms(spark):
    frame = spark.createDataFrame([(" CRÍTICO",), ("Médio",), ("high",), ("x",), (None,)], "v string")
    assert [r[0] for r in rows(frame.select(normalize_level(F.col("v"))))] == [
        "crítico", "moderado", "alto", "x", "",
    ]


def test_schema_difference(incidents):
    frame = incidents.drop("Status").withColumn("Extra", F.lit(1))
    assert rows(quality.schema_difference(frame, list(S.COLUMN_MAP)), "problem") == [
        ("Status", "missing"), ("Extra", "unexpected"),
    ]


def test_leakage_is_refused():
    with pytest.raises(quality.ContractError, match="leakage"):
        quality.require_no_leakage([*S.MODEL_FEATURES, "resolved_at"])
    quality.require_no_leakage(S.MODEL_FEATURES)


def test_label_audit_without_rule_columns(built):
    audit = quality.label_audit(built.drop("entered_kpi_rule_mismatch"))
    got = {row["rule"]: row for row in audit.collect()}
    assert not got["entered_kpi_rule_mismatch"]["column_present"]
    assert got["entered_kpi_rule_mismatch"]["mismatches_total"] is None
    assert got["kpi_breached_rule_mismatch"]["mismatches_total"] == 0
