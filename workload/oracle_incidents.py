"""Checking SQL of the incident queries."""

from __future__ import annotations

from faultline import schema as S
from workload.oracle_base import cte, day, sql, stamp

COUNTS = ", ".join(S.VOLUME_COUNTS)
START, CUTOFF = "DATE '1998-01-01'", "DATE '2000-01-01'"
LOADED = "'2026-01-01 00:00:00.000000'"


def silver(columns: str) -> str:
    return sql(f"SELECT incident_id, {columns} FROM silver", "silver")


def _raw_value(name: str) -> str:
    if name in S.DATE_COLUMNS:
        text = f"strftime({name}, '%d/%m/%Y %H:%M:%S')"
    elif name == "duration_seconds":
        text = "CAST(duration_seconds AS VARCHAR)"
    else:
        text = f"CASE WHEN k % 4 = 0 THEN '  ' || {name} || ' ' ELSE {name} END"
    return f"coalesce({text}, '')"


RENAMED = ", ".join(f"{_raw_value(name)} AS {name}" for name in S.COLUMN_MAP.values())
VOLUME = f"{day('reference_date')} AS reference_date, priority_scope, {COUNTS}"
BREAKDOWN = (
    f"{day('reference_date')} AS reference_date, dimension_name, dimension_value, "
    "priority_scope, incident_count, entered_kpi_count, kpi_breach_count"
)

# Raw text as a CSV reader returns it: blank is null.
CSV = ", ".join(
    f'nullif({_raw_value(name)}, \'\') AS "{raw}"' for raw, name in S.COLUMN_MAP.items()
)

BLOCKING = {
    "mandatory_nulls": " + ".join(
        f"count(*) FILTER ({name} IS NULL)" for name in S.MANDATORY_COLUMNS
    ),
    "invalid_incident_ids": r"count(*) FILTER (NOT regexp_full_match(incident_id, 'INC\d{7}'))",
    "closed_before_opened": "count(*) FILTER (closed_at < opened_at)",
    "negative_duration": "count(*) FILTER (duration_seconds < 0)",
    "duplicate_incident_ids": "count(*) - count(DISTINCT incident_id)",
}
WARNING = {
    "resolved_after_closed": "count(*) FILTER (resolved_at > closed_at)",
    "duration_mismatch": "count(*) FILTER "
    "(abs(duration_seconds - calculated_duration_seconds) > 2)",
    "subcategory_without_category": "count(*) FILTER "
    "(subcategory IS NOT NULL AND category IS NULL)",
    "entered_kpi_rule_mismatch": "count(*) FILTER "
    "(entered_kpi_raw <> entered_kpi_recalculated_raw)",
    "kpi_breached_rule_mismatch": "count(*) FILTER "
    "(kpi_breached_raw <> kpi_breached_recalculated_raw)",
}
CHECKS = " UNION ALL ".join(
    f"SELECT '{name}' AS check_name, {rule} AS violations, '{severity}' AS severity FROM silver"
    for severity, rules in (("blocking", BLOCKING), ("warning", WARNING))
    for name, rule in rules.items()
)
cte("checks", CHECKS, "silver")

cte(
    "features",
    """
    SELECT *, avg(incident_count) OVER (w ROWS 6 PRECEDING) AS rolling_mean_7,
      avg(incident_count) OVER (w ROWS 29 PRECEDING) AS rolling_mean_30,
      isodow(reference_date) - 1 AS day_of_week_number,
      ['Segunda', 'Terça', 'Quarta', 'Quinta', 'Sexta', 'Sábado', 'Domingo']
        [isodow(reference_date)] AS day_of_week,
      strftime(reference_date, '%Y-%m') AS year_month, isodow(reference_date) >= 6 AS is_weekend
    FROM volume WINDOW w AS (PARTITION BY priority_scope ORDER BY reference_date)""",
    "volume",
)
SUMS = ", ".join(f"CAST(sum({name}) AS BIGINT) AS {name}" for name in S.VOLUME_COUNTS)
SHARES = """round(sum(monitoring_incident_count)::DOUBLE / nullif(sum(incident_count), 0), 6)
    AS monitoring_share,
  round(sum(no_intervention_count)::DOUBLE / nullif(sum(incident_count), 0), 6)
    AS no_intervention_share"""
REGIME = f"CASE WHEN reference_date < {CUTOFF} THEN 'before' ELSE 'after' END"
cte(
    "ratios",
    f"""
    SELECT priority_scope, round_even(avg(incident_count) FILTER (reference_date >= {CUTOFF})
      / nullif(avg(incident_count) FILTER (reference_date < {CUTOFF}), 0), 4) AS after_before_ratio
    FROM volume WHERE reference_date >= {START} GROUP BY 1""",
    "volume",
)

# The star schema.
for table, columns, names in [
    ("dim_prioridade", "priority_code, priority_label", "priority_code, priority_label"),
    ("dim_produto", "product", "produto"),
    ("dim_categoria", "category, subcategory", "categoria, subcategoria"),
    ("dim_grupo", "assigned_group", "grupo"),
    ("dim_item_configuracao", "configuration_item", "item_configuracao"),
]:
    key = table.replace("dim_", "sk_")
    targets = names.split(", ")
    picked = ", ".join(f"{c} AS {n}" for c, n in zip(columns.split(", "), targets, strict=True))
    cte(
        table,
        f"""SELECT row_number() OVER (ORDER BY {names}) AS {key}, *
            FROM (SELECT DISTINCT {picked} FROM informed)""",
        "informed",
    )
cte(
    "informed",
    "SELECT * REPLACE ("
    + ", ".join(
        f"coalesce({n}, 'Não informado') AS {n}"
        for n in ("product", "category", "subcategory", "assigned_group", "configuration_item")
    )
    + ") FROM silver",
    "silver",
)
cte(
    "dim_tempo",
    """
    SELECT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS sk_tempo, d AS data, year(d) AS ano,
      month(d) AS mes, day(d) AS dia, isodow(d) AS dia_semana, weekofyear(d) AS semana_ano,
      quarter(d) AS trimestre, isodow(d) >= 6 AS fim_semana
    FROM (SELECT CAST(unnest(generate_series(min(opened_date), max(opened_date), INTERVAL 1 DAY))
      AS DATE) AS d FROM silver)""",
    "silver",
)
cte(
    "fact",
    """
    SELECT incident_id, CAST(strftime(opened_date, '%Y%m%d') AS BIGINT) AS sk_tempo, sk_prioridade,
      sk_produto, sk_categoria, sk_grupo, sk_item_configuracao, 1::BIGINT AS qtd_incidente,
      duration_seconds, duration_hours, CASE entered_kpi_raw WHEN 'SIM' THEN 1 ELSE 0 END::BIGINT
        AS entered_kpi,
      CASE kpi_breached_raw WHEN 'SIM' THEN 1 WHEN 'NAO' THEN 0 END::BIGINT AS kpi_breached,
      is_monitoring_opened, is_no_intervention, opened_hour
    FROM informed
    LEFT JOIN dim_prioridade USING (priority_code, priority_label)
    LEFT JOIN dim_produto ON produto = product
    LEFT JOIN dim_categoria ON categoria = category AND subcategoria = subcategory
    LEFT JOIN dim_grupo ON grupo = assigned_group
    LEFT JOIN dim_item_configuracao ON item_configuracao = configuration_item""",
    "dim_prioridade",
    "dim_produto",
    "dim_categoria",
    "dim_grupo",
    "dim_item_configuracao",
)
KEYS = {
    "dim_tempo": "sk_tempo",
    "dim_prioridade": "sk_prioridade",
    "dim_produto": "sk_produto",
    "dim_categoria": "sk_categoria",
    "dim_grupo": "sk_grupo",
    "dim_item_configuracao": "sk_item_configuracao",
}
NUMBER = "CAST(substr(incident_id, 4) AS BIGINT)"
cte(
    "spoiled_fact",
    f"""
    SELECT * REPLACE (CASE WHEN {NUMBER} % 19 <> 3 THEN sk_produto END AS sk_produto,
      CASE WHEN {NUMBER} % 23 = 4 THEN -1 ELSE sk_grupo END AS sk_grupo)
    FROM (SELECT * FROM fact UNION ALL SELECT * FROM fact WHERE {NUMBER} % 29 = 5)""",
    "fact",
)
cte(
    "spoiled_prioridade",
    """SELECT * FROM dim_prioridade UNION ALL SELECT * REPLACE (sk_prioridade + 100 AS sk_prioridade)
       FROM dim_prioridade WHERE priority_code = 2""",
    "dim_prioridade",
)
cte("spoiled_categoria", "SELECT * FROM dim_categoria WHERE false", "dim_categoria")
ORPHANS = " UNION ALL ".join(
    f"SELECT '{table}' AS dimension, count(*) AS orphan_rows FROM fact "
    f"WHERE {key} NOT IN (SELECT {key} FROM {table})"
    for table, key in KEYS.items()
)


def warehouse_checks(fact: str = "fact", **tables: str) -> str:
    named = {table: tables.get(table, table) for table in KEYS}
    parts = [
        f"SELECT 'null_{key}' AS check_name, count(*) FILTER ({key} IS NULL) AS violations FROM {fact}"
        for key in KEYS.values()
    ]
    parts.append(f"SELECT 'duplicate_incident_id', count(*) - count(DISTINCT incident_id) FROM {fact}")
    parts.append(
        f"""SELECT 'repeated_priority_code', count(*) - count(DISTINCT priority_code)
            FROM {named["dim_prioridade"]}"""
    )
    parts += [f"SELECT 'empty_{t}', CAST(count(*) = 0 AS BIGINT) FROM {n}" for t, n in named.items()]
    parts.append(f"SELECT 'empty_fato_incidente', CAST(count(*) = 0 AS BIGINT) FROM {fact}")
    # A lost key has no member either.
    parts += [
        f"""SELECT 'orphan_{t}', count(*) FROM {fact} f
            WHERE NOT EXISTS (SELECT 1 FROM {named[t]} d WHERE d.{key} = f.{key})"""
        for t, key in KEYS.items()
    ]
    return " UNION ALL ".join(parts)


def ranking(where: str, having: str, order: str, limit: int) -> str:
    return sql(
        f"""
        SELECT dimension_value, CAST(sum(incident_count) AS BIGINT) AS incident_count,
          CAST(sum(entered_kpi_count) AS BIGINT) AS entered_kpi_count,
          CAST(sum(kpi_breach_count) AS BIGINT) AS kpi_breach_count,
          round(100.0::DOUBLE * sum(kpi_breach_count) / nullif(sum(entered_kpi_count), 0), 6)
            AS breach_rate_pct
        FROM breakdown
        WHERE reference_date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'
          AND priority_scope = 'ALL' AND {where}
        GROUP BY 1 HAVING sum(entered_kpi_count) >= {having}
        ORDER BY {order} LIMIT {limit}""",
        "breakdown",
    )


def correlation(lagged: str) -> str:
    spread = f"min(y) FILTER ({lagged} IS NOT NULL) <> max(y) FILTER ({lagged} IS NOT NULL)"
    return f"round(CASE WHEN {spread} THEN corr(y, {lagged}) END, 6)"


LEVELS = """CASE event_id % 8 WHEN 0 THEN 'crítico' WHEN 1 THEN 'alto' WHEN 2 THEN 'moderado'
  WHEN 3 THEN 'moderado' WHEN 4 THEN 'baixo' WHEN 5 THEN 'alto' WHEN 6 THEN 'other' ELSE '' END"""

SILVER_COLUMNS = [
    *S.COLUMN_MAP.values(),
    "priority_code",
    "priority_label",
    "entered_kpi_source",
    "kpi_breached_source",
    "has_parent_incident",
    "is_no_intervention",
    "is_monitoring_opened",
    "sla_limit_seconds",
    "duration_hours",
    "opened_date",
    "opened_year",
    "opened_month",
    "opened_day_of_week",
    "opened_hour",
    "calculated_duration_seconds",
    "entered_kpi_recalculated_raw",
    "kpi_breached_recalculated_raw",
]
ALWAYS = [
    "duration_difference_seconds",
    "duration_mismatch",
    "entered_kpi_rule_mismatch",
    "kpi_breached_rule_mismatch",
]
FORBIDDEN = ", ".join(f"'{name}'" for name in S.LEAKAGE_COLUMNS)
LEAKAGE = " UNION ALL ".join(
    f"SELECT '{n}' AS column_name, count({n}) AS filled_rows FROM silver" for n in SILVER_COLUMNS
) + "".join(f" UNION ALL SELECT '{n}', count(*) FROM silver" for n in ALWAYS)

MEASURES = {
    "all": "incident_count",
    "manual": "incident_count - monitoring_incident_count",
    "monitoring": "monitoring_incident_count",
    "kpi_eligible": "entered_kpi_count",
}
DECOMPOSED = " UNION ALL ".join(
    f"""SELECT '{cut}' AS cut, avg({m}) FILTER (reference_date < {CUTOFF}) AS mean_before,
        avg({m}) FILTER (reference_date >= {CUTOFF}) AS mean_after
        FROM volume WHERE priority_scope = 'ALL' AND reference_date >= {START}"""
    for cut, m in MEASURES.items()
)
# A volume table with broken rows on certain days of the month.
cte(
    "spoiled_volume",
    """
    SELECT CASE WHEN day(reference_date) = 9 THEN NULL ELSE reference_date END AS reference_date,
      CASE WHEN day(reference_date) = 7 THEN 'ZZ' ELSE priority_scope END AS priority_scope,
      * EXCLUDE (reference_date, priority_scope)
        REPLACE (CASE WHEN day(reference_date) = 3 THEN -1 - incident_count ELSE incident_count END
          AS incident_count)
    FROM volume WHERE day(reference_date) <> 11
    UNION ALL SELECT * FROM volume WHERE day(reference_date) = 5""",
    "volume",
)


def contract(table: str) -> str:
    rules = {
        "invalid_dates": "count(*) FILTER (reference_date IS NULL)",
        "unexpected_scopes": f"count(*) FILTER (priority_scope NOT IN {tuple(S.GOLD_SCOPES)})",
        **{f"invalid_{n}": f"count(*) FILTER ({n} IS NULL)" for n in S.VOLUME_COUNTS},
        **{f"negative_{n}": f"count(*) FILTER ({n} < 0)" for n in S.VOLUME_COUNTS},
        "duplicate_keys": f"""count(*) - (SELECT count(*) FROM
          (SELECT DISTINCT reference_date, priority_scope FROM {table}))""",
        "empty_table": "(count(*) = 0)::BIGINT",
    }
    return " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, {rule} AS violations FROM {table}"
        for name, rule in rules.items()
    )


def gold_rules(volume: str) -> str:
    def repeated(table: str, key: list[str]) -> str:
        names = ", ".join(key)
        return f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {names} FROM {table}))"

    def nulls(names: list[str]) -> str:
        return " + ".join(f"count(*) FILTER ({n} IS NULL)" for n in names)

    def below(names: list[str]) -> str:
        return " + ".join(f"count(*) FILTER ({n} < 0)" for n in names)

    rules = [
        ("daily_duplicate_keys", repeated(volume, S.VOLUME_KEY), volume),
        ("breakdown_duplicate_keys", repeated("breakdown", S.BREAKDOWN_KEY), "breakdown"),
        ("daily_null_values", nulls(S.VOLUME_KEY + S.VOLUME_COUNTS), volume),
        ("breakdown_null_values", nulls(S.BREAKDOWN_KEY + S.BREAKDOWN_COUNTS), "breakdown"),
    ]
    made = [f"SELECT '{n}' AS check_name, {rule} AS violations FROM {t}" for n, rule, t in rules]
    made.append(
        f"""SELECT 'negative_counts', (SELECT {below(S.VOLUME_COUNTS)} FROM {volume})
          + (SELECT {below(S.BREAKDOWN_COUNTS)} FROM breakdown)"""
    )
    sources = {"ALL": "true", "P2": "priority_code = 2", "P3": "priority_code = 3"}
    matches = " AND ".join(
        f"""(SELECT count(*) FROM silver WHERE {rule})
          = coalesce((SELECT sum(incident_count) FROM {volume} WHERE priority_scope = '{scope}'), 0)"""
        for scope, rule in sources.items()
    )
    made.append(f"SELECT 'reconciliation_failed', (NOT ({matches}))::BIGINT")
    return " UNION ALL ".join(made)


def continuity(table: str) -> str:
    return f"""SELECT priority_scope, count(reference_date) - count(DISTINCT reference_date)
        AS duplicate_days,
      CAST(date_diff('day', min(reference_date), max(reference_date)) + 1
        - count(DISTINCT reference_date) AS BIGINT) AS missing_days
      FROM {table} GROUP BY 1"""
STAR = f"""
    SELECT incident_id, {day("data")} AS data, priority_label AS prioridade, produto, categoria,
      subcategoria, grupo, item_configuracao, round(duration_hours, 6) AS duration_hours,
      entered_kpi, kpi_breached
    FROM fact JOIN dim_tempo USING (sk_tempo) JOIN dim_prioridade USING (sk_prioridade)
      JOIN dim_produto USING (sk_produto) JOIN dim_categoria USING (sk_categoria)
      JOIN dim_grupo USING (sk_grupo) JOIN dim_item_configuracao USING (sk_item_configuracao)"""
TABLES = ["fact", *KEYS]
FACT = "* REPLACE (round(duration_hours, 6) AS duration_hours)"

SQL = {
    "daily_volume": sql(f"SELECT {VOLUME} FROM volume", "volume"),
    "daily_volume_all_scopes": sql(f"SELECT {VOLUME} FROM volume_all", "volume_all"),
    "daily_breakdown": sql(f"SELECT {BREAKDOWN} FROM breakdown", "breakdown"),
    "raw_scan": sql(f"SELECT {CSV} FROM silver", "silver"),
    "raw_round_trip": silver(f"{stamp('opened_at')} AS opened_at, duration_seconds"),
    "bronze_provenance": f"""
        SELECT o_orderkey, 'orders.parquet' AS _source_file, o_orderkey + 2 AS _source_row_number,
          {LOADED} AS _ingested_at_utc FROM orders""",
    "text_provenance": """
        SELECT o_orderkey, o_orderkey % 8 AS part,
          row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) + 1
            AS _source_row_number
        FROM orders""",
    "dirty_raw": f"""
        WITH o AS (
          SELECT o_orderkey AS k, o_orderdate::TIMESTAMP
            + to_seconds(o_orderkey * 7919 % 86400) AS ts FROM orders)
        SELECT k AS order_key,
          strftime(CASE k % 8 WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('minute', ts)
            WHEN 4 THEN ts + INTERVAL 250000 MICROSECOND WHEN 7 THEN NULL ELSE ts END,
            '%Y-%m-%d %H:%M:%S.%f') AS opened_at,
          CASE k % 9 WHEN 5 THEN 2 WHEN 6 THEN 4 WHEN 7 THEN k WHEN 8 THEN -k END AS duration_seconds,
          'line ' || k || chr(10) || 'and "' || k || '"' AS description
        FROM o""",
    "parquet_scan": "SELECT o_orderkey, o_orderpriority FROM orders",
    "optional_artifact": silver("CAST(NULL AS BIGINT) AS risk_score"),
    "rename_columns": sql(f"SELECT {RENAMED} FROM silver", "silver"),
    "rename_for_serving": sql(
        f"""SELECT {_raw_value("incident_id")} AS incident_number,
            {_raw_value("assigned_group")} AS "Grupo_designado",
            {_raw_value("parent_incident_id")} AS "Incidente_Pai",
            {_raw_value("kpi_breached_raw")} AS "KPI_Violado" FROM silver""",
        "silver",
    ),
    "clean_text": silver(", ".join(name for name in S.TEXT_COLUMNS if name != "incident_id")),
    "parse_dates": silver(", ".join(f"{stamp(name)} AS {name}" for name in S.DATE_COLUMNS)),
    "parse_duration": silver("duration_seconds"),
    "priority_parse": silver("priority_code, priority_label"),
    "flag_map": silver("entered_kpi_source, kpi_breached_source"),
    "derived_flags": silver("has_parent_incident, is_no_intervention, is_monitoring_opened"),
    "sla_lookup": silver("priority_code, CAST(sla_limit_seconds AS BIGINT) AS sla_limit_seconds"),
    "calendar_parts": silver(
        f"{day('opened_date')} AS opened_date, opened_year, opened_month, opened_day_of_week, "
        "opened_hour, round(duration_hours, 6) AS duration_hours"
    ),
    "duration_audit": silver(
        "calculated_duration_seconds, "
        "abs(duration_seconds - calculated_duration_seconds) AS duration_difference_seconds, "
        "abs(duration_seconds - calculated_duration_seconds) > 2 AS duration_mismatch"
    ),
    "kpi_rule_recalc": silver("entered_kpi_recalculated_raw, kpi_breached_recalculated_raw"),
    "rule_mismatch": silver(
        "entered_kpi_raw <> entered_kpi_recalculated_raw AS entered_kpi_rule_mismatch, "
        "kpi_breached_raw <> kpi_breached_recalculated_raw AS kpi_breached_rule_mismatch"
    ),
    "etl_derive": sql(
        f"""SELECT {_raw_value("incident_id")} AS incident_id,
            CAST(priority_code AS VARCHAR) AS priority_code, is_monitoring_opened AS is_monitoring,
            is_no_intervention, {LOADED} AS processed_at FROM silver""",
        "silver",
    ),
    "missing_token": silver(
        "coalesce(product, '__MISSING__') AS product, "
        "coalesce(category, 'Não informado') AS category"
    ),
    "critical_group": silver(
        "coalesce(product, '__MISSING__') || ' | ' || coalesce(category, '__MISSING__') "
        "|| ' | P' || priority_code AS critical_group"
    ),
    "coerce_flag": silver(
        "entered_kpi_raw = 'SIM' AS from_text, coalesce(kpi_breached_source, false) "
        "AS from_boolean, opened_hour <> 0 AS from_number"
    ),
    "normalize_level": f"SELECT event_id, {LEVELS} AS risk_level FROM events",
    "leakage_audit": sql(
        f"SELECT *, column_name IN ({FORBIDDEN}) AS forbidden FROM ({LEAKAGE})", "silver"
    ),
    "silver_checks": sql("SELECT * FROM checks", "checks"),
    "layer_table": silver(f"{stamp('opened_at')} AS opened_at") + " WHERE month(opened_at) <= 6",
    "schema_difference": sql(
        """SELECT 'status' AS column_name, 'missing' AS problem, NULL::BIGINT AS filled_rows
           UNION ALL SELECT 'extra', 'unexpected', count(product) FROM silver""",
        "silver",
    ),
    "quality_gate": sql(
        """SELECT 'clean' AS "table", quality_status AS gate, 0::BIGINT AS violations
           FROM (SELECT CASE WHEN sum(violations) FILTER (severity = 'blocking') > 0 THEN 'stopped'
             WHEN sum(violations) > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS quality_status
             FROM checks)
           UNION ALL SELECT 'broken', CASE WHEN n > 0 THEN 'stopped' ELSE 'passed' END, n
           FROM (SELECT count(*) AS n FROM silver WHERE day(opened_at) = 1)""",
        "checks",
    ),
    "quality_status": sql(
        """SELECT CASE WHEN sum(violations) FILTER (severity = 'blocking') > 0 THEN 'failed'
           WHEN sum(violations) > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS quality_status
           FROM checks""",
        "checks",
    ),
    "null_profile": sql(
        " UNION ALL ".join(
            f"SELECT '{n}' AS column_name, round(100.0 * count(*) FILTER ({n} IS NULL) "
            "/ count(*), 3)::DOUBLE AS null_percentage FROM silver"
            for n in S.COLUMN_MAP.values()
        ),
        "silver",
    ),
    "value_distribution": sql(
        " UNION ALL ".join(
            f"SELECT '{n}' AS column_name, {n} AS value, count(*) AS incident_count FROM silver "
            f"WHERE {n} IS NOT NULL GROUP BY 2"
            for n in ("priority_raw", "status", "entered_kpi_raw", "kpi_breached_raw")
        ),
        "silver",
    ),
    "monthly_volume": sql(
        """SELECT strftime(opened_at, '%Y-%m') AS year_month, count(*) AS incident_count
           FROM silver GROUP BY 1""",
        "silver",
    ),
    "duplicate_keys": sql(
        """SELECT count(*) - count(DISTINCT {'a': assigned_group, 'b': configuration_item})
           AS duplicate_keys FROM silver""",
        "silver",
    ),
    "gold_checks": sql(gold_rules("volume"), "volume", "breakdown"),
    "gold_checks_seeded": sql(gold_rules("spoiled_volume"), "spoiled_volume", "breakdown"),
    "reconciliation": sql(
        """SELECT scope AS priority_scope, n AS source_count,
             (SELECT CAST(sum(incident_count) AS BIGINT) FROM volume v
              WHERE v.priority_scope = scope) AS gold_count, true AS matches
           FROM (SELECT 'ALL' AS scope, count(*) AS n FROM silver
             UNION ALL SELECT 'P2', count(*) FROM silver WHERE priority_code = 2
             UNION ALL SELECT 'P3', count(*) FROM silver WHERE priority_code = 3)""",
        "volume",
    ),
    "volume_contract": sql(contract("volume"), "volume"),
    "volume_contract_seeded": sql(contract("spoiled_volume"), "spoiled_volume"),
    "continuous_series": sql(continuity("volume"), "volume"),
    "continuous_series_seeded": sql(continuity("spoiled_volume"), "spoiled_volume"),
    "serving_volume": sql(f"SELECT {VOLUME} FROM volume", "volume"),
    "serving_breakdown": sql(f"SELECT {BREAKDOWN} FROM breakdown", "breakdown"),
    "period_filter": sql(
        f"""SELECT {VOLUME} FROM volume
            WHERE reference_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'""",
        "volume",
    ),
    "period_presets": sql(
        """SELECT priority_scope, count(*) AS days, CAST(sum(incident_count) AS BIGINT) AS incident_count, preset
           FROM (SELECT *, max(reference_date) OVER () AS newest FROM volume) JOIN
             (VALUES ('7d', 7), ('14d', 14), ('30d', 30), ('regime', NULL), ('custom', NULL)) p(preset, n)
             ON CASE preset WHEN 'regime' THEN reference_date >= """
        + CUTOFF
        + """ WHEN 'custom' THEN true
               ELSE reference_date > newest - n * INTERVAL 1 DAY END
           GROUP BY 1, 4""",
        "volume",
    ),
    "narrow_dimensions": sql(
        """SELECT tabela, column_name, CASE tabela WHEN 'as_byte' THEN
             (SELECT count(*) FROM dim_item_configuracao WHERE sk_item_configuracao > 127)
             ELSE 0 END::BIGINT AS lost_values
           FROM (VALUES ('dim_tempo', ['sk_tempo', 'data', 'ano', 'mes', 'dia', 'dia_semana',
               'semana_ano', 'trimestre', 'fim_semana']),
             ('dim_prioridade', ['sk_prioridade', 'priority_code']), ('dim_produto', ['sk_produto']),
             ('dim_categoria', ['sk_categoria']), ('dim_grupo', ['sk_grupo']),
             ('dim_item_configuracao', ['sk_item_configuracao']),
             ('as_byte', ['sk_item_configuracao'])) v(tabela, names), unnest(names) u(column_name)""",
        "dim_item_configuracao",
    ),
    "root_events": sql(
        f"SELECT incident_id, {stamp('opened_at')} AS opened_at FROM roots", "roots"
    ),
    "cascade_sizes": sql(
        """SELECT parent_incident_id, count(*) AS cascade_size FROM silver
           WHERE parent_incident_id IS NOT NULL GROUP BY 1""",
        "silver",
    ),
    "active_items": sql(
        f"""
        SELECT {day("d")} AS day, CAST(CASE WHEN d <= last THEN n
          ELSE (SELECT count(DISTINCT configuration_item) FROM silver WHERE opened_date = last) END
          AS DOUBLE) AS active_items
        FROM (SELECT d, last, count(DISTINCT configuration_item) AS n
          FROM (SELECT CAST(unnest(generate_series(min(opened_date), max(opened_date)
              + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS DATE) AS d, max(opened_date) AS last FROM silver)
          LEFT JOIN silver ON opened_date = d GROUP BY 1, 2)""",
        "silver",
    ),
    "ranking_by_volume": ranking(
        "dimension_name = 'assigned_group'", "0", "2 DESC, 4 DESC, 2 DESC, 1", 10
    ),
    "ranking_by_breaches": ranking(
        "dimension_name = 'product' AND dimension_value NOT LIKE '%\\_\\_MISSING\\_\\_%' ESCAPE '\\'",
        "0",
        "4 DESC, 4 DESC, 2 DESC, 1",
        10,
    ),
    "ranking_by_rate": ranking(
        "dimension_name = 'configuration_item'",
        "3",
        "5 DESC NULLS LAST, 4 DESC, 2 DESC, 1",
        20,
    ),
    "rolling_means": sql(
        f"""SELECT {VOLUME}, round(rolling_mean_7, 6) AS rolling_mean_7,
            round(rolling_mean_30, 6) AS rolling_mean_30, day_of_week_number, day_of_week,
            year_month, is_weekend FROM features""",
        "features",
    ),
    "monthly_summary": sql(
        f"""SELECT year_month, priority_scope, count(DISTINCT reference_date) AS observed_days,
            round(avg(incident_count), 6) AS average_daily_incidents, {SUMS}, {SHARES}
            FROM features GROUP BY 1, 2""",
        "features",
    ),
    "weekday_summary": sql(
        """SELECT day_of_week_number, day_of_week, priority_scope,
             count(reference_date) AS observed_days,
             CAST(sum(incident_count) AS BIGINT) AS total_incidents,
             round(avg(incident_count), 6) AS average_incidents,
             median(incident_count)::DOUBLE AS median_incidents,
             max(incident_count) AS maximum_incidents
           FROM features GROUP BY 1, 2, 3""",
        "features",
    ),
    "peak_days": sql(
        f"""SELECT peak_rank, {VOLUME} FROM (
              SELECT *, row_number() OVER (PARTITION BY priority_scope
                ORDER BY incident_count DESC, reference_date) AS peak_rank FROM volume)
            WHERE peak_rank <= 10""",
        "volume",
    ),
    "regime_comparison": sql(
        f"""SELECT priority_scope, {REGIME} AS regime, count(*) AS observed_days,
              round(avg(incident_count), 6) AS average_daily_incidents,
              median(incident_count)::DOUBLE AS median_daily_incidents,
              round(stddev_samp(incident_count), 6) AS standard_deviation,
              round(quantile_cont(incident_count, 0.95), 6) AS p95_daily_incidents,
              max(incident_count) AS maximum_daily_incidents, {SUMS}, {SHARES}
            FROM volume WHERE reference_date >= {START} GROUP BY 1, 2""",
        "volume",
    ),
    "regime_ratio": sql("SELECT * FROM ratios", "ratios"),
    "zero_days": sql(
        """SELECT priority_scope, count(*) FILTER (incident_count = 0) AS zero_incident_days
           FROM volume GROUP BY 1""",
        "volume",
    ),
    "temporal_report": sql(
        f"""SELECT * FROM (
              SELECT priority_scope, {day("min(reference_date)")} AS reference_date_min,
                {day("max(reference_date)")} AS reference_date_max, count(*) AS daily_rows,
                count(DISTINCT strftime(reference_date, '%Y-%m')) AS monthly_rows,
                count(*) FILTER (incident_count = 0) AS zero_incident_days
              FROM volume GROUP BY 1) JOIN ratios USING (priority_scope)""",
        "ratios",
    ),
    "series_anatomy": sql(
        f"""SELECT priority_scope, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS std,
              round(stddev_samp(y) / avg(y), 6) AS cv,
              round(var_samp(y) / avg(y), 6) AS variance_to_mean,
              {correlation("y1")} AS acf_1, {correlation("y7")} AS acf_7,
              round(avg(y) FILTER (isodow(reference_date) >= 6)
                / avg(y) FILTER (isodow(reference_date) < 6), 6) AS weekend_to_weekday
            FROM (SELECT *, incident_count::DOUBLE AS y, lag(y, 1) OVER w AS y1,
                lag(y, 7) OVER w AS y7
              FROM volume WINDOW w AS (PARTITION BY priority_scope ORDER BY reference_date))
            GROUP BY 1""",
        "volume",
    ),
    "regime_decomposition": sql(
        f"""SELECT cut, round(mean_before, 6) AS mean_before, round(mean_after, 6) AS mean_after,
            round(mean_after / nullif(mean_before, 0), 6) AS ratio FROM ({DECOMPOSED})""",
        "volume",
    ),
    "dedup_effect": sql(
        """SELECT * FROM (SELECT priority_scope, max(incident_count) AS maximum_raw,
              round(stddev_samp(incident_count) / avg(incident_count), 6) AS cv_raw
            FROM volume GROUP BY 1)
          JOIN (SELECT priority_scope, max(incident_count) AS maximum_root,
              round(stddev_samp(incident_count) / avg(incident_count), 6) AS cv_root
            FROM root_volume GROUP BY 1) USING (priority_scope)""",
        "volume",
        "root_volume",
    ),
    "dim_time": sql(f"SELECT * REPLACE ({day('data')} AS data) FROM dim_tempo", "dim_tempo"),
    "dim_priority": sql("SELECT * FROM dim_prioridade", "dim_prioridade"),
    "dim_product": sql("SELECT * FROM dim_produto", "dim_produto"),
    "dim_category": sql("SELECT * FROM dim_categoria", "dim_categoria"),
    "dim_group": sql("SELECT * FROM dim_grupo", "dim_grupo"),
    "dim_item": sql("SELECT * FROM dim_item_configuracao", "dim_item_configuracao"),
    "fact_incident": sql(f"SELECT {FACT} FROM fact", "fact"),
    "warehouse_checks": sql(warehouse_checks(), "fact", "dim_tempo"),
    "warehouse_checks_seeded": sql(
        warehouse_checks(
            "spoiled_fact", dim_prioridade="spoiled_prioridade", dim_categoria="spoiled_categoria"
        ),
        "spoiled_fact",
        "spoiled_prioridade",
        "spoiled_categoria",
        "dim_tempo",
    ),
    "orphan_check": sql(ORPHANS, "fact", "dim_tempo"),
    "table_counts": sql(
        " UNION ALL ".join(
            f"SELECT '{'fato_incidente' if n == 'fact' else n}' AS tabela, "
            f"count(*) AS registros FROM {n}"
            for n in TABLES
        ),
        "fact",
        "dim_tempo",
    ),
    "grain_check": sql(
        """SELECT count(*) AS total_incidentes, count(DISTINCT incident_id)
           AS incidentes_distintos FROM fact""",
        "fact",
    ),
    "incidents_by_priority": sql(
        """SELECT priority_code, priority_label, count(*) AS quantidade_incidentes
           FROM silver GROUP BY 1, 2""",
        "silver",
    ),
    "incidents_by_year": sql(
        "SELECT opened_year AS ano, count(*) AS quantidade_incidentes FROM silver GROUP BY 1",
        "silver",
    ),
    "top_products": sql(
        """SELECT product AS produto, count(*) AS quantidade_incidentes FROM informed
           GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
        "informed",
    ),
    "top_groups": sql(
        """SELECT assigned_group AS grupo, count(*) AS quantidade_incidentes FROM informed
           GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
        "informed",
    ),
    "kpi_by_priority": sql(
        """SELECT priority_label, count(*) FILTER (entered_kpi_raw = 'SIM') AS incidentes_em_kpi,
           count(*) FILTER (kpi_breached_raw = 'SIM') AS kpis_violados FROM silver GROUP BY 1""",
        "silver",
    ),
    "star_join": sql(STAR, "fact", "dim_tempo"),
    "incident_summary": sql("SELECT count(*) AS total_incidents FROM fact", "fact"),
    "narrow_types": sql(
        # Half up to hundredths of an hour, in whole numbers.
        "SELECT * REPLACE (((duration_seconds * 200 + 3600) // 7200) / 100.0::DOUBLE "
        "AS duration_hours) FROM fact",
        "fact",
    ),
    "narrowing_losses": sql(
        """SELECT n AS column_name, CASE WHEN n = 'qtd_incidente' THEN
             (SELECT count(*) FROM fact WHERE sk_item_configuracao > 127) ELSE 0 END::BIGINT
             AS lost_values
           FROM (SELECT unnest(['incident_id', 'sk_tempo', 'sk_prioridade', 'sk_produto',
             'sk_categoria', 'sk_grupo', 'sk_item_configuracao', 'qtd_incidente',
             'duration_seconds', 'duration_hours', 'entered_kpi', 'kpi_breached',
             'is_monitoring_opened', 'is_no_intervention', 'opened_hour']) AS n)""",
        "fact",
    ),
}
