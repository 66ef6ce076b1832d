"""Shared parts of the checking SQL: the incident tables as DuckDB subqueries."""

from __future__ import annotations

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (body, needs)


def sql(body: str, *needs: str) -> str:
    """``body`` with the subqueries it needs, each once and in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in CTES[name][1]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    # A subquery that reads itself makes the whole recursive.
    recursive = any(f"FROM {n} " in CTES[n][0] for n in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in ordered) + "\n" + body


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def day(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


SLA = """CASE priority_code WHEN 1 THEN 14400 WHEN 2 THEN 14400 WHEN 3 THEN 43200
         WHEN 4 THEN 86400 WHEN 5 THEN 345600 END"""

cte(
    "order_base",
    """
    SELECT o_orderkey AS k, printf('INC%07d', o_orderkey) AS incident_id,
      substr(o_orderpriority, 1, 1) || ' - ' || substr(o_orderpriority, 3) AS priority_raw,
      CASE WHEN o_custkey % 10 >= 6 THEN c_mktsegment END AS product,
      CASE WHEN o_custkey % 10 >= 6 THEN 'cat' || (o_custkey % 7) END AS category,
      CASE WHEN o_custkey % 10 >= 6 THEN 'sub' || (o_custkey % 13) END AS subcategory,
      'Team' || (c_nationkey % 17) AS assigned_group,
      'IC' || o_custkey AS configuration_item,
      o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR
        + (o_orderkey % 60) * INTERVAL 1 MINUTE AS opened_at,
      (o_orderkey * 7919) % 50000 AS duration_seconds,
      CASE WHEN o_orderkey % 5 > 0 THEN 'code' || (o_orderkey % 4) END AS closure_code,
      'Incidente ' || o_orderpriority AS short_description,
      CASE WHEN o_orderkey % 7 > 0 THEN
        CASE WHEN o_orderkey % 2 = 0 THEN 'Definitiva' ELSE 'Contorno' END END AS solution_type,
      CASE WHEN o_orderstatus = 'O' THEN 'Monitoramento' ELSE 'Manual' END AS opened_by,
      CASE WHEN o_orderkey % 8 = 0 THEN printf('INC%07d', o_orderkey - o_orderkey % 100 + 1) END
        AS parent_incident_id,
      CASE WHEN o_orderstatus = 'P' AND substr(o_orderpriority, 1, 1) >= '4'
        THEN 'Sem Intervenção' ELSE 'Encerrado' END AS status,
      CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority_code,
      substr(o_orderpriority, 3) AS priority_label
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
cte(
    "order_rules",
    f"""
    SELECT *, {SLA} AS sla_limit_seconds,
      CASE WHEN k % 3 = 0 THEN opened_at + duration_seconds * INTERVAL 1 SECOND END AS resolved_at,
      opened_at + (duration_seconds + CASE WHEN k % 3 = 0 THEN 600 ELSE 0 END
        + CASE WHEN k % 250 = 1 THEN 3 ELSE 0 END) * INTERVAL 1 SECOND AS closed_at,
      priority_code <= 3 AND parent_incident_id IS NULL AND status <> 'Sem Intervenção' AS entry,
      duration_seconds > {SLA} AS over, k % 500 = 0 AS flip
    FROM order_base""",
    "order_base",
)
cte(
    "silver",
    f"""
    SELECT *,
      entered_kpi_raw = 'SIM' AS entered_kpi_source,
      CASE kpi_breached_raw WHEN 'SIM' THEN true WHEN 'NAO' THEN false END AS kpi_breached_source,
      parent_incident_id IS NOT NULL AS has_parent_incident,
      status = 'Sem Intervenção' AS is_no_intervention,
      opened_by = 'Monitoramento' AS is_monitoring_opened,
      duration_seconds / 3600.0::DOUBLE AS duration_hours,
      CAST(opened_at AS DATE) AS opened_date,
      year(opened_at) AS opened_year, month(opened_at) AS opened_month,
      isodow(opened_at) - 1 AS opened_day_of_week, hour(opened_at) AS opened_hour,
      epoch_us(coalesce(resolved_at, closed_at)) / 1e6 - epoch_us(opened_at) / 1e6
        AS calculated_duration_seconds,
      CASE WHEN entry THEN 'SIM' ELSE 'NAO' END AS entered_kpi_recalculated_raw,
      CASE WHEN NOT entry THEN 'N/A' WHEN over THEN 'SIM' ELSE 'NAO' END
        AS kpi_breached_recalculated_raw
    FROM (
      SELECT *,
        CASE WHEN entry <> flip THEN 'SIM' ELSE 'NAO' END AS entered_kpi_raw,
        CASE WHEN NOT entry AND NOT flip THEN 'N/A' WHEN over <> flip THEN 'SIM' ELSE 'NAO' END
          AS kpi_breached_raw
      FROM order_rules)""",
    "order_rules",
)
cte(
    "event_silver",
    f"""
    SELECT *, CASE WHEN priority_code <= 3 THEN duration_seconds > {SLA} END
        AS kpi_breached_source,
      opened_at + duration_seconds * INTERVAL 1 SECOND AS closed_at,
      epoch_us(opened_at) AS us, epoch_us(opened_at) + duration_seconds * 1000000 AS closed_us
    FROM (
      SELECT event_id, printf('INC%07d', event_id) AS incident_id, 1 + event_id % 5 AS priority_code,
        CASE WHEN user_id % 4 <> 0 THEN 'prod' || (user_id % 5) END AS product,
        event_type AS category, 'sub' || (user_id % 3) AS subcategory,
        'Team' || (user_id % 17) AS assigned_group, 'IC' || user_id AS configuration_item,
        ts AS opened_at, CAST(floor(value * 100) AS BIGINT) AS duration_seconds,
        CASE WHEN event_id % 3 = 0 THEN 'Monitoramento' ELSE 'Manual' END AS opened_by,
        1 + event_id % 5 <= 3 AS entered_kpi_source
      FROM events)""",
)


def volume_cte(name: str, source: str, scopes: dict[str, int | None]) -> None:
    """Zero-filled daily counts of ``source`` per scope."""
    listed = ", ".join(f"('{s}', {'NULL' if c is None else c})" for s, c in scopes.items())
    cte(
        name,
        f"""
        SELECT d AS reference_date, s.scope AS priority_scope,
          count(f.incident_id) AS incident_count,
          count(*) FILTER (f.entered_kpi_source) AS entered_kpi_count,
          count(*) FILTER (f.kpi_breached_source) AS kpi_breach_count,
          count(*) FILTER (f.is_monitoring_opened) AS monitoring_incident_count,
          count(*) FILTER (f.is_no_intervention) AS no_intervention_count
        FROM (SELECT CAST(unnest(generate_series(min(opened_date), max(opened_date),
                INTERVAL 1 DAY)) AS DATE) AS d FROM {source})
        CROSS JOIN (VALUES {listed}) s(scope, code)
        LEFT JOIN {source} f ON f.opened_date = d AND (s.code IS NULL OR f.priority_code = s.code)
        GROUP BY ALL""",
        source,
    )


cte("roots", "SELECT * FROM silver WHERE parent_incident_id IS NULL", "silver")
GOLD = {"ALL": None, "P2": 2, "P3": 3}
EVERY = {"ALL": None, "P1": 1, "P2": 2, "P3": 3, "P4": 4, "P5": 5}
volume_cte("volume", "silver", GOLD)
volume_cte("volume_all", "silver", EVERY)
volume_cte("root_volume", "roots", GOLD)
cte(
    "breakdown",
    """
    SELECT opened_date AS reference_date, x.n AS dimension_name, x.v AS dimension_value,
      s.scope AS priority_scope, count(*) AS incident_count,
      count(*) FILTER (entered_kpi_source) AS entered_kpi_count,
      count(*) FILTER (kpi_breached_source) AS kpi_breach_count
    FROM (SELECT *, unnest([
        {'n': 'assigned_group', 'v': coalesce(assigned_group, '__MISSING__')},
        {'n': 'product', 'v': coalesce(product, '__MISSING__')},
        {'n': 'category', 'v': coalesce(category, '__MISSING__')},
        {'n': 'configuration_item', 'v': coalesce(configuration_item, '__MISSING__')},
        {'n': 'critical_group', 'v': coalesce(product, '__MISSING__') || ' | '
          || coalesce(category, '__MISSING__') || ' | P' || priority_code},
        {'n': 'parent_incident_id', 'v': coalesce(parent_incident_id, '__MISSING__')}]) AS x
      FROM silver)
    JOIN (VALUES ('ALL', NULL), ('P2', 2), ('P3', 3)) s(scope, code)
      ON s.code IS NULL OR priority_code = s.code
    GROUP BY ALL""",
    "silver",
)
