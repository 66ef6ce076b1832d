"""Checking SQL of the operational queries."""

from __future__ import annotations

import workload.oracle_risk  # noqa: F401  (defines the score subqueries)
from workload.oracle_base import cte, day, sql, stamp
from workload.oracle_forecasts import NEWEST

cte(
    "alerting",
    """SELECT *, event_id FROM points JOIN (SELECT incident_id, event_id FROM event_silver)
       USING (incident_id) WHERE risk_level IN ('alto', 'crítico')""",
    "points",
    "event_silver",
)


def periods(start: str, end: str, before: str, days: int, comparable: bool) -> str:
    change = "100.0::DOUBLE * (now - past) / nullif(past, 0)" if comparable else "NULL::DOUBLE"
    return sql(
        f"""SELECT priority_scope, now AS incident_count, round(now / {days}.0::DOUBLE, 6)
              AS daily_average, past AS previous_count, breaches AS kpi_breach_count,
              {str(comparable).lower()} AS comparable, round({change}, 6) AS change_pct
            FROM (SELECT priority_scope,
                CAST(sum(incident_count) FILTER (reference_date >= {start}) AS BIGINT) AS now,
                CAST(sum(incident_count) FILTER (reference_date < {start}) AS BIGINT) AS past,
                CAST(sum(kpi_breach_count) FILTER (reference_date >= {start}) AS BIGINT) AS breaches
              FROM volume WHERE reference_date BETWEEN {before} AND {end} GROUP BY 1)""",
        "volume",
    )


def changed(status: str, version: int) -> str:
    one = f"CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE {status} END"
    return one if version == 1 else f"CASE WHEN o_orderkey % 5 = 0 THEN 'Y' ELSE {one} END"


def hashed(status: str) -> str:
    record = """'{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' """
    return f"""sha256({record} || {status} || '"}}')"""


cte(
    "snapshots",
    """
    SELECT strftime(d, '%Y%m%d') AS snapshot_id, d::TIMESTAMP + INTERVAL 3 HOUR AS created_at,
      CASE WHEN date_diff('day', min(d) OVER (), d) % 6 = 0 THEN 'full' ELSE 'incremental' END
        AS mode
    FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)""",
)
SCOPED = "o_orderkey % 10 <> 0"

SQL = {
    "period_over_period": periods(
        "DATE '2001-03-01'", "DATE '2001-05-31'", "DATE '2000-11-29'", 92, True
    ),
    "period_across_regimes": periods(
        "DATE '2000-01-01'", "DATE '2000-06-30'", "DATE '1999-07-03'", 182, False
    ),
    "regime_days": sql(
        """SELECT CASE WHEN reference_date < DATE '1998-01-01' THEN 'base'
             WHEN reference_date < DATE '2000-01-01' THEN 'transition' ELSE 'current' END AS regime,
             count(*) AS days, CAST(sum(incident_count) AS BIGINT) AS incident_count
           FROM volume WHERE priority_scope = 'ALL' GROUP BY 1""",
        "volume",
    ),
    "alert_rules": sql(
        f"""
        SELECT severity, rule, round(value, 6) AS value,
          list_position(['crítico', 'sério', 'atenção'], severity)::BIGINT AS severity_rank
        FROM (
          SELECT CASE horizon WHEN 'D+1' THEN 'crítico' ELSE 'sério' END AS severity,
            'forecast_above_mean ' || horizon AS rule, predicted_incident_count AS value
          FROM ({NEWEST.format("published")}) WHERE priority_scope = 'ALL'
            AND predicted_incident_count > (SELECT sum(incident_count) / 92.0::DOUBLE FROM volume
              WHERE priority_scope = 'ALL' AND reference_date
                BETWEEN DATE '2001-03-01' AND DATE '2001-05-31')
          UNION ALL SELECT 'crítico', 'critical_incidents',
            count(*) FILTER (risk_level = 'crítico') FROM points
          UNION ALL SELECT 'atenção', 'score_above_threshold',
            count(*) FILTER (risk_score >= 70) FROM points
          UNION ALL SELECT 'sério', 'recent_breaches', sum(kpi_breach_count) FROM volume
            WHERE priority_scope = 'ALL' AND reference_date
              >= (SELECT max(reference_date) FROM volume) - INTERVAL 6 DAY)
        WHERE value > 0""",
        "published",
        "volume",
        "points",
    ),
    "latest_score_per_incident": sql(
        """SELECT incident_id, strftime(TIMESTAMP '2026-01-01' + CASE WHEN event_id % 3 = 0 THEN 2
               WHEN event_id % 2 = 0 THEN 1 ELSE 0 END * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S.%f')
             AS scored_at,
             risk_score + CASE WHEN event_id % 3 <> 0 AND event_id % 2 = 0 THEN 1 ELSE 0 END
               AS risk_score, risk_level
           FROM points JOIN (SELECT incident_id, event_id FROM event_silver) USING (incident_id)""",
        "points",
        "event_silver",
    ),
    "snapshot_diff": f"""
        SELECT 'orders/' || o_orderkey AS archive_path,
          CASE WHEN o_orderkey % 10 <> 0 THEN {hashed(changed("o_orderstatus", 1))} END AS sha256,
          CASE WHEN o_orderkey % 10 = 0 THEN 'deleted' WHEN o_orderkey % 13 = 0 THEN 'added'
            ELSE 'changed' END AS change
        FROM orders WHERE CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey % 10 <> 0
          ELSE o_orderkey % 10 = 0 OR {changed("o_orderstatus", 1)} <> o_orderstatus END""",
    "mode_select": sql(
        f"""SELECT snapshot_id, mode, {stamp("created_at")} AS created_at,
              CASE WHEN last IS NULL OR created_at >= last + INTERVAL 7 DAY THEN 'full'
                ELSE 'incremental' END AS automatic_mode
            FROM (SELECT *, max(created_at) FILTER (mode = 'full') OVER (ORDER BY created_at
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM snapshots)""",
        "snapshots",
    ),
    "retention": sql(
        f"""SELECT snapshot_id, mode, {stamp("created_at")} AS created_at FROM snapshots
            WHERE created_at < TIMESTAMP '2024-01-21' AND snapshot_id <> '20240105'
              AND snapshot_id <> (SELECT max(snapshot_id) FROM snapshots WHERE mode = 'full')""",
        "snapshots",
    ),
    "replay": f"""
        SELECT 'orders/' || o_orderkey AS archive_path,
          {hashed(changed("o_orderstatus", 2))} AS sha256 FROM orders
        WHERE {SCOPED} AND o_orderkey % 11 <> 0""",
    # Both sides are written out in SQL and compared.
    "replay_parity": f"""
        WITH table_state AS (
          SELECT o_orderkey, {hashed(changed("o_orderstatus", 2))} AS h FROM orders
          WHERE {SCOPED} AND o_orderkey % 11 <> 0),
        replayed AS (
          SELECT o_orderkey, arg_max(h, n) AS h, arg_max(gone, n) AS gone FROM (
            SELECT o_orderkey, 0 AS n, {hashed("o_orderstatus")} AS h, false AS gone FROM orders
              WHERE o_orderkey % 13 <> 0
            UNION ALL SELECT o_orderkey, 1, {hashed(changed("o_orderstatus", 1))},
              o_orderkey % 10 = 0 FROM orders
            UNION ALL SELECT o_orderkey, 2, {hashed(changed("o_orderstatus", 2))},
              o_orderkey % 11 = 0 FROM orders WHERE {SCOPED})
          GROUP BY 1)
        SELECT count(*) AS differences FROM table_state t
          FULL JOIN (SELECT * FROM replayed WHERE NOT gone) r ON t.o_orderkey = r.o_orderkey
        WHERE t.h IS DISTINCT FROM r.h""",
    "integrity_check": f"""
        SELECT 'orders/' || o_orderkey AS archive_path,
          CASE WHEN o_orderkey % 10 = 0 THEN 'missing' ELSE 'checksum_mismatch' END AS reason
        FROM orders WHERE o_orderkey % 13 <> 0
          AND (o_orderkey % 10 = 0 OR {changed("o_orderstatus", 1)} <> o_orderstatus)""",
    "table_manifest": "SELECT 'lineitem.parquet' AS archive_path, count(*) AS row_count "
    "FROM lineitem",
    "partitioned_run": sql(
        f"""SELECT {day("reference_date")} AS reference_date, priority_scope, 'run-2' AS run_id,
            incident_count FROM volume WHERE incident_count > 5""",
        "volume",
    ),
    "versioned_publish": sql(
        """SELECT incident_id, risk_score, 'v2' AS model_version FROM points
           WHERE risk_score > 50""",
        "points",
    ),
    "replace_table": sql(
        f"""SELECT * REPLACE ({day("reference_date")} AS reference_date) FROM volume
            WHERE priority_scope = 'P2'""",
        "volume",
    ),
    "csv_export": sql(
        f"""SELECT {day("reference_date")} AS reference_date, priority_scope,
              ['Segunda', 'Terça', 'Quarta', 'Quinta', 'Sexta', 'Sábado', 'Domingo']
                [isodow(reference_date)] AS day_of_week,
              CAST(incident_count AS VARCHAR) AS incident_count FROM volume""",
        "volume",
    ),
    "run_audit": """
        SELECT 'orders' AS run_id, 'load' AS action, count(*) AS processed_records FROM orders
        UNION ALL SELECT 'nation', 'load', count(*) FROM nation""",
    "alert_messages": sql(
        """SELECT incident_id, 'ola_risk_alert' AS event_type, risk_level, risk_score,
           9::BIGINT AS fields FROM alerting""",
        "alerting",
    ),
    "valid_alerts": sql(
        """SELECT incident_id, risk_score, risk_level FROM alerting
           WHERE event_id % 10 NOT IN (1, 2, 5, 6)""",
        "alerting",
    ),
    "dead_letters": sql(
        """SELECT CASE event_id % 10 WHEN 1 THEN 'not_json' WHEN 2 THEN 'unknown_field'
             WHEN 5 THEN 'risk_score' ELSE 'missing_field' END AS reject_reason,
             count(*) AS messages
           FROM alerting WHERE event_id % 10 IN (1, 2, 5, 6) GROUP BY 1""",
        "alerting",
    ),
}
