"""Checking SQL of the risk queries."""

from __future__ import annotations

from faultline import schema as S
from faultline.operators.metrics import FIXED_THRESHOLDS, QUANTILE_RANGE
from workload.oracle_base import cte, sql, stamp

DAY_US = 86_400_000_000
SCORED = "'2026-01-01 00:00:00.000000'"


def prior(key: str, days: int) -> str:
    name = key.removesuffix("_code")
    return (
        f"count(*) OVER (PARTITION BY {key} ORDER BY us RANGE BETWEEN {days * DAY_US} PRECEDING "
        f"AND 1 PRECEDING) AS {name}_incidents_previous_{days}d"
    )


PRIORS = [
    prior("assigned_group", 1),
    prior("assigned_group", 7),
    prior("assigned_group", 30),
    prior("product", 7),
    prior("category", 7),
    prior("priority_code", 7),
]
cte("prior", f"SELECT *, {', '.join(PRIORS)} FROM event_silver", "event_silver")
cte(
    "outcomes",
    f"""
    SELECT o.incident_id, count(c.incident_id) AS assigned_group_known_outcomes_previous_30d,
      count(*) FILTER (c.kpi_breached_source) AS assigned_group_breaches_previous_30d,
      count(*) FILTER (c.kpi_breached_source) / nullif(count(c.incident_id), 0)::DOUBLE
        AS assigned_group_breach_rate_previous_30d
    FROM event_silver o LEFT JOIN event_silver c
      ON c.assigned_group IS NOT DISTINCT FROM o.assigned_group AND c.entered_kpi_source
      AND c.closed_us >= o.us - {30 * DAY_US} AND c.closed_us < o.us
    GROUP BY 1""",
    "event_silver",
)
cte(
    "features",
    """
    SELECT p.*, hour(opened_at) AS opened_hour, isodow(opened_at) - 1 AS opened_day_of_week,
      month(opened_at) AS opened_month, CAST(isodow(opened_at) >= 6 AS BIGINT) AS is_weekend,
      o.* EXCLUDE (incident_id)
    FROM prior p JOIN outcomes o USING (incident_id)""",
    "prior",
    "outcomes",
)
WEEK = "date_trunc('week', opened_at)"
cte(
    "split",
    f"""
    SELECT *, CASE WHEN entered_kpi_source AND {WEEK} <= date_trunc('week', DATE '2024-01-21')
        THEN 'pretest_train'
      WHEN entered_kpi_source AND {WEEK} >= date_trunc('week', DATE '2024-01-22')
        THEN 'final_test' ELSE 'not_eligible' END AS dataset_split
    FROM features""",
    "features",
)
cte("training", "SELECT * FROM split WHERE dataset_split = 'pretest_train'", "split")
cte(
    "scored",
    """
    SELECT incident_id, opened_at, priority_code,
      ((event_id * 7919) % 10007) / 10007.0::DOUBLE AS probability,
      CAST(kpi_breached_source AS INTEGER) AS label
    FROM event_silver WHERE entered_kpi_source""",
    "event_silver",
)
cte(
    "indexed",
    """
    SELECT s.*, (SELECT count(*) FROM scored r WHERE r.opened_at < TIMESTAMP '2024-01-15'
        AND r.probability <= s.probability)
      / (SELECT count(*) FROM scored WHERE opened_at < TIMESTAMP '2024-01-15')::DOUBLE
      AS predictive_risk_index
    FROM scored s""",
    "scored",
)
LEVEL = """CASE WHEN risk_score <= 39 THEN 'baixo' WHEN risk_score <= 59 THEN 'moderado'
  WHEN risk_score <= 79 THEN 'alto' ELSE 'crítico' END"""
ACTION = "CASE risk_level " + " ".join(
    f"WHEN '{level}' THEN '{text}'" for level, text in S.RECOMMENDED_ACTIONS.items()
) + " END"
cte(
    "points",
    f"""
    SELECT *, {ACTION} AS recommended_action FROM (
      SELECT *, {LEVEL} AS risk_level FROM (
        SELECT *, CAST(least(greatest(floor((predictive_risk_index * 0.80::DOUBLE
            + priority_impact * 0.15::DOUBLE + operational_pressure * 0.05::DOUBLE) * 100 + 0.5),
            0), 100) AS BIGINT) AS risk_score
        FROM (
          SELECT incident_id, {SCORED} AS scored_at, 'stand-in' AS model_version,
            probability AS breach_probability, predictive_risk_index,
            CASE i.priority_code WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 WHEN 3 THEN 0.6 END::DOUBLE
              AS priority_impact,
            least(assigned_group_incidents_previous_1d / 40.0::DOUBLE, 1) AS operational_pressure,
            'prioridade' AS top_risk_factors
          FROM indexed i JOIN prior USING (incident_id))))""",
    "indexed",
    "prior",
)
POINTS = "* REPLACE (" + ", ".join(
    f"round({n}, 6) AS {n}"
    for n in ("breach_probability", "predictive_risk_index", "priority_impact", "operational_pressure")
) + ")"
cte("ranked", "SELECT *, row_number() OVER (ORDER BY probability DESC, opened_at, incident_id) - 1 "
    "AS position FROM scored", "scored")
cte(
    "histogram",
    """
    SELECT probability, count(*) AS n, sum(label) AS pos,
      sum(count(*)) OVER (ORDER BY probability DESC) AS upto,
      sum(sum(label)) OVER (ORDER BY probability DESC) AS hits
    FROM scored GROUP BY 1""",
    "scored",
)
LOW, HIGH, STEPS = QUANTILE_RANGE
SHARES = ", ".join(repr(LOW + (HIGH - LOW) * i / (STEPS - 1)) for i in range(STEPS))
FIXED = ", ".join(f"{t!r}::DOUBLE" for t in FIXED_THRESHOLDS)
cte(
    "thresholds",
    f"""
    SELECT t AS threshold, coalesce(tp / nullif(chosen, 0)::DOUBLE, 0) AS precision,
      coalesce(tp / nullif(positives, 0)::DOUBLE, 0) AS recall,
      coalesce(2 * tp / nullif(chosen + positives, 0)::DOUBLE, 0) AS f1
    FROM (SELECT t, count(*) FILTER (probability >= t) AS chosen,
        count(*) FILTER (probability >= t AND label = 1) AS tp, sum(label) AS positives
      FROM scored CROSS JOIN (SELECT unnest([{FIXED}]) AS t UNION
        SELECT unnest(quantile_cont(probability, [{SHARES}])) FROM scored) GROUP BY t)""",
    "scored",
)
THRESHOLD = ", ".join(f"round({n}, 6) AS {n}" for n in ("threshold", "precision", "recall", "f1"))
METRICS = """
    SELECT 0.5::DOUBLE AS threshold, true_negative, false_positive, false_negative, true_positive,
      round(brier, 6) AS brier_score,
      round(true_positive / (true_positive + false_positive)::DOUBLE, 6) AS precision,
      round(true_positive / (true_positive + false_negative)::DOUBLE, 6) AS recall,
      round(2 * true_positive / (2 * true_positive + false_positive + false_negative)::DOUBLE, 6)
        AS f1,
      round((SELECT avg(CASE WHEN a.probability > b.probability THEN 1
          WHEN a.probability = b.probability THEN 0.5 ELSE 0 END)
        FROM scored a, scored b WHERE a.label = 1 AND b.label = 0), 6) AS roc_auc,
      round((SELECT sum(pos * hits / upto::DOUBLE) / sum(pos) FROM histogram), 6) AS pr_auc
    FROM (SELECT count(*) FILTER (probability < 0.5 AND label = 0) AS true_negative,
        count(*) FILTER (probability >= 0.5 AND label = 0) AS false_positive,
        count(*) FILTER (probability < 0.5 AND label = 1) AS false_negative,
        count(*) FILTER (probability >= 0.5 AND label = 1) AS true_positive,
        avg((probability - label) ** 2) AS brier FROM scored)"""
TOPK = """
    SELECT f AS requested_fraction, k AS rows_reviewed, round(k / total::DOUBLE, 6)
        AS actual_fraction, hits AS positives_found, round(hits / k::DOUBLE, 6) AS precision_at_k,
      round(hits / positives::DOUBLE, 6) AS recall_at_k,
      round((hits / k::DOUBLE) / (positives / total::DOUBLE), 6) AS lift_vs_base_rate
    FROM (SELECT f, k, any_value(total) AS total, count(*) FILTER (label = 1) AS positives,
        count(*) FILTER (label = 1 AND position < k) AS hits
      FROM ranked, (SELECT f, total, CAST(greatest(ceil(total * f), 1) AS BIGINT) AS k
        FROM (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE]) AS f),
          (SELECT count(*) AS total FROM scored)) GROUP BY f, k)"""
LIFT = """
    SELECT decile, row_count, positives, round(positives / row_count::DOUBLE, 6) AS precision,
      round((positives / row_count::DOUBLE)
        / (sum(positives) OVER () / sum(row_count) OVER ()::DOUBLE), 6) AS lift_vs_base_rate,
      round(sum(positives) OVER (ORDER BY decile) / sum(positives) OVER ()::DOUBLE, 6)
        AS cumulative_recall,
      round(lo, 6) AS probability_min, round(hi, 6) AS probability_max
    FROM (SELECT position * 10 // (SELECT count(*) FROM scored) + 1 AS decile,
        count(*) AS row_count, count(*) FILTER (label = 1) AS positives,
        min(probability) AS lo, max(probability) AS hi FROM ranked GROUP BY 1)"""
SUMMARY = """
    SELECT round(min(probability), 6) AS minimum,
      round(quantile_cont(probability, 0.05), 6) AS p05,
      round(quantile_cont(probability, 0.5), 6) AS p50,
      round(quantile_cont(probability, 0.95), 6) AS p95,
      round(max(probability), 6) AS maximum, round(avg(probability), 6) AS mean FROM scored"""
ROUNDED = ["assigned_group_breach_rate_previous_30d"]
FEATURES = ", ".join(
    f"round({n}, 6) AS {n}" if n in ROUNDED else n for n in S.MODEL_FEATURES
)
NUMBERS = " UNION ALL ".join(
    f"""SELECT '{n}' AS feature, round(any_value(m), 6) AS median,
        round(avg(coalesce({n}, m)), 6) AS mean, round(stddev_pop(coalesce({n}, m)), 6) AS deviation
        FROM training, (SELECT median({n})::DOUBLE AS m FROM training)"""
    for n in S.NUMERIC_FEATURES
)
CATEGORIES = " UNION ALL ".join(
    f"""SELECT '{n}' AS feature, category, n, place FROM (
          SELECT *, row_number() OVER (ORDER BY n DESC, category) AS place, count(*) OVER () AS size
          FROM (SELECT coalesce(CAST({n} AS VARCHAR), '__MISSING__') AS category, count(*) AS n
            FROM training GROUP BY 1))
        WHERE place <= CASE WHEN size > 100 THEN 99 ELSE 100 END"""
    for n in S.CATEGORICAL_FEATURES
)
TEXT_FACTORS = ["product", "category", "assigned_group", "configuration_item", "opened_by"]
TYPICAL = " UNION ALL ".join(
    f"""(SELECT '{n}' AS feature, {n} AS text, CAST(NULL AS DOUBLE) AS number FROM training
        WHERE {n} IS NOT NULL GROUP BY {n} ORDER BY count(*) DESC, {n} LIMIT 1)"""
    if n in TEXT_FACTORS
    else f"SELECT '{n}' AS feature, NULL AS text, round(median({n})::DOUBLE, 6) AS number FROM training"
    for n in S.FACTOR_LABELS
)
AUDIT = " UNION ALL ".join(
    f"""SELECT count(*) FILTER (entered_kpi_source) AS eligible_rows,
          count(*) FILTER (entered_kpi_source AND kpi_breached_source) AS positive_targets,
          '{name}_rule_mismatch' AS rule, true AS column_present,
          count(*) FILTER ({name}_raw <> {name}_recalculated_raw) AS mismatches_total,
          count(*) FILTER (entered_kpi_source AND {name}_raw <> {name}_recalculated_raw)
            AS mismatches_eligible,
          count(*) FILTER (entered_kpi_source AND kpi_breached_source
            AND {name}_raw <> {name}_recalculated_raw) AS mismatches_among_positive_targets
        FROM silver"""
    for name in ("entered_kpi", "kpi_breached")
)
FORMULA = """least(greatest(floor((predictive_risk_index * 0.80::DOUBLE + priority_impact
  * 0.15::DOUBLE + operational_pressure * 0.05::DOUBLE) * 100 + 0.5), 0), 100)"""


def score_rules(table: str) -> str:
    def outside(name: str, top: int) -> str:
        return f"coalesce({name} NOT BETWEEN 0 AND {top}, true)"

    parts = ["breach_probability", "predictive_risk_index", "priority_impact", "operational_pressure"]
    rules = {
        "null_incident_id": "coalesce(trim(incident_id), '') = ''",
        "invalid_scored_at": "scored_at IS NULL",
        "null_model_version": "coalesce(trim(model_version), '') = ''",
        **{f"{name}_range": outside(name, 1) for name in parts},
        "risk_score_range": outside("risk_score", 100),
        "risk_level_domain": "risk_level NOT IN ('baixo', 'moderado', 'alto', 'crítico')",
        "risk_score_formula": f"risk_score <> {FORMULA}",
        "risk_level_band": f"risk_level <> {LEVEL}",
        "empty_top_risk_factors": "coalesce(trim(top_risk_factors), '') = ''",
        "empty_recommended_action": "coalesce(trim(recommended_action), '') = ''",
    }
    counted = " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, count(*) FILTER ({rule}) AS violations FROM {table}"
        for name, rule in rules.items()
    )
    key = "{'a': incident_id, 'b': scored_at, 'c': model_version}"
    return f"""{counted} UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT {key})
      FROM {table}"""


NUMBER = "CAST(substr(incident_id, 4) AS BIGINT)"


def spoiled(rest: int, name: str, value: str) -> str:
    return f"CASE WHEN number % 31 = {rest} THEN {value} ELSE {name} END AS {name}"


SPOILED_SCORES = ", ".join(
    [
        spoiled(1, "scored_at", "NULL"),
        spoiled(2, "model_version", "'  '"),
        spoiled(3, "breach_probability", "1.5"),
        spoiled(4, "predictive_risk_index", "-0.25"),
        spoiled(5, "priority_impact", "NULL"),
        spoiled(6, "operational_pressure", "2.0"),
        spoiled(7, "risk_score", "101"),
        spoiled(8, "risk_level", "'unknown'"),
        spoiled(9, "incident_id", "NULL"),
        spoiled(10, "top_risk_factors", "''"),
        spoiled(11, "recommended_action", "' '"),
    ]
)
cte(
    "spoiled_points",
    f"""
    SELECT * REPLACE ({SPOILED_SCORES}) FROM (
      SELECT *, {NUMBER} AS number FROM points
      UNION ALL SELECT *, {NUMBER} AS number FROM points WHERE {NUMBER} % 31 = 12)""",
    "points",
)
cte(
    "spoiled_events",
    f"""
    SELECT CASE WHEN number % 11 <> 3 THEN incident_id END AS incident_id,
      CASE WHEN number % 13 <> 5 THEN opened_at END AS opened_at, entered_kpi_source,
      CASE WHEN number % 7 <> 2 THEN kpi_breached_source END AS kpi_breached_source
    FROM (SELECT *, {NUMBER} AS number FROM event_silver
      UNION ALL SELECT *, {NUMBER} AS number FROM event_silver WHERE {NUMBER} % 17 = 4)""",
    "event_silver",
)


def input_rules(table: str) -> str:
    return f"""
    SELECT 'null_incident_id' AS check_name, count(*) FILTER (incident_id IS NULL) AS violations
      FROM {table}
    UNION ALL SELECT 'invalid_opened_at', count(*) FILTER (opened_at IS NULL) FROM {table}
    UNION ALL SELECT 'no_eligible_rows', CAST(count(*) FILTER (entered_kpi_source) = 0 AS BIGINT)
      FROM {table}
    UNION ALL SELECT 'eligible_without_target',
      count(*) FILTER (entered_kpi_source AND kpi_breached_source IS NULL) FROM {table}
    UNION ALL SELECT 'duplicate_incident_id', count(incident_id) - count(DISTINCT incident_id)
      FROM {table}"""


SQL = {
    "prior_counts": sql(
        "SELECT incident_id, "
        + ", ".join(n for n in S.HISTORICAL_FEATURES if "_incidents_" in n)
        + " FROM prior",
        "prior",
    ),
    "known_outcomes": sql(
        """SELECT * REPLACE (round(assigned_group_breach_rate_previous_30d, 6)
           AS assigned_group_breach_rate_previous_30d) FROM outcomes""",
        "outcomes",
    ),
    "arrival_features": sql(
        f"""SELECT * REPLACE (round(assigned_group_breach_rate_previous_30d, 6)
           AS assigned_group_breach_rate_previous_30d)
           FROM (SELECT incident_id, {", ".join(S.HISTORICAL_FEATURES)} FROM features)""",
        "features",
    ),
    "risk_features": sql(
        f"""SELECT incident_id, {stamp("opened_at")} AS opened_at, entered_kpi_source,
            kpi_breached_source, {FEATURES} FROM features""",
        "features",
    ),
    "risk_input_checks": sql(input_rules("event_silver"), "event_silver"),
    "risk_input_checks_seeded": sql(input_rules("spoiled_events"), "spoiled_events"),
    "temporal_split": sql("SELECT incident_id, dataset_split FROM split", "split"),
    "split_summary": sql(
        f"""SELECT dataset_split, count(*) AS row_count,
              count(*) FILTER (kpi_breached_source) AS positives,
              round(avg(CAST(coalesce(kpi_breached_source, false) AS INTEGER)), 6)
                AS positive_rate,
              {stamp("min(opened_at)")} AS opened_at_min, {stamp("max(opened_at)")} AS opened_at_max
            FROM split GROUP BY 1""",
        "split",
    ),
    "label_audit": sql(AUDIT, "silver"),
    "latest_cohort": sql(
        """SELECT incident_id FROM event_silver WHERE entered_kpi_source
           AND CAST(opened_at AS DATE) = (SELECT max(CAST(opened_at AS DATE)) FROM event_silver
             WHERE entered_kpi_source)""",
        "event_silver",
    ),
    "bounded_cohort": sql(
        """SELECT count(*) AS cohort_rows, 0::BIGINT AS differing
           FROM event_silver WHERE entered_kpi_source
           AND CAST(opened_at AS DATE) = (SELECT max(CAST(opened_at AS DATE)) FROM event_silver
             WHERE entered_kpi_source)""",
        "event_silver",
    ),
    "breach_rate_by_priority": sql(
        """SELECT priority_code, count(*) AS eligible,
           round(avg(CAST(kpi_breached_source AS INTEGER)), 6) AS breach_rate
           FROM silver WHERE entered_kpi_source GROUP BY 1""",
        "silver",
    ),
    "monthly_breach_rate": sql(
        """SELECT strftime(opened_at, '%Y-%m') AS year_month, count(*) AS eligible,
             count(*) FILTER (kpi_breached_source) AS breaches,
             round(100.0 * count(*) FILTER (kpi_breached_source) / count(*), 6)::DOUBLE
               AS breach_rate_pct
           FROM silver WHERE entered_kpi_source GROUP BY 1""",
        "silver",
    ),
    "pressure_reference": sql(
        """SELECT round(greatest(quantile_cont(assigned_group_incidents_previous_1d, 0.95), 1), 6)
           AS pressure_reference_p95 FROM training""",
        "training",
    ),
    "typical_values": sql(TYPICAL, "training"),
    "category_table": sql(CATEGORIES, "training"),
    "numeric_table": sql(NUMBERS, "training"),
    "classification_metrics": sql(METRICS, "histogram"),
    "precision_recall_curve": sql(
        """SELECT round(probability, 6) AS threshold, round(hits / upto::DOUBLE, 6) AS precision,
           round(hits / (SELECT sum(label) FROM scored)::DOUBLE, 6) AS recall FROM histogram""",
        "histogram",
    ),
    "topk_metrics": sql(TOPK, "ranked"),
    "lift_by_decile": sql(LIFT, "ranked"),
    "threshold_table": sql(f"SELECT {THRESHOLD} FROM thresholds", "thresholds"),
    "threshold_select": sql(
        f"""SELECT {THRESHOLD} FROM (SELECT *, recall >= 0.70 AS enough FROM thresholds) t
            ORDER BY enough DESC, CASE WHEN enough THEN t.precision ELSE t.f1 END DESC,
              CASE WHEN enough THEN t.f1 ELSE t.recall END DESC,
              CASE WHEN enough THEN t.threshold ELSE t.precision END DESC, t.threshold DESC
            LIMIT 1""",
        "thresholds",
    ),
    "probability_summary": sql(SUMMARY, "scored"),
    "predictive_index": sql(
        """SELECT incident_id, round(predictive_risk_index, 6) AS predictive_risk_index
           FROM indexed""",
        "indexed",
    ),
    "risk_scores": sql(f"SELECT {POINTS} FROM points", "points"),
    "risk_score_contract": sql(score_rules("points"), "points"),
    "risk_score_contract_seeded": sql(score_rules("spoiled_points"), "spoiled_points"),
    "risk_distribution": sql(
        """SELECT place, l.risk_level, count(incident_id) AS incident_count
           FROM (VALUES (0::BIGINT, 'baixo'), (1, 'moderado'), (2, 'alto'), (3, 'crítico'))
             l(place, risk_level)
           LEFT JOIN points p ON p.risk_level = l.risk_level GROUP BY 1, 2""",
        "points",
    ),
    "risk_summary": sql(
        """SELECT round(avg(risk_score), 6) AS average_score,
             count(*) FILTER (risk_level IN ('alto', 'crítico')) AS high_or_critical,
             count(*) FILTER (risk_level = 'crítico') AS critical FROM points""",
        "points",
    ),
    "attention_list": sql(
        f"SELECT {POINTS} FROM points WHERE risk_level IN ('alto', 'crítico') OR risk_score >= 70",
        "points",
    ),
    "risk_queue": sql(
        f"""SELECT {POINTS} FROM points WHERE risk_level IN ('alto', 'moderado')
            AND contains(lower(incident_id), 'inc00')
            ORDER BY risk_score DESC, incident_id LIMIT 50""",
        "points",
    ),
    "top_scores": sql(
        f"""SELECT {POINTS} FROM points
            ORDER BY risk_score DESC, points.breach_probability DESC, incident_id LIMIT 10""",
        "points",
    ),
}
