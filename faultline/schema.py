"""Column names, value domains and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Source header and its English names, in file order.
COLUMN_MAP = {
    "Número": "incident_id",
    "Prioridade": "priority_raw",
    "Produto": "product",
    "Categoria": "category",
    "Subcategoria": "subcategory",
    "Grupo designado": "assigned_group",
    "Item de configuração": "configuration_item",
    "Aberto": "opened_at",
    "Resolvido": "resolved_at",
    "Encerrado": "closed_at",
    "Duração": "duration_seconds",
    "Código de fechamento": "closure_code",
    "Descrição resumida": "short_description",
    "Solução": "solution_type",
    "Aberto por": "opened_by",
    "Incidente Pai": "parent_incident_id",
    "Status": "status",
    "Entrou para KPI?": "entered_kpi_raw",
    "KPI Violado?": "kpi_breached_raw",
}

# Names accepted by the serving database.
SERVING_COLUMN_MAP = {
    "Número": "incident_number",
    "Grupo designado": "Grupo_designado",
    "Item de configuração": "Item_configuracao",
    "Duração": "Duracao",
    "Código de fechamento": "Codigo_de_fechamento",
    "Descrição resumida": "Descricao_resumida",
    "Solução": "Solucao",
    "Aberto por": "Aberto_por",
    "Incidente Pai": "Incidente_Pai",
    "Entrou para KPI?": "Entrou_para_KPI",
    "KPI Violado?": "KPI_Violado",
}

DATE_COLUMNS = ["opened_at", "resolved_at", "closed_at"]
TEXT_COLUMNS = [
    name for name in COLUMN_MAP.values() if name not in {*DATE_COLUMNS, "duration_seconds"}
]

# Columns that must hold a value.
MANDATORY_COLUMNS = [
    "incident_id",
    "priority_raw",
    "assigned_group",
    "opened_at",
    "closed_at",
    "duration_seconds",
    "short_description",
    "opened_by",
    "status",
    "entered_kpi_raw",
    "kpi_breached_raw",
]

# Service limits in seconds by priority (4 h, 4 h, 12 h, 24 h, 96 h).
SLA_SECONDS = {1: 14400, 2: 14400, 3: 43200, 4: 86400, 5: 345600}

NO_INTERVENTION = "Sem Intervenção"
MONITORING = "Monitoramento"
MISSING = "__MISSING__"
NOT_INFORMED = "Não informado"

GOLD_SCOPES = {"ALL": None, "P2": 2, "P3": 3}
FORECAST_SCOPES = {"ALL": None, "P1": 1, "P2": 2, "P3": 3, "P4": 4, "P5": 5}
HORIZONS = {"D+1": 1, "D+7": 7}

# Columns the gold tables need.
GOLD_REQUIRED = [
    "incident_id",
    "opened_at",
    "priority_code",
    "assigned_group",
    "product",
    "category",
    "configuration_item",
    "parent_incident_id",
    "entered_kpi_source",
    "kpi_breached_source",
    "opened_by",
    "status",
]
# Dimensions of the breakdown.
BREAKDOWN_DIMENSIONS = [
    "assigned_group",
    "product",
    "category",
    "configuration_item",
    "critical_group",
    "parent_incident_id",
]
# Measures of the daily volume.
VOLUME_COUNTS = [
    "incident_count",
    "entered_kpi_count",
    "kpi_breach_count",
    "monitoring_incident_count",
    "no_intervention_count",
]
BREAKDOWN_COUNTS = VOLUME_COUNTS[:3]
VOLUME_KEY = ["reference_date", "priority_scope"]
BREAKDOWN_KEY = ["reference_date", "dimension_name", "dimension_value", "priority_scope"]

# Weekday names, Monday first.
WEEKDAY_LABELS = ["Segunda", "Terça", "Quarta", "Quinta", "Sexta", "Sábado", "Domingo"]

ELIGIBLE = "entered_kpi_source"
TARGET = "kpi_breached_source"
# Features of the risk model.
CATEGORICAL_FEATURES = [
    "priority_code",
    "product",
    "category",
    "subcategory",
    "assigned_group",
    "configuration_item",
    "opened_by",
]
TEMPORAL_FEATURES = ["opened_hour", "opened_day_of_week", "opened_month", "is_weekend"]
HISTORICAL_FEATURES = [
    "assigned_group_incidents_previous_1d",
    "assigned_group_incidents_previous_7d",
    "assigned_group_incidents_previous_30d",
    "assigned_group_known_outcomes_previous_30d",
    "assigned_group_breaches_previous_30d",
    "assigned_group_breach_rate_previous_30d",
    "product_incidents_previous_7d",
    "category_incidents_previous_7d",
    "priority_incidents_previous_7d",
]
NUMERIC_FEATURES = TEMPORAL_FEATURES + HISTORICAL_FEATURES
MODEL_FEATURES = CATEGORICAL_FEATURES + NUMERIC_FEATURES

# Columns known only after the outcome, forbidden as features.
LEAKAGE_COLUMNS = [
    "resolved_at",
    "closed_at",
    "duration_seconds",
    "duration_hours",
    "calculated_duration_seconds",
    "duration_difference_seconds",
    "duration_mismatch",
    "closure_code",
    "solution_type",
    "status",
    "entered_kpi_source",
    "kpi_breached_source",
    "entered_kpi_raw",
    "kpi_breached_raw",
    "entered_kpi_recalculated_raw",
    "kpi_breached_recalculated_raw",
    "entered_kpi_rule_mismatch",
    "kpi_breached_rule_mismatch",
]
# Columns the risk features need.
RISK_REQUIRED = [
    "incident_id",
    "opened_at",
    "closed_at",
    "priority_code",
    "product",
    "category",
    "subcategory",
    "assigned_group",
    "configuration_item",
    "opened_by",
    "entered_kpi_source",
    "kpi_breached_source",
]

# Risk levels in rising order, business impact and advice.
RISK_LEVELS = ["baixo", "moderado", "alto", "crítico"]
LEVEL_CEILINGS = {"baixo": 39, "moderado": 59, "alto": 79}
ALERT_LEVELS = ["alto", "crítico"]
PRIORITY_IMPACT = {1: 1.00, 2: 0.80, 3: 0.60, 4: 0.30, 5: 0.10}
RECOMMENDED_ACTIONS = {
    "baixo": "Acompanhamento normal do incidente.",
    "moderado": "Acompanhar evolução e capacidade da equipe responsável.",
    "alto": "Priorizar investigação preventiva e revisar a fila da equipe.",
    "crítico": "Priorizar atendimento e avaliar escalonamento imediato.",
}
LEVEL_SYNONYMS = {
    "baixo": "baixo",
    "low": "baixo",
    "moderado": "moderado",
    "medio": "moderado",
    "medium": "moderado",
    "moderate": "moderado",
    "alto": "alto",
    "high": "alto",
    "critico": "crítico",
    "critical": "crítico",
}

# Features that can be named as a risk factor, with their labels.
FACTOR_LABELS = {
    "priority_code": "prioridade",
    "product": "produto",
    "category": "categoria",
    "assigned_group": "equipe",
    "configuration_item": "item de configuração",
    "opened_by": "origem da abertura",
    "opened_hour": "hora de abertura",
    "opened_day_of_week": "dia da semana",
    "assigned_group_incidents_previous_1d": "carga da equipe nas 24h anteriores",
    "assigned_group_incidents_previous_7d": "carga da equipe nos 7 dias anteriores",
    "assigned_group_breach_rate_previous_30d": "taxa histórica da equipe em 30 dias",
    "product_incidents_previous_7d": "volume do produto nos 7 dias anteriores",
    "category_incidents_previous_7d": "volume da categoria nos 7 dias anteriores",
}
NO_FACTOR = "sem fator positivo dominante"
NO_INFORMATION = "sem informação"

# Features of the forecasts.
CALENDAR_FEATURES = [f"dow_{day}" for day in range(7)] + [
    "is_weekend",
    "is_holiday",
    "black_week",
    "dec_season",
]
LEVEL_FEATURES = [
    "seas_lag7",
    "seas_lag14",
    "last",
    "roll7_mean",
    "roll7_std",
    "roll28_mean",
    "exp_last",
    "exp_roll7",
    "trend",
    *CALENDAR_FEATURES,
]
RATE_FEATURES = ["r_last", "r_roll7", "r_seas7", *CALENDAR_FEATURES]
BASELINE_FEATURES = [
    "trend",
    "lag_1",
    "lag_7",
    "rolling_7",
    "rolling_28",
    "dow_sin",
    "dow_cos",
]

ALERT_EVENT_TYPE = "ola_risk_alert"


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_STRING, _LONG, _DOUBLE = T.StringType(), T.LongType(), T.DoubleType()

RAW_SCHEMA = T.StructType([T.StructField(name, _STRING, True) for name in COLUMN_MAP])
VOLUME_SCHEMA = _struct(
    reference_date=T.DateType(), priority_scope=_STRING, **dict.fromkeys(VOLUME_COUNTS, _LONG)
)
RISK_SCORE_SCHEMA = _struct(
    incident_id=_STRING,
    scored_at=T.TimestampType(),
    model_version=_STRING,
    breach_probability=_DOUBLE,
    predictive_risk_index=_DOUBLE,
    priority_impact=_DOUBLE,
    operational_pressure=_DOUBLE,
    risk_score=_LONG,
    risk_level=_STRING,
    top_risk_factors=_STRING,
    recommended_action=_STRING,
)
PREDICTION_SCHEMA = _struct(
    reference_date=T.DateType(),
    generated_at=T.TimestampType(),
    horizon=_STRING,
    priority_scope=_STRING,
    predicted_incident_count=_DOUBLE,
    lower_bound=_DOUBLE,
    upper_bound=_DOUBLE,
    model_name=_STRING,
    model_version=_STRING,
)
ALERT_SCHEMA = _struct(
    event_type=_STRING,
    incident_id=_STRING,
    scored_at=T.TimestampType(),
    model_version=_STRING,
    breach_probability=_DOUBLE,
    risk_score=_LONG,
    risk_level=_STRING,
    top_risk_factors=_STRING,
    recommended_action=_STRING,
)
RUN_AUDIT_SCHEMA = _struct(
    run_id=_STRING,
    app_env=_STRING,
    action=_STRING,
    processed_records=_LONG,
    created_at=T.TimestampType(),
)
