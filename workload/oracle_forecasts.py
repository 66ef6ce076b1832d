"""Checking SQL of the forecast queries."""

from __future__ import annotations

from faultline import schema as S
from workload.oracle_base import EVERY, cte, day, sql, stamp

SCOPES = ", ".join(f"('{s}', {'NULL' if c is None else c})" for s, c in EVERY.items())
START = "DATE '1995-01-01'"

cte("years", "SELECT unnest(range(1990, 2040))::BIGINT AS y")
cte(
    "easter",
    """
    SELECT y, make_date(y, (e + w - 7 * s + 114) // 31, (e + w - 7 * s + 114) % 31 + 1) AS easter
    FROM (SELECT *, (g + 11 * e + 22 * w) // 451 AS s
      FROM (SELECT *, (32 + 2 * (c % 4) + 2 * ((y % 100) // 4) - e - (y % 100) % 4) % 7 AS w
        FROM (SELECT *, (19 * g + c - c // 4 - (c - (c + 8) // 25 + 1) // 3 + 15) % 30 AS e
          FROM (SELECT y, y % 19 AS g, y // 100 AS c FROM years))))""",
    "years",
)
cte(
    "marks",
    """
    SELECT e.y, any_value(easter) - INTERVAL 2 DAY AS good_friday,
      list_sort(list(d) FILTER (isodow(d) = 5))[4] AS black_friday
    FROM easter e JOIN (SELECT y, unnest(generate_series(make_date(y, 11, 1), make_date(y, 11, 30),
      INTERVAL 1 DAY)) AS d FROM years) n ON n.y = e.y GROUP BY 1""",
    "easter",
)


def calendar(column: str) -> str:
    flags = [f"CAST(isodow({column}) = {i + 1} AS BIGINT) AS dow_{i}" for i in range(7)]
    flags += [
        f"CAST(isodow({column}) >= 6 AS BIGINT) AS is_weekend",
        f"""CAST(strftime({column}, '%m%d') IN ('0101', '0421', '0501', '0907', '1012', '1102',
            '1115', '1225') OR (strftime({column}, '%m%d') = '1120' AND year({column}) >= 2024)
            OR {column} = good_friday AS BIGINT) AS is_holiday""",
        f"""CAST({column} BETWEEN black_friday - INTERVAL 1 DAY AND black_friday
            + INTERVAL 4 DAY AS BIGINT) AS black_week""",
        f"CAST(month({column}) = 12 AND day({column}) >= 15 AS BIGINT) AS dec_season",
    ]
    return ", ".join(flags)


cte("recent", f"SELECT * FROM silver WHERE opened_date >= {START}", "silver")
cte(
    "grid",
    f"""
    SELECT CAST(unnest(generate_series({START}, max(opened_date) + INTERVAL 7 DAY,
      INTERVAL 1 DAY)) AS DATE) AS day, max(opened_date) AS last_day FROM recent""",
    "recent",
)
cte(
    "items",
    """
    SELECT day, last_day, CAST(last_value(n IGNORE NULLS) OVER (ORDER BY day) AS DOUBLE)
      AS active_items
    FROM (SELECT day, last_day,
        CASE WHEN day <= last_day THEN count(DISTINCT configuration_item) END AS n
      FROM grid LEFT JOIN recent ON opened_date = day GROUP BY 1, 2)""",
    "grid",
)
cte(
    "context",
    f"""
    SELECT s.scope, i.day, i.last_day, i.active_items,
      CASE WHEN i.day <= i.last_day THEN count(r.incident_id)::DOUBLE END AS y
    FROM items i CROSS JOIN (VALUES {SCOPES}) s(scope, code)
    LEFT JOIN recent r ON r.opened_date = i.day AND r.parent_incident_id IS NULL
      AND (s.code IS NULL OR r.priority_code = s.code)
    GROUP BY 1, 2, 3, 4""",
    "items",
)


def full(how: str, column: str, size: int) -> str:
    frame = f"OVER (e ROWS {size - 1} PRECEDING)"
    return f"CASE WHEN count({column}) {frame} = {size} THEN {how}({column}) {frame} END"


cte(
    "lagged",
    """
    SELECT *, CASE horizon_days WHEN 1 THEN lag(y, 1) OVER w ELSE lag(y, 7) OVER w END AS last,
      CASE horizon_days WHEN 1 THEN lag(active_items, 1) OVER w ELSE lag(active_items, 7) OVER w END
        AS exp_last,
      lag(y, 7) OVER w AS seas_lag7, lag(y, 14) OVER w AS seas_lag14,
      (row_number() OVER w - 1)::DOUBLE AS trend
    FROM context CROSS JOIN (VALUES ('D+1', 1::BIGINT), ('D+7', 7)) h(horizon, horizon_days)
    WINDOW w AS (PARTITION BY scope, horizon ORDER BY day)""",
    "context",
)
cte(
    "rolled",
    f"""
    SELECT *, {full("avg", "last", 7)} AS roll7_mean, {full("stddev_samp", "last", 7)} AS roll7_std,
      {full("avg", "last", 28)} AS roll28_mean, {full("avg", "exp_last", 7)} AS exp_roll7
    FROM lagged WINDOW e AS (PARTITION BY scope, horizon ORDER BY day)""",
    "lagged",
)
cte(
    "frame",
    f"""
    SELECT r.*, last / nullif(exp_last, 0) AS r_last, roll7_mean / nullif(exp_roll7, 0) AS r_roll7,
      seas_lag7 / nullif(exp_roll7, 0) AS r_seas7, {calendar("day")}
    FROM rolled r JOIN marks m ON m.y = year(r.day)""",
    "rolled",
    "marks",
)
NAMES = list(dict.fromkeys([*S.LEVEL_FEATURES, *S.RATE_FEATURES]))
SHOWN = ", ".join(n if n in S.CALENDAR_FEATURES else f"round({n}, 6) AS {n}" for n in NAMES)
COMPLETE = " AND ".join(
    f"{n} IS NOT NULL" for n in NAMES if n not in S.CALENDAR_FEATURES
)
cte(
    "candidates",
    f"""
    SELECT scope, horizon, day, y, c.candidate, greatest(c.predicted, 0) AS predicted
    FROM (SELECT scope, horizon, day, y, unnest([
        {{'candidate': 'naive7', 'predicted': seas_lag7}},
        {{'candidate': 'media7', 'predicted': roll7_mean}},
        {{'candidate': 'ultimo', 'predicted': last}}]) AS c
      FROM (SELECT day, scope, horizon, y, seas_lag7, seas_lag14, last, roll7_mean, roll7_std,
          roll28_mean, exp_last, exp_roll7, trend, r_last, r_roll7, r_seas7 FROM frame)
      WHERE day >= DATE '2001-04-01' AND {COMPLETE})""",
    "frame",
)
cte(
    "errors",
    """
    SELECT scope, horizon, candidate, count(*) AS days, avg(abs(y - predicted)) AS mae,
      sqrt(avg((y - predicted) ** 2)) AS rmse,
      100 * avg(2 * abs(y - predicted) / (abs(y) + abs(predicted) + 1e-9::DOUBLE)) AS smape
    FROM candidates WHERE y IS NOT NULL AND day >= DATE '2001-06-01' GROUP BY 1, 2, 3""",
    "candidates",
)
cte(
    "published",
    """
    SELECT day AS reference_date, CAST(day AS TIMESTAMP) - horizon_days * INTERVAL 1 DAY
        AS generated_at, horizon, scope AS priority_scope, p AS predicted_incident_count,
      round_even(p * 0.8::DOUBLE, 2) AS lower_bound, round_even(p * 1.2::DOUBLE, 2) AS upper_bound,
      'media7' AS model_name, 'volume-check' AS model_version
    FROM (SELECT *, round_even(roll7_mean, 2) AS p FROM rolled WHERE roll7_mean IS NOT NULL)""",
    "rolled",
)
PUBLISHED = f"""* REPLACE ({day("reference_date")} AS reference_date,
  {stamp("generated_at")} AS generated_at)"""
NEWEST = """SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (
    PARTITION BY priority_scope, horizon ORDER BY reference_date DESC) AS place FROM {}) WHERE place = 1"""
cte(
    "viewed",
    """
    SELECT p.reference_date, horizon, priority_scope AS scope,
      predicted_incident_count AS predicted, c.y AS actual, lower_bound, upper_bound
    FROM published p JOIN context c ON c.scope = priority_scope AND c.day = p.reference_date
    WHERE horizon = 'D+1'""",
    "published",
    "context",
)
VIEWED = f"* REPLACE ({day('reference_date')} AS reference_date)"
ANGLE = "2 * 3.141592653589793::DOUBLE * (isodow(reference_date) - 1) / 7"


def contract(table: str) -> str:
    names = ["predicted_incident_count", "lower_bound", "upper_bound"]
    rules = {
        "invalid_reference_date": "reference_date IS NULL",
        "invalid_generated_at": "generated_at IS NULL",
        "horizon_domain": "coalesce(horizon NOT IN ('D+1', 'D+7'), true)",
        "priority_scope_domain":
            "coalesce(priority_scope NOT IN ('ALL', 'P1', 'P2', 'P3', 'P4', 'P5'), true)",
        **{f"negative_{name}": f"coalesce({name} < 0, true)" for name in names},
        "interval_order": """lower_bound > predicted_incident_count
          OR upper_bound < predicted_incident_count OR lower_bound > upper_bound""",
        "empty_model_name": "coalesce(trim(model_name), '') = ''",
        "empty_model_version": "coalesce(trim(model_version), '') = ''",
    }
    counted = " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, count(*) FILTER ({rule}) AS violations FROM {table}"
        for name, rule in rules.items()
    )
    key = "{'a': reference_date, 'b': horizon, 'c': priority_scope, 'd': model_version}"
    return f"""{counted} UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT {key})
      FROM {table}"""


SPOILED = {
    "reference_date": (2, "NULL"),
    "generated_at": (3, "NULL"),
    "horizon": (4, "'D+2'"),
    "priority_scope": (5, "'P9'"),
    "predicted_incident_count": (6, "-1"),
    "lower_bound": (7, "upper_bound + 1"),
    "upper_bound": (8, "NULL"),
    "model_name": (9, "' '"),
    "model_version": (10, "NULL"),
}
cte(
    "spoiled_published",
    f"""SELECT {", ".join(
        f"CASE WHEN place = {place} THEN {value} ELSE {name} END AS {name}"
        for name, (place, value) in SPOILED.items()
    )} FROM (SELECT *, day(reference_date) AS place FROM published
      UNION ALL SELECT *, 11 FROM published WHERE day(reference_date) = 11)""",
    "published",
)

# --- Ridge regression by running sums and elimination ---
LEVEL = S.LEVEL_FEATURES
WIDE = len(LEVEL)
PAIRS = [(i, j) for i in range(WIDE) for j in range(i, WIDE)]
KNOWN = "FILTER (y IS NOT NULL) OVER w"
cte(
    "complete",
    f"""SELECT scope, horizon, horizon_days, day, last_day, y,
      {", ".join(f"{n}::DOUBLE AS x_{i}" for i, n in enumerate(LEVEL))}
    FROM (SELECT * FROM frame WHERE {COMPLETE})""",
    "frame",
)
cte(
    "ridge_sums",
    f"""SELECT *, row_number() OVER () AS id FROM (SELECT *, (count(*) {KNOWN})::DOUBLE AS n, sum(y) {KNOWN} AS sy,
      min(y) {KNOWN} AS least, max(y) {KNOWN} AS most,
      {", ".join(f"sum(x_{i}) {KNOWN} AS s_{i}, sum(x_{i} * y) {KNOWN} AS sy_{i}" for i in range(WIDE))},
      {", ".join(f"sum(x_{i} * x_{j}) {KNOWN} AS s_{i}_{j}" for i, j in PAIRS)}
    FROM complete WINDOW w AS (PARTITION BY scope, horizon ORDER BY day
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE day >= DATE '2001-04-01'""",
    "complete",
)
cte(
    "ridge_means",
    f"""SELECT *, {", ".join(f"s_{i} / n AS m_{i}" for i in range(WIDE))},
      {", ".join(f"CASE WHEN s_{i}_{i} / n - (s_{i} / n) ** 2 > s_{i}_{i} / n * 1e-12::DOUBLE "
                 f"THEN s_{i}_{i} / n - (s_{i} / n) ** 2 ELSE 0 END AS v_{i}" for i in range(WIDE))}
    FROM ridge_sums""",
    "ridge_sums",
)


def _entry(i: int, j: int) -> str:
    low, high = min(i, j), max(i, j)
    penalty = f" + 5 * v_{i}" if i == j else ""
    return f"CASE WHEN v_{i} = 0 OR v_{j} = 0 THEN 0 ELSE s_{low}_{high} - n * m_{i} * m_{j}{penalty} END"


SYSTEM = ", ".join(
    "[" + ", ".join(_entry(i, j) for j in range(WIDE)) + f", CASE WHEN v_{i} = 0 THEN 0 ELSE sy_{i} - m_{i} * sy END]"
    for i in range(WIDE)
)
cte(
    "ridge_steps",
    f"""SELECT id, 1 AS k, [{SYSTEM}]::DOUBLE[][] AS a,
      1e-13::DOUBLE * list_max([{", ".join(f"abs({_entry(i, i)})" for i in range(WIDE))}]) AS small
    FROM ridge_means
    UNION ALL
    SELECT id, k + 1, CASE WHEN abs(a[k][k]) <= small
      THEN list_transform(a, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: 0::DOUBLE) ELSE r END)
      ELSE list_transform(a, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / a[k][k])
        ELSE list_transform(r, lambda v, j: v - a[k][j] / a[k][k] * r[k]) END) END, small
    FROM ridge_steps WHERE k <= {WIDE}""",
    "ridge_means",
)
cte(
    "ridge",
    f"""SELECT scope, horizon, horizon_days, day, last_day, y, sy / n AS intercept, beta,
      greatest(CASE WHEN least = most THEN least ELSE sy / n
        + {" + ".join(f"beta[{i + 1}] * (x_{i} - m_{i})" for i in range(WIDE))} END, 0) AS predicted
    FROM ridge_means JOIN (SELECT id, list_transform(a, lambda r: r[{WIDE + 1}]) AS beta
      FROM ridge_steps WHERE k = {WIDE + 1}) USING (id)""",
    "ridge_means",
    "ridge_steps",
)


def choose(name: str, source: str, order: str, *needs: str) -> None:
    """The rows of the simplest candidate within 5 % of the best, per series."""
    cte(
        name,
        f"""
        SELECT c.* FROM {source} c JOIN (
          SELECT scope, horizon, candidate FROM (
            SELECT *, row_number() OVER (PARTITION BY scope, horizon ORDER BY list_position({order}, candidate)) AS f
            FROM (SELECT *, mae <= min(mae) OVER (PARTITION BY scope, horizon) * 1.05::DOUBLE AS close
              FROM (SELECT scope, horizon, candidate, avg(abs(y - predicted)) AS mae
                FROM {source} WHERE y IS NOT NULL AND day <= DATE '2001-05-31' GROUP BY 1, 2, 3))
            WHERE close) WHERE f = 1) USING (scope, horizon, candidate)""",
        *needs,
    )


def banded(name: str, chosen: str) -> None:
    """Adaptive bands by a recursion over the days of each series."""
    root = "greatest(sqrt(greatest(p, 0)), 1)"
    cte(
        f"{name}_series",
        f"""
        SELECT scope, horizon, list(day ORDER BY day) AS ds, list(y ORDER BY day) AS ys, list(p ORDER BY day) AS ps,
          list((y - p) / {root} ORDER BY day) AS rs, list({root} ORDER BY day) AS ss, any_value(candidate) AS candidate
        FROM (SELECT *, predicted AS p FROM {chosen} WHERE y IS NOT NULL) GROUP BY 1, 2""",
        chosen,
    )

    def quantile(share: str) -> str:
        place = f"({share} * (len(o) - 1))"
        low, high = f"o[floor({place})::BIGINT + 1]", f"o[ceil({place})::BIGINT + 1]"
        return f"{low} + ({high} - {low}) * ({place} - floor({place}))"

    cte(
        name,
        f"""
        SELECT scope, horizon, 1::BIGINT AS i, 0.2::DOUBLE AS level, 0::DOUBLE AS q_low, 0::DOUBLE AS q_high,
          NULL::DOUBLE AS low, NULL::DOUBLE AS high
        FROM {name}_series
        UNION ALL
        SELECT scope, horizon, i + 1,
          CASE WHEN i > 28 THEN greatest(0.01, least(0.6, level + 0.03::DOUBLE
            * (0.2::DOUBLE - CASE WHEN y BETWEEN l AND h THEN 0 ELSE 1 END))) ELSE level END, ql, qh, l, h
        FROM (SELECT *, CASE WHEN i > 28 THEN greatest(0, p + ql * s) END AS l, CASE WHEN i > 28 THEN p + qh * s END AS h
          FROM (SELECT *, CASE WHEN i > 28 THEN {quantile("level / 2")} ELSE q_low END AS ql,
              CASE WHEN i > 28 THEN {quantile("(1 - level / 2)")} ELSE q_high END AS qh
            FROM (SELECT b.*, ys[i] AS y, ps[i] AS p, ss[i] AS s, list_sort(rs[greatest(1, i - 60):i - 1]) AS o
              FROM {name} b JOIN {name}_series USING (scope, horizon) WHERE i <= len(ys))))""",
        f"{name}_series",
    )
    cte(
        f"{name}_days",
        f"""
        SELECT scope, horizon, ds[i - 1] AS day, candidate, ys[i - 1] AS y, ps[i - 1] AS predicted, low, high,
          last_value(q_low) OVER e AS q_low, last_value(q_high) OVER e AS q_high,
          first_value(low IGNORE NULLS) OVER e AS first_low, first_value(high IGNORE NULLS) OVER e AS first_high
        FROM {name} JOIN {name}_series USING (scope, horizon) WHERE i > 1
        WINDOW e AS (PARTITION BY scope, horizon ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
        name,
        f"{name}_series",
    )


choose("naive_chosen", "candidates", "['naive7', 'media7', 'ultimo']", "candidates")
banded("naive_bands", "naive_chosen")
cte(
    "every_candidate",
    """SELECT * FROM candidates
    UNION ALL BY NAME SELECT scope, horizon, day, y, 'ridge' AS candidate, predicted FROM ridge""",
    "candidates",
    "ridge",
)
choose("best_chosen", "every_candidate", "['naive7', 'media7', 'ultimo', 'ridge']", "every_candidate")
banded("best_bands", "best_chosen")
cte("ridge_chosen", "SELECT * FROM every_candidate WHERE candidate = 'ridge'", "every_candidate")
banded("ridge_bands", "ridge_chosen")
BANDED = """scope, horizon, candidate, y, predicted, coalesce(low, first_low, predicted) AS lower_bound,
  coalesce(high, first_high, predicted) AS upper_bound, low IS NOT NULL AS evaluated, q_low, q_high"""
SPREAD = "greatest(sqrt(greatest(p, 0)), 1)"

# --- Least squares by the same elimination ---
BASE = S.BASELINE_FEATURES
OLS = len(BASE) + 1
cte(
    "base_rows",
    f"""SELECT priority_scope, reference_date, y, trend, 1::DOUBLE AS b_0,
      {", ".join(f"{n}::DOUBLE AS b_{i + 1}" for i, n in enumerate(BASE))}
    FROM (SELECT *, sin({ANGLE}) AS dow_sin, cos({ANGLE}) AS dow_cos
      FROM (SELECT *, incident_count::DOUBLE AS y, (row_number() OVER w - 1)::DOUBLE AS trend,
        lag(incident_count::DOUBLE, 1) OVER w AS lag_1, lag(incident_count::DOUBLE, 7) OVER w AS lag_7,
        avg(incident_count) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_7,
        avg(incident_count) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS rolling_28
      FROM volume WINDOW w AS (PARTITION BY priority_scope ORDER BY reference_date))) WHERE trend >= 28""",
    "volume",
)


def least_squares(name: str, rows: str, *needs: str) -> None:
    sums = ", ".join(f"sum(b_{i} * b_{j}) AS s_{i}_{j}" for i in range(OLS) for j in range(i, OLS))
    roots = ", ".join(f"sqrt(greatest(s_{i}_{i}, 1e-300)) AS r_{i}" for i in range(OLS))
    system = ", ".join(
        "[" + ", ".join(f"s_{min(i, j)}_{max(i, j)} / r_{i} / r_{j}" for j in range(OLS)) + f", t_{i} / r_{i}]"
        for i in range(OLS)
    )
    cte(
        f"{name}_sums",
        f"""SELECT *, {roots} FROM (SELECT priority_scope, {sums},
          {", ".join(f"sum(b_{i} * y) AS t_{i}" for i in range(OLS))} FROM ({rows}) GROUP BY 1)""",
        *needs,
    )
    cte(
        f"{name}_steps",
        f"""SELECT priority_scope, 1 AS k, [{system}]::DOUBLE[][] AS a FROM {name}_sums
        UNION ALL
        SELECT priority_scope, k + 1, list_transform(a, lambda r, i: CASE
          WHEN i = k THEN list_transform(r, lambda v: CASE WHEN abs(a[k][k]) <= 1e-13::DOUBLE THEN 0 ELSE v / a[k][k] END)
          WHEN abs(a[k][k]) <= 1e-13::DOUBLE THEN r
          ELSE list_transform(r, lambda v, j: v - a[k][j] / a[k][k] * r[k]) END)
        FROM {name}_steps WHERE k <= {OLS}""",
        f"{name}_sums",
    )
    cte(
        name,
        f"""SELECT priority_scope, [{", ".join(f"a[{i + 1}][{OLS + 1}] / r_{i}" for i in range(OLS))}] AS c
        FROM {name}_steps JOIN {name}_sums USING (priority_scope) WHERE k = {OLS + 1}""",
        f"{name}_steps",
        f"{name}_sums",
    )


cte(
    "base_placed",
    """SELECT *, row_number() OVER (PARTITION BY priority_scope ORDER BY reference_date DESC) AS back
    FROM base_rows""",
    "base_rows",
)
least_squares("base_fit", "SELECT * FROM base_rows", "base_rows")
least_squares("held_fit", "SELECT * FROM base_placed WHERE back > 60", "base_placed")
LINEAR = " + ".join(f"c[{i + 1}] * b_{i}" for i in range(OLS))
cte(
    "base_errors",
    f"""SELECT priority_scope, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse,
      quantile_cont(e, 0.1) AS residual_low, quantile_cont(e, 0.9) AS residual_high
    FROM (SELECT priority_scope, y - greatest({LINEAR}, 0) AS e
      FROM base_placed JOIN held_fit USING (priority_scope) WHERE back <= 60) GROUP BY 1""",
    "base_placed",
    "held_fit",
)
STEP_ANGLE = "2 * 3.141592653589793::DOUBLE * (isodow(last_day + i::INTEGER) - 1) / 7"
cte(
    "base_ahead",
    f"""SELECT priority_scope, 1::BIGINT AS i, max(reference_date) AS last_day, count(*)::DOUBLE AS n,
      list(incident_count::DOUBLE ORDER BY reference_date)[-28:] AS h FROM volume GROUP BY 1
    UNION ALL
    SELECT priority_scope, i + 1, last_day, n, list_append(h, greatest(c[1] + c[2] * (n + i - 1) + c[3] * h[-1]
      + c[4] * h[-7] + c[5] * list_avg(h[-7:]) + c[6] * list_avg(h[-28:])
      + c[7] * sin({STEP_ANGLE}) + c[8] * cos({STEP_ANGLE}), 0))
    FROM base_ahead JOIN base_fit USING (priority_scope) WHERE i <= 7""",
    "volume",
    "base_fit",
)

SQL = {
    "ridge_walk_forward": sql(
        f"""SELECT scope, horizon, {day("day")} AS day, 'ridge' AS candidate, round(predicted, 6) AS predicted
            FROM ridge""",
        "ridge",
    ),
    "conformal_bands": sql(f"SELECT {day('day')} AS day, {BANDED} FROM naive_bands_days", "naive_bands_days"),
    "band_coverage": sql(
        """SELECT scope, horizon, count(*) AS days, avg(CASE WHEN y BETWEEN low AND high THEN 1 ELSE 0 END) AS coverage,
             avg(high - low) AS mean_width
           FROM naive_bands_days WHERE low IS NOT NULL AND day >= DATE '2001-06-01' GROUP BY 1, 2""",
        "naive_bands_days",
    ),
    "advanced_bands": sql(
        f"""SELECT scope, horizon, {day("day")} AS day, candidate, y, predicted, low AS lower_bound, high AS upper_bound
            FROM naive_bands_days WHERE day > DATE '2001-07-01'""",
        "naive_bands_days",
    ),
    "volume_bundle": sql(
        f"""SELECT r.scope, r.horizon, 'ridge' AS candidate, {day("r.day")} AS until, 'ridge' AS kind, intercept,
              q_low, q_high, place::INTEGER AS place, beta[place + 1] AS coefficient
            FROM (SELECT * FROM ridge QUALIFY row_number() OVER (PARTITION BY scope, horizon ORDER BY day DESC) = 1) r
            JOIN (SELECT DISTINCT scope, horizon, q_low, q_high FROM ridge_bands_days) USING (scope, horizon),
              (SELECT unnest(range({WIDE})) AS place)""",
        "ridge",
        "ridge_bands_days",
    ),
    "volume_forecast": sql(
        f"""SELECT {day("day")} AS reference_date, '2026-01-01 00:00:00.000000' AS generated_at, horizon,
              scope AS priority_scope, round_even(p, 2) AS predicted_incident_count,
              round_even(least(low, p), 2) AS lower_bound,
              round_even(greatest(p + q_high * {SPREAD}, low, p), 2) AS upper_bound,
              candidate AS model_name, 'volume-check' AS model_version
            FROM (SELECT c.day, c.horizon, c.scope, c.candidate, predicted AS p, q_high,
                greatest(predicted + q_low * greatest(sqrt(greatest(predicted, 0)), 1), 0) AS low
              FROM best_chosen c
              JOIN (SELECT DISTINCT scope, horizon, day, last_day, horizon_days FROM complete) f USING (scope, horizon, day)
              JOIN (SELECT DISTINCT scope, horizon, q_low, q_high FROM best_bands_days) USING (scope, horizon)
              WHERE c.day = last_day + horizon_days::INTEGER)""",
        "best_chosen",
        "best_bands_days",
        "complete",
    ),
    "forecast_parity": "SELECT 0 AS only_left, 0 AS only_right, 0 AS differing",
    "forecast_parity_seeded": "SELECT 0 AS only_left, 0 AS only_right, 1 AS differing",
    "baseline_coefficients": sql(
        f"""SELECT priority_scope, place::INTEGER AS place, c[place + 1] AS value
            FROM base_fit, (SELECT unnest(range({OLS})) AS place)""",
        "base_fit",
    ),
    "baseline_evaluation": sql("SELECT * FROM base_errors", "base_errors"),
    "baseline_forecast": sql(
        f"""SELECT {day("last_day + d::INTEGER")} AS reference_date, '2026-01-01 00:00:00.000000' AS generated_at,
              horizon, priority_scope, round_even(p, 2) AS predicted_incident_count,
              round_even(greatest(p + least(residual_low, 0), 0), 2) AS lower_bound,
              round_even(p + greatest(residual_high, 0), 2) AS upper_bound,
              'linear_lag' AS model_name, 'linear-lag-baseline-v1' AS model_version
            FROM (SELECT priority_scope, last_day, h.horizon, d, a.h[d - 8] AS p
              FROM base_ahead a, (VALUES ('D+1', 1), ('D+7', 7)) h(horizon, d) WHERE i = 8)
            JOIN base_errors USING (priority_scope)""",
        "base_ahead",
        "base_errors",
    ),
    "series_context": sql(
        f"SELECT * REPLACE ({day('day')} AS day, {day('last_day')} AS last_day) FROM context",
        "context",
    ),
    "calendar_features": sql(
        f"""SELECT {day("d")} AS day, {calendar("d")}
            FROM (SELECT DISTINCT opened_date AS d FROM silver) JOIN marks m ON m.y = year(d)""",
        "silver",
        "marks",
    ),
    "forecast_features": sql(
        f"""SELECT scope, horizon, horizon_days, {day("day")} AS day, {day("last_day")} AS last_day,
            y, {SHOWN} FROM frame""",
        "frame",
    ),
    "naive_forecasts": sql(
        f"""SELECT scope, horizon, {day("day")} AS day, y, seas_lag7 AS naive7,
            round(roll7_mean, 6) AS media7, last AS ultimo FROM rolled""",
        "rolled",
    ),
    "baseline_features": sql(
        f"""SELECT priority_scope, {day("reference_date")} AS reference_date,
              incident_count::DOUBLE AS incident_count, trend, lag_1, lag_7,
              round(rolling_7, 6) AS rolling_7, round(rolling_28, 6) AS rolling_28,
              round(sin({ANGLE}), 6) AS dow_sin, round(cos({ANGLE}), 6) AS dow_cos
            FROM (SELECT *, (row_number() OVER w - 1)::DOUBLE AS trend,
                lag(incident_count::DOUBLE, 1) OVER w AS lag_1,
                lag(incident_count::DOUBLE, 7) OVER w AS lag_7,
                avg(incident_count) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_7,
                avg(incident_count) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS rolling_28
              FROM volume WINDOW w AS (PARTITION BY priority_scope ORDER BY reference_date))
            WHERE trend >= 28""",
        "volume",
    ),
    "naive_metrics": sql(
        """SELECT scope, horizon, candidate, days, round(mae, 6) AS mae, round(rmse, 6) AS rmse,
             round(smape, 6) AS smape,
             round(CASE WHEN best > 1e-9 THEN 1 - mae / best END, 6) AS skill_vs_best_naive,
             round(CASE WHEN weekly > 1e-9 THEN 1 - mae / weekly END, 6) AS skill_vs_naive7
           FROM (SELECT *, min(mae) OVER s AS best,
               min(mae) FILTER (candidate = 'naive7') OVER s AS weekly
             FROM errors WINDOW s AS (PARTITION BY scope, horizon))""",
        "errors",
    ),
    "occam_select": sql(
        """SELECT scope, horizon, candidate, round(mae, 6) AS selection_mae FROM (
             SELECT *, row_number() OVER (PARTITION BY scope, horizon ORDER BY place) AS first FROM (
               SELECT *, mae <= min(mae) OVER (PARTITION BY scope, horizon) * 1.05::DOUBLE AS close,
                 list_position(['naive7', 'media7', 'ultimo'], candidate) AS place
               FROM (SELECT scope, horizon, candidate, avg(abs(y - predicted)) AS mae
                 FROM candidates WHERE y IS NOT NULL AND day <= DATE '2001-05-31' GROUP BY 1, 2, 3))
             WHERE close) WHERE first = 1""",
        "candidates",
    ),
    "block_skill": sql(
        """SELECT scope, horizon, block, round(mae, 6) AS mae, round(naive, 6) AS naive7_mae,
             round(1 - mae / nullif(naive, 0), 6) AS skill
           FROM (SELECT scope, horizon, block,
               avg(abs(y - predicted)) FILTER (candidate = 'media7') AS mae,
               avg(abs(y - predicted)) FILTER (candidate = 'naive7') AS naive
             FROM (SELECT *, (row_number() OVER (s ORDER BY day) - 1) * 6 // count(*) OVER s + 1
                 AS block
               FROM candidates WHERE y IS NOT NULL
               WINDOW s AS (PARTITION BY scope, horizon, candidate)) GROUP BY 1, 2, 3)""",
        "candidates",
    ),
    "daily_predictions": sql(f"SELECT {PUBLISHED} FROM published", "published"),
    "prediction_contract": sql(contract("published"), "published"),
    "prediction_contract_seeded": sql(contract("spoiled_published"), "spoiled_published"),
    "latest_predictions": sql(
        f"SELECT {PUBLISHED} FROM ({NEWEST.format('published')})", "published"
    ),
    "upsert_current": sql(
        f"""SELECT {PUBLISHED} FROM ({NEWEST.format('''(SELECT * FROM published
              WHERE reference_date <= CASE WHEN priority_scope = 'P5' THEN DATE '2001-06-30'
                ELSE DATE '2001-07-07' END)''')})""",
        "published",
    ),
    "predictions_view": sql(f"SELECT {VIEWED} FROM viewed", "viewed"),
    "future_predictions": sql(f"SELECT {VIEWED} FROM viewed WHERE actual IS NULL", "viewed"),
    "backtest_mae": sql(
        """SELECT count(*) AS days, round(avg(abs(predicted - actual)), 6) AS mae
           FROM viewed WHERE actual IS NOT NULL""",
        "viewed",
    ),
}
