"""SQL that checks the registered queries, by name."""

from __future__ import annotations

from workload import oracle_forecasts, oracle_incidents, oracle_operations, oracle_risk


def oracle_sql() -> dict[str, str]:
    named = {}
    for module in (oracle_incidents, oracle_risk, oracle_forecasts, oracle_operations):
        named |= module.SQL
    return named
