"""All queries of the core with their oracle SQL."""

from __future__ import annotations

from panelforge import queries_reference, queries_training

FLAGSHIP = "backtest_risk_report"


def queries() -> dict:
    return queries_reference.QUERIES | queries_training.QUERIES


def oracle_sql() -> dict[str, str]:
    return queries_reference.ORACLE | queries_training.ORACLE
