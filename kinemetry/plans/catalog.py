"""All queries on machine readings, signals and their evaluation."""

from __future__ import annotations

from kinemetry.plans import evaluation, ingest, learning, live, monitoring, rates, screening, serving, soak, spectral

_MODULES = (monitoring, serving, spectral, evaluation, learning, soak, ingest, live, rates, screening)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
