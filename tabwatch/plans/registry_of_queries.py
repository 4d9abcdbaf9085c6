"""All registered queries and their DuckDB oracle SQL, merged from the groups."""

from __future__ import annotations

from tabwatch.plans import (
    contract_learn_queries, drift_oracle, drift_queries, log_monitor_queries, registry_queries,
)

GROUPS = [
    (drift_queries.QUERIES, drift_oracle.ORACLE),
    (contract_learn_queries.QUERIES, contract_learn_queries.ORACLE),
    (log_monitor_queries.QUERIES, log_monitor_queries.ORACLE),
    (registry_queries.QUERIES, registry_queries.ORACLE),
]


def all_queries() -> dict:
    out = {}
    for q, _ in GROUPS:
        out.update(q)
    return out


def all_oracle() -> dict[str, str]:
    out = {}
    for _, o in GROUPS:
        out.update({k: f() for k, f in o.items()})
    return out
