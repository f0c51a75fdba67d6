"""All registered queries over the driver's tables, and the SQL that checks each."""

from __future__ import annotations

from . import corpus_plans, graph_plans, rank_plans

_MODULES = (corpus_plans, rank_plans, graph_plans)


def queries() -> dict:
    return {name: f for m in _MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
