"""DuckDB oracle SQL for the registered queries (correctness harness only)."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    from . import bundle, compare_charts, filters, groups, kpis, metrics, posted, profiles, sources, tools_profit
    out: dict[str, str] = {}
    for mod in (kpis, compare_charts, metrics, tools_profit, posted, bundle, profiles, sources, filters, groups):
        out.update(mod.queries())
    from .base import spark_rounding
    return {k: spark_rounding(v) for k, v in out.items()}
