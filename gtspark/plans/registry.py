"""Registry of named queries and their DuckDB oracles.

``register(name, sql)`` decorates a ``(spark, sf_dir) -> DataFrame`` builder;
``sql`` is the oracle text (None when the operator has no SQL equivalent).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


PLAN_MODULES = ("q_truth", "q_marts", "q_text", "q_retrieval", "q_evaluate", "q_stats",
                "q_forecast", "q_sources", "q_geo", "q_stream", "q_ingest", "q_search", "q_feeds", "q_sweep", "q_catalog")


def load_all():
    """Import every plan module so the decorators run."""
    import importlib
    import importlib.util

    for m in PLAN_MODULES:
        name = f"gtspark.plans.{m}"
        if importlib.util.find_spec(name) is not None:
            importlib.import_module(name)
    return QUERIES, ORACLES
