"""Query catalog: one Spark query per operator ID plus its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the library operator on a
binding view; ``ORACLE[name]`` is an independent SQL statement over the
driver's views that must return the same rows (order-insensitive, columns
matched by name).  Operators without an oracle are registered with
``sql=None`` and are checked against brute force in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries (idempotent)."""
    from codelens.plans import (  # noqa: F401
        q_baseline, q_detect, q_diff, q_functions, q_joins, q_more, q_reports, q_scores, q_sources, q_stream, q_text,
    )
