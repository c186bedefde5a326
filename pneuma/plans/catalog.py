"""Registry of the checkable queries: Spark builder + DuckDB oracle SQL per key.

``__spark_entry__.py`` only wires this registry. Each query reads the given
tables (through the portable views) at full size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import q_clean, q_crisis, q_features, q_forest, q_index, q_labels, q_models, q_odd, q_profile, q_stream, q_whole  # noqa: F401
