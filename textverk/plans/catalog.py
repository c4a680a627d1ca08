"""Every query of the core, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textverk.plans import matrix_queries, other_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (matrix_queries, text_queries, other_queries)


def queries() -> dict[str, Query]:
    return {k: f for m in _MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items() if v}
