"""All queries of this package, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import consensus, defects, garbled, leaks, packing, ranking, splits, titles

_MODULES = (splits, ranking, consensus, defects, titles, packing, leaks, garbled)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.ORACLE.items()}
