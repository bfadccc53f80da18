"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.plans import case_queries, nested_queries, rank_queries, review_queries, table_queries, text_queries

_MODULES = (nested_queries, text_queries, table_queries, rank_queries, review_queries, case_queries)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return rank_queries.leak_free(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.ORACLE.items()}
