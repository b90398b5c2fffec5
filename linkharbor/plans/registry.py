"""All core queries, keyed by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import address_queries, problems, record_queries

_MODULES = (problems, address_queries, record_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return record_queries.flagship(spark, d)
