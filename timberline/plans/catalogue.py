"""All named queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timberline.plans import logs, training


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return logs.flagship(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return training.QUERIES | logs.QUERIES


def oracle_sql() -> dict[str, str]:
    return training.ORACLE | logs.ORACLE
