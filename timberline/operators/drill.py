"""Drill-downs over parsed, clustered and scored records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANY = "*"


def where_attributes(df: DataFrame, attributes: dict | None) -> DataFrame:
    """Rows whose attributes (as text) equal all given values; '*' and an empty dict don't restrict."""
    for k, v in (attributes or {}).items():
        if v != ANY:
            df = df.where(F.col(k).cast("string") == str(v))
    return df


def patterns(df: DataFrame, attributes: dict | None = None, template: str = "parsed_logline") -> DataFrame:
    """Distinct templates of the rows with these attributes; without any, the templates of all rows as they are."""
    d = where_attributes(df, attributes).select(template)
    return d.distinct() if attributes else d


def lines_of_pattern(df: DataFrame, pattern: str, template: str = "parsed_logline") -> DataFrame:
    """Rows of one template, without the parser's columns."""
    return df.where(F.col(template) == pattern).drop(template, "parameter_list", "event_id")


def lines_of_cluster(df: DataFrame, cluster_id: str) -> DataFrame:
    return df.where(F.col("cluster_id") == str(cluster_id))


def anomalies(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_anomaly"))


def pattern_of_line(df: DataFrame, logline: str, with_parameters: bool = False, row_id: str = "_id", text: str = "logline") -> DataFrame:
    """Template (and parameters) of the first row with exactly this line; no row if there is none."""
    cols = ["parsed_logline", *(["parameter_list"] if with_parameters else [])]
    return df.where(F.col(text) == logline).orderBy(row_id).limit(1).select(*cols)


def parameter_summary(df: DataFrame, pattern: str | None = None, template: str = "parsed_logline") -> DataFrame:
    """Per template and parameter position: how many rows have one, and the distinct values' number.

    Rows have parameters at as many positions as their own list is long. The values themselves: parameter_values.
    """
    d = df if pattern is None else df.where(F.col(template) == pattern)
    p = d.select(template, F.posexplode("parameter_list").alias("position", "value"))
    return p.groupBy(template, "position").agg(F.count("value").alias("value_counts"), F.count_distinct("value").alias("distinct_values"))


def parameter_values(df: DataFrame, pattern: str, template: str = "parsed_logline") -> DataFrame:
    """position, value, counts of one template's parameters."""
    p = df.where(F.col(template) == pattern).select(F.posexplode("parameter_list").alias("position", "value"))
    return p.groupBy("position", "value").agg(F.count("*").alias("counts"))


def page(df: DataFrame, order: list[str], number: int = 0, size: int = 20) -> DataFrame:
    """One page of rows in a total order."""
    return df.orderBy(*order).offset(number * size).limit(size)
