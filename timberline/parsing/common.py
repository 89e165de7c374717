"""What the template parsers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.text import event_id, java_literal, java_regex, parameters_by_substring


def mask(c: Column, rex: list[str] | None, by: str) -> Column:
    for p in rex or []:
        c = F.regexp_replace(c, java_regex(p), java_literal(by))
    return c


def finish(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """row id, logline, parsed_logline, parameter_list, event_id from columns `id`, `line` and `template`."""
    return df.select(
        F.col("id").alias(row_id),
        F.col("line").alias(text),
        F.col("template").alias("parsed_logline"),
        parameters_by_substring(F.col("line"), F.col("template")).alias("parameter_list"),
        event_id(F.col("template")).alias("event_id"),
    )


def lines_of(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """id and line; rows with null text or id take no part."""
    return df.where(F.col(text).isNotNull() & F.col(row_id).isNotNull()).select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("line"))
