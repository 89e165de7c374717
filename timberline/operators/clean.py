"""Cleaning of log lines, and the cleaners of open data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.config import PreprocessorConfig
from timberline.functions.text import binary_label, collapse_placeholders, replace_delimiters, replace_terms, squeeze
from timberline.operators.encode import serial_ids
from timberline.operators.windows import time_sessions

#: Cleaning rules of open data sets.
HDFS_RULES = PreprocessorConfig([":", ",", "=", "\t"], [[r"(blk_-?\d+)", " BLOCK "], [r"/?/*\d+\.\d+\.\d+\.\d+", " IP "], [r"(0x)[0-9a-zA-Z]+", " HEX "], [r"\d+", " INT "]])
BGL_RULES = PreprocessorConfig([":", ",", "=", "\t"], [[r"(0x)[0-9a-zA-Z]+", " HEX "], [r"((?![A-Za-z]{8}|\d{8})[A-Za-z\d]{8})", " ALPHANUM "], [r"\d+.\d+.\d+.\d+", " IP "], [r"\d+", " INT "]])
THUNDERBIRD_RULES = PreprocessorConfig(
    [":", ",", "=", "\t"],
    [[r"(/[a-zA-Z0-9\-\_\./]*[\s]?)", " FILE "], [r"\d+.\d+.\d+.\d+", " IP "], [r"(0x)[0-9a-zA-Z]+", " HEX "], [r"((?![A-Za-z]{8}|\d{8})[A-Za-z\d]{8})", " ALPHANUM "], [r"\d+", " INT "], [r"Warning: we failed to resolve data source name [\w\s]+", " WARNING "]],
)


def clean(df: DataFrame, config: PreprocessorConfig, text: str = "logline", terms: bool = True) -> DataFrame:
    """Replace delimiters by spaces, then terms by their placeholders in order; found terms become array columns named by
    the placeholder (as it is, spaces included). Null text stays null."""
    c = replace_delimiters(F.col(text), config.custom_delimiters_regex or [])
    rules = [(p, r) for p, r in config.custom_replace_list or []]
    c, found = replace_terms(c, rules)
    return df.withColumns({text: c, **(found if terms else {})})


def clean_open_set(df: DataFrame, config: PreprocessorConfig, text: str = "logline") -> DataFrame:
    """clean, then runs of one placeholder become one, asterisks go, spaces are squeezed."""
    d = clean(df, config, text)
    c = collapse_placeholders(F.col(text), [r for _, r in config.custom_replace_list or []])
    return d.withColumn(text, squeeze(c))


def clean_hdfs(df: DataFrame, labels: DataFrame, config: PreprocessorConfig = HDFS_RULES, text: str = "logline", row_id: str = "_id") -> DataFrame:
    """Cleaned lines with span_id (serial number of the line's set of blocks, in sorted order) and labels (1 if any of its
    blocks is labelled 'Anomaly' in the table BlockId, Label; any number of labels)."""
    d = clean_open_set(df, config, text)
    d = d.withColumn("__b", F.array_join(F.array_sort(F.array_distinct(F.coalesce(F.col("` BLOCK `"), F.array().cast("array<string>")))), " "))
    bad = labels.where(F.col("Label") == "Anomaly").select(F.col("BlockId").alias("__x")).distinct()
    sets = d.select("__b").distinct().withColumn("__x", F.explode(F.split("__b", " ")))
    hit = sets.join(bad, "__x", "left_semi").select("__b").distinct().withColumn("labels", F.lit(1))
    d = serial_ids(d, "__b").join(hit, "__b", "left").withColumn("labels", F.coalesce("labels", F.lit(0)))
    return d.drop("__b")


def clean_bgl(df: DataFrame, config: PreprocessorConfig = BGL_RULES, text: str = "logline", label: str = "labels", span: str = "span_id", row_id: str = "_id") -> DataFrame:
    """Cleaned lines; the span (seconds) becomes the minute since the first row's, labels 0 for '-' and else 1."""
    d = clean_open_set(df, config, text)
    d = time_sessions(d.withColumn("__sec", F.col(span).cast("bigint")).drop(span), F.col("__sec"), row_id, 60, span).drop("__sec")
    return d.withColumn(label, binary_label(F.col(label)))


def clean_thunderbird(df: DataFrame, config: PreprocessorConfig = THUNDERBIRD_RULES, text: str = "logline", label: str = "labels") -> DataFrame:
    """Cleaned lines; the span is kept, labels 0 for '-' and else 1."""
    return clean_open_set(df, config, text).withColumn(label, binary_label(F.col(label)))
