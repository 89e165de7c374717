"""Train and test splits of log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.positions import with_position


def chronological_split(df: DataFrame, order: list[str], train_fraction: float = 0.7) -> DataFrame:
    """Add `is_train`: whether a row is among the first floor(fraction * n) in order."""
    d = with_position(df, order, "__p")  # written once: counting reads what is kept
    n = d.count()
    return d.withColumn("is_train", F.col("__p") < int(train_fraction * n)).drop("__p")


def _share(*cols) -> Column:
    """A number in [0, 1) by a hash of the columns."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("bigint"), F.lit(1_000_000)) / 1_000_000.0


def span_split(df: DataFrame, span: str = "span_id", label: str = "labels", train: float = 0.7, dev: float = 0.1, seed: int = 7) -> DataFrame:
    """Add `split` (train, dev, test): spans of either label in these shares by a hash of the span, never divided.

    A span is positive if any of its rows is. Rows with null span are left out.
    """
    d = df.where(F.col(span).isNotNull())
    pos = d.groupBy(span).agg(F.max((F.coalesce(F.col(label), F.lit(0)) == 1).cast("int")).alias("__pos"))
    u = _share(F.col(span), F.col("__pos"), F.lit(seed))
    which = F.when(u < train, "train").when(u < train + dev, "dev").otherwise("test")
    return d.join(pos.select(F.col(span), which.alias("split")), span)


def unsupervised_split(df: DataFrame, span: str = "span_id", label: str = "labels", test_fraction_pos: float = 0.8, test_fraction_neg: float = 0.8, seed: int = 7) -> DataFrame:
    """Like span_split for training on normal spans: positive spans are in test or dropped (null split), by their fraction."""
    d = df.where(F.col(span).isNotNull())
    pos = d.groupBy(span).agg(F.max((F.coalesce(F.col(label), F.lit(0)) == 1).cast("int")).alias("__pos"))
    u = _share(F.col(span), F.lit(seed))
    which = F.when(F.col("__pos") == 1, F.when(u < test_fraction_pos, "test")).otherwise(F.when(u < test_fraction_neg, "test").otherwise("train"))
    return d.join(pos.select(F.col(span), which.alias("split")), span)
