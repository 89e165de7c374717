"""Join pieces of keyed sequences that were computed per time slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stitch(parts: DataFrame, order: tuple[str, ...], continues, aggregates: list[Column]) -> DataFrame:
    """Merge pieces over `key` where `continues(lag)` holds; lag(c) is the column c of the piece before.

    parts has key, slice, at_head and at_tail (first or last piece of its key and slice). Only such edges can go on in
    another slice; there are at most two a slice, so the window over a hot key stays small. Pieces inside a slice
    are final: they keep to partitions of their own slice, and the whole is one pass with one shuffle of pieces.
    """
    edge = F.col("at_head") | F.col("at_tail")
    parts = parts.withColumn("own", F.when(~edge, F.col("slice")))
    w = Window.partitionBy("key", "own").orderBy(*order)
    fresh = F.when(edge & continues(lambda c: F.lag(c).over(w)), 0).otherwise(1)
    g = parts.withColumn("fresh", fresh).withColumn("g", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("key", "own", "g").agg(*aggregates).drop("own", "g")
