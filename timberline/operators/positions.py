"""Row numbers and neighbourhoods over a whole table, without gathering it (or a hot group) in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.runtime import cut, shuffle_partitions

LOCAL_BITS = 33


def with_position(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Add the row's number (from 0) in the order of the given columns, nulls first; ties in any order.

    Rows are range-partitioned and sorted in their partitions; a partition's first number is the sum of the sizes before
    it (one number per partition on the driver). The sorted rows are written once, so that numbers can't change between uses.
    """
    d = df.repartitionByRange(shuffle_partitions(df.sparkSession), *[F.col(c).asc() for c in order]).sortWithinPartitions(*order)
    d = cut(d.withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", LOCAL_BITS)
    sizes = {r[0]: r[1] for r in d.groupBy(part.alias("p")).count().collect()}
    first, n = [], 0
    for p in range(max(sizes, default=-1) + 1):
        first.append(n)
        n += sizes.get(p, 0)
    offset = F.get(F.array(*[F.lit(x).cast("bigint") for x in first]), part.cast("int")) if first else F.lit(0).cast("bigint")
    return d.withColumn(name, offset + F.col("__m").bitwiseAND((1 << LOCAL_BITS) - 1)).drop("__m")


def neighbourhood(df: DataFrame, before: int, after: int, block: int = 20_000, pos: str = "pos") -> tuple[DataFrame, Column, object]:
    """Blocks of consecutive rows with the rows just outside copied in: (rows, own, window).

    Every frame of at most `before` preceding and `after` following rows is whole in the block of its row. `own` tells a
    block's rows from the copies; the window is ordered by position within the block.
    """
    block = max(block, before, after, 1)
    b, r = F.floor(F.col(pos) / block).cast("bigint"), F.pmod(F.col(pos), F.lit(block))
    to = F.array_compact(F.array(b, F.when(r >= block - before, b + 1) if before else F.lit(None).cast("bigint"), F.when((r < after) & (b > 0), b - 1) if after else F.lit(None).cast("bigint")))
    d = df.withColumn("__b", F.explode(to))
    return d, F.col("__b") == b, Window.partitionBy("__b").orderBy(pos)
