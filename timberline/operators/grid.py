"""Irregular readings onto a regular grid by a two-sided as-of merge (problem 7).

Readings are first reduced to one row per series and grid step (sum of weights, last and first reading): a hot series
or step is combined map-side, and what is left of a series is bounded by its time range, not by its number of readings.
Each series' grid, from its first to its last step, is then merged with these rows in one sort: every grid step takes its
nearest observed neighbour on both sides, and empty steps are interpolated linearly in time between the two, unless
the neighbours lie further apart than the gap limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.runtime import cut


@dataclass(frozen=True)
class GridSpec:
    series: tuple[str, ...] = ("action_name", "id")
    ts: str = "ts"
    value: str = "counts"
    step_seconds: int = 900
    gap_limit_seconds: int = 3 * 3600
    span_steps: int = 4096  # grid steps of a series in one sort; longer series are cut and the cuts bridged


def regular_grid(df: DataFrame, spec: GridSpec = GridSpec()) -> DataFrame:
    """One row per series and grid step from the series' first to its last reading.

    Columns: the series columns, bucket_start (seconds since 1970 UTC), n_readings, value, status, prev_s, next_s.
    status is 'observed' (value = mean of the step's readings), 'interpolated' (linear in time between the readings
    before and after the step) or 'gap' (value null: those readings are more than the gap limit apart). prev_s and next_s
    are the times (seconds) of the last reading before the step's end and of the first at or after its beginning, so
    that a step is empty where they lie on its two sides. A step holds its beginning and not its end. Rows with null or negative value, null time or a null series column are no readings;
    a row delivered again (same series, time and value) counts once. A series of one reading is one step; an
    empty table gives no rows. Other columns are not read.
    """
    keys = [f"s{i}" for i in range(len(spec.series))]
    step = spec.step_seconds
    us = F.unix_micros(F.col(spec.ts).cast("timestamp"))
    r = df.select(*[F.col(c).alias(k) for c, k in zip(spec.series, keys)], us.alias("us"), F.col(spec.value).cast("double").alias("v"))
    ok = F.col("us").isNotNull() & (F.col("v") >= 0) & ~F.isnan("v")
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    r = r.where(ok).withColumn("bucket", F.floor(F.col("us") / F.lit(step * 1_000_000)).cast("bigint"))
    # repeats differ in delivery only; the set of distinct readings of a step is what counts
    once = r.groupBy(*keys, "bucket", "us", "v").agg(F.lit(1).alias("one"))
    steps = once.groupBy(*keys, "bucket").agg(
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        F.min(F.struct("us", "v")).alias("head"),
        F.max(F.struct("us", "v")).alias("tail"),
    )
    steps = cut(steps)  # used three times: as readings, for the bounds of the grid and at the edges of its pieces
    bounds = steps.groupBy(*keys).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    # the grid in pieces of span_steps: a far outlier of one series gives many small rows, not one huge array
    piece = F.lit(spec.span_steps)
    pieces = bounds.withColumn("p", F.explode(F.sequence(F.floor(F.col("lo") / piece), F.floor(F.col("hi") / piece))))
    grid = pieces.select(*keys, F.explode(F.sequence(F.greatest("lo", F.col("p") * piece), F.least("hi", F.col("p") * piece + piece - 1))).alias("bucket"))
    empty = steps.select(*keys, "bucket", "n", "mean", "head", "tail")
    both = empty.unionByName(grid, allowMissingColumns=True)
    # grid row and reading row of the same step meet here: map-side combined, and partitioned as the as-of windows need it
    merged = both.groupBy(*keys, "bucket").agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("head").alias("head"), F.max("tail").alias("tail"))
    merged = merged.withColumn("p", F.floor(F.col("bucket") / piece).cast("bigint"))
    # as of a step's end and as of its beginning: a reading within the step is its own neighbour on both sides
    before = Window.partitionBy(*keys, "p").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*keys, "p").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = merged.withColumn("prev", F.last("tail", ignorenulls=True).over(before)).withColumn("next", F.last("head", ignorenulls=True).over(after))
    # neighbours across the cuts: one row per series and piece
    edge = steps.withColumn("p", F.floor(F.col("bucket") / piece).cast("bigint")).groupBy(*keys, "p").agg(F.max("tail").alias("e_tail"), F.min("head").alias("e_head"))
    edge = pieces.select(*keys, F.col("p").cast("bigint").alias("p")).join(edge, [*keys, "p"], "left")
    eb = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ea = Window.partitionBy(*keys).orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(*keys, "p", F.last("e_tail", ignorenulls=True).over(eb).alias("far_prev"), F.last("e_head", ignorenulls=True).over(ea).alias("far_next"))
    merged = merged.join(edge, [*keys, "p"], "left").withColumn("prev", F.coalesce("prev", "far_prev")).withColumn("next", F.coalesce("next", "far_next"))
    at = F.col("bucket") * F.lit(step * 1_000_000)
    share = (at - F.col("prev.us")) / (F.col("next.us") - F.col("prev.us"))
    line = F.col("prev.v") + (F.col("next.v") - F.col("prev.v")) * share
    near = (F.col("next.us") - F.col("prev.us")) <= F.lit(spec.gap_limit_seconds * 1_000_000)
    seen = (F.col("prev.us") >= at) & (F.col("next.us") < at + F.lit(step * 1_000_000))
    return merged.select(
        *[F.col(k).alias(c) for c, k in zip(spec.series, keys)],
        (F.col("bucket") * step).cast("bigint").alias("bucket_start"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_readings"),
        F.when(seen, F.col("mean")).when(near, line).alias("value"),
        F.when(seen, "observed").when(near, "interpolated").otherwise("gap").alias("status"),
        (F.col("prev.us") / 1e6).alias("prev_s"),
        (F.col("next.us") / 1e6).alias("next_s"),
    )
