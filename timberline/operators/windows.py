"""Sliding, strided, tumbling and id-based windows over log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.timebuckets import bucket_start
from timberline.operators.positions import neighbourhood, with_position


def require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in {df.columns}")


def _grouped(df: DataFrame, keys: list[str], group_by_time: str | None, ts: str) -> tuple[DataFrame, list[str]]:
    """Rows with non-null keys, and the grouping columns (time as its bucket's start in `timestamp`)."""
    require(df, [*keys, *([ts] if group_by_time else [])])
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    if group_by_time:
        df = df.where(F.col(ts).isNotNull()).withColumn("__t", bucket_start(F.col(ts), group_by_time))
        return df, [*keys, "__t"]
    return df, keys


def sliding_windows(df: DataFrame, size: int, text: str = "logline", row_id: str = "_id", group_by: list[str] | None = None, group_by_time: str | None = None, ts: str = "timestamp", separator: str = "[SEP]", exclude_last_window: bool = False, exclude_smaller_windows: bool = False, label: str | None = None) -> DataFrame:
    """Windows of `size` consecutive rows, joined by the separator; within groups if group columns or a bucket are given.

    Output: group columns (`timestamp` for the time bucket), row id of the window's row, `window`, and with both flags
    `next_logline` (and `labels`: any label 1 in the window or the next row, if a label column is given).

    Neither flag: one window per row, ending with it; the first ones are shorter. exclude_last_window: the window ends before
    the row, so a group's first is empty. exclude_smaller_windows: only full windows. Groups of at most `size` rows give, with
    exclude_smaller_windows, one window: all rows, or with both flags all but the last. size <= 0: rows are returned as they are,
    with a window of their own. Null texts are left out of the joined text; null group keys leave the row out. Hot
    groups are cut into blocks that share rows at their edges.
    """
    keys0 = list(group_by or [])
    df, keys = _grouped(df, keys0, group_by_time, ts)
    require(df, [text, row_id])
    out = [F.col(k) for k in keys0] + ([F.col("__t").alias(ts)] if group_by_time else [])
    if size <= 0:
        return df.select(*out, F.col(row_id), F.col(text).alias("window"))
    lab = F.coalesce(F.col(label).cast("int"), F.lit(0)) if label else F.lit(0)
    slim = df.select(*keys, row_id, F.struct(F.col(text).alias("x"), lab.alias("l")).alias("__x"))
    d, own, w = neighbourhood(with_position(slim, [*keys, row_id]), before=size, after=1)
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("k"))
    d = d.withColumn("__k", key)
    d = d.withColumn("__a", F.collect_list(F.struct(F.col("__k").alias("k"), F.col("__x").alias("v"))).over(w.rowsBetween(-size, 0)))
    ends = F.coalesce(F.lead("__k").over(w) != F.col("__k"), F.lit(True))
    d = d.withColumn("__ends", ends).where(own)
    d = d.withColumn("__a", F.transform(F.filter("__a", lambda e: e["k"] == F.col("__k")), lambda e: e["v"]))
    n, a = F.size("__a"), F.col("__a")
    small = F.col("__ends") & (n <= size)  # last row of a group of at most `size` rows
    join = lambda x: F.array_join(F.transform(x, lambda v: v["x"]), separator)
    rest = F.slice(a, 1, n - 1)
    extra: list[Column] = []
    if exclude_last_window and exclude_smaller_windows:
        d = d.where((n == size + 1) | small)
        window = join(rest)
        extra.append(F.element_at(a, -1)["x"].alias("next_logline"))
        if label:
            extra.append(F.exists(a, lambda v: v["l"] == 1).cast("int").alias("labels"))
    elif exclude_smaller_windows:
        d = d.where((n >= size) | small)
        window = join(F.slice(a, F.greatest(n - size + 1, F.lit(1)), size))
    elif exclude_last_window:
        window = join(rest)
    else:
        window = join(F.slice(a, F.greatest(n - size + 1, F.lit(1)), size))
    return d.select(*out, row_id, window.alias("window"), *extra)


def strided_sequences(df: DataFrame, size: int, step: int = 1, text: str = "logline", row_id: str = "_id", group_by: list[str] | None = None, group_by_time: str | None = None, ts: str = "timestamp", separator: str = " ") -> DataFrame:
    """Windows of `size` rows that start at every `step`-th row of a group and are full; groups of fewer rows give one.

    Output: group columns, `seq_no` (from 0), `n_rows`, `first_id`, `sequence` (texts joined). With size <= 0 a group is one
    window (its rows are then gathered: such groups should be time buckets).
    """
    keys0 = list(group_by or [])
    df, keys = _grouped(df, keys0, group_by_time, ts)
    require(df, [text, row_id])
    out = [F.col(k) for k in keys0] + ([F.col("__t").alias(ts)] if group_by_time else [])
    if size <= 0:
        g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(row_id).alias("i"), F.col(text).alias("x")))).alias("a"))
        return g.select(*out, F.lit(0).cast("bigint").alias("seq_no"), F.size("a").cast("bigint").alias("n_rows"), F.get("a", F.lit(0))["i"].alias("first_id"), F.array_join(F.transform("a", lambda v: v["x"]), separator).alias("sequence"))
    slim = with_position(df.select(*keys, row_id, F.col(text).alias("__x")), [*keys, row_id])
    bounds = slim.groupBy(*keys).agg(F.min("pos").alias("__lo"), F.count("*").alias("__n")) if keys else slim.agg(F.min("pos").alias("__lo"), F.count("*").alias("__n"))
    d, own, w = neighbourhood(slim, before=0, after=size)
    d = d.withColumn("__a", F.collect_list(F.struct(F.col(row_id).alias("i"), F.coalesce("__x", F.lit("")).alias("x"))).over(w.rowsBetween(0, size - 1))).where(own)
    d = d.join(bounds, keys) if keys else d.join(F.broadcast(bounds))  # without keys the bounds are one row
    i = F.col("pos") - F.col("__lo")
    d = d.where((F.pmod(i, F.lit(step)) == 0) & ((i + size <= F.col("__n")) | ((i == 0) & (F.col("__n") < size))))
    a = F.slice("__a", F.lit(1), F.least(F.lit(size), F.col("__n")).cast("int"))
    return d.select(*out, (i / step).cast("bigint").alias("seq_no"), F.size(a).cast("bigint").alias("n_rows"), F.col(row_id).alias("first_id"), F.array_join(F.transform(a, lambda v: v["x"]), separator).alias("sequence"))


def id_sessions(df: DataFrame, span: str = "span_id", text: str = "logline", row_id: str = "_id", label: str | None = "labels", separator: str = "[SEP]") -> DataFrame:
    """One row per span id: its lines in order, joined, and whether any label is 1. Null spans are left out.

    The joined text of a span is one value; spans are expected to be of a size that a value can have.
    """
    require(df, [span, text, row_id])
    lines = F.array_sort(F.collect_list(F.struct(F.col(row_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("x"))))
    aggs = [F.array_join(F.transform(lines, lambda v: v["x"]), separator).alias("logline"), F.count("*").alias("counts")]
    if label:
        aggs.append(F.max((F.coalesce(F.col(label), F.lit(0)) == 1).cast("int")).alias("labels"))
    return df.where(F.col(span).isNotNull()).groupBy(span).agg(*aggs)


def time_sessions(df: DataFrame, seconds: Column, row_id: str = "_id", width: int = 60, name: str = "span_id") -> DataFrame:
    """Add the number of `width`-second steps since the first row (by row id), cut towards zero; null for null."""
    d = df.withColumn("__s", seconds)
    first = d.agg(F.min_by("__s", row_id).alias("s")).first()[0]
    return d.withColumn(name, ((F.col("__s") - F.lit(first)) / width).cast("int")).drop("__s")
