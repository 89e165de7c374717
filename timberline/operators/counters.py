"""Counters, feature vectors and trends over groups and time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.timebuckets import bucket_start, width_micros
from timberline.operators.positions import with_position
from timberline.operators.windows import _grouped, require
from timberline.runtime import cut


def group_counts(df: DataFrame, group_by: list[str] | None = None, group_by_time: str | None = None, ts: str = "timestamp") -> DataFrame:
    """Rows per group: group columns, `timestamp` (start of the bucket, if grouped by time) and `counts`.

    Only observed groups; rows with a null key take no part. With neither grouping, ValueError.
    """
    if not group_by and not group_by_time:
        raise ValueError("no grouping given")
    keys0 = list(group_by or [])
    d, keys = _grouped(df, keys0, group_by_time, ts)
    c = d.groupBy(*keys).agg(F.count("*").alias("counts"))
    return c.withColumnRenamed("__t", ts) if group_by_time else c


def _part(name: str):
    return lambda v: v[name]


def counter_vector(df: DataFrame, group_by: list[str] | None = None, group_by_time: str | None = None, ts: str = "timestamp", row_id: str = "_id", lists: list[str] | None = None) -> DataFrame:
    """Counter vector: group columns, time bucket, each column of `lists` as an array, `event_index` and `counts`.

    Arrays are in the order of row ids. Without any grouping every row is its own group. Arrays hold a whole group: for hot
    groups ask for counts (group_counts) and keep the rows (group_rows) instead.
    """
    keys0 = list(group_by or [])
    if not keys0 and not group_by_time:
        return df.select(*[F.array(c).alias(c) for c in lists or []], F.array(row_id).alias("event_index"), F.lit(1).cast("bigint").alias("counts"))
    d, keys = _grouped(df, keys0, group_by_time, ts)
    require(d, [row_id, *(lists or [])])
    rows = F.array_sort(F.collect_list(F.struct(F.col(row_id).alias("i"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(lists or [])])))
    g = d.groupBy(*keys).agg(rows.alias("__r"))
    out = [F.col(k) for k in keys0] + ([F.col("__t").alias(ts)] if group_by_time else [])
    return g.select(*out, *[F.transform("__r", _part(f"c{k}")).alias(c) for k, c in enumerate(lists or [])], F.transform("__r", lambda v: v["i"]).alias("event_index"), F.size("__r").cast("bigint").alias("counts"))


def group_rows(df: DataFrame, group_by: list[str] | None = None, group_by_time: str | None = None, ts: str = "timestamp", row_id: str = "_id") -> DataFrame:
    """Membership of rows in groups as rows (group columns, row id): the inverse of event_index, at any size."""
    keys0 = list(group_by or [])
    d, _ = _grouped(df, keys0, group_by_time, ts)
    return d.select(*keys0, *([F.col("__t").alias(f"{ts}_bucket")] if group_by_time else []), row_id)


def group_index(df: DataFrame, by: list[str], row_id: str = "_id") -> DataFrame:
    """Per group the sorted array of its row ids."""
    return counter_vector(df, group_by=by, row_id=row_id).drop("counts")


def feature_vector(df: DataFrame, vector: str, length: int = 100, group_by: list[str] | None = None, group_by_time: str | None = None, ts: str = "timestamp", row_id: str = "_id", numeric: list[str] | None = None) -> DataFrame:
    """Mean of the padded vectors and of the numeric columns in each group: group columns, `features`, means, `counts`.

    Vectors are cut or filled with zeros to `length`. Means are built from per-position sums, which combine map-side.
    """
    from timberline.functions.text import pad

    keys0 = list(group_by or [])
    if not keys0 and not group_by_time:
        keys0 = [row_id]
    d, keys = _grouped(df, keys0, group_by_time, ts)
    require(d, [vector, *(numeric or [])])
    v = pad(F.coalesce(F.col(vector), F.array().cast("array<double>")), length, F.lit(0.0))
    cells = [F.avg(F.get("__v", F.lit(i))).alias(f"f{i}") for i in range(length)]
    g = d.withColumn("__v", v).groupBy(*keys).agg(F.count("*").alias("counts"), *cells, *[F.avg(c).alias(f"mean_{c}") for c in numeric or []])
    out = [F.col(k) for k in keys0] + ([F.col("__t").alias(ts)] if group_by_time else [])
    return g.select(*out, F.array(*[f"f{i}" for i in range(length)]).alias("features"), *[F.col(f"mean_{c}") for c in numeric or []], "counts")


def spread_features(df: DataFrame, vector: str = "features", length: int = 100) -> DataFrame:
    """The vector as columns feature_0 ... feature_{n-1}."""
    return df.select(*[c for c in df.columns if c != vector], *[F.get(vector, F.lit(i)).alias(f"feature_{i}") for i in range(length)])


def trend(df: DataFrame, width: str, ts: str = "timestamp", label: str = "left", zero_fill: bool = True, flags: dict[str, Column] | None = None) -> DataFrame:
    """Rows (and rows by flag) per time bucket, from the first to the last bucket, empty ones with zeros.

    label 'right' names a bucket by its end. Rows with null time take no part. flags: name -> condition counted.
    """
    d = df.where(F.col(ts).isNotNull())
    flags = flags or {}
    c = d.groupBy(bucket_start(F.col(ts), width, label).alias(ts)).agg(F.count("*").alias("counts"), *[F.sum(F.when(f, 1).otherwise(0)).cast("bigint").alias(k) for k, f in flags.items()])
    if not zero_fill:
        return c
    w = width_micros(width)
    us = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
    c = c.withColumn("__u", us(ts))
    # each bucket brings the empty ones up to the next: no array longer than a gap
    nxt = F.lead("__u").over(Window.orderBy("__u"))  # over the buckets, which the time range bounds
    filled = c.withColumn("__n", nxt).withColumn("__e", F.explode(F.sequence(F.col("__u"), F.coalesce(F.col("__n") - w, F.col("__u")), F.lit(w))))
    own = F.col("__e") == F.col("__u")
    return filled.select(F.timestamp_micros("__e").cast("timestamp_ntz").alias(ts), *[F.when(own, F.col(k)).otherwise(0).cast("bigint").alias(k) for k in ("counts", *flags)])


def frequency(df: DataFrame, column: str, count: str = "counts") -> DataFrame:
    """Distinct values with count, ratio of all, and rank from 0 by falling count (ties by value)."""
    c = cut(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(count)))
    total = c.agg(F.sum(count)).first()[0] or 1
    return with_position(c.withColumn("__o", -F.col(count)), ["__o", column], "order").select(column, count, (F.col(count) / F.lit(total)).alias("ratio"), "order")


def dedup_with_counts(df: DataFrame, span: str = "span_id", text: str = "logline", label: str = "labels", ts: str = "timestamp", row_id: str = "_id") -> DataFrame:
    """Distinct (span, text) with count, the highest label and the last row's time."""
    return df.groupBy(span, text).agg(F.count("*").alias("counts"), F.max(label).alias(label), F.max_by(ts, row_id).alias(ts))


def histogram(df: DataFrame, column: str, bins: int, lo: float, hi: float, whole: bool = False) -> DataFrame:
    """Counts in `bins` equal bins of [lo, hi]; the last includes its end, values outside and nulls are left out.

    With `whole`, values outside are counted in further bins of the same width: from `bins` on above hi, negative ones below lo."""
    x = F.col(column).cast("double")
    if whole:
        w = (hi - lo) / bins
        b = F.when(x == F.lit(hi), F.lit(bins - 1)).otherwise(F.floor((x - F.lit(lo)) / F.lit(w))).cast("bigint")
        return df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("counts"))
    w = (hi - lo) / bins
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(w)), F.lit(bins - 1)).cast("bigint")
    return df.where(x.between(lo, hi)).groupBy(b.alias("bin")).agg(F.count("*").alias("counts"))


def top_values(df: DataFrame, key: str, values: str, k: int = 6) -> DataFrame:
    """Mean of the k largest values in a key's arrays. The k largest are kept per partial aggregate, not all values."""
    d = df.select(key, F.explode(values).alias("v"))
    w = Window.partitionBy(key).orderBy(F.col("v").desc())
    return d.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy(key).agg(F.avg("v").alias("top_mean"), F.count("*").alias("n_top"))


def score_moments(df: DataFrame, score: str, label: str) -> DataFrame:
    """Mean and population deviation of the scores by label."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count("*").alias("n"))


def attribute_summary(df: DataFrame, column: str) -> DataFrame:
    """Number of distinct values and of rows."""
    return df.agg(F.count_distinct(column).alias("n_distinct"), F.count("*").alias("n_rows"))
