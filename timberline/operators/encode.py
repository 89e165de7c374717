"""Categorical encoders. Null categories take the id after all others in order of value (nulls first in sort order: id 0)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.positions import with_position
from timberline.operators.windows import require


def value_ids(df: DataFrame, column: str, first: int = 0) -> DataFrame:
    """Distinct values with ids by sorted value, nulls first."""
    return with_position(df.select(column).distinct(), [column], "id").withColumn("id", F.col("id") + first)


def _with_ids(df: DataFrame, columns: list[str], suffix: str, kind: str) -> DataFrame:
    require(df, columns)
    for c in columns:
        ids = value_ids(df, c).select(F.col(c).alias("__v"), F.col("id").cast(kind).alias(f"{c}{suffix}"))
        df = df.join(ids, df[c].eqNullSafe(ids["__v"]), "left").drop("__v")
    return df


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add {column}_categorical: ids by sorted value."""
    return _with_ids(df, columns, "_categorical", "bigint")


def ordinal_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add {column}-categorical: ids by sorted value, as doubles."""
    return _with_ids(df, columns, "-categorical", "double")


def one_hot_encode(df: DataFrame, columns: list[str], drop: str | None = None, max_categories: int = 1000) -> DataFrame:
    """Add one 0/1 double per category of each column, named {c1-c2}-{i} by position. drop='first' leaves out each first
    category. More than `max_categories` categories in a column raise ValueError: they are columns of the plan."""
    require(df, columns)
    out, name = [], "-".join(columns)
    for c in columns:
        seen = df.select(c).distinct().limit(max_categories + 1).collect()
        if len(seen) > max_categories:
            raise ValueError(f"{c} has more than {max_categories} categories")
        values = sorted((r[0] for r in seen), key=lambda v: (v is not None, v))
        out += [F.col(c).eqNullSafe(F.lit(v)).cast("double") for v in (values[1:] if drop == "first" else values)]
    return df.select("*", *[x.alias(f"{name}-{i}") for i, x in enumerate(out)])


def encode(df: DataFrame, columns: list[str], name: str = "label_encoder", params: dict | None = None) -> DataFrame:
    kinds = {"label_encoder": label_encode, "one_hot_encoder": one_hot_encode, "ordinal_encoder": ordinal_encode}
    if name not in kinds:
        raise ValueError(f"no encoder {name!r}; there are {sorted(kinds)}")
    return kinds[name](df, columns, **(params or {}))


def serial_ids(df: DataFrame, column: str, name: str = "span_id") -> DataFrame:
    """Replace ids of any type by serial numbers in sorted order; null stays null."""
    ids = value_ids(df.where(F.col(column).isNotNull()), column).select(F.col(column).alias("__v"), F.col("id").alias("__i"))
    return df.join(ids, F.col(column) == F.col("__v"), "left").drop("__v").withColumn(name, F.col("__i")).drop("__i")
