"""Metrics of binary predictions and scores, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.positions import with_position


def binary_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: n, accuracy, precision, recall, f1. Rows with a null are left out; a ratio without cases is 0."""
    d = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    y, p = F.col(label) == 1, F.col(prediction) == 1
    c = d.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(x.cast("int")), F.lit(0)).alias(k) for k, x in (("tp", y & p), ("fp", ~y & p), ("fn", y & ~p), ("hit", y == p))])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("n", ratio(F.col("hit"), F.col("n")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def auroc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: n_pos, n_neg, auroc by ranks, equal scores sharing their average rank. Null without both classes."""
    d = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select((F.col(label) == 1).cast("bigint").alias("y"), F.col(score).alias("s"))
    by = with_position(d, ["s"]).groupBy("s").agg(F.sum("y").alias("pos"), F.count("*").alias("n"), ((F.min("pos") + F.max("pos")) / 2 + 1).alias("rank"))
    r = by.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum(F.col("n") - F.col("pos")), F.lit(0)).alias("n_neg"), F.sum(F.col("pos") * F.col("rank")).alias("ranks"))
    p, q = F.col("n_pos"), F.col("n_neg")
    return r.select("n_pos", "n_neg", F.when((p > 0) & (q > 0), (F.col("ranks") - p * (p + 1) / 2) / (p * q)).alias("auroc"))


def perplexity(df: DataFrame, loss: str) -> DataFrame:
    return df.agg(F.exp(F.avg(loss)).alias("perplexity"))


def session_predictions(df: DataFrame, session: str, prediction: str, label: str) -> DataFrame:
    """Per session whether any window is predicted, and whether any is labelled."""
    return df.groupBy(session).agg(F.max((F.col(prediction) > 0).cast("int")).alias("prediction"), F.max((F.col(label) > 0).cast("int")).alias("label"))
