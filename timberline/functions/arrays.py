"""Arithmetic on arrays of scores and token ids, as higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(scores: Column) -> Column:
    """exp(x - max) over its sum; null for an empty array."""
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.when(F.size(scores) > 0, F.transform(e, lambda x: x / _sum(e)))


def entropy(probabilities: Column) -> Column:
    """-sum p ln p, where p > 0."""
    return _sum(F.transform(probabilities, lambda p: F.when(p > 0, -p * F.log(p)).otherwise(0.0)))


def log_probability(probabilities: Column, truth: Column) -> Column:
    """ln of the probability at an index (from 0); null if it is zero or there is none."""
    p = F.get(probabilities, truth)
    return F.when(p > 0, F.log(p))


def divergence(p: Column, q: Column, floor: float = 1e-20) -> Column:
    """Kullback-Leibler divergence of two arrays of probabilities, floored."""
    f = lambda x: F.greatest(x, F.lit(floor))
    return _sum(F.zip_with(p, q, lambda a, b: f(a) * F.log(f(a) / f(b))))


def top_k(scores: Column, k: int) -> Column:
    """Indexes (from 0) of the k largest scores, ties by index."""
    order = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.alias("i"))))
    return F.slice(F.transform(order, lambda o: o["i"]), 1, k)


def in_top_k(scores: Column, truth: Column, k: int) -> Column:
    """Whether an index is among the k largest scores."""
    return F.array_contains(top_k(scores, k), truth)


def masked_windows(ids: Column, mask_id: int, ngram: int = 1) -> Column:
    """One copy of the ids per window of `ngram` places, with the window masked: windows follow each other and the last may be
    shorter. The masked language model's test inputs; an empty array has none."""
    n = F.size(ids)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(ngram))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.transform(ids, lambda x, i: F.when((i >= s) & (i < s + ngram), F.lit(mask_id)).otherwise(x)))
