"""What an algorithm of each task takes and gives, for those who register their own."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Parser(Protocol):
    """Lines -> row id, logline, parsed_logline, parameter_list, event_id."""

    def __call__(self, df: DataFrame, *, row_id: str = "_id", text: str = "logline") -> DataFrame: ...


@runtime_checkable
class Vectorizer(Protocol):
    """Lines -> row id and a vector, ids, or terms with weights."""

    def __call__(self, df: DataFrame, *, text: str = "logline", row_id: str = "_id") -> DataFrame: ...


@runtime_checkable
class Clusterer(Protocol):
    """Vectors -> row id and cluster_id (text)."""

    def __call__(self, df: DataFrame, *, vector: str = "features", row_id: str = "_id") -> DataFrame: ...


@runtime_checkable
class Detector(Protocol):
    """Vectors -> row id, anom_score (-1 for outliers), raw_score, trainval."""

    def __call__(self, df: DataFrame, *, vector: str = "features", row_id: str = "_id") -> DataFrame: ...


@runtime_checkable
class SeriesDetector(Protocol):
    """Counters of series -> keys, timestamp, value, anom_score (0 if normal), trainval."""

    def __call__(self, df: DataFrame, keys: list[str], ts: str = "timestamp", value: str = "counts", *, train_fraction: float = 0.7) -> DataFrame: ...
