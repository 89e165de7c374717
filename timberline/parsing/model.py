"""A log parser as a model: fitted on some lines, kept as a table, applied to others."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from timberline.parsing.ael import AELParams, ael
from timberline.parsing.drain import DrainParams, drain, fit_templates, match_templates
from timberline.parsing.iplom import IPLoMParams, iplom
from timberline.runtime import cut

ALGORITHMS = {"drain": (drain, DrainParams), "ael": (ael, AELParams), "iplom": (iplom, IPLoMParams)}


class LogParser:
    """fit, parse, fit_parse, match, save and load.

    Drain keeps its templates: `fit` grows them, `parse` grows them by its lines too and matches, `match` leaves them alone. AEL
    and IPLoM have no state: they parse whatever they are given.
    """

    def __init__(self, algorithm: str = "drain", params: dict | None = None):
        if algorithm.lower() not in ALGORITHMS:
            raise ValueError(f"no parsing algorithm {algorithm!r}; there are {sorted(ALGORITHMS)}")
        self.algorithm = algorithm.lower()
        self.run, kind = ALGORITHMS[self.algorithm]
        self.params = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in (params or {}).items()})
        self.templates: DataFrame | None = None

    def fit(self, df: DataFrame, row_id: str = "_id", text: str = "logline") -> LogParser:
        if self.algorithm == "drain":
            self.templates = cut(fit_templates(df, self.params, row_id, text, self.templates))
        return self

    def parse(self, df: DataFrame, row_id: str = "_id", text: str = "logline") -> DataFrame:
        if self.algorithm != "drain":
            return self.run(df, self.params, row_id, text)
        before = self.templates
        self.fit(df, row_id, text)
        return drain(df, self.params, row_id, text, start=before)

    fit_parse = parse

    def match(self, df: DataFrame, row_id: str = "_id", text: str = "logline") -> DataFrame:
        """Lines by the templates as they are; null where none fits."""
        if self.templates is None:
            raise ValueError("the parser has no templates: fit it, or load some")
        return match_templates(df, self.templates, self.params, row_id, text)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the algorithm, its parameters and its templates below a path that all executors reach."""
        head = json.dumps({"algorithm": self.algorithm, "params": asdict(self.params)})
        spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/parser")
        if self.templates is not None:
            self.templates.write.mode("overwrite").parquet(f"{path}/templates")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LogParser:
        head = json.loads(spark.read.text(f"{path}/parser").first()[0])
        parser = cls(head["algorithm"], head["params"])
        if parser.algorithm == "drain":
            parser.templates = spark.read.parquet(f"{path}/templates")
        return parser
