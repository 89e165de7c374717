"""The log record: one DataFrame with a mapping of fields to columns, and an explicit row id."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a record, and the columns they usually have.
FIELDS = ("timestamp", "attributes", "resource", "trace_id", "span_id", "severity_text", "severity_number", "body", "labels")
ROW_ID = "_id"


@dataclass
class LogRecord:
    """Rows with `_id` and, per field, the columns that make it up. A field without columns is absent."""

    df: DataFrame
    columns: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self):
        unknown = set(self.columns) - set(FIELDS)
        if unknown:
            raise KeyError(f"no fields {sorted(unknown)}")
        missing = [c for cs in self.columns.values() for c in cs if c not in self.df.columns]
        if missing or ROW_ID not in self.df.columns:
            raise IndexError(f"columns {missing or [ROW_ID]} are not in the rows")

    @classmethod
    def from_dataframe(cls, df: DataFrame, meta: dict[str, list[str]] | None = None) -> "LogRecord":
        """Without meta all columns, joined by spaces, are the body. An unknown field raises KeyError."""
        if not meta:
            own = [c for c in df.columns if c != ROW_ID]
            return cls(df.select(ROW_ID, F.concat_ws(" ", *own).alias("logline")), {"body": ["logline"]})
        meta = {k: list(v) for k, v in meta.items() if v}
        if set(meta) - set(FIELDS):
            raise KeyError(f"no fields {sorted(set(meta) - set(FIELDS))}")
        return cls(df.select(ROW_ID, *dict.fromkeys(c for cs in meta.values() for c in cs)), meta)

    def to_dataframe(self) -> DataFrame:
        return self.df

    def select_by_index(self, ids: list | DataFrame) -> "LogRecord":
        """Rows with these ids: a short list, or a table of ids of any size."""
        if isinstance(ids, DataFrame):
            return LogRecord(self.df.join(ids.select(ROW_ID).distinct(), ROW_ID, "left_semi"), self.columns)
        return LogRecord(self.df.where(F.col(ROW_ID).isin(list(ids))), self.columns)

    def filter_by_index(self, ids: list | DataFrame) -> "LogRecord":
        """Rows without these ids."""
        if isinstance(ids, DataFrame):
            return LogRecord(self.df.join(ids.select(ROW_ID).distinct(), ROW_ID, "left_anti"), self.columns)
        return LogRecord(self.df.where(~F.col(ROW_ID).isin(list(ids))), self.columns)

    def dropna(self) -> "LogRecord":
        """Rows whose body has no null."""
        return LogRecord(self.df.dropna(subset=self.columns.get("body", ["logline"])), self.columns)

    def save(self, path: str) -> None:
        """Parquet with the fields beside it (`<path>_metadata.json`)."""
        self.df.write.mode("overwrite").parquet(path)
        _write_meta(self.df.sparkSession, path, self.columns)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LogRecord":
        return cls(spark.read.parquet(path), _read_meta(spark, path))

    def save_to_csv(self, path: str) -> None:
        """CSV with header, for exchange; arrays as JSON text, nulls and empty texts alike (null when read). Paths that don't end in .csv
        raise ValueError."""
        if not path.endswith(".csv"):
            raise ValueError(f"not a .csv path: {path}")
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in self.df.dtypes]
        self.df.select(*flat).write.mode("overwrite").options(**CSV_AS_IS).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
        _write_meta(self.df.sparkSession, path.removesuffix(".csv"), self.columns)

    @classmethod
    def load_from_csv(cls, spark: SparkSession, path: str, schema: str | None = None) -> "LogRecord":
        r = spark.read.options(**CSV_AS_IS).option("header", True).option("multiLine", True).option("escape", '"')
        df = r.schema(schema).csv(path) if schema else r.csv(path)
        return cls.from_dataframe(df, _read_meta(spark, path.removesuffix(".csv")))


#: Values in CSV as they are: times with all their digits, texts with the blanks around them.
CSV_AS_IS = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}_metadata.json")


def _read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path}_metadata.json").collect()))
