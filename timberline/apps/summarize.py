"""Log summarization: load, clean, parse, and query the templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timberline.config import LogParserConfig, PreprocessorConfig, WorkFlowConfig
from timberline.operators import drill
from timberline.operators.clean import clean
from timberline.operators.counters import frequency, trend
from timberline.record import ROW_ID, LogRecord
from timberline.registry import registry
from timberline.sources.readers import load


def prepared(spark: SparkSession | None, config: WorkFlowConfig, record: LogRecord | None) -> LogRecord:
    """The record, loaded if none is given, without null lines, cleaned."""
    record = record or load(spark, config.data_loader_config)
    record = record.dropna()
    rules = config.preprocessor_config or PreprocessorConfig()
    return LogRecord(clean(record.df, rules, terms=False), record.columns)


def parsed(df: DataFrame, config: LogParserConfig | None) -> DataFrame:
    """Rows with parsed_logline, parameter_list and event_id added."""
    config = config or LogParserConfig()
    p = registry.get("parsing", config.parsing_algorithm, config.parsing_algo_params)(df)
    return df.join(p.drop("logline"), ROW_ID)


class LogSummary:
    def __init__(self, config: WorkFlowConfig):
        self.config = config
        self.results: DataFrame | None = None

    def execute(self, spark: SparkSession | None = None, record: LogRecord | None = None) -> DataFrame:
        r = prepared(spark, self.config, record)
        self.results = parsed(r.df, self.config.log_parser_config)
        return self.results

    @property
    def log_patterns(self) -> DataFrame:
        return self.results.select("parsed_logline").distinct()

    def get_parameter_list(self, pattern: str) -> DataFrame:
        return drill.parameter_summary(self.results, pattern)

    def find_log_pattern(self, logline: str, with_parameters: bool = False) -> DataFrame:
        return drill.pattern_of_line(self.results, logline, with_parameters)

    def summary(self, attributes: dict | None = None) -> DataFrame:
        return frequency(drill.where_attributes(self.results, attributes), "parsed_logline")

    def trend(self, pattern: str, width: str) -> DataFrame:
        return trend(self.results.where(self.results["parsed_logline"] == pattern), width, label="right")
