"""Readers of csv, tsv, json and free text into log records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.config import DataLoaderConfig
from timberline.functions.timebuckets import parse_time
from timberline.operators.positions import with_position
from timberline.record import ROW_ID, LogRecord
from timberline.sources.formats import line_pattern, preset


def _numbered(df: DataFrame) -> DataFrame:
    """_id by place in the files, which must be read before anything shuffles: file, then order within its splits."""
    d = df.withColumn("__f", F.col("_metadata.file_path")).withColumn("__s", F.col("_metadata.file_block_start")).withColumn("__m", F.monotonically_increasing_id())
    return with_position(d, ["__f", "__s", "__m"], ROW_ID).drop("__f", "__s", "__m")


def read_text(spark: SparkSession, path: str, log_format: str, numbered: bool = True) -> DataFrame:
    """Lines that match the format, one column per field (all text); others are left out. Lines are stripped first.

    Bytes that are no UTF-8 are dropped. _id counts the kept lines.
    """
    pattern, names = line_pattern(log_format)
    readable = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.regexp_replace(F.make_valid_utf8("value"), "\ufffd", ""))
    line = F.regexp_replace(readable, r"^\s+|\s+$", "")
    d = spark.read.text(path).withColumn("value", line).where(F.col("value").rlike(pattern))
    d = _numbered(d) if numbered else d
    return d.select(*([ROW_ID] if numbered else []), *[F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: int | None | str = "infer", names: list[str] | None = None, on_bad_lines: str = "error", schema: str | None = None) -> DataFrame:
    """Delimited text with the usual reader arguments: `header` is the line with names (0), None for none; `names` replaces them
    (with header 0 the first line is dropped). on_bad_lines: 'error' or 'skip' (lines of more fields than names)."""
    if header == "infer":
        header = None if names else 0
    r = spark.read.option("sep", sep).option("header", header == 0).option("mode", "DROPMALFORMED" if on_bad_lines == "skip" else "FAILFAST")
    r = r.option("enforceSchema", True)
    if schema or names:
        r = r.schema(schema or ", ".join(f"`{n}` string" for n in names))
        return _numbered(r.csv(path))
    return _numbered(r.option("inferSchema", True).csv(path))


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Files that are one document each (an array of objects, or an object), or with `lines` have an object in every line."""
    return _numbered(spark.read.option("multiLine", not lines).json(path))


def to_record(df: DataFrame, config: DataLoaderConfig) -> LogRecord:
    """Map columns to fields by `dimensions`: body and time of several columns are joined by a space.

    Without dimensions all columns make up the body. More than one span column raises ValueError. The time is parsed where
    infer_datetime and a format are set; what doesn't fit is null.
    """
    dims = {k: list(v) for k, v in (config.dimensions or {}).items() if v}
    if not dims:
        return LogRecord.from_dataframe(df)
    if len(dims.get("span_id", [])) > 1:
        raise ValueError("a record has one span column")
    out, meta = [F.col(ROW_ID)], {}
    for f, cols in dims.items():
        one = F.col(f"`{cols[0]}`") if len(cols) == 1 else F.concat_ws(" ", *[F.col(f"`{c}`") for c in cols])
        if f == "body":
            out.append(one.cast("string").alias("logline"))
            meta[f] = ["logline"]
        elif f == "timestamp":
            ts = parse_time(one.cast("string"), config.datetime_format) if config.infer_datetime and config.datetime_format else one
            out.append(ts.alias("timestamp"))
            meta[f] = ["timestamp"]
        elif f in ("span_id", "labels"):
            out.append(one.alias(f))
            meta[f] = [f]
        else:
            out += [F.col(f"`{c}`") for c in cols]
            meta[f] = cols
    return LogRecord(df.select(*out), meta)


def load(spark: SparkSession, config: DataLoaderConfig) -> LogRecord:
    """Load by `log_type`: csv, tsv, json, anything else is text with reader_args.log_format; or an open data set by name."""
    if config.open_dataset:
        config = preset(config.open_dataset, config.filepath)
    args = dict(config.reader_args or {})
    if config.log_type in ("csv", "tsv"):
        sep = args.get("sep", "\t" if config.log_type == "tsv" else ",")
        df = read_delimited(spark, config.filepath, sep, args.get("header", "infer"), args.get("names"), args.get("on_bad_lines", "error"), args.get("schema"))
    elif config.log_type == "json":
        df = read_json(spark, config.filepath, bool(args.get("lines", False)))
    elif config.log_type in ("parquet", "orc"):
        df = _numbered(spark.read.format(config.log_type).load(config.filepath))
    else:
        df = read_text(spark, config.filepath, args["log_format"])
    return to_record(df, config)
