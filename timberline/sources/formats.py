"""Formats of text logs: the field notation, and presets of open data sets."""

from __future__ import annotations

import re

from timberline.config import DataLoaderConfig

#: Settings of open data sets.
PRESETS = {
    "hdfs": {
        "log_type": "log",
        "reader_args": {"log_format": "<Date> <Time> <Pid> <Level> <Content>"},
        "dimensions": {"timestamp": ["Date", "Time"], "body": ["Content"], "attributes": ["Level"], "span_id": ["Pid"]},
        "infer_datetime": True,
        "datetime_format": "%y%m%d %H%M%S",
    },
    "bgl": {
        "log_type": "log",
        "reader_args": {"log_format": "<Label> <Id> <Date> <Code1> <Time> <Code2> <Content>"},
        "dimensions": {"timestamp": ["Date"], "body": ["Content"], "attributes": ["Code1", "Code2"]},
        "infer_datetime": True,
        "datetime_format": "%Y.%m.%d",
    },
    "healthapp": {
        "log_type": "csv",
        "reader_args": {"names": ["Timestamps", "Action", "ID", "Details"], "sep": "|", "header": 0, "on_bad_lines": "skip"},
        "dimensions": {"timestamp": ["Timestamps"], "body": ["Details"], "attributes": ["Action", "ID"]},
        "infer_datetime": True,
        "datetime_format": "%Y%m%d-%H:%M:%S:%f",
    },
}


def notation(log_format: str) -> list[tuple[str | None, str]]:
    """The parts of a format such as '<Date> <Time> <Content>': (field, '') for a field, (None, expression) for the text between
    fields, which is a regular expression itself; its blanks stand for any white space."""
    parts, at = [], 0
    for m in re.finditer(r"<([^<>]+)>", log_format):
        parts += [(None, re.sub(" +", r"\\s+", log_format[at : m.start()])), (m[1], "")]
        at = m.end()
    return [p for p in [*parts, (None, re.sub(" +", r"\\s+", log_format[at:]))] if p != (None, "")]


def line_pattern(log_format: str) -> tuple[str, list[str]]:
    """A format as an expression with one lazy group per field, and the fields."""
    parts = notation(log_format)
    return "^" + "".join("(.*?)" if f else x for f, x in parts) + "$", [f for f, _ in parts if f]


def preset(name: str, path: str) -> DataLoaderConfig:
    """Settings of a named open data set; an unknown name raises ValueError."""
    if name is None or name.lower() not in PRESETS:
        raise ValueError(f"no data set {name!r}; there are {sorted(PRESETS)}")
    return DataLoaderConfig.from_dict(PRESETS[name.lower()] | {"filepath": path})
