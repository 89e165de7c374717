"""Time bucket widths and strptime patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of bucket widths in microseconds.
UNITS = {"us": 1, "ms": 1_000, "S": 1_000_000, "s": 1_000_000, "sec": 1_000_000, "T": 60_000_000, "min": 60_000_000, "m": 60_000_000, "H": 3_600_000_000, "h": 3_600_000_000, "D": 86_400_000_000, "d": 86_400_000_000}
CALENDAR = {"M": "month", "ME": "month", "MS": "month", "Q": "quarter", "QS": "quarter", "Y": "year", "YS": "year", "W": "week"}


def width_micros(alias: str) -> int:
    """Width of an alias such as '15min', '1h', 's'; calendar units are rejected here (see bucket_start)."""
    m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", alias)
    if not m or m[2] not in UNITS:
        raise ValueError(f"not a fixed time width: {alias!r}")
    n = int(m[1] or 1) * UNITS[m[2]]
    if n <= 0:
        raise ValueError(f"a time width must be positive: {alias!r}")
    return n


def bucket_start(ts: Column, alias: str, label: str = "left") -> Column:
    """Start (or, labelled right, end) of the epoch-aligned bucket of a timestamp; null for null."""
    unit = alias.strip().lstrip("0123456789 ")
    if unit in CALENDAR:
        if alias.strip() != unit and not alias.strip().startswith("1"):
            raise ValueError(f"calendar widths are single units: {alias!r}")
        if label != "left":
            raise ValueError("calendar buckets are labelled left")
        return F.date_trunc(CALENDAR[unit], ts).cast("timestamp_ntz")
    w = F.lit(width_micros(alias))
    us = F.unix_micros(ts.cast("timestamp"))
    start = us - F.pmod(us, w) + (w if label == "right" else F.lit(0))
    return F.timestamp_micros(start).cast("timestamp_ntz")


#: Strptime directives and their counterparts in datetime patterns.
STRPTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%p": "a", "%a": "EEE", "%A": "EEEE", "%z": "xx", "%%": "'%'"}


def datetime_pattern(fmt: str, fraction_digits: int = 6) -> str:
    """A strptime pattern as a datetime pattern. %f stands for `fraction_digits` digits."""
    out = []
    for p in re.findall(r"%.|[^%]+", fmt):
        if p == "%f":
            out.append("S" * fraction_digits)
        elif p in STRPTIME:
            out.append(STRPTIME[p])
        elif p.startswith("%"):
            raise ValueError(f"no counterpart of {p} in {fmt!r}")
        else:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", p))
    return "".join(out)


def parse_time(c: Column, fmt: str, tolerant: bool = True) -> Column:
    """A text in a strptime pattern as TIMESTAMP_NTZ; null where it doesn't fit (or an error, if not tolerant).

    %f takes one to nine digits: the fraction is padded or cut to six before parsing. %a is checked loosely: the name of
    the day is removed.
    """
    if "%f" in fmt:
        head, tail = fmt.split("%f", 1)
        if tail:
            c = F.regexp_replace(c, r"(\d{1,6})\d{0,3}(?=" + ("" if tail.startswith("%") else re.escape(tail[0])) + r"[^\d]*$)", "$1")
        else:
            digits = F.regexp_extract(c, r"(\d+)$", 1)
            c = F.concat(F.regexp_replace(c, r"\d+$", ""), F.rpad(F.substring(digits, 1, 6), 6, "0"))
        del head
    if fmt.startswith(("%a", "%A")):
        c, fmt = F.regexp_replace(c, r"^[A-Za-z]+", ""), fmt[2:]
    # packed date and time fields such as %y%m%d are parsed by width
    p = F.lit(datetime_pattern(fmt))
    return (F.try_to_timestamp(c, p) if tolerant else F.to_timestamp(c, p)).cast("timestamp_ntz")
