"""Mixed timestamp notations into UTC microseconds (problem 3).

Every notation, and every datetime format that the table of sources declares, is one branch of a single alternation of named
groups. The text runs through that expression once: a
replacement lays all groups out in a fixed order, a split gives them as an array. Components are then checked against the
calendar and assembled with integer day arithmetic; only the offset of a wall clock without zone is looked up, in the
JVM's zone rules. Everything stays in built-in expressions (whole-stage codegen), with no Python worker and no join but
the one with the small table of sources.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

US = 1_000_000
SEP, MARK = "\u0001", "\u0002"
#: Bound of the distinct datetime formats of a table of sources (they become branches of one expression).
MAX_FORMATS = 500
# English names of months and days of the week, whole or by their first letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MON = r"(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DOW = r"(?i:(?:mon|tue(?:s)?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?)"
_HMS = r"(?<H{k}>\d{1,2}):(?<M{k}>\d{1,2}):(?<S{k}>\d{1,2})"
_F = r"(?<F{k}>\d{1,6})\d{0,6}"  # digits beyond microseconds are cut off
_FRAC = r"(?:[.,]" + _F + ")?"
_ZONE = r"(?:(?<Z{k}>[A-Za-z]{1,5})|(?<O{k}>[+-]\d{2})(?::?(?<o{k}>\d{2}))?)"
#: General branches of the alternation. Groups: Y year, y its last two digits, m month number, B month name, d day, J day of the
#: year, H M S F time, P half of the day, Z letters of a zone, O o hours and minutes of an offset, a b slashed day and month in the
#: source's order, E seconds, milli- or microseconds since 1970.
BRANCHES = (
    r"(?<Y{k}>\d{4})-(?<m{k}>\d{1,2})-(?<d{k}>\d{1,2})(?:[Tt]|\s+)(?<H{k}>\d{1,2}):(?<M{k}>\d{1,2})(?::(?<S{k}>\d{1,2})" + _FRAC + r")?(?:\s*" + _ZONE + r")?",
    r"(?<Y{k}>\d{4})-(?<m{k}>\d{1,2})-(?<d{k}>\d{1,2})-(?<H{k}>\d{1,2})\.(?<M{k}>\d{1,2})\.(?<S{k}>\d{1,2})(?:\." + _F + r")?",
    r"(?<Y{k}>\d{4})(?<m{k}>\d{2})(?<d{k}>\d{2})-(?<H{k}>\d{1,2}):(?<M{k}>\d{1,2}):(?<S{k}>\d{1,2}):" + _F,
    r"(?<y{k}>\d{2})(?<m{k}>\d{2})(?<d{k}>\d{2})\s(?<H{k}>\d{2})(?<M{k}>\d{2})(?<S{k}>\d{2})",
    r"(?<Y{k}>\d{4})[./](?<m{k}>\d{1,2})[./](?<d{k}>\d{1,2})\s+" + _HMS + _FRAC,
    r"(?<a{k}>\d{1,2})/(?<b{k}>\d{1,2})/(?:(?<Y{k}>\d{4})|(?<y{k}>\d{2}))\s+(?<H{k}>\d{1,2}):(?<M{k}>\d{1,2})(?::(?<S{k}>\d{1,2})" + _FRAC + r")?(?:\s*(?<P{k}>[AaPp][Mm]))?",
    r"(?<d{k}>\d{1,2})/(?<B{k}>" + _MON + r")/(?<Y{k}>\d{4}):" + _HMS + r"(?:\s*" + _ZONE + r")?",
    r"(?:" + _DOW + r",?\s+)?(?<d{k}>\d{1,2})\s+(?<B{k}>" + _MON + r")\.?\s+(?<Y{k}>\d{4})\s+" + _HMS + r"(?:\s*" + _ZONE + r")?",
    r"(?<B{k}>" + _MON + r")\.?\s+(?<d{k}>\d{1,2}),?\s+(?<Y{k}>\d{4})\s+" + _HMS + r"(?:\s*(?<P{k}>[AaPp][Mm]))?",
    r"(?<B{k}>" + _MON + r")\.?\s+(?<d{k}>\d{1,2})\s+" + _HMS + _FRAC,
    r"(?<d{k}>\d{1,2})\.(?<m{k}>\d{1,2})\.(?<Y{k}>\d{4})\s+" + _HMS + _FRAC,
    r"(?<E{k}>\d{10})(?:\.(?<F{k}>\d{1,6})\d*)?",
    r"(?<Y{k}>\d{4})(?<m{k}>\d{2})(?<d{k}>\d{2})(?<H{k}>\d{2})(?<M{k}>\d{2})(?<S{k}>\d{2})",
    r"(?<E{k}>\d{13}|\d{16})",
    r"(?<E{k}>\d{16})\d{3}",
)
PARTS = ("Y", "y", "m", "B", "d", "J", "a", "b", "H", "M", "S", "F", "P", "Z", "O", "o", "E")
# What each strptime directive reads, as (group, expression where directives touch, else). Without a group it is
# read and not used; an expression that begins with "(" brings its own groups.
DIRECTIVES = {
    "%Y": ("Y", r"\d{4}", r"\d{4}"),
    "%y": ("y", r"\d{2}", r"\d{2}"),
    "%m": ("m", r"\d{2}", r"\d{1,2}"),
    "%d": ("d", r"\d{2}", r"\d{1,2}"),
    "%e": ("d", r"[ \d]\d", r"\s?\d{1,2}"),
    "%j": ("J", r"\d{3}", r"\d{1,3}"),
    "%H": ("H", r"\d{2}", r"\d{1,2}"),
    "%I": ("H", r"\d{2}", r"\d{1,2}"),
    "%M": ("M", r"\d{2}", r"\d{1,2}"),
    "%S": ("S", r"\d{2}", r"\d{1,2}"),
    "%f": ("F", "(?:" + _F + ")", "(?:" + _F + ")"),
    "%b": ("B", _MON, _MON),
    "%B": ("B", _MON, _MON),
    "%p": ("P", r"[AaPp][Mm]", r"[AaPp][Mm]"),
    "%z": ("Z", _ZONE, _ZONE),
    "%Z": ("Z", r"[A-Za-z]{1,5}", r"[A-Za-z]{1,5}"),
    "%a": (None, _DOW, _DOW),
    "%A": (None, _DOW, _DOW),
    "%%": (None, "%", "%"),
}


def format_branch(fmt: str) -> str | None:
    """A strptime format as a branch of the alternation; None if it has an unknown directive, one twice, or no day and time."""
    parts, out, used = re.findall(r"%.|[^%]+|%$", fmt.replace("%T", "%H:%M:%S").replace("%R", "%H:%M").replace("%F", "%Y-%m-%d")), [], []
    for i, p in enumerate(parts):
        if p in DIRECTIVES:
            group, packed, free = DIRECTIVES[p]
            touching = (i and parts[i - 1] in DIRECTIVES) or (i + 1 < len(parts) and parts[i + 1] in DIRECTIVES)
            body = packed if touching else free
            named = group and not body.startswith("(?:")
            out.append(f"(?<{group}{{k}}>{body})" if named else f"(?:{body})")
            used += [group] if group else []
        elif p.startswith("%"):
            return None
        else:
            out.append(re.sub(r"(?:\\?\s)+", r"\\s+", re.escape(p)))
    dated = "J" in used or ("d" in used and ("m" in used or "B" in used))
    return "".join(out) if dated and "H" in used and len(used) == len(set(used)) else None


@lru_cache(maxsize=64)
def alternation(formats: tuple[str, ...] = ()) -> tuple[str, str]:
    """The expression, and the replacement that lays out its groups: parts in the order of PARTS, each from any branch.

    The text comes behind the number of its source's format (if it has one) and a mark: the branch of that format is tried
    first, and only for texts of its sources; then the general ones.
    """
    lead, own = r"[\s\p{Z}]*", [(i, b) for i, f in enumerate(formats) if (b := format_branch(f))]
    branches = [b.replace("{k}", f"x{i}") for i, b in enumerate([*(b for _, b in own), *BRANCHES])]
    listed = [f"{i}{MARK}{lead}{b}" for (i, _), b in zip(own, branches)]
    general = r"\d*" + MARK + lead + "(?:" + "|".join(branches[len(own) :]) + ")"
    pattern = "^(?:" + "|".join([*listed, general]) + r")[\s\p{Z}]*$"
    # groups of branches that didn't match are empty, so a part is the concatenation of its groups; a replacement refers to
    # groups by number faster than by name
    names = re.findall(r"\(\?<([A-Za-z])x\d+>", pattern)
    return pattern, SEP.join("".join(f"${i}" for i, n in enumerate(names, 1) if n == p) for p in PARTS)


def _leap(y: Column) -> Column:
    return y % F.when(y % 100 == 0, 400).otherwise(4) == 0


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, with integers only (years from 1 on)."""
    c = F.call_function("div", y - 1, F.lit(100))
    months = F.call_function("div", m * 367 - 362, F.lit(12)) - F.when(m <= 2, 0).when(_leap(y), 1).otherwise(2)
    return ((y - 1) * 365 + F.shiftright(y - 1, 2) - c + F.shiftright(c, 2) + months + d - 719163).cast("bigint")


def _month_length(y: Column, m: Column) -> Column:
    return F.when(m == 2, F.when(_leap(y), 29).otherwise(28)).otherwise((m + F.shiftright(m, 3)).bitwiseAND(1) + 30)


def wall_to_utc(wall_us: Column, zone: Column) -> Column:
    """UTC of a wall clock: the first of two occurrences; a skipped time is read with the offset before the change."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall_us), zone))


@lru_cache(maxsize=1024)
def zone_abbreviations(zone: str) -> dict[str, int]:
    """Offsets in seconds of a zone's own letter abbreviations, 2000 to 2037."""
    found: dict[str, int] = {}
    tz, t = ZoneInfo(zone), datetime(2000, 1, 1, tzinfo=timezone.utc)
    while t.year < 2038:
        local = t.astimezone(tz)
        if (local.tzname() or "").isalpha():
            found[local.tzname().upper()] = int(local.utcoffset().total_seconds())
        t += timedelta(days=14)
    return found


def abbreviation_map(zones: list[str]) -> Column:
    """A literal map 'zone|ABBREVIATION' -> offset seconds (zones are few: the distinct zones of the table of sources)."""
    items = []
    for z in sorted({z for z in zones if z}):
        try:
            for a, s in zone_abbreviations(z).items():
                items += [F.lit(f"{z}|{a}"), F.lit(s)]
        except (KeyError, ValueError, OSError):  # not an IANA zone: nothing to abbreviate
            continue
    return F.create_map(*items) if items else F.lit(None).cast("map<string,int>")


def _column(part: str) -> str:
    return f"n_upper_{part}" if part.isupper() else f"n_lower_{part}"  # column names are case-insensitive


def decompose(df: DataFrame, text: str, formats: tuple[str, ...] = (), number: Column | None = None) -> DataFrame:
    """Extract the components of a text once: PARTS, behind an empty element, as an array `parts` of texts (empty where the notation
    has none), null if the text is matched by no branch.

    number: the place in `formats` of the format that the text's source declares, null if it has none.
    """
    pattern, layout = alternation(formats)
    mark = F.coalesce(number.cast("string"), F.lit("")) if number is not None else F.lit("")
    # a text that is matched becomes its layout, which begins with a separator; one that isn't begins with its mark
    df = df.withColumn("parts", F.split(F.regexp_replace(F.concat(mark, F.lit(MARK), F.col(text)), pattern, SEP + layout), SEP, -1))
    return df.withColumn("parts", F.when(F.get("parts", F.lit(0)) == "", F.col("parts")))


def apart(c: Column) -> Column:
    """The same value; its projection is compiled by itself. One method of all projections would be over the 8,000 bytes
    that the JVM compiles, and stay interpreted."""
    return F.get(F.transform(F.array(c), lambda x: x), F.lit(0))


def _year_with(y: Column, m: Column, d: Column) -> Column:
    """The last year up to y that has the day: y itself, or for a 29 February the last leap year."""
    four = y - F.pmod(y, F.lit(4))
    return F.when((m == 2) & (d == 29), F.when(_leap(four), four).otherwise(four - 4)).otherwise(y)


def assemble(df: DataFrame, zone: str, day_first: str, received: str, abbreviations: Column, into: str) -> DataFrame:
    """Check the components of `decompose` against the calendar and add the instant in microseconds, null if there is none.

    zone: IANA zone of a wall clock without one (null: UTC). day_first: whether slashed digits start with the day (null: with the
    month, unless only the day fits). received: UTC timestamp, the bound of a date without year. Each stage is a projection
    of its own, so nothing is evaluated twice.
    """
    part = lambda p: F.nullif(F.get("parts", F.lit(PARTS.index(p) + 1)), F.lit(""))
    num = lambda p: F.col(_column(p))
    zero = F.lit(0).cast("bigint")
    df = df.withColumns({_column(p): part(p).try_cast("bigint") for p in PARTS if p not in "BFPZ"} | {"n_sign": part("O").startswith("-")})
    df = df.withColumns(
        {
            "n_y": apart(F.coalesce(num("Y"), num("y") + 2000)),
            "n_first": F.coalesce(F.col(day_first), (num("a") > 12) & (num("b") <= 12)),
            "n_name": F.call_function("div", F.instr(F.lit("".join(MONTHS)), F.lower(F.substring(part("B"), 1, 3))) + 2, F.lit(3)),
            "n_pm": F.lower(part("P")) == "pm",
            "n_us": F.coalesce(F.rpad(part("F"), 6, "0").try_cast("bigint"), zero),
            "n_zone": F.coalesce(F.col(zone), F.lit("UTC")),
            "n_at": F.unix_micros(F.col(received).cast("timestamp")),
            "n_named": F.upper(part("Z")),
        }
    )
    h, m, s, pm, z = num("H"), F.coalesce(num("M"), zero), F.coalesce(num("S"), zero), F.col("n_pm"), F.col("n_named")
    hours, rest, e = num("O"), F.coalesce(num("o"), zero), num("E")
    df = df.withColumns(
        {
            "n_mo": F.coalesce(num("m"), "n_name", F.when(F.col("n_first"), num("b")).otherwise(num("a")), F.when(num("J").isNotNull(), 1)),
            "n_d": F.coalesce(num("d"), F.when(F.col("n_first"), num("a")).otherwise(num("b")), num("J")),
            "n_j": apart(num("J").isNotNull()),
            "n_sec": F.when(F.when(pm.isNull(), h.between(0, 23)).otherwise(h.between(1, 12)) & (m <= 59) & (s <= 59), F.when(pm.isNull(), h).otherwise(h % 12 + F.when(pm, 12).otherwise(0)) * 3600 + m * 60 + s),
            "n_local": hours.isNull() & z.isNull(),
            "n_off": F.when(hours.isNotNull(), F.when(hours.between(-18, 18) & (rest <= 59), hours * 3600 + F.when(F.col("n_sign"), -rest).otherwise(rest) * 60))
            .when(z.isin("Z", "UTC", "GMT"), zero)
            .when(z.isNotNull(), F.element_at(abbreviations, F.concat("n_zone", F.lit("|"), "n_named")).cast("bigint")),
            "n_epoch": F.when(e < 10**10, e * US + F.col("n_us")).when(e < 10**13, e * 1000).otherwise(e),
        }
    )
    mo, d, y1 = F.col("n_mo"), F.col("n_d"), F.col("n_y1")
    local, off = F.col("n_local"), F.col("n_off") * US
    df = df.withColumns({"n_tod": F.when(mo.between(1, 12) & (d >= 1), F.col("n_sec") * US + F.col("n_us"))})
    # A date without year. `now` is the wall clock at receipt, with a margin for its changes: the last year whose date comes before
    # it holds the instant, or, where that lies within the margin, the year with that date before it.
    no_year = F.col("n_y").isNull() & F.col("n_tod").isNotNull()
    df = df.withColumn("n_now", F.when(no_year, F.timestamp_micros(F.when(local, F.unix_micros(F.from_utc_timestamp(F.timestamp_micros("n_at"), F.col("n_zone")))).otherwise(F.col("n_at") + off) + 3 * 3600 * US)))
    now = F.col("n_now")
    df = df.withColumns({"n_y0": _year_with(F.year(now).cast("bigint"), mo, d), "n_day": (F.month(now) * 32 + F.dayofmonth(now)) - (mo * 32 + d), "n_rest": F.pmod(F.unix_micros(now), F.lit(86400 * US)) - F.col("n_tod")})
    y0 = F.col("n_y0")
    past = (y0 < F.year(now)) | (F.col("n_day") > 0) | ((F.col("n_day") == 0) & (F.col("n_rest") >= 0))
    df = df.withColumn("n_y1", F.coalesce("n_y", F.when(past, y0).otherwise(_year_with(y0 - 1, mo, d))))
    fits = y1.between(1, 9999) & (d <= F.when(F.col("n_j"), F.when(_leap(y1), 366).otherwise(365)).otherwise(_month_length(y1, mo)))
    df = df.withColumn("n_days", F.when(apart(fits), days_from_civil(y1, mo, d)))
    utc = lambda days: _to_utc(days * (86400 * US) + F.col("n_tod"), local, F.col("n_zone"), off)
    df = df.withColumn("n_utc", utc(F.col("n_days")))
    late = F.col("n_y").isNull() & (F.col("n_utc") > F.col("n_at"))
    df = df.withColumn("n_y2", F.when(late, _year_with(y1 - 1, mo, d)))
    last = F.when(F.col("n_y2").isNotNull(), utc(days_from_civil(F.col("n_y2"), mo, d))).otherwise(F.col("n_utc"))
    return df.withColumn(into, F.coalesce("n_epoch", last).cast("bigint"))


def _to_utc(wall: Column, local: Column, zone: Column, offset: Column) -> Column:
    """UTC of a wall clock: with its offset, or in its zone the first of two occurrences; a skipped time is read with the
    offset before the change."""
    return F.when(local, F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone))).otherwise(wall - offset)


def normalise_times(records: DataFrame, sources: DataFrame, record_id: str = "row_id", source: str = "source_name", text: str = "timestamps", received: str = "received_at", zone: str = "zone_name", fmt: str = "datetime_format") -> DataFrame:
    """One row (record id, utc_micros) per record whose text names a time.

    A text is read by the datetime format of its source, if that fits, else by the general notations. A record delivered again (same
    id) counts once, as first received (at the same time: the least instant, none before any). Records without id, with null,
    blank or impossible text are left out, and those without year and time of receipt; an unknown source, or one whose zone is
    null or no IANA zone, is read as UTC; a format that can't be compiled is ignored. An empty table gives no rows. The table of
    sources is small and fixed: one row per source (duplicates of a name: the first zone and format in order), at most
    MAX_FORMATS formats (more raise ValueError).
    """
    named = {r[0] for r in sources.select(zone).where(F.col(zone).isNotNull()).distinct().collect()}
    formats = tuple(sorted(r[0] for r in sources.where(F.col(fmt).isNotNull()).select(fmt).distinct().limit(MAX_FORMATS + 1).collect()))
    if len(formats) > MAX_FORMATS:
        raise ValueError(f"more than {MAX_FORMATS} datetime formats")
    zones = sorted(named & available_timezones())
    s = sources.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("src")).agg(F.min(F.when(F.col(zone).isin(zones), F.col(zone))).alias("zone"), F.min(fmt).alias("fmt"))
    s = s.withColumn("day_first", F.when(F.col("fmt").contains("/"), F.instr("fmt", "%d") < F.instr("fmt", "%m")))
    s = s.withColumn("number", F.array_position(F.array(*[F.lit(f) for f in formats]), F.col("fmt")) - 1 if formats else F.lit(None).cast("int"))
    r = records.where(F.col(record_id).isNotNull()).select(F.col(record_id).alias("id"), F.col(source).alias("src"), F.col(text).alias("t"), F.col(received).alias("at"))
    r = decompose(r.join(s, "src", "left"), "t", formats, F.col("number"))
    # instants first: a repeated record costs two numbers in the shuffle, not its text
    r = assemble(r, "zone", "day_first", "at", abbreviation_map(zones), "utc_micros").select("id", "n_at", "utc_micros")
    out = r.groupBy("id").agg(F.min(F.struct(F.coalesce("n_at", F.lit(2**63 - 1)).alias("at"), "utc_micros")).alias("r"))
    return out.select(F.col("id").alias(record_id), F.col("r.utc_micros").alias("utc_micros")).where(F.col("utc_micros").isNotNull())
