"""Raw log lines into entries with fields: header detection, cumulative grouping, field cascade (problem 2).

1. Every layout becomes one header expression, anchored at the first column and tight about its time fields (built from
   the layout's strptime pattern), so that text that merely resembles an entry, or quotes one, starts nothing. Layouts come
   from reader settings (`layouts_of`) or from the lines themselves (`find_layouts`).
2. Lines are grouped cumulatively in file order: a line belongs to the last header at or before it.
3. The layouts form an ordered cascade of named-field patterns, compiled into one alternation: the first branch that matches a
   header gives its fields, and a line runs through the cascade once.

Scale: headers are matched in the scan stage, inside the JVM. Lines are grouped per block of a file's lines; only the first and
last piece of a block can go on in another (two rows a block), so a file of any share of all lines is spread out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.operators.instants import SEP, assemble, decompose
from timberline.sources.formats import notation

# What each strptime directive may match in a header.
DIRECTIVE = {
    "%Y": r"\d{4}",
    "%y": r"\d{2}",
    "%m": r"\d{1,2}",
    "%d": r"\d{1,2}",
    "%H": r"\d{1,2}",
    "%I": r"\d{1,2}",
    "%M": r"\d{1,2}",
    "%S": r"\d{1,2}",
    "%f": r"\d{1,9}",
    "%b": r"[A-Z][a-z]{2}",
    "%B": r"[A-Z][a-z]+",
    "%a": r"[A-Z][a-z]{2}",
    "%j": r"\d{1,3}",
    "%p": r"[AaPp][Mm]",
    "%z": r"(?:Z|[+-]\d{2}:?\d{2})",
    "%Z": r"[A-Z]{1,5}",
}
#: Directives that are written with their full width when no separator stands beside them.
PACKED = {"%y": r"\d{2}", "%m": r"\d{2}", "%d": r"\d{2}", "%H": r"\d{2}", "%M": r"\d{2}", "%S": r"\d{2}"}
TIME_FIELDS = ("date", "time", "timestamp", "timestamps", "month", "day", "datetime")
#: Time notations that are looked for in lines of no known layout.
TIME_FORMATS = (
    "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%d %H:%M:%S,%f", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d-%H.%M.%S.%f", "%Y%m%d-%H:%M:%S:%f",
    "%Y/%m/%d %H:%M:%S", "%Y.%m.%d %H:%M:%S", "%d.%m.%Y %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%d-%m-%Y %H:%M:%S",
    "%d/%b/%Y:%H:%M:%S %z", "%d-%b-%Y %H:%M:%S", "%d %b %Y %H:%M:%S", "%b %d %Y %H:%M:%S", "%b %d %H:%M:%S", "%y%m%d %H%M%S",
)
#: Words for severities, without case.
SEVERITIES = ("trace", "debug", "info", "information", "notice", "warn", "warning", "error", "err", "severe", "critical", "crit", "fatal", "alert", "emerg", "emergency", "panic")
COLOUR = r"\u001b\[[0-9;]*m"
BOM = "\ufeff"


@dataclass(frozen=True)
class Layout:
    """A layout: its header expression (positional groups) and the fields those groups stand for, in order."""

    name: str
    pattern: str
    fields: tuple[str, ...]
    json_keys: dict = field(default_factory=dict)  # field -> key, for layouts that are JSON objects
    time_groups: tuple[int, ...] = ()  # groups that make up the time


def time_pattern(fmt: str) -> str:
    """The expression of a strptime pattern; directives that touch each other have their full width."""
    out, parts = [], re.findall(r"%.|[^%]+", fmt)
    for i, p in enumerate(parts):
        if p in DIRECTIVE:
            touching = (i and parts[i - 1] in DIRECTIVE) or (i + 1 < len(parts) and parts[i + 1] in DIRECTIVE)
            out.append(PACKED.get(p, DIRECTIVE[p]) if touching else DIRECTIVE[p])
        else:
            out.append(re.sub(r"(?:\\ )+| +", r"\\s+", re.escape(p)))
    return "".join(out)


def compile_layout(name: str, log_format: str, datetime_format: str) -> Layout:
    """A reader setting as a header expression.

    Literal text of the format is a regular expression (its groups capture nothing), its spaces any white space. The parts of the datetime
    format, split at spaces, belong to the last time fields (one part each, or all to a single field); other time fields, numbers,
    levels and components are words; the content is the rest of the line, which may be empty. Groups hold the bare value:
    padding, brackets and colour codes of a level or component stay outside.
    """
    parts = notation(log_format)
    fields = [f.lower() for f, _ in parts if f]
    times = [i for i, f in enumerate(fields) if f in TIME_FIELDS]
    pieces = (datetime_format or "").split()
    spec: dict[int, str] = {}
    if pieces and times:
        spec = {times[-1]: time_pattern(datetime_format)} if len(times) < len(pieces) else {i: time_pattern(p) for i, p in zip(times[-len(pieces) :], pieces)}
    paint, edge = f"(?:{COLOUR})?", r"[(){}<>]*"
    out, i = [], 0
    for k, (f, text) in enumerate(parts):
        if not f:
            out.append(re.sub(r"(?<!\\)\((?!\?)", "(?:", text))
            continue
        f, last = f.lower(), k == len(parts) - 1
        if i in spec:
            out.append(f"({spec[i]})")
        elif f == "content":
            out.append("(.*)" if last else "(.*?)")
        elif f in ("pid", "id"):
            out.append(r"([^\s|\[\]]+)")
        elif f == "level":
            out.append(rf"\s*{paint}\s*([A-Za-z]+)\s*{paint}\s*")
        elif f == "component":
            out.append(rf"{paint}{edge}([^\s|\[\]:;=]*[^\s|\[\]:;=(){{}}<>]){edge}{paint}")
        else:
            out.append(r"(\S+)")
        i += 1
    p = "".join(out)
    # an empty message may have lost the white space before it
    p = re.sub(r"\\s\+\(\.\*\)$", r"(?:\\s+(.*))?", p)
    p = re.sub(r'"\(\.\*\??\)"$', r'"(.*?)"?\\s*$', p)
    names = tuple({"level": "severity", "content": "message"}.get(f, f) for f in fields)
    return Layout(name, p, names, {}, tuple(i + 1 for i in sorted(spec)) or tuple(i + 1 for i in times))


def layouts_of(settings: DataFrame, program: str = "program_name", log_format: str = "log_format", datetime_format: str = "datetime_format") -> list[Layout]:
    """The cascade of a table of reader settings (a handful of rows of configuration)."""
    rows = settings.where(F.col(log_format).isNotNull()).select(program, log_format, datetime_format).distinct().collect()
    return [compile_layout(r[0], r[1], r[2]) for r in sorted(rows, key=lambda r: (str(r[0]), r[1]))]


_WORD = r"([A-Za-z][\w./$@-]*)"
_BETWEEN = r"([\])>]?[\s:;,|=-]+[\[(<]?)"
_CLOSES = r"(\]\s*|\)\s*|>\s*|\s*[:;|]\s*|\s+[=-]+\s*)"


def _shape(text: Column) -> Column:
    """(shape, format number) of a line that begins with a time, a component and, in any place, a severity; else null.

    The component must be set off by more than a blank. The shape is the reader setting of such a line.
    """
    times = "|".join(f"({time_pattern(f)})" for f in TIME_FORMATS)
    n, word, opens = len(TIME_FORMATS), F.regexp_replace, r"([\[(<]?)"
    # groups: opening, [word, between], times, between, word, between or closing, [word, closing]
    pattern = rf"(?s)^{opens}(?:{_WORD}{_BETWEEN})?(?:{times}){_BETWEEN}{_WORD}{_CLOSES}(?:(?<=[\s\[(<|:;-]){opens}{_WORD}{_CLOSES})?.*$"
    keep = [1, 2, 3, *range(4, 4 + n), *range(4 + n, 10 + n)]
    g = F.split(word(text, pattern, SEP + SEP.join(f"${i}" for i in keep)), SEP, -1)
    at = lambda i: F.get(g, F.lit(i))
    level = lambda c: F.lower(c).isin(*SEVERITIES)
    fmt = F.array_position(F.transform(F.slice(g, 5, n), lambda x: x != ""), F.lit(True))
    first, second, third = at(2), at(5 + n), at(8 + n)
    lead = F.when(first == "", F.lit("")).when(level(first), F.concat(F.lit("<Level>"), at(3)))
    two = F.when((third != "") & level(second) & ~level(third), F.concat(F.lit("<Level>"), at(6 + n), at(7 + n), F.lit("<Component>"), at(9 + n)))
    two = two.when((third != "") & level(third) & ~level(second) & (first == ""), F.concat(F.lit("<Component>"), at(6 + n), at(7 + n), F.lit("<Level>"), at(9 + n)))
    rest = two.when(~level(second), F.concat(F.lit("<Component>"), at(6 + n)))
    blank = F.regexp_replace(F.concat(at(1), lead, F.lit("<Time>"), at(4 + n), rest, F.lit("<Content>")), r"\s+", " ")
    return F.when((F.get(g, F.lit(0)) == "") & ~text.startswith(SEP), F.struct(blank.alias("key"), fmt.cast("int").alias("fmt")))


def find_layouts(lines: DataFrame, known: list[Layout], text: str = "raw_text", least_lines: int = 3, least_share: float = 0.001) -> list[Layout]:
    """Layouts of the lines that no known layout reads, by what all of them show.

    Text: lines that begin with a time in one of TIME_FORMATS, a component and perhaps a severity, are counted by their shape (the
    punctuation between these fields). JSON: objects on one line; of their keys, the one that mostly holds times, severities,
    names and longer text becomes the field. Both must be shown by at least `least_lines` lines and `least_share` of all, which bounds what
    is collected (1 / least_share shapes and keys for each field of a line). Most frequent first.
    """
    src = lines.select(F.regexp_replace(F.col(text), f"^{BOM}", "").alias("t")).where(F.col("t").rlike(r"^\S") & F.col("t").rlike(r"\d"))
    plain = [k.pattern for k in known if not k.json_keys]
    if plain:
        src = src.where(~F.col("t").rlike("(?s)^(?:" + "|".join(plain) + ")"))
    times = "^(?:" + "|".join(time_pattern(f) for f in TIME_FORMATS) + ")$"
    is_time = lambda v: v.rlike(times)
    is_level = lambda v: F.lower(F.trim(v)).isin(*SEVERITIES)
    is_name = lambda v: v.rlike(r"^[A-Za-z][\w./$@-]*$") & ~is_level(v)
    count = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    item = lambda key, fmt, *n: F.struct(key.alias("key"), fmt.alias("fmt"), *[x.alias(a) for x, a in zip(n, ("n_time", "n_level", "n_name", "n_text"))])
    none, zero = F.lit(None).cast("int"), F.lit(0).cast("bigint")
    fields = F.transform(F.map_entries(F.from_json("t", "map<string,string>")), lambda e: item(e["key"], none, count(is_time(e["value"])), count(is_level(e["value"])), count(is_name(e["value"])), count(e["value"].contains(" "))))
    shape = F.col("shape")
    src = src.withColumn("shape", F.when(~F.col("t").startswith("{"), _shape(F.col("t"))))
    items = F.when(F.col("t").rlike(r"^\{.*\}\s*$"), fields).when(shape["key"].isNotNull(), F.array(item(shape["key"], shape["fmt"], zero, zero, zero, zero)))
    e = src.select(F.explode(items).alias("i")).groupBy("i.key", "i.fmt").agg(F.count("*").alias("n"), *[F.sum(f"i.{c}").alias(c) for c in ("n_time", "n_level", "n_name", "n_text")])
    least = max(least_lines, least_share * lines.count())
    rows = sorted(e.where(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["key"], r["fmt"] or 0))
    out = [compile_layout(r["key"], re.sub(r"([\[\](){}|.*+?^$])", r"\\\1", r["key"]), TIME_FORMATS[r["fmt"] - 1]) for r in rows if r["fmt"]]
    keys: dict[str, str] = {}
    for name, c in (("time", "n_time"), ("severity", "n_level"), ("component", "n_name"), ("message", "n_text")):
        fit = [r for r in rows if not r["fmt"] and r["key"] not in keys.values() and 2 * r[c] > r["n"]]
        if fit:
            keys[name] = max(fit, key=lambda r: r[c])["key"]
    if "time" in keys and "component" in keys:
        out.append(Layout("json", "", (), keys))
    return out


def _parsed(text: Column, layouts: list[Layout]) -> Column:
    """An array (empty, layout's number or its branch's time, severity, component, message) of the first layout that matches, or null."""
    plain, groups, n = [x for x in layouts if not x.json_keys], {"severity": [], "component": [], "message": []}, 0
    which, times = [], []
    for x in plain:
        times.append("".join(f"${n + g}" if i == 0 else f" ${n + g}" for i, g in enumerate(x.time_groups)))
        for f in groups:
            groups[f] += [n + x.fields.index(f) + 1] if f in x.fields else []
        n += len(x.fields)
        which.append(x.name)
    out = F.lit(None).cast("array<string>")
    if plain:
        pattern = "(?s)^(?:" + "|".join(x.pattern for x in plain) + ").*$"
        # texts of groups in branches that didn't match are empty; the message comes last, since it may hold a separator
        refs = [SEP.join(times), *("".join(f"${i}" for i in groups[f]) for f in ("severity", "component", "message"))]
        a = F.split(F.regexp_replace(text, pattern, SEP + SEP.join(refs)), SEP, len(plain) + 4)
        out = F.when((F.size(a) == len(plain) + 4) & (F.get(a, F.lit(0)) == "") & ~text.startswith(SEP), a)
    return out


def parse_header(df: DataFrame, text: str, layouts: list[Layout], whole: bool = True) -> DataFrame:
    """Add h: (severity, component[, layout, time, message]) of the first layout in the cascade that matches, or null.

    Layouts that are JSON objects come after the others.
    """
    plain, t = [x for x in layouts if not x.json_keys], F.col(text)
    df = df.withColumn("h_all", _parsed(t, layouts))
    k, a = len(plain), F.col("h_all")
    fields = [F.get(a, F.lit(k + 1)).alias("severity"), F.get(a, F.lit(k + 2)).alias("component")]
    if whole:
        times = F.slice(a, 2, k) if k else F.array(F.lit(""))
        at = F.array_position(F.transform(times, lambda x: F.trim(x) != ""), F.lit(True))
        names = F.array(*[F.lit(x.name) for x in plain] or [F.lit("")])
        fields += [F.get(names, (at - 1).cast("int")).alias("layout"), F.trim(F.array_join(times, "")).alias("time"), F.get(a, F.lit(k + 3)).alias("message")]
    h = F.when(a.isNotNull(), F.struct(*fields))
    for x in (x for x in layouts if x.json_keys):
        get = {f: F.trim(F.get_json_object(t, f"$['{key}']")) for f, key in x.json_keys.items()}
        fields = [F.coalesce(get.get("severity", F.lit("")), F.lit("")).alias("severity"), get["component"].alias("component")]
        if whole:
            fields += [F.lit(x.name).alias("layout"), get["time"].alias("time"), F.coalesce(get.get("message", F.lit("")), F.lit("")).alias("message")]
        hit = t.startswith("{") & t.rlike(r'(?s)^\{\s*".*\}\s*$') & get["time"].isNotNull() & get["component"].isNotNull()
        h = h.when(hit, F.struct(*fields))
    return df.withColumn("h", h).drop("h_all")


def log_entries(lines: DataFrame, layouts: list[Layout], line_id: str = "line_id", file: str = "file_name", line_no: str = "line_no", text: str = "raw_text", with_message: bool = True, block_lines: int = 4096) -> DataFrame:
    """One row per entry: file_name, first_line_id, last_line_id, severity_text, component[, layout, time (as written), n_lines,
    message, ts].

    An entry begins with a header at the first column (a byte-order mark aside) and runs to the line before the file's next
    header. Lines before a file's first header belong to none. Null text is a blank line; of rows with the same file and line
    number the one with the least id counts; rows without file or line number take no part. The message is the header's message
    and the following lines as they are, joined by newlines, white space at the end removed. ts is the time as UTC (a time
    without zone is read as UTC, one without a year is null). An empty table gives no rows.
    """
    raw = F.when(F.col(text).startswith(BOM), F.substring(F.col(text), 2, 2**31 - 1)).otherwise(F.col(text))
    e = lines.select(F.col(line_id).alias("id"), F.col(file).alias("f"), F.col(line_no).cast("bigint").alias("no"), F.col(text).alias("raw"), raw.alias("t"))
    e = parse_header(e.where(F.col("f").isNotNull() & F.col("no").isNotNull()), "t", layouts, with_message)
    e = e.select("id", "f", "no", F.floor(F.col("no") / block_lines).cast("bigint").alias("b"), "h", *(["raw"] if with_message else []))
    w = Window.partitionBy("f", "b").orderBy("no", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("again", F.coalesce(F.lag("no").over(w) == F.col("no"), F.lit(False))).where(~F.col("again"))
    if with_message:
        e = e.withColumn("start", F.last(F.when(F.col("h").isNotNull(), F.col("no")), ignorenulls=True).over(upto))
        tail = F.when(F.col("h").isNull(), F.struct("no", F.coalesce("raw", F.lit("")).alias("x")))
        p = e.groupBy("f", "b", "start").agg(F.min_by("id", "no").alias("first_id"), F.max_by("id", "no").alias("last_id"), F.min_by("h", "no").alias("h"), F.count("*").alias("n"), F.array_sort(F.collect_list(tail)).alias("tail"))
        p = p.withColumn("tail", F.array_join(F.transform("tail", lambda x: x["x"]), "\n")).withColumn("h", F.when(F.col("start").isNotNull(), F.col("h")))
        p = p.withColumn("edge", F.col("start").isNull() | (F.col("start") == F.max("start").over(Window.partitionBy("f", "b"))))
    else:
        # a block's headers, its first and its last line; a piece ends with the line before the next header or with the last line
        e = e.withColumns({"before": F.lag("id").over(w), "end": F.lead("id").over(w).isNull()})
        e = e.where(F.col("h").isNotNull() | F.col("before").isNull() | F.col("end"))
        head, nxt = F.col("h").isNotNull(), F.lead(F.struct(F.when(F.col("h").isNotNull(), F.col("before")).otherwise(F.col("id")).alias("id"), F.col("h").isNotNull().alias("head"))).over(w)
        p = e.withColumn("next", nxt).where(head | F.col("before").isNull())
        p = p.select("f", "b", F.when(head, F.col("no")).alias("start"), F.col("id").alias("first_id"), F.coalesce("next.id", "id").alias("last_id"), "h", (~head | ~F.coalesce("next.head", F.lit(False))).alias("edge"))
    p = p.withColumn("own", F.when(~F.col("edge"), F.col("b")))
    g = F.count("start").over(Window.partitionBy("f", "own").orderBy("b", "start").rowsBetween(Window.unboundedPreceding, 0))
    p = p.withColumn("g", g).where("g > 0")
    aggs = [F.min_by("first_id", "b").alias("first_line_id"), F.max_by("last_id", F.struct("b", "start")).alias("last_line_id"), F.max("h").alias("h")]
    if with_message:
        aggs += [F.sum("n").alias("n_lines"), F.array_sort(F.collect_list(F.struct("b", F.when((F.col("n") > 1) | F.col("start").isNull(), F.col("tail")).alias("x")))).alias("tail")]
    p = p.groupBy("f", "own", "g").agg(*aggs)
    out = [F.col("f").alias("file_name"), "first_line_id", "last_line_id", F.col("h.severity").alias("severity_text"), F.col("h.component").alias("component")]
    if not with_message:
        return p.select(*out)
    body = F.array_join(F.concat(F.array(F.col("h.message")), F.filter(F.transform("tail", lambda x: x["x"]), lambda x: x.isNotNull())), "\n")
    p = p.select(*out, F.col("h.layout").alias("layout"), F.col("h.time").alias("time"), "n_lines", F.regexp_replace(body, r"\s+$", "").alias("message"))
    blank = {"zone": F.lit(None).cast("string"), "day_first": F.lit(None).cast("boolean"), "at": F.lit(None).cast("timestamp")}
    t = assemble(decompose(p.withColumns(blank), "time"), "zone", "day_first", "at", F.lit(None).cast("map<string,int>"), "us")
    return t.select(*p.columns, F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"))
