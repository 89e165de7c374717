"""Queries of the general training-data problems (1, 2, 3, 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.entries import find_layouts, layouts_of, log_entries
from timberline.operators.grid import regular_grid
from timberline.operators.instants import normalise_times
from timberline.operators.sessions import sessionize
from timberline.runtime import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    s = sessionize(read(spark, d, "log_records"))
    return s.select("span_id", F.col("first_id").alias("first_record_id"), F.col("last_id").alias("last_record_id"))


def p1_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessionize(read(spark, d, "log_records"))


def _entries(spark: SparkSession, d: str, with_message: bool) -> DataFrame:
    lines, listed = read(spark, d, "raw_lines"), layouts_of(read(spark, d, "log_formats"))
    return log_entries(lines, [*listed, *find_layouts(lines, listed)], with_message=with_message)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d, False)
    return e.select("first_line_id", "last_line_id", "severity_text", "component")


def p2_entries(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d, True)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return normalise_times(read(spark, d, "device_records"), read(spark, d, "device_sources"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    g = regular_grid(read(spark, d, "counter_readings"))
    # empty: the as-of neighbours lie on both sides of the quarter hour
    return g.where("prev_s < bucket_start and next_s >= bucket_start + 900").select("action_name", "id", "bucket_start")


def p7_grid(spark: SparkSession, d: str) -> DataFrame:
    g = regular_grid(read(spark, d, "counter_readings"))
    return g.select("action_name", "id", "bucket_start", "n_readings", F.round("value", 6).alias("value"), "status")


QUERIES = {f.__name__: f for f in (p1_found, p1_sessions, p2_found, p2_entries, p3_found, p7_found, p7_grid)}

# The layouts of the lines as plain expressions: (expression, group of the severity or 0, group of the component).
_HEADS = (
    (r"^\d{6} \d{6}\s+\d+ +(\S+) +([^\s:]+):(\s|$)", 1, 2),
    (r"^\S+ \d+ \d{4}\.\d\d\.\d\d \S+ \d{4}-\d\d-\d\d-\d\d\.\d\d\.\d\d\.\d+ \S+ (\S+) +([A-Z]+)(\s|$)", 2, 1),
    (r"^\d{8}-\d+:\d+:\d+:\d+\|([^|]+)\|\d+\|", 0, 1),
    (r"^[A-Z][a-z]{2} +\d+ \d\d:\d\d:\d\d \S+ ([^\s\[]+)\[\d+\]:(\s|$)", 0, 1),
    (r"^\[\d\d/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d [+-]\d{4}\] \[([^\]]+)\] \[([^\]]+)\](\s|$)", 1, 2),
    (r'^ts=\d{4}-\d\d-\d\dT\S+Z level=(\S+) logger=(\S+) msg="', 1, 2),
    (r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d+ - (\S+) - (\S+) -(\s|$)", 2, 1),
    (r"^([a-z]+): \d\d\.\d\d\.\d{4} \d\d:\d\d:\d\d; ([^;]+);", 1, 2),
)


def _head_sql() -> str:
    """k (layout), severity and component of a line t."""
    k = " ".join(f"when regexp_matches(t, '{x}') then {i}" for i, (x, _, _) in enumerate(_HEADS))
    sev = " ".join(f"when {i} then regexp_extract(t, '{x}', {g})" for i, (x, g, _) in enumerate(_HEADS) if g)
    com = " ".join(f"when {i} then regexp_extract(t, '{x}', {g})" for i, (x, _, g) in enumerate(_HEADS))
    return rf"""
        l as (select min(line_id) as id, file_name as f, line_no as no, regexp_replace(coalesce(arg_min(raw_text, line_id), ''), '^\x{{FEFF}}', '') as t from raw_lines where file_name is not null and line_no is not null group by file_name, line_no),
        j as (select *, case when t like '{{%' then try_cast(t as json) end as o from l),
        k as (select *, case {k} when o->>'time' is not null and o->>'mod' is not null then 9 end as k from j),
        h as (select *, case k {sev} when 9 then coalesce(o->>'lvl', '') when null then null else '' end as sev, case k {com} when 9 then o->>'mod' end as com from k)"""


ORACLE = {
    "p2_found": "with"
    + _head_sql()
    + r""", g as (select *, count(k) over (partition by f order by no) as g from h)
        select arg_min(id, no) as first_line_id, arg_max(id, no) as last_line_id, trim(regexp_replace(arg_min(sev, no), '\x1b\[[0-9;]*m', '', 'g'), ' []') as severity_text, trim(arg_min(com, no), ' []') as component from g where g > 0 group by f, g""",
    "p1_found": r"""
        with e as (select distinct span_id, ts, record_id from log_records where regexp_matches(span_id, '\S') and ts is not null and record_id is not null),
        f as (select *, case when ts - lag(ts) over w <= interval 30 minute then 0 else 1 end as fresh from e window w as (partition by span_id order by ts, record_id)),
        g as (select *, sum(fresh) over (partition by span_id order by ts, record_id) as n from f)
        select span_id, arg_min(record_id, (ts, record_id)) as first_record_id, arg_max(record_id, (ts, record_id)) as last_record_id from g group by span_id, n""",
    "p1_sessions": r"""
        with e as (select distinct span_id, ts, record_id from log_records where regexp_matches(span_id, '\S') and ts is not null and record_id is not null),
        f as (select *, case when ts - lag(ts) over w <= interval 30 minute then 0 else 1 end as fresh from e window w as (partition by span_id order by ts, record_id)),
        g as (select *, sum(fresh) over (partition by span_id order by ts, record_id) as n from f)
        select span_id, arg_min(record_id, (ts, record_id)) as first_id, arg_max(record_id, (ts, record_id)) as last_id,
            min(ts) as start_ts, max(ts) as end_ts, epoch_us(max(ts)) - epoch_us(min(ts)) as duration_us, count(*) as n_events from g group by span_id, n""",
    "p7_found": r"""
        with r as (select action_name, id, cast(floor(epoch_us(ts) / 900000000) as bigint) as b from counter_readings
            where action_name is not null and id is not null and ts is not null and counts >= 0 group by all),
        s as (select action_name, id, min(b) as lo, max(b) as hi from r group by all),
        g as (select action_name, id, unnest(range(lo, hi + 1)) as b from s)
        select action_name, id, b * 900 as bucket_start from g anti join r using (action_name, id, b)""",
    "p7_grid": r"""
        with once as (select distinct action_name, id, epoch_us(ts) as us, cast(counts as double) as v, cast(floor(epoch_us(ts) / 900000000) as bigint) as b from counter_readings
            where action_name is not null and id is not null and ts is not null and counts >= 0),
        r as (select action_name, id, b, count(*) as n, avg(v) as mean, min({'us': us, 'v': v}) as head, max({'us': us, 'v': v}) as tail from once group by all),
        s as (select action_name, id, min(b) as lo, max(b) as hi from r group by all),
        g as (select action_name, id, unnest(range(lo, hi + 1)) as b from s),
        j as (select g.*, n, mean, head, tail from g left join r using (action_name, id, b)),
        k as (select *, last_value(tail ignore nulls) over w as p, first_value(head ignore nulls) over x as q from j
            window w as (partition by action_name, id order by b rows between unbounded preceding and 1 preceding), x as (partition by action_name, id order by b rows between 1 following and unbounded following))
        select action_name, id, b * 900 as bucket_start, coalesce(n, 0) as n_readings,
            round(case when n is not null then mean when q.us - p.us <= 10800000000 then p.v + (q.v - p.v) * ((b * 900000000 - p.us) / (q.us - p.us)) end, 6) as value,
            case when n is not null then 'observed' when q.us - p.us <= 10800000000 then 'interpolated' else 'gap' end as status from k""",
}
