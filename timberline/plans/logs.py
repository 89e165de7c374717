"""Queries of the log operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.apps.anomaly import LogAnomalies
from timberline.apps.clustering import LogClusters
from timberline.apps.openset import OpenSetWorkflow
from timberline.apps.summarize import LogSummary
from timberline.config import AnomalyDetectionConfig, ClusteringConfig, DataLoaderConfig, FeatureExtractorConfig, LogParserConfig, OpenSetADWorkflowConfig, OpenSetPartitionerConfig, PreprocessorConfig, VectorizerConfig, WorkFlowConfig
from timberline.functions import arrays as A
from timberline.functions import text as T
from timberline.operators import cluster, counters, detect, drill, encode, evaluate, splits, vectorize, windows
from timberline.operators.clean import HDFS_RULES, clean, clean_hdfs, clean_open_set
from timberline.parsing.ael import ael
from timberline.parsing.drain import drain, fit_templates, match_templates
from timberline.parsing.iplom import iplom
from timberline.record import LogRecord
from timberline.runtime import checkpoint_dir, read
from timberline.sources.readers import load
from timberline.streaming.sessions import stream_counts, window_sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_R = "with r as (select distinct record_id as _id, ts as timestamp, span_id, severity_text, component, dataset_name, logline, labels from log_records)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def records(spark: SparkSession, d: str) -> DataFrame:
    """log_records as records: deliveries of one record are equal but for the time of arrival."""
    r = read(spark, d, "log_records")
    return r.select(F.col("record_id").alias("_id"), F.col("ts").alias("timestamp"), "span_id", "severity_text", "component", "dataset_name", "logline", "labels").distinct()


def record(spark: SparkSession, d: str) -> LogRecord:
    return LogRecord(records(spark, d), {"timestamp": ["timestamp"], "body": ["logline"], "attributes": ["component", "dataset_name"], "span_id": ["span_id"], "labels": ["labels"]})


def _bucket(seconds: int, ts: str = "timestamp", right: bool = False) -> str:
    w = seconds * 1_000_000
    return f"make_timestamp((epoch_us({ts}) // {w} {'+ 1' if right else ''}) * {w})"


# --- projection, filter, set operations


@query(_R + " select _id, logline from r where dataset_name = 'blockstore' and severity_text = 'ERROR'")
def filter_attributes(spark, d):
    return drill.where_attributes(records(spark, d), {"dataset_name": "blockstore", "severity_text": "ERROR", "component": "*"}).select("_id", "logline")


@query(_R + " select _id, component from r where _id in (select _id from r where labels = 1)")
def select_by_index(spark, d):
    r = record(spark, d)
    return r.select_by_index(r.df.where("labels = 1")).df.select("_id", "component")


@query(_R + " select _id, component from r where _id not in (select _id from r where labels = 1)")
def filter_by_index(spark, d):
    r = record(spark, d)
    return r.filter_by_index(r.df.where("labels = 1")).df.select("_id", "component")


@query(_R + " select _id, logline from r where logline is not null")
def drop_null_lines(spark, d):
    return record(spark, d).dropna().df.select("_id", "logline")


@query(_R + ", s as (select _id, list_filter(string_split(logline, ' '), lambda t: t <> '') as t from r where logline is not null) select _id from s where len(list_filter(t, lambda x: x not in ('token', 'issued', 'to'))) > 0")
def drop_special_only(spark, d):
    r = records(spark, d).where("logline is not null")
    return r.where(~vectorize.only_special(F.col("logline"), ("token", "issued", "to"))).select("_id")


@query(_R + " select _id, logline from r where logline is not null order by logline, _id limit 20 offset 40")
def page_of_lines(spark, d):
    return drill.page(records(spark, d).where("logline is not null").select("_id", "logline"), ["logline", "_id"], 2)


@query(_R + " select distinct component from r where labels = 1 and component is not null intersect select component from r where severity_text = 'FATAL'")
def shared_components(spark, d):
    r = records(spark, d).where("component is not null")
    return r.where("labels = 1").select("component").intersect(r.where("severity_text = 'FATAL'").select("component"))


@query(_R + " select _id, logline as line from r where labels = 1 union all select _id, component as line from r where labels = 0")
def union_of_parts(spark, d):
    r = records(spark, d)
    return r.where("labels = 1").select("_id", F.col("logline").alias("line")).unionByName(r.where("labels = 0").select("_id", F.col("component").alias("line")))


@query(
    _R
    + ", g as (select dataset_name, "
    + _bucket(900)
    + " as timestamp_bucket, _id from r where dataset_name is not null and timestamp is not null) select g.*, r.severity_text from g join r using (_id)"
)
def rows_of_groups(spark, d):
    r = records(spark, d)
    g = counters.group_rows(r, ["dataset_name"], "15min")
    return g.join(r.select("_id", "severity_text"), "_id")


# --- aggregations


@query(_R + f" select dataset_name, {_bucket(900)} as timestamp, count(*) as counts from r where dataset_name is not null and timestamp is not null group by all")
def group_counter(spark, d):
    return counters.group_counts(records(spark, d), ["dataset_name"], "15min")


@query("select " + _bucket(900, "ts") + " as timestamp, event_type, count(*) as counts from events where ts is not null and event_type is not null group by all")
def event_counter(spark, d):
    e = read(spark, d, "events").withColumnRenamed("ts", "timestamp")
    return counters.group_counts(e, ["event_type"], "15min")


@query(_R + " select component, severity_text, count(*) as counts from r where component is not null and severity_text is not null group by all")
def simple_counter(spark, d):
    return counters.group_counts(records(spark, d), ["component", "severity_text"])


@query(_R + f" select span_id, {_bucket(3600)} as timestamp, count(*) as counts, array_to_string(list(_id order by _id), ',') as event_index, array_to_string(list(coalesce(logline, '') order by _id), '|') as loglines from r where span_id is not null and timestamp is not null group by all")
def counter_vector(spark, d):
    c = counters.counter_vector(records(spark, d).withColumn("logline", F.coalesce("logline", F.lit(""))), ["span_id"], "1h", lists=["logline"])
    return c.select("span_id", "timestamp", "counts", F.array_join("event_index", ",").alias("event_index"), F.array_join("logline", "|").alias("loglines"))


@query("select label, count(*) as counts, " + ", ".join(f"round(avg(cast(embedding[{i + 1}] as double)), 5) as feature_{i}" for i in range(8)) + " from embeddings where label is not null group by label")
def feature_vector(spark, d):
    e = read(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    f = counters.spread_features(counters.feature_vector(e, "v", 8, ["label"], row_id="vec_id"), "features", 8)
    return f.select("label", "counts", *[F.round(f"feature_{i}", 5).alias(f"feature_{i}") for i in range(8)])


@query(
    _R
    + f", c as (select {_bucket(3600, right=True)} as timestamp, count(*) as counts, sum(case when labels = 1 then 1 else 0 end)::bigint as anomalies from r where timestamp is not null group by 1),"
    " g as (select unnest(range(min(timestamp), max(timestamp) + interval 1 hour, interval 1 hour)) as timestamp from c) select timestamp, coalesce(counts, 0) as counts, coalesce(anomalies, 0) as anomalies from g left join c using (timestamp)"
)
def trend(spark, d):
    return counters.trend(records(spark, d), "1h", label="right", flags={"anomalies": F.coalesce(F.col("labels") == 1, F.lit(False))})


@query(_R + ", m as (select *, md5(logline) as k from r) select span_id, logline, count(*) as counts, max(labels) as labels, arg_max(coalesce(cast(timestamp as varchar), ''), _id) as timestamp from r group by span_id, logline")
def dedup_counts(spark, d):
    r = records(spark, d).withColumn("timestamp", F.coalesce(F.col("timestamp").cast("string"), F.lit("")))
    return counters.dedup_with_counts(r)


@query(_R + ", c as (select component, count(*) as counts from r where component is not null group by 1) select component, counts, round(counts / sum(counts) over (), 9) as ratio, row_number() over (order by counts desc, component) - 1 as \"order\" from c")
def component_frequency(spark, d):
    f = counters.frequency(records(spark, d), "component")
    return f.withColumn("ratio", F.round("ratio", 9))


@query(_R + " select cast(least(floor((length(logline) - 0) / 5.0), 19) as bigint) as bin, count(*) as counts from r where length(logline) between 0 and 100 group by 1")
def length_histogram(spark, d):
    r = records(spark, d).withColumn("n", F.length("logline"))
    return counters.histogram(r, "n", 20, 0, 100, whole=True)


@query(_R + ", x as (select component, cast(length(logline) as double) as v from r where component is not null and logline is not null), t as (select *, row_number() over (partition by component order by v desc) as k from x) select component, avg(v) as top_mean, count(*) as n_top from t where k <= 6 group by component")
def top_six(spark, d):
    r = records(spark, d).where("component is not null and logline is not null").withColumn("v", F.array(F.length("logline").cast("double")))
    return counters.top_values(r, "component", "v")


@query(_R + " select labels, round(avg(length(logline)), 6) as mean, round(stddev_pop(length(logline)), 6) as std, count(*) as n from r where labels is not null group by labels")
def score_moments(spark, d):
    m = counters.score_moments(records(spark, d).withColumn("s", F.length("logline")), "s", "labels")
    return m.select("labels", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query(_R + " select count(distinct span_id) as n_distinct, count(*) as n_rows from r")
def span_summary(spark, d):
    return counters.attribute_summary(records(spark, d), "span_id")


# --- windows


def _window_sql(frame: str, where: str = "") -> str:
    return _R + f", w as (select _id, array_to_string(list(component) over (order by _id rows between {frame}), '[SEP]') as win, count(*) over (order by _id rows between {frame}) as n from r) select _id, coalesce(win, '') as \"window\" from w {where}"


@query(_window_sql("2 preceding and current row"))
def windows_default(spark, d):
    return windows.sliding_windows(records(spark, d), 3, "component")


@query(_window_sql("3 preceding and 1 preceding"))
def windows_before(spark, d):
    return windows.sliding_windows(records(spark, d), 3, "component", exclude_last_window=True)


@query(_window_sql("2 preceding and current row", "where n = 3"))
def windows_full(spark, d):
    return windows.sliding_windows(records(spark, d), 3, "component", exclude_smaller_windows=True)


@query(
    _R
    + """, w as (select span_id, _id, component, labels, row_number() over v as i, count(*) over (partition by span_id) as n,
        array_to_string(list(component) over (v rows between 4 preceding and 1 preceding), '[SEP]') as win, max(coalesce(labels, 0)) over (v rows between 4 preceding and current row) as lab
        from r where span_id is not null window v as (partition by span_id order by _id))
        select span_id, _id, coalesce(win, '') as "window", component as next_logline, lab as labels from w where i > 4 or (n <= 4 and i = n)"""
)
def next_line_windows(spark, d):
    return windows.sliding_windows(records(spark, d), 4, "component", group_by=["span_id"], exclude_last_window=True, exclude_smaller_windows=True, label="labels")


@query(
    _R
    + f""", g as (select span_id, {_bucket(3600)} as timestamp, _id, component from r where span_id is not null and timestamp is not null)
        select span_id, timestamp, _id, coalesce(array_to_string(list(component) over (partition by span_id, timestamp order by _id rows between 2 preceding and current row), '[SEP]'), '') as "window" from g"""
)
def windows_in_groups(spark, d):
    return windows.sliding_windows(records(spark, d), 3, "component", group_by=["span_id"], group_by_time="1h")


@query(
    _R
    + """, w as (select span_id, _id, row_number() over v - 1 as i, count(*) over (partition by span_id) as n, list(coalesce(component, '')) over (v rows between current row and 4 following) as l
        from r where span_id is not null window v as (partition by span_id order by _id))
        select span_id, i // 2 as seq_no, len(l) as n_rows, _id as first_id, array_to_string(l, ' ') as sequence from w where i % 2 = 0 and (i + 5 <= n or (i = 0 and n < 5))"""
)
def strided_sequences(spark, d):
    return windows.strided_sequences(records(spark, d), 5, 2, "component", group_by=["span_id"])


@query("select user_id as span_id, array_to_string(list(event_type order by event_id), '[SEP]') as logline, count(*) as counts, max(case when event_type = 'error' then 1 else 0 end) as labels from events where user_id is not null group by 1")
def id_sessions(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("_id"), F.col("user_id").alias("span_id"), F.col("event_type").alias("logline"), (F.col("event_type") == "error").cast("int").alias("labels"))
    return windows.id_sessions(e)


@query("with e as (select event_id as _id, epoch_us(ts) // 1000000 as s from events) select _id, cast(trunc((s - (select arg_min(s, _id) from e)) / 60.0) as int) as span_id from e")
def time_sessions(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("sec"))
    return windows.time_sessions(e, F.col("sec")).select("_id", "span_id")


# --- cleaning and scalar functions

_CLEAN = r"""
    c0 as (select _id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(logline, ':', ' ', 'g'), ',', ' ', 'g'), '=', ' ', 'g'), '\t', ' ', 'g') as x from r where logline is not null),
    c1 as (select _id, regexp_extract_all(x, '(blk_-?\d+)', 1) as blocks, regexp_replace(x, '(blk_-?\d+)', ' BLOCK ', 'g') as x from c0),
    c2 as (select _id, blocks, regexp_extract_all(x, '/?/*\d+\.\d+\.\d+\.\d+') as ips, regexp_replace(x, '/?/*\d+\.\d+\.\d+\.\d+', ' IP ', 'g') as x from c1),
    c3 as (select _id, blocks, ips, regexp_extract_all(x, '(0x)[0-9a-zA-Z]+', 1) as hexes, regexp_replace(x, '(0x)[0-9a-zA-Z]+', ' HEX ', 'g') as x from c2),
    c4 as (select _id, blocks, ips, hexes, regexp_extract_all(x, '\d+') as ints, regexp_replace(x, '\d+', ' INT ', 'g') as x from c3)"""


@query(_R + "," + _CLEAN + " select _id, x as logline, array_to_string(blocks, ' ') as blocks, array_to_string(ips, ' ') as ips, array_to_string(hexes, ' ') as hexes, array_to_string(ints, ' ') as ints from c4")
def cleaned_terms(spark, d):
    c = clean(records(spark, d).where("logline is not null"), HDFS_RULES)
    return c.select("_id", "logline", *[F.array_join(f"` {p} `", " ").alias(n) for p, n in (("BLOCK", "blocks"), ("IP", "ips"), ("HEX", "hexes"), ("INT", "ints"))])


@query(_R + "," + _CLEAN + r""", c5 as (select _id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(( BLOCK )[ /=]*)+', ' BLOCK ', 'g'), '(( IP )[ /=]*)+', ' IP ', 'g'), '(( HEX )[ /=]*)+', ' HEX ', 'g'), '(( INT )[ /=]*)+', ' INT ', 'g') as x from c4)
    select _id, regexp_replace(replace(x, '*', ''), ' +', ' ', 'g') as logline from c5""")
def collapsed_placeholders(spark, d):
    return clean_open_set(records(spark, d).where("logline is not null"), HDFS_RULES).select("_id", "logline")


@query(_R + "," + _CLEAN + r""", s as (select _id, array_to_string(list_sort(list_distinct(blocks)), ' ') as k from c4), i as (select k, dense_rank() over (order by k) - 1 as span_id from (select distinct k from s)),
    bad as (select distinct unnest(regexp_extract_all(logline, '(blk_-?\d+)', 1)) as b from r where labels = 1)
    select s._id, i.span_id, case when list_has_any(string_split(s.k, ' '), (select list(b) from bad)) then 1 else 0 end as labels from s join i using (k)""")
def block_labels(spark, d):
    r = records(spark, d).where("logline is not null")
    bad = r.where("labels = 1").select(F.explode(F.regexp_extract_all("logline", F.lit(r"(blk_-?\d+)"), F.lit(1))).alias("BlockId")).distinct().withColumn("Label", F.lit("Anomaly"))
    return clean_hdfs(r.drop("labels", "span_id"), bad).select("_id", "span_id", "labels")


@query("select seq_id as _id, case when trace_id is null then null when trace_id <> '-' then 1 else 0 end as labels from log_sequences")
def dash_labels(spark, d):
    return read(spark, d, "log_sequences").select(F.col("seq_id").alias("_id"), T.binary_label(F.col("trace_id")).alias("labels"))


@query(
    _R
    + r""" select _id,
        regexp_replace(replace(logline, ':', ' '), '\s+', ' ', 'g') as delimited,
        trim(regexp_replace(regexp_replace(logline, '([A-Z]+)', ' \1', 'g'), '([A-Z][a-z]+)', ' \1', 'g'), ' ') as camel,
        array_to_string(list_transform(list_filter(regexp_split_to_array(logline, '\s+'), lambda t: t <> ''), lambda t: case when regexp_full_match(t, '\d+') then '[DIGITS]' else t end), ' ') as digits,
        len(list_filter(regexp_split_to_array(logline, '[\s=:,]'), lambda t: t <> '')) as pieces,
        array_to_string(list_filter(regexp_split_to_array(lower(translate(logline, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', repeat(' ', 32))), '\s+'), lambda t: t <> ''), ' ') as plain,
        substr(md5(logline), 1, 8) as event_id, concat_ws('-', component, dataset_name) as attribute,
        array_to_string(list_resize(regexp_extract_all(logline, '\w+'), 4, '<pad>'), ' ') as padded
        from r where logline is not null"""
)
def scalar_functions(spark, d):
    r, c = records(spark, d).where("logline is not null"), F.col("logline")
    return r.select(
        "_id",
        F.regexp_replace(T.replace_delimiter(c, ":"), r"\s+", " ").alias("delimited"),
        T.split_camel(c).alias("camel"),
        T.mask_digits(c).alias("digits"),
        F.size(T.split_at(c)).cast("bigint").alias("pieces"),
        F.array_join(T.plain_tokens(c), " ").alias("plain"),
        T.event_id(c).alias("event_id"),
        T.attribute_key(F.col("component"), F.col("dataset_name")).alias("attribute"),
        F.array_join(T.pad(F.regexp_extract_all(c, F.lit(r"\w+"), F.lit(0)), 4, F.lit("<pad>")), " ").alias("padded"),
    )


@query(
    _R
    + r""", a as (select _id, logline, array_to_string(list_transform(regexp_extract_all(logline, '\p{L}+|\P{L}+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), ' ') as x from r where logline is not null)
        select _id, array_to_string(list_filter(string_split(x, ' '), lambda t: length(t) > 0 and instr('!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', t) = 0), ' ') as tokens,
        array_to_string(list_transform(list_filter(regexp_split_to_array(logline, '\s+'), lambda t: t <> ''), lambda t: regexp_extract(lower(t), '(\w+|[^\w\s])', 1)), ' ') as words from a"""
)
def split_tokens(spark, d):
    words = F.transform(T.tokens(F.col("logline")), T.first_word)
    return records(spark, d).where("logline is not null").select("_id", T.split_alpha(F.col("logline")).alias("tokens"), F.array_join(words, " ").alias("words"))


# --- templates

_AEL = r"""
    l as (select _id, logline, list_filter(regexp_split_to_array(logline, '\s+'), lambda t: t <> '') as t from r where logline is not null),
    b as (select len(t) as n, len(list_filter(t, lambda x: x = '<*>')) as w, * from l),
    e as (select n, w, count(distinct t) as events from b group by all),
    p as (select n, w, i, case when min(tok) = max(tok) then min(tok) else '<*>' end as tok from (select n, w, unnest(t) as tok, generate_subscripts(t, 1) as i from b) group by n, w, i),
    m as (select n, w, string_agg(tok, ' ' order by i) as merged from p group by n, w),
    a as (select b._id, b.logline, case when e.events > 2 then coalesce(m.merged, '') else array_to_string(b.t, ' ') end as parsed_logline from b join e using (n, w) left join m using (n, w))"""


@query(_R + "," + _AEL + r" select _id, parsed_logline, substr(md5(parsed_logline), 1, 8) as event_id, array_to_string(list_filter(regexp_split_to_array(logline, '\s+'), lambda t: t <> '' and not contains(parsed_logline, t)), ' ') as parameters from a")
def ael_templates(spark, d):
    return ael(records(spark, d)).select("_id", "parsed_logline", "event_id", F.array_join("parameter_list", " ").alias("parameters"))


@query(_R + "," + _AEL + ', c as (select parsed_logline, count(*) as counts from a group by 1) select parsed_logline, counts, round(counts / sum(counts) over (), 9) as ratio, row_number() over (order by counts desc, parsed_logline) - 1 as "order" from c')
def template_frequency(spark, d):
    return counters.frequency(ael(records(spark, d)), "parsed_logline").withColumn("ratio", F.round("ratio", 9))


@query(
    _R
    + "," + _AEL
    + r""", q as (select parsed_logline, list_filter(regexp_split_to_array(logline, '\s+'), lambda t: t <> '' and not contains(parsed_logline, t)) as ps from a),
    u as (select parsed_logline, unnest(ps) as v, generate_subscripts(ps, 1) - 1 as position from q)
    select parsed_logline, cast(position as int) as position, count(v) as value_counts, count(distinct v) as distinct_values from u group by all"""
)
def parameter_summary(spark, d):
    return drill.parameter_summary(ael(records(spark, d)))


@query(_R + "," + _AEL + " select distinct parsed_logline from a join r using (_id) where r.component = 'kernel'")
def patterns_of_component(spark, d):
    r = records(spark, d)
    return drill.patterns(ael(r).join(r.select("_id", "component"), "_id"), {"component": "kernel"})


_IPLOM = r"""
    l as (select _id, logline, list_filter(regexp_split_to_array(logline, '[\s=:,]'), lambda t: t <> '') as t from r where logline is not null),
    b as (select len(t) as n, * from l),
    x as (select n, unnest(t) as tok, generate_subscripts(t, 1) as i from b),
    k as (select n, i, count(distinct tok) as card from x group by n, i),
    s as (select n, case when min(card) > 1 then arg_min(i, (card, i)) end as p from k group by n),
    c as (select b.*, case when s.p is not null then b.t[s.p] end as k2 from b left join s using (n)),
    d2 as (select n, k2, count(distinct t[1]) as c1, count(distinct t[2]) as c2, count(*) as m from c where n = 2 group by all),
    f as (select c.*, case when c.n = 2 and greatest(d2.c1, d2.c2) > 1 and greatest(d2.c1, d2.c2) / d2.m <= 0.25 then array_to_string(c.t, ' ') end as k3 from c left join d2 on c.n = d2.n and c.k2 is not distinct from d2.k2),
    y as (select n, k2, k3, i, case when min(tok) = max(tok) then min(tok) else '<*>' end as tok from (select n, k2, k3, unnest(t) as tok, generate_subscripts(t, 1) as i from f) group by all),
    z as (select n, k2, k3, string_agg(tok, ' ' order by i) as tpl from y group by n, k2, k3)"""


@query(_R + "," + _IPLOM + " select f._id, coalesce(z.tpl, '') as parsed_logline from f left join z on f.n = z.n and f.k2 is not distinct from z.k2 and f.k3 is not distinct from z.k3")
def iplom_templates(spark, d):
    return iplom(records(spark, d)).select("_id", "parsed_logline")


@query()
def drain_templates(spark, d):
    return drain(records(spark, d)).select("_id", "parsed_logline", "parameter_list")


@query()
def drain_applied(spark, d):
    """Templates fitted on the lines of normal records, matched to all: null where they have none."""
    r = records(spark, d)
    templates = fit_templates(r.where("labels = 0"))
    return match_templates(r, templates).select("_id", "parsed_logline")


@query()
def aligned_parameters(spark, d):
    p = drain(records(spark, d))
    return p.select("_id", T.parameters_by_alignment(F.col("logline"), F.col("parsed_logline")).alias("parameters"))


@query(_R + "," + _AEL + """, t as (select arg_min(parsed_logline, _id) as p from a where logline = (select min(logline) from r)) select _id, logline from a where parsed_logline = (select p from t)""")
def lines_of_pattern(spark, d):
    r = records(spark, d)
    p = ael(r)
    line = r.agg(F.min("logline")).first()[0]
    pattern = drill.pattern_of_line(p, line).first()[0]
    return drill.lines_of_pattern(p, pattern).select("_id", "logline")


# --- encoding and vectorizing


@query(_R + ", v as (select severity_text as s, row_number() over (order by severity_text nulls first) - 1 as i from (select distinct severity_text from r)) select _id, i as severity_text_categorical from r join v on r.severity_text is not distinct from v.s")
def label_encoding(spark, d):
    return encode.label_encode(records(spark, d), ["severity_text"]).select("_id", "severity_text_categorical")


@query(_R + ", v as (select component as s, row_number() over (order by component nulls first) - 1 as i from (select distinct component from r)) select _id, cast(i as double) as \"component-categorical\" from r join v on r.component is not distinct from v.s")
def ordinal_encoding(spark, d):
    return encode.ordinal_encode(records(spark, d), ["component"]).select("_id", "component-categorical")


@query("select event_id as _id, " + ", ".join(f"case when event_type = '{v}' then 1.0::double else 0.0::double end as \"event_type-{i}\"" for i, v in enumerate(("click", "error", "purchase", "signup", "view"))) + " from events")
def one_hot_encoding(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("_id"), "event_type")
    return encode.one_hot_encode(e, ["event_type"]).drop("event_type")


@query(
    _R
    + r""", t as (select _id, unnest(regexp_extract_all(lower(logline), '\b\w\w+\b')) as term from r where logline is not null), f as (select _id, term, count(*) as tf from t group by all),
    i as (select term, ln((1.0 + (select count(*) from r where logline is not null)) / (1.0 + count(*))) + 1 as idf from f group by term), w as (select _id, term, tf, tf * idf as x from f join i using (term))
    select _id, term, tf, round(x / sqrt(sum(x * x) over (partition by _id)), 6) as weight from w"""
)
def tfidf(spark, d):
    return vectorize.tfidf(records(spark, d)).withColumn("weight", F.round("weight", 6))


@query(
    _R
    + r""", w as (select _id, list_filter(regexp_extract_all(lower(logline), '\b\w\w+\b'), lambda t: t not in ('to', 'of', 'for')) as w from r where logline is not null),
    t as (select _id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from w), f as (select _id, term, count(*) as tf from t group by all),
    i as (select term, ln((1.0 + (select count(*) from w)) / (1.0 + count(*))) + 1 as idf from f group by term having count(*) >= 5), w2 as (select _id, term, tf, (1 + ln(tf)) * idf as x from f join i using (term))
    select _id, term, tf, round(x / sum(abs(x)) over (partition by _id), 6) as weight from w2"""
)
def tfidf_pairs(spark, d):
    w = vectorize.tfidf(records(spark, d), ngram_range=(1, 2), stop_words=("to", "of", "for"), min_df=5, sublinear_tf=True, norm="l1")
    return w.withColumn("weight", F.round("weight", 6))


_VOCAB = r", v as (select token, row_number() over (order by token) + 1 as id from (select distinct trim(component) as token from r where component is not null))"


@query(_R + _VOCAB + " select token, id from v")
def line_vocabulary(spark, d):
    return vectorize.line_vocabulary(records(spark, d), "component")


@query(
    """with s as (select seq_id, string_split(logline, '[SEP]') as p from log_sequences where logline is not null),
    v as (select token, row_number() over (order by token) + 1 as id from (select distinct trim(logline) as token from log_records where logline is not null)),
    t as (select seq_id, unnest(p) as x, generate_subscripts(p, 1) as i from s), j as (select seq_id, i, coalesce(v.id, 1) as id from t left join v on trim(t.x) = v.token where i <= 10),
    a as (select seq_id, list(id order by i) as ids from j group by seq_id) select seq_id as _id, array_to_string(list_resize(ids, 10, 0), ',') as ids from a"""
)
def sequential_ids(spark, d):
    s = read(spark, d, "log_sequences").where("logline is not null").select(F.col("seq_id").alias("_id"), "logline")
    return vectorize.sequential(s, vectorize.line_vocabulary(records(spark, d)), max_token_len=10).select("_id", F.array_join("ids", ",").alias("ids"))


@query(
    """with s as (select seq_id, string_split(logline, '[SEP]') as p from log_sequences where logline is not null),
    v as (select token, row_number() over (order by token) + 1 as id from (select distinct trim(logline) as token from log_records where logline is not null)),
    t as (select seq_id, unnest(p) as x, generate_subscripts(p, 1) as i from s), j as (select seq_id, i, coalesce(v.id, 1) as id from t left join v on trim(t.x) = v.token)
    select seq_id as _id, array_to_string(list(id order by i), ',') as ids from j group by seq_id"""
)
def whole_sequential_ids(spark, d):
    s = read(spark, d, "log_sequences").where("logline is not null").select(F.col("seq_id").alias("_id"), "logline")
    return vectorize.sequential(s, vectorize.line_vocabulary(records(spark, d))).select("_id", F.array_join("ids", ",").alias("ids"))


@query(
    _R
    + r""", w as (select _id, list_filter(regexp_split_to_array(lower(translate(coalesce(logline, ''), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', repeat(' ', 32))), '\s+'), lambda t: t <> '') as ws from r),
        t as (select _id, unnest(ws) as token, generate_subscripts(ws, 1) as i from w), v as (select token, row_number() over (order by token) + 1 as id from (select distinct token from t)),
        a as (select _id, list(id order by i) as ids from t join v using (token) where i <= 10 group by _id)
        select _id, array_to_string(list_resize(coalesce(a.ids, []::bigint[]), 10, 0), ',') as ids from r left join a using (_id)"""
)
def semantic_ids(spark, d):
    r = records(spark, d)
    return vectorize.semantic_ids(r, vectorize.word_vocabulary(r)).select("_id", F.array_join("ids", ",").alias("ids"))


@query(
    r"""with w as (select seq_id, list_filter(regexp_split_to_array(coalesce(logline, ''), '\s+'), lambda t: t not in ('', '[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]')) as ws from log_sequences),
    t as (select seq_id, unnest(ws) as token, generate_subscripts(ws, 1) as i from w), top as (select token from t group by token order by count(*) desc, token limit 5000),
    v as (select token, row_number() over (order by token) + 4 as id from top), a as (select seq_id, list(coalesce(id, 1) order by i) as ids from t left join v using (token) where i <= 382 group by seq_id)
    select seq_id as _id, array_to_string(list_concat(list_concat([2], coalesce(a.ids, []::bigint[])), [3]), ',') as ids from log_sequences left join a using (seq_id)"""
)
def token_ids(spark, d):
    s = read(spark, d, "log_sequences").select(F.col("seq_id").alias("_id"), "logline")
    return vectorize.token_ids(s).select("_id", F.array_join("ids", ",").alias("ids"))


@query()
def word2vec(spark, d):
    return vectorize.word2vec(ael(records(spark, d)), "parsed_logline")


@query()
def subword_vectors(spark, d):
    return vectorize.subword_vectors(ael(records(spark, d)), "parsed_logline")


@query(
    _R
    + _VOCAB
    + """, i as (select r.*, coalesce(v.id, 1) as id from r left join v on trim(coalesce(r.component, '')) = v.token),
        w as (select span_id, _id, id, row_number() over u as k, count(*) over (partition by span_id) as n, list(case when component is not null then id end) over (u rows between 5 preceding and 1 preceding) as ids,
        max(coalesce(labels, 0)) over (u rows between 5 preceding and current row) as lab from i where span_id is not null window u as (partition by span_id order by _id))
        select span_id as session_idx, array_to_string(list_resize(case when len(coalesce(list_filter(ids, lambda x: x is not null), [])) = 0 then [1] else list_filter(ids, lambda x: x is not null) end, 5, 0), ',') as features,
        lab as window_anomalies, id as window_labels from w where k > 5 or (n <= 5 and k = n)"""
)
def next_line_dataset(spark, d):
    r = records(spark, d)
    w = windows.sliding_windows(r, 5, "component", group_by=["span_id"], exclude_last_window=True, exclude_smaller_windows=True, label="labels")
    return vectorize.next_line_dataset(w, vectorize.line_vocabulary(r, "component"), max_token_len=5).withColumn("features", F.array_join("features", ","))


# --- sources, sinks, and the batch form of the streaming operators


def _scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(_R + " select _id, epoch_us(timestamp) as us, nullif(span_id, '') as span_id, nullif(component, '') as component, nullif(logline, '') as logline, labels from r where logline is not null")
def csv_round_trip(spark, d):
    """Records to CSV with their fields beside it, and back."""
    r, path = record(spark, d).dropna(), _scratch(spark, "records") + ".csv"
    r.save_to_csv(path)
    back = LogRecord.load_from_csv(spark, path, ", ".join(f"`{n}` {t}" for n, t in r.df.dtypes))
    return back.df.select("_id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"), "span_id", "component", "logline", "labels")


@query(_R + " select _id, span_id, component, logline, labels from r")
def record_round_trip(spark, d):
    r, path = record(spark, d), _scratch(spark, "records")
    r.save(path)
    return LogRecord.load(spark, path).df.select("_id", "span_id", "component", "logline", "labels")


@query(_R + " select logline, component, severity_text, count(*) as n from r where logline is not null and component is not null and severity_text is not null group by all")
def json_reader(spark, d):
    """JSON objects to records by `dimensions`."""
    r, path = records(spark, d).where("logline is not null and component is not null and severity_text is not null"), _scratch(spark, "objects")
    r.select("logline", "component", "severity_text").write.json(path)
    config = DataLoaderConfig(filepath=path, log_type="json", reader_args={"lines": True}, dimensions={"body": ["logline"], "attributes": ["component", "severity_text"]})
    return load(spark, config).df.groupBy("logline", "component", "severity_text").agg(F.count("*").alias("n"))


@query(_R + r" select epoch_us(date_trunc('second', timestamp)) as us, severity_text, component, trim(logline, E' \t\n\r\f\x0B') as logline, count(*) as n from r where logline is not null and timestamp is not null and regexp_matches(severity_text, '^\S+$') and regexp_matches(component, '^\S+$') and regexp_matches(logline, '^\S([^\n\r]*\S)?$') group by all")
def text_reader(spark, d):
    """Lines of free text to records by a field notation and a time format."""
    r = records(spark, d).where(F.col("logline").rlike(r"^\S([^\n\r]*\S)?$") & F.col("timestamp").isNotNull() & F.col("severity_text").rlike(r"^\S+$") & F.col("component").rlike(r"^\S+$"))
    path = _scratch(spark, "lines")
    r.select(F.concat_ws(" ", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), "severity_text", "component", "logline").alias("value")).write.text(path)
    config = DataLoaderConfig(filepath=path, log_type="log", reader_args={"log_format": "<Date> <Time> <Level> <Component> <Content>"}, dimensions={"timestamp": ["Date", "Time"], "attributes": ["Level", "Component"], "body": ["Content"]}, infer_datetime=True, datetime_format="%Y-%m-%d %H:%M:%S")
    g = load(spark, config).df.groupBy("timestamp", F.col("Level").alias("severity_text"), F.col("Component").alias("component"), "logline").agg(F.count("*").alias("n"))
    return g.select(F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"), "severity_text", "component", "logline", "n")


@query(_R + ", b as (select severity_text, unnest([epoch_us(timestamp) // 300000000, epoch_us(timestamp) // 300000000 - 1, epoch_us(timestamp) // 300000000 - 2]) * 300000000 as us from r where timestamp is not null) select us, severity_text, count(*) as counts from b group by all")
def sliding_counts(spark, d):
    c = stream_counts(records(spark, d).where("timestamp is not null"), "15min", ["severity_text"], slide="5min")
    return c.select(F.unix_micros("timestamp").alias("us"), "severity_text", "counts")


@query(
    _R
    + """, e as (select span_id, epoch_us(timestamp) as us, _id from r where span_id is not null and timestamp is not null),
        f as (select *, case when us - lag(us) over w <= 1800000000 then 0 else 1 end as fresh from e window w as (partition by span_id order by us, _id)),
        g as (select *, sum(fresh) over (partition by span_id order by us, _id) as n from f) select span_id, min(us) as start_us, max(us) as end_us, count(*) as n_events from g group by span_id, n"""
)
def gap_sessions(spark, d):
    s = window_sessions(records(spark, d).where("span_id is not null and timestamp is not null"))
    return s.select("span_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "n_events")


# --- clusters and detectors


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("_id"), F.col("embedding").cast("array<double>").alias("features"), "label")


@query()
def kmeans(spark, d):
    return cluster.kmeans(_embeddings(spark, d), n_clusters=8, max_iter=50)


@query(
    """with recursive e as (select vec_id, embedding::double[] as v from embeddings where embedding is not null),
    p as (select v, count(*) as w, row_number() over (order by v) - 1 as p from e group by v),
    m as (select a.p as x, b.p as y, b.w from p a join p b on list_distance(a.v, b.v) <= sqrt(0.36 + 1e-9)),
    n as (select x, sum(w) >= 5 as core from m group by x),
    l as (select m.x, m.y from m join n a on m.x = a.x and a.core join n b on m.y = b.x and b.core),
    r as (select x, x as y from n where core union select r.x, l.y from r join l on r.y = l.x),
    c as (select x, min(y) as c from r group by x),
    g as (select x, c from c union all select m.x, min(c.c) from m join n on m.x = n.x and not n.core join c on m.y = c.x group by m.x)
    select vec_id as _id, coalesce(cast(g.c as varchar), '-1') as cluster_id from e join p using (v) left join g on p.p = g.x"""
)
def dbscan(spark, d):
    return cluster.dbscan(_embeddings(spark, d), eps=0.6, min_samples=5)


@query()
def birch(spark, d):
    return cluster.birch(_embeddings(spark, d), threshold=0.6)


@query()
def one_class_svm(spark, d):
    return detect.one_class_svm(_embeddings(spark, d), nu=0.1)


@query()
def isolation_forest(spark, d):
    return detect.isolation_forest(_embeddings(spark, d))


@query(
    """with e as (select vec_id, embedding::double[] as v from embeddings where embedding is not null),
    m as (select a.vec_id as x, b.vec_id as y, list_distance(a.v, b.v) as d from e a join e b on a.vec_id <> b.vec_id),
    f as (select x, y, d from (select *, row_number() over (partition by x order by d, y) as n from m) where n <= 8),
    u as (select x, y, d from (select *, row_number() over (partition by x order by d, y) as n from (select * from m union all select vec_id, vec_id, 0.0 from e)) where n <= 8),
    k as (select x, max(d) as kd from f group by x),
    l as (select f.x, 1 / greatest(sum(greatest(f.d, k.kd)) / 8.0, 1e-10) as lrd from f join k on f.y = k.x group by f.x),
    s as (select u.x, 1 / greatest(sum(greatest(u.d, k.kd)) / 8.0, 1e-10) as own from u join k on u.y = k.x group by u.x),
    r as (select u.x, 1.1 - sum(l.lrd) / 8.0 / any_value(s.own) as raw from u join l on u.y = l.x join s on u.x = s.x group by u.x)
    select x as _id, case when raw < 0 then -1 else 1 end as anom_score, round(raw, 6) as raw_score from r"""
)
def local_outlier_factor(spark, d):
    f = detect.local_outlier_factor(_embeddings(spark, d), n_neighbors=8, bar=1.1)
    return f.select("_id", "anom_score", F.round("raw_score", 6).alias("raw_score"))


@query(
    _R
    + """, x as (select dataset_name, cast(length(logline) as double) as v from r where dataset_name in ('blockstore', 'rackfarm') and logline is not null), lim as (select min(v) as lo, max(v) as hi from x),
    h as (select least(floor((v - lo) / ((hi - lo) / 20)), 19) as b, sum((dataset_name = 'blockstore')::int) as p, sum((dataset_name = 'rackfarm')::int) as q from x, lim group by 1),
    n as (select greatest(p / sum(p) over (), 1e-20) as p, greatest(q / sum(q) over (), 1e-20) as q from h)
    select 'KL' as kind, round(sum(p * ln(p / q)), 9) as anom_score from n union all select 'JS', round(sum(p * ln(p / ((p + q) / 2))) / 2 + sum(q * ln(q / ((p + q) / 2))) / 2, 9) from n"""
)
def divergence(spark, d):
    r = records(spark, d).where("logline is not null").withColumn("n", F.length("logline"))
    v = detect.distribution_divergence(r.where("dataset_name = 'blockstore'"), r.where("dataset_name = 'rackfarm'"), ["n"], 20, "KL,JS")
    return v.withColumn("anom_score", F.round("anom_score", 9))


_SERIES = _R + f", c as (select component as attribute, {_bucket(3600)} as timestamp, count(*) as counts from r where component is not null and timestamp is not null group by all)"


def _series(spark: SparkSession, d: str) -> DataFrame:
    return counters.group_counts(records(spark, d), ["component"], "1h")


@query(
    _SERIES
    + """, s as (select *, count(*) over (partition by attribute) as n, row_number() over (partition by attribute order by timestamp) as k, hour(timestamp) as slot from c),
    t as (select *, k <= floor(n * 0.7) as trainval from s),
    m as (select *, avg(case when trainval then counts end) over a as ma, stddev_pop(case when trainval then counts end) over a as sa, avg(case when trainval then counts end) over b as mb, stddev_pop(case when trainval then counts end) over b as sb
        from t window a as (partition by attribute, slot), b as (partition by attribute))
    select attribute, timestamp, counts, trainval, round(case when not trainval and n >= 10 then (counts - coalesce(ma, mb)) / (case when coalesce(sa, sb) > 0 then coalesce(sa, sb) else 1 end) else 0 end, 6) as anom_score from m"""
)
def dynamic_baseline(spark, d):
    s = detect.per_attribute(_series(spark, d), ["component"], "dbl", train_fraction=0.7)
    return s.select("attribute", "timestamp", "counts", "trainval", F.round("anom_score", 6).alias("anom_score"))


@query()
def smoothing_residuals(spark, d):
    return detect.per_attribute(_series(spark, d), ["component"], "ets", train_fraction=0.7)


# --- splits and metrics


@query(_R + ", p as (select _id, row_number() over (order by timestamp, _id) - 1 as k from r where timestamp is not null) select _id, k < floor(0.7 * (select count(*) from p)) as is_train from p")
def chronological_split(spark, d):
    return splits.chronological_split(records(spark, d).where("timestamp is not null").select("_id", "timestamp"), ["timestamp", "_id"]).select("_id", "is_train")


@query(
    _R
    + """, p as (select span_id, max(case when labels = 1 then 1 else 0 end) as pos, count(*) as n from r where span_id is not null group by 1),
        u as (select *, (('0x' || substr(md5(concat_ws('|', span_id, pos, 7)), 1, 8))::bigint % 1000000) / 1000000.0 as u from p)
        select case when u < 0.7 then 'train' when u < 0.7 + 0.1 then 'dev' else 'test' end as split, sum(n)::bigint as rows, count(*) as spans from u group by 1"""
)
def span_split(spark, d):
    return splits.span_split(records(spark, d)).groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("span_id").alias("spans"))


_PRED = ", p as (select labels as y, case when length(logline) > 60 then 1 else 0 end as z, cast(length(logline) as double) as s from r where labels is not null and logline is not null)"


@query(_R + _PRED + ", c as (select count(*) as n, sum((y = z)::int) as h, sum((y = 1 and z = 1)::int) as tp, sum((y = 0 and z = 1)::int) as fp, sum((y = 1 and z = 0)::int) as fn from p) select n, h / n as accuracy, tp / (tp + fp) as precision, tp / (tp + fn) as recall, 2 * tp / (2 * tp + fp + fn) as f1 from c")
def binary_metrics(spark, d):
    r = records(spark, d).where("labels is not null and logline is not null").withColumn("z", (F.length("logline") > 60).cast("int"))
    return evaluate.binary_metrics(r, "labels", "z")


@query(_R + _PRED + ", k as (select y, s, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as rk from p) select sum((y = 1)::bigint)::bigint as n_pos, sum((y <> 1)::bigint)::bigint as n_neg, round((sum(case when y = 1 then rk else 0 end) - sum((y = 1)::int) * (sum((y = 1)::int) + 1) / 2.0) / (sum((y = 1)::int) * sum((y <> 1)::int)), 9) as auroc from k")
def auroc(spark, d):
    r = records(spark, d).where("labels is not null and logline is not null").withColumn("s", F.length("logline").cast("double"))
    return evaluate.auroc(r, "labels", "s").withColumn("auroc", F.round("auroc", 9))


@query(_R + " select round(exp(avg(length(logline) / 50.0)), 9) as perplexity from r where logline is not null")
def perplexity(spark, d):
    return evaluate.perplexity(records(spark, d).where("logline is not null").withColumn("loss", F.length("logline") / 50.0), "loss").withColumn("perplexity", F.round("perplexity", 9))


@query(_R + " select span_id, max((length(logline) > 80)::int) as prediction, max((labels > 0)::int) as label from r where span_id is not null and logline is not null and labels is not null group by 1")
def session_predictions(spark, d):
    r = records(spark, d).where("span_id is not null and logline is not null and labels is not null").withColumn("z", (F.length("logline") > 80).cast("int"))
    return evaluate.session_predictions(r, "span_id", "z", "labels")


@query(_R + " select component, array_to_string(list(_id order by _id), ',') as event_index from r where component is not null and severity_text = 'FATAL' group by 1")
def group_index(spark, d):
    r = records(spark, d).where("component is not null and severity_text = 'FATAL'")
    return counters.group_index(r, ["component"]).select("component", F.array_join("event_index", ",").alias("event_index"))


@query(
    """with e as (select vec_id, list_transform(embedding[1:8], lambda x: cast(x as double)) as v from embeddings where embedding is not null),
    x as (select *, list_transform(v, lambda x: exp(x - list_max(v))) as e from e), p as (select *, list_transform(e, lambda x: x / list_sum(e)) as p from x)
    select vec_id as _id, round(list_sum(list_transform(p, lambda x: -x * ln(x))), 6) as entropy, round(ln(p[1]), 6) as log_probability, list_position(v, list_max(v)) - 1 as best, v[1] >= list_sort(v, 'DESC')[3] as in_first_three from p"""
)
def array_scores(spark, d):
    e = read(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("_id"), F.slice(F.col("embedding").cast("array<double>"), 1, 8).alias("v"))
    p = e.withColumn("p", A.softmax(F.col("v")))
    return p.select("_id", F.round(A.entropy(F.col("p")), 6).alias("entropy"), F.round(A.log_probability(F.col("p"), F.lit(0)), 6).alias("log_probability"), F.get(A.top_k(F.col("v"), 1), F.lit(0)).alias("best"), A.in_top_k(F.col("v"), F.lit(0), 3).alias("in_first_three"))


@query(
    """with s as (select event_id, list_transform(range(1, 6), lambda i: (event_id * i) % 97) as ids from events)
    select event_id as _id, array_to_string(list_transform(range(0, 5, 2), lambda s: array_to_string(list_transform(range(0, 5), lambda i: case when i >= s and i < s + 2 then -1 else ids[i + 1] end), ',')), ';') as windows from s"""
)
def masked_windows(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("_id"), F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.col("event_id") * i % 97).alias("ids"))
    w = A.masked_windows(F.col("ids"), -1, 2)
    return e.select("_id", F.array_join(F.transform(w, lambda x: F.array_join(x, ",")), ";").alias("windows"))


# --- applications


@query()
def app_summary(spark, d):
    app = LogSummary(WorkFlowConfig(preprocessor_config=PreprocessorConfig([":", ","], [[r"\d+", " <NUM> "]]), log_parser_config=LogParserConfig("drain", {"depth": 4, "sim_th": 0.5})))
    app.execute(record=record(spark, d))
    return app.summary()


@query()
def app_clusters(spark, d):
    app = LogClusters(WorkFlowConfig(log_parser_config=LogParserConfig("ael"), log_vectorizer_config=VectorizerConfig("tfidf"), clustering_config=ClusteringConfig("kmeans", {"n_clusters": 6, "max_iter": 20})))
    app.execute(record=record(spark, d))
    return app.sizes()


@query(
    _R
    + ","
    + _AEL
    + f""", x as (select a._id, a.parsed_logline, r.component, r.timestamp, {_bucket(900, 'r.timestamp')} as bucket from a join r using (_id) where r.timestamp is not null and r.component is not null),
    c as (select component, bucket, count(*) as counts from x group by all),
    s as (select *, count(*) over (partition by component) as n, row_number() over (partition by component order by bucket) as k, hour(bucket) as slot from c),
    t as (select *, k <= floor(n * 0.7) as trainval from s),
    mm as (select *, avg(case when trainval then counts end) over u as ma, stddev_pop(case when trainval then counts end) over u as sa, avg(case when trainval then counts end) over v as mb, stddev_pop(case when trainval then counts end) over v as sb
        from t window u as (partition by component, slot), v as (partition by component)),
    z as (select component, bucket from mm where not trainval and n >= 10 and (counts - coalesce(ma, mb)) / (case when coalesce(sa, sb) > 0 then coalesce(sa, sb) else 1 end) >= 3)
    select _id, timestamp, component, concat_ws('|', parsed_logline, component, strftime(bucket, '%Y-%m-%d %H:%M:%S')) as group_id from x join z using (component, bucket)"""
)
def app_counter_anomalies(spark, d):
    app = LogAnomalies(WorkFlowConfig(log_parser_config=LogParserConfig("ael"), feature_extractor_config=FeatureExtractorConfig(["parsed_logline", "component"], "15min"), anomaly_detection_config=AnomalyDetectionConfig("dbl", {"threshold": 3.0})))
    app.execute(record=record(spark, d))
    return app.anomaly_results.select("_id", "timestamp", "component", "group_id")


@query()
def app_vector_anomalies(spark, d):
    app = LogAnomalies(WorkFlowConfig(log_parser_config=LogParserConfig("ael"), log_vectorizer_config=VectorizerConfig("word2vec"), feature_extractor_config=FeatureExtractorConfig(["component"], "1d"), anomaly_detection_config=AnomalyDetectionConfig("isolation_forest")))
    app.execute(record=record(spark, d))
    return app.evaluation()


@query(
    _R
    + ","
    + _AEL
    + """, d as (select r._id, r.span_id, coalesce(r.labels, 0) as labels, r.labels as lab, a.parsed_logline as t from a join r using (_id)),
    v as (select token, row_number() over (order by token) + 1 as id from (select distinct trim(t) as token from d)),
    pp as (select span_id, max((labels = 1)::int) as pos from d where span_id is not null group by 1),
    u as (select span_id, (('0x' || substr(md5(concat_ws('|', span_id, pos, 7)), 1, 8))::bigint % 1000000) / 1000000.0 as u from pp),
    w as (select d.span_id, d._id, v.id, row_number() over o as k, count(*) over (partition by d.span_id) as n, lag(v.id) over o as last, max(labels) over (o rows between 5 preceding and current row) as lab
        from d join v on trim(d.t) = v.token where d.span_id is not null window o as (partition by d.span_id order by d._id)),
    s as (select w.*, u.u from w join u using (span_id) where k > 5 or (n <= 5 and k = n)),
    q as (select last, id, rank from (select coalesce(last, 1) as last, id, row_number() over (partition by coalesce(last, 1) order by count(*) desc, id) as rank from s where u < 0.7 group by 1, 2) where rank <= 5),
    ee as (select s.span_id, s.lab, q.rank from s left join q on coalesce(s.last, 1) = q.last and s.id = q.id where u >= 0.7 + 0.1),
    g as (select k, span_id, max((coalesce(rank, 6) > k)::int) as p, max(lab) as y from ee, (select unnest([1, 2, 3, 4, 5]) as k) group by all),
    c as (select k, sum((p = 1 and y = 1)::int)::bigint as tp, sum((p = 1 and y <> 1)::int)::bigint as fp, sum((p <> 1 and y = 1)::int)::bigint as fn, count(*) as n from g group by k)
    select k, tp, fp, fn, n, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end as f1 from c"""
)
def app_next_line(spark, d):
    app = OpenSetWorkflow(OpenSetADWorkflowConfig(parse_logline=True, log_parser_config=LogParserConfig("ael"), open_set_partitioner_config=OpenSetPartitionerConfig(5, False)))
    return app.execute(record=record(spark, d), k=5)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return template_frequency(spark, d)
