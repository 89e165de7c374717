"""Queries of the corpus problems (4, 5, 6, 8, 9, 10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.mixing import mix
from timberline.llm.overlap import coverage, cross_split_pairs, overlap_classes, overlap_report
from timberline.llm.repetition import repetition
from timberline.llm.runs import RunSpec, collapse_runs
from timberline.llm.splits import related_pairs, span_classes, split_report, stratified_split
from timberline.llm.tokens import encode_corpus
from timberline.runtime import read


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_pairs(read(spark, d, "log_sequences")).select("seq_a", "seq_b")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(read(spark, d, "log_sequences"))


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage(read(spark, d, "log_sequences"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return overlap_classes(read(spark, d, "log_sequences"))[0]


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    return overlap_classes(read(spark, d, "log_sequences"))[1]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return related_pairs(read(spark, d, "log_sequences"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Spans with their class, named after its least span: what p5_found lists as pairs."""
    return span_classes(read(spark, d, "log_sequences"))


def p5_split(spark: SparkSession, d: str) -> DataFrame:
    return stratified_split(read(spark, d, "log_sequences"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "log_sequences")
    return split_report(df, stratified_split(df))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    r = collapse_runs(read(spark, d, "log_records"), min_events=3)
    return r.select("span_id", F.col("first_id").alias("first_record_id"), F.col("last_id").alias("last_record_id"))


def p6_runs(spark: SparkSession, d: str) -> DataFrame:
    return collapse_runs(read(spark, d, "log_records"))


def p6_near(spark: SparkSession, d: str) -> DataFrame:
    """Runs of nearly the same message: those of least cost over each span."""
    return collapse_runs(read(spark, d, "log_records"), RunSpec(near=True))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(read(spark, d, "documents"))


def p9_sample(spark: SparkSession, d: str) -> DataFrame:
    return mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition(read(spark, d, "documents"), shares=False).where("is_repetitive").select("doc_id")


def p10_repetition(spark: SparkSession, d: str) -> DataFrame:
    return repetition(read(spark, d, "documents")).select("doc_id", "n_words", "n_repeated", "share")


QUERIES = {f.__name__: f for f in (p4_found, p4_report, p4_coverage, p4_classes, p4_members, p5_found, p5_classes, p5_split, p5_report, p6_found, p6_runs, p6_near, p8_ids, p9_sample, p9_shares, p10_found, p10_repetition)}

_RUNS = r"""
    with e as (select distinct span_id, ts, record_id, logline from log_records where regexp_matches(span_id, '\S') and ts is not null and record_id is not null and logline is not null),
    m as (select *, regexp_replace(rtrim(regexp_replace(trim(regexp_replace(lower(logline), '[\s\p{Z}]+', ' ', 'g')), '\.$', '')), '[^ ]*\p{Nd}[^ ]*', '0', 'g') as says from e),
    f as (select *, case when says = lag(says) over w then 0 else 1 end as fresh from m window w as (partition by span_id order by ts, record_id)),
    g as (select *, sum(fresh) over (partition by span_id order by ts, record_id) as n from f)"""

_REPEATED = r"""
        with w as (select doc_id, regexp_extract_all(lower(text), '\p{L}+') as ws, len(regexp_extract_all(lower(text), '[\p{Hiragana}\p{Katakana}\p{Han}ー]')) as cjk from documents where text is not null),
        c as (select doc_id, ws, 2 * cjk > length(array_to_string(ws, '')) as single from w where len(ws) > 0),
        v as (select doc_id, case when single then string_split(array_to_string(ws, ''), '') else ws end as ws, case when single then 12 else 6 end as k from c),
        g as (select doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') as g from (select *, unnest(range(1, len(ws) - k + 2)) as i from v)),
        a as (select doc_id, k, i from (select *, row_number() over (partition by doc_id, g order by i) as n from g) where n > 1),
        r as (select doc_id, count(distinct p) as r from (select doc_id, unnest(range(i, i + k)) as p from a) group by doc_id)"""

_SPANS = r"""
        with recursive p as (select distinct span_id, lower(trim(span_id)) as name, case when regexp_matches(trace_id, '[\p{L}1-9]') and lower(trim(trace_id)) not in ('n/a', 'na', 'none', 'null', 'nil', 'nan', 'unknown', 'undefined', 'missing', 'empty', 'notrace', 'no trace', 'no-trace', 'no_trace') then trace_id end as t
            from log_sequences where span_id is not null),
        l as (select distinct a.name as x, b.name as y from p a join p b on a.t = b.t),
        r as (select distinct name as x, name as y from p union select r.x, l.y from r join l on r.y = l.x),
        c as (select x, min(y) as c from r group by x),
        s as (select distinct span_id, c from p join c on p.name = c.x)"""

ORACLE = {
    "p6_found": _RUNS + " select span_id, arg_min(record_id, (ts, record_id)) as first_record_id, arg_max(record_id, (ts, record_id)) as last_record_id from g group by span_id, n having count(*) >= 3",
    "p6_runs": _RUNS
    + """ select span_id, arg_min(record_id, (ts, record_id)) as first_id, arg_max(record_id, (ts, record_id)) as last_id, min(ts) as start_ts, max(ts) as end_ts,
        epoch_us(max(ts)) - epoch_us(min(ts)) as duration_us, count(*) as n_events from g group by span_id, n""",
    "p10_found": _REPEATED + " select doc_id from r join v using (doc_id) where 10 * r >= 3 * len(ws)",
    "p4_coverage": r"""
        with m as (select distinct seq_id, split_name, list_filter(regexp_split_to_array(lower(logline), '\s+'), lambda w: w <> '') as w from log_sequences where seq_id is not null and logline is not null and split_name in ('train', 'dev', 'test')),
        g as (select seq_id, split_name, i, array_to_string(w[i : i + 7], ' ') as g from (select *, unnest(range(1, len(w) - 6)) as i from m)),
        t as (select distinct g from g where split_name = 'train'),
        c as (select seq_id, split_name, count(distinct p) as c from (select g.seq_id, g.split_name, unnest(range(i, i + 8)) as p from g join t using (g) where g.split_name <> 'train') group by all)
        select seq_id, split_name, len(w) as n_words, coalesce(c, 0) as covered_words, case when len(w) > 0 then coalesce(c, 0) / len(w) else 0.0 end as share from m left join c using (seq_id, split_name) where split_name <> 'train'""",
    "p10_repetition": _REPEATED + " select documents.doc_id, coalesce(len(ws), 0) as n_words, coalesce(r, 0) as n_repeated, coalesce(r, 0) / greatest(coalesce(len(ws), 0), 1) as share from documents left join v using (doc_id) left join r using (doc_id)",
    "p5_classes": _SPANS + " select distinct span_id, min(span_id) over (partition by c) as class_id from s",
    "p5_found": _SPANS + " select a.span_id as span_a, b.span_id as span_b from s a join s b on a.c = b.c and a.span_id < b.span_id",
}
