"""Sessions, entries, instants and grids: against plain Python on the test tables, and edge cases."""

from datetime import datetime, timedelta

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests import brute
from timberline.operators.entries import Layout, compile_layout, find_layouts, log_entries
from timberline.operators.grid import GridSpec, regular_grid
from timberline.operators.instants import days_from_civil, normalise_times, zone_abbreviations
from timberline.operators.sessions import GapTimers, SessionSpec, sessionize
from timberline.plans import training

T0 = datetime(2024, 1, 1)
LOG = "record_id bigint, ts timestamp_ntz, span_id string, logline string"


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def table(d, sql):
    return duckdb.sql(sql.replace("@", d)).fetchall()


def test_p1_found(spark, tiny):
    assert found(training.p1_found(spark, tiny)) == brute.sessions(table(tiny, "select record_id, ts, span_id from '@/log_records.parquet'"))


def test_p2_found(spark, tiny):
    assert found(training.p2_found(spark, tiny)) == brute.entries(table(tiny, "select line_id, file_name, line_no, raw_text from '@/raw_lines.parquet'"))


def test_p3_found(spark, tiny):
    src = {a: (b, c) for a, b, c in table(tiny, "select source_name, zone_name, datetime_format from '@/device_sources.parquet'")}
    assert found(training.p3_found(spark, tiny)) == brute.times(table(tiny, "select row_id, source_name, timestamps, received_at from '@/device_records.parquet'"), src)


def test_p7_found(spark, tiny):
    assert found(training.p7_found(spark, tiny)) == brute.empty_steps(table(tiny, "select action_name, id, ts, counts from '@/counter_readings.parquet'"))


def test_p7_found_merges_readings_and_grid(spark, tiny):
    plan = training.p7_found(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 4  # both sides, in pieces and across them


def minutes(*ms):
    return [T0 + timedelta(minutes=m) for m in ms]


def test_sessions_gap_is_exclusive_and_repeats_count_once(spark):
    a, b, c, e = minutes(0, 30, 60.1, 10)
    rows = [(1, a, "s", "x"), (2, b, "s", "x"), (2, b, "s", "x"), (3, c, "s", "x"), (9, a, " ", "x"), (9, None, "s", "x"), (None, e, "s", "x"), (9, e, None, "x")]
    out = {(r.span_id, r.first_id, r.last_id, r.n_events, r.duration_us) for r in sessionize(spark.createDataFrame(rows, LOG)).collect()}
    assert out == {("s", 1, 2, 2, 1800 * 10**6), ("s", 3, 3, 1, 0)}


def test_sessions_across_slices_and_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        times = [T0 + timedelta(minutes=20 * i) for i in range(200)] + [T0 + timedelta(days=5, minutes=29 * i) for i in range(50)]
        rows = [(i, t, k, None) for k in ("a", "b") for i, t in enumerate(times)]
        df = spark.createDataFrame(rows, LOG).withColumnRenamed("logline", "slice")  # a clashing name
        out = {(r.span_id, r.first_id, r.last_id, r.n_events) for r in sessionize(df, SessionSpec(slice_seconds=3600)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out == {(k, f, l, n) for k in ("a", "b") for f, l, n in ((0, 199, 200), (200, 249, 50))}


def test_sessions_of_nothing(spark):
    assert sessionize(spark.createDataFrame([], LOG)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.integers(0, 5)), max_size=40), st.integers(1, 9))
def test_timers_do_not_depend_on_batches(events, size):
    import numpy as np

    ev = sorted(events)

    def run(step):
        t, out = GapTimers(3), []
        for i in range(0, len(ev), step):
            part = ev[i : i + step]
            out += t.feed(np.array([str(k) for k, _, _ in part], object), np.zeros(len(part), int), np.array([u for _, u, _ in part]), np.array([i for _, _, i in part]))
        return out + t.expire()

    assert [tuple(map(str, r)) for r in run(size)] == [tuple(map(str, r)) for r in run(1000)]


def test_entries_edge_cases(spark):
    lay = [compile_layout("a", "<Date> <Time> - <Component> - <Level> - <Content>", "%Y-%m-%d %H:%M:%S,%f"), compile_layout("b", "<Level>: <Time>; <Component>; <Content>", "%d.%m.%Y %H:%M:%S"), Layout("json", "", (), {"time": "time", "severity": "lvl", "component": "mod", "message": "msg"})]
    h = "2024-01-01 00:00:0{},000 - comp.A - \x1b[31mWARN\x1b[0m - m{}"
    rows = [
        (1, "f", 1, "tail of something"),
        (2, "f", 2, "﻿" + h.format(1, 1)),
        (3, "f", 3, None),
        (4, "f", 4, "> " + h.format(2, 2)),
        (4, "f", 4, "> " + h.format(2, 2)),
        (5, "f", 5, "x" * 200_000),
        (6, "f", 6, '{"time":"t","mod":"k","msg":"hi"}'),
        (7, "f", 7, "{"),
        (8, "f", 8, "info: 01.02.2024 03:04:05; c/D; text"),
        (9, "g", 1, ""),
        (10, None, 1, h.format(3, 3)),
        (11, "g", None, h.format(3, 3)),
    ]
    df = spark.createDataFrame(rows, "line_id bigint, file_name string, line_no bigint, raw_text string")
    out = {(r.first_line_id, r.last_line_id, r.severity_text, r.component, r.n_lines, r.message[:5]) for r in log_entries(df, lay, block_lines=2).collect()}
    times = {r.first_line_id: r.ts for r in log_entries(df, lay).collect()}
    assert times == {2: datetime(2024, 1, 1, 0, 0, 1), 6: None, 8: datetime(2024, 2, 1, 3, 4, 5)}
    assert out == {(2, 5, "WARN", "comp.A", 4, "m1\n\n>"), (6, 7, "", "k", 2, "hi\n{"), (8, 8, "info", "c/D", 1, "text")}
    assert log_entries(df.limit(0), lay).count() == 0


def test_groups_in_a_layout_capture_nothing(spark):
    lay = [compile_layout("g", r"(at|on) <Time> \(<Component>\) <Content>", "%H:%M")]
    df = spark.createDataFrame([(1, "f", 1, "on 10:20 (core) hello")], "line_id bigint, file_name string, line_no bigint, raw_text string")
    assert [(r.time, r.component, r.message) for r in log_entries(df, lay).collect()] == [("10:20", "core", "hello")]


def test_layouts_are_found_in_the_lines(spark):
    known = [compile_layout("a", "<Date> <Time> - <Component> - <Level> - <Content>", "%Y-%m-%d %H:%M:%S,%f")]
    lines = []
    for i in range(30):
        lines += [
            f"2024/01/02 03:04:{i:02d} [WARN] [svc.{i % 3}] disk {i} is full",
            f"<{i}> no layout at all",
            f'{{"at": "2024-01-02T03:04:{i:02d}Z", "sev": "Error", "unit": "db/main{i % 4}", "text": "row {i} lost", "n": {i}}}',
            f"2024-01-02 03:04:05,{i:03d} - known - INFO - line {i}",
            f"    at step {i} 2024/01/02 03:04:05 [WARN] [svc.1] quoted",
            f"2024-01-02 03:04:{i:02d} maintenance window begins",
            f">> 2024/01/02 03:04:{i:02d} [WARN] [svc.1] quoted",
        ]
    df = spark.createDataFrame([(i, "f", i, t) for i, t in enumerate(lines)] + [(900, "f", 900, None), (901, "f", 901, "{")], "line_id bigint, file_name string, line_no bigint, raw_text string")
    found = find_layouts(df, known)
    assert [(x.fields, x.json_keys) for x in found] == [(("time", "severity", "component", "message"), {}), ((), {"time": "at", "severity": "sev", "component": "unit", "message": "text"})]
    out = log_entries(df, [*known, *found]).collect()
    assert len(out) == 90
    assert {(r.severity_text, r.component) for r in out} == {("WARN", "svc.0"), ("WARN", "svc.1"), ("WARN", "svc.2"), ("INFO", "known"), *(("Error", f"db/main{k}") for k in range(4))}
    assert {r.ts for r in out if r.component == "svc.0"} == {datetime(2024, 1, 2, 3, 4, s) for s in range(0, 30, 3)}
    assert sorted((r.first_line_id, r.last_line_id) for r in log_entries(df, [*known, *found], with_message=False, block_lines=5).collect()) == sorted((r.first_line_id, r.last_line_id) for r in out)
    assert find_layouts(df.limit(0), known) == []


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 25), st.booleans()), max_size=30), st.integers(1, 7))
def test_entries_do_not_depend_on_blocks(spark, rows, block):
    lay = [compile_layout("a", "<Time> <Component>: <Content>", "%H:%M")]
    data = [(10 * n + i, f"f{f}", n, "10:00 c: m" if h else f"x{n}") for i, (f, n, h) in enumerate(rows)]
    df = spark.createDataFrame(data, "line_id bigint, file_name string, line_no bigint, raw_text string")
    by = {}
    for i, f, n, t in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        by.setdefault(f, {}).setdefault(n, (i, t))
    want = want_text(by)
    for whole in (False, True):
        got = {(r.first_line_id, r.last_line_id, *([r.message] if whole else [])) for r in log_entries(df, lay, with_message=whole, block_lines=block).collect()}
        assert got == {w if whole else w[:2] for w in want}


def want_text(by):
    out = set()
    for lines in by.values():
        cur = None
        for n in sorted(lines):
            i, t = lines[n]
            if t[0] == "1":
                out |= {(cur[0], cur[1], "\n".join(cur[2]))} if cur else set()
                cur = [i, i, ["m"]]
            elif cur:
                cur = [cur[0], i, [*cur[2], t]]
        out |= {(cur[0], cur[1], "\n".join(cur[2]))} if cur else set()
    return out


def instants(spark, rows, sources):
    r = spark.createDataFrame([(i, s, t, datetime(2024, 6, 1, 12)) for i, (s, t) in enumerate(rows)], "row_id bigint, source_name string, timestamps string, received_at timestamp_ntz")
    s = spark.createDataFrame(sources, "source_name string, zone_name string, datetime_format string")
    got = dict(map(tuple, normalise_times(r, s).collect()))
    return [got.get(i) for i in range(len(rows))]


def us(*a):
    return brute.micros(datetime(*a))


def test_instants_edge_cases(spark):
    src = [("ny", "America/New_York", None), ("de", "Europe/Berlin", "%d/%m/%Y %H:%M"), ("u", None, None), ("bad", "Mars/Base", None), ("odd", None, "%Hh%Mm%S %d~%m~%Y"), ("doy", "Asia/Tokyo", "%Y/%j %H.%M"), ("no", None, "%Q %d"), ("z", None, "%A %d %B %y, %I:%M %p %z")]
    cases = [
        (("ny", "2024-11-03 01:30:00"), us(2024, 11, 3, 5, 30)),  # twice: the first
        (("ny", "2024-11-03 01:30:00 EST"), us(2024, 11, 3, 6, 30)),
        (("ny", "2024-03-10 02:30:00"), us(2024, 3, 10, 7, 30)),  # skipped: offset before
        (("de", "03/02/2024 10:00"), us(2024, 2, 3, 9)),
        (("u", "2024-02-30 10:00:00"), None),
        (("u", "2023-02-29T10:00:00Z"), None),
        (("u", "2024-02-29T23:59:59.9999999Z"), us(2024, 2, 29, 23, 59, 59, 999999)),
        (("u", "Feb 29 00:00:00"), us(2024, 2, 29)),
        (("u", "Jun  1 12:00:00"), us(2024, 6, 1, 12)),
        (("u", "Jun  1 12:00:01"), us(2023, 6, 1, 12, 0, 1)),
        (("u", "1700000000.5"), 1_700_000_000_500_000),
        (("u", "1700000000123456789"), 1_700_000_000_123_456),
        (("u", "20240229235959"), us(2024, 2, 29, 23, 59, 59)),
        (("u", "13/13/2024 10:00"), None),
        (("u", "January 5, 2024 12:00:01 am"), us(2024, 1, 5, 0, 0, 1)),
        (("u", "2024-01-01 10:00:00 XYZ"), None),
        (("bad", "\t2024-01-01 10:00:00 "), us(2024, 1, 1, 10)),
        (("nowhere", "2024-01-01T10:00:00-03:30"), us(2024, 1, 1, 13, 30)),
        (("u", None), None),
        (("u", ""), None),
        (("u", "9" * 100_000), None),
        ((None, "240101 000000"), us(2024, 1, 1)),
        # formats that only the sources declare; their other texts are read by the general notations
        (("odd", "10h20m30 5~6~2024"), us(2024, 6, 5, 10, 20, 30)),
        (("odd", "10h20m30 31~6~2024"), None),
        (("odd", "2024-01-01 10:00:00"), us(2024, 1, 1, 10)),
        (("u", "10h20m30 5~6~2024"), None),
        (("doy", "2024/366 09.30"), us(2024, 12, 31, 0, 30)),
        (("doy", "2023/366 09.30"), None),
        (("no", "2024-01-01 10:00:00"), us(2024, 1, 1, 10)),
        (("z", "Monday 03 June 24, 12:15 am +0230"), us(2024, 6, 2, 21, 45)),
        # words that are no months or days
        (("u", "Marble 5, 2024 10:00:00"), None),
        (("u", "Zzz, 12 Junk 2024 10:00:00"), None),
        (("u", "Zzz, 12 Jun 2024 10:00:00"), None),
        (("u", "Sept. 5, 2023 10:00:00"), us(2023, 9, 5, 10)),
        (("u", "\x0110:00"), None),
    ]
    assert instants(spark, [c for c, _ in cases], src) == [e for _, e in cases]


def test_instants_of_nothing(spark):
    assert instants(spark, [], [("a", None, None)]) == []


def test_abbreviations():
    assert zone_abbreviations("America/New_York") == {"EST": -18000, "EDT": -14400}
    assert zone_abbreviations("Asia/Kathmandu") == {}


@pytest.mark.parametrize("day", [(1, 1, 1), (1600, 2, 29), (1970, 1, 1), (2000, 12, 31), (2024, 2, 29), (9999, 12, 31)])
def test_day_arithmetic(spark, day):
    from pyspark.sql import functions as F

    y, m, d = (F.lit(x).cast("bigint") for x in day)
    assert spark.range(1).select(days_from_civil(y, m, d)).first()[0] == (datetime(*day) - datetime(1970, 1, 1)).days


def test_grid_edge_cases(spark):
    q = lambda n, s=0: T0 + timedelta(minutes=15 * n, seconds=s)
    rows = [("a", 1, q(0), 10), ("a", 1, q(0), 10), ("a", 1, q(2), 30), ("a", 1, q(30), 0), ("a", 1, q(1), -5), ("a", 1, q(1), None), (None, 1, q(1), 5), ("a", None, q(1), 5), ("a", 2, None, 5), ("a", 3, q(7, 1), 4)]
    df = spark.createDataFrame(rows, "action_name string, id bigint, ts timestamp_ntz, counts bigint")
    for steps in (4096, 4):
        got = {(r.action_name, r.id, (r.bucket_start - 1704067200) // 900): (r.n_readings, r.value, r.status) for r in regular_grid(df, GridSpec(span_steps=steps)).collect()}
        assert len(got) == 32
        assert got["a", 1, 0] == (1, 10.0, "observed") and got["a", 1, 1] == (0, 20.0, "interpolated")
        assert got["a", 1, 29] == (0, None, "gap") and got["a", 3, 7] == (1, 4.0, "observed")
    assert regular_grid(df.limit(0)).count() == 0
