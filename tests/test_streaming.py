"""Streams against their batch forms."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from timberline.functions.timebuckets import bucket_start
from timberline.operators.sessions import sessionize
from timberline.streaming.sessions import join_sessions, stream_counts, stream_sessions, window_sessions
from timberline.streaming.templates import OnlineTemplates

T0 = datetime(2024, 1, 1)
SCHEMA = "record_id bigint, ts timestamp_ntz, span_id string, logline string"


def write_batches(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")


def run(spark, df, name, path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/ck_{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def at(m):
    return T0 + timedelta(minutes=m)


def batches():
    rows = [(i, at(m), k, f"line {i}") for i, (m, k) in enumerate([(0, "a"), (10, "a"), (5, "b"), (50, "a"), (55, "a"), (100, "b"), (101, "b")])]
    return [[*rows[:3], rows[1]], [*rows[3:], (90, None, "a", "x"), (91, at(3), " ", "x")], [(99, at(5000), "end", "x")], [(100, at(9000), "end2", "x")]]


def test_timers_emit_what_the_batch_finds(spark, tmp_path):
    write_batches(spark, tmp_path, batches())
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {tuple(r) for r in run(spark, stream_sessions(src), "timers", tmp_path).select("span_id", "first_id", "last_id", "n_events").collect()}
    want = {(r.span_id, r.first_id, r.last_id, r.n_events) for r in sessionize(spark.read.parquet(f"{tmp_path}/in")).collect()}
    assert got >= {w for w in want if not w[0].startswith("end")} and got <= want


def test_counts_and_session_windows(spark, tmp_path):
    write_batches(spark, tmp_path, batches())
    src = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in").withColumnRenamed("ts", "timestamp")
    got = {tuple(r) for r in run(spark, stream_counts(src, "15min", ["span_id"]), "counts", tmp_path, "complete").select(F.unix_seconds("timestamp"), "span_id", "counts").collect()}
    b = spark.read.parquet(f"{tmp_path}/in").where("ts is not null").groupBy(bucket_start(F.col("ts"), "15min").alias("t"), "span_id").count()
    assert got == {tuple(r) for r in b.select(F.unix_seconds(F.col("t").cast("timestamp")), "span_id", "count").collect()}
    assert run(spark, window_sessions(src), "gaps", tmp_path).where("span_id = 'a'").count() == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_timers_under_disorder(spark, tmp_path, seed):
    """Shuffled micro-batches within the delay give the sessions of the table."""
    rng = random.Random(seed)
    rows = sorted(((i, at(m), k, "x") for i, (m, k) in enumerate((rng.randrange(600), rng.choice("abc")) for _ in range(120))), key=lambda r: r[1])
    order = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.randrange(170)))
    parts = [order[i : i + 17] for i in range(0, len(order), 17)]
    for p in parts:
        rng.shuffle(p)
    write_batches(spark, tmp_path, [*parts, [(999, at(5000), "end", "x")], [(1000, at(9000), "end2", "x")]])
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = [tuple(r) for r in run(spark, stream_sessions(src, delay="3 hours"), f"disorder{seed}", tmp_path).where("span_id not like 'end%'").select("span_id", "first_id", "last_id", "n_events").collect()]
    want = {(r.span_id, r.first_id, r.last_id, r.n_events) for r in sessionize(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_events_that_bridge_sessions():
    gap = 30
    assert join_sessions([], [(0, 1), (40, 2), (20, 3)], gap) == [[0, 1, 40, 2, 3]]
    assert join_sessions([[0, 1, 0, 1, 1], [61, 2, 61, 2, 1]], [(30, 3)], gap) == [[0, 1, 30, 3, 2], [61, 2, 61, 2, 1]]
    assert join_sessions([[50, 1, 60, 2, 2]], [(10, 3), (20, 9)], gap) == [[10, 3, 60, 2, 4]]


def test_online_templates_and_restart(spark, tmp_path):
    lines = [["open door 1", "open door 2"], ["open door 3", None, "close all"], ["open gate 4", "close all"]]
    write_batches(spark, tmp_path, [[(10 * i + j, at(i), "a", t) for j, t in enumerate(b)] for i, b in enumerate(lines[:2])])
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    OnlineTemplates(f"{tmp_path}/t").start(src, f"{tmp_path}/ck", row_id="record_id").awaitTermination(120)
    write_batches(spark, tmp_path, [[(20 + j, at(2), "a", t) for j, t in enumerate(lines[2])]])
    again = OnlineTemplates(f"{tmp_path}/t")  # another driver
    again.start(src, f"{tmp_path}/ck", row_id="record_id").awaitTermination(120)
    got = {(r.template, r.size) for r in again.templates(spark).collect()}
    assert got == {("open door *", 3), ("open gate 4", 1), ("close all", 2)}
    last = again._batches(spark)[-1]
    again.feed(spark.createDataFrame([(20, at(2), "a", "open gate 4"), (21, at(2), "a", "close all")], SCHEMA), last, row_id="record_id")
    assert {(r.template, r.size) for r in again.templates(spark).collect()} == got  # a batch that is run again
    assert OnlineTemplates(f"{tmp_path}/none").templates(spark) is None
