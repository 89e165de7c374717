"""Sessions separated by inactivity, by keyed timers over ordered events (problem 1).

The state machine is the one of a streaming job: each key holds at most one open session and one timer. An event
that comes before its key's timer fires extends the session and resets the timer to `event time + gap`; when the timer
fires, the session is final and emitted. `GapTimers` runs it over a finite table replayed in event order
(`sessionize`); `streaming.sessions.stream_sessions` runs the same rules on an unbounded stream with Spark's state store.

Scale: a key is cut into time slices, so that a hot key (a third of all rows, say) is replayed by many tasks. A task
streams over its sorted partition in Arrow batches and holds one open session. Only the first and last session of a
slice can continue in a neighbouring slice; these edges (at most two a slice, whatever the number of events) are joined
by a window over the key. Repeated deliveries sort next to each other and are dropped on the way: no shuffle of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.stitching import stitch

MICROS = 1_000_000


@dataclass(frozen=True)
class SessionSpec:
    key: str = "span_id"
    ts: str = "ts"
    event_id: str = "record_id"
    gap_seconds: int = 1800
    slice_seconds: int = 6 * 3600


class GapTimers:
    """Keyed inactivity timers over batches sorted by key, slice, time and event id.

    `feed` takes the next batch and returns the sessions whose timers fired; `expire` ends the input. The one open
    session (of the key and slice seen last) is carried from batch to batch.
    """

    COLUMNS = ("key", "slice", "first_id", "last_id", "start_us", "end_us", "n", "at_head", "at_tail")

    def __init__(self, gap_us: int):
        self.gap_us = gap_us
        self.open: list | None = None  # key, slice, first_id, last_id, start, end, n, at_head

    def feed(self, key: np.ndarray, slc: np.ndarray, ts: np.ndarray, ids: np.ndarray) -> list[tuple]:
        if not len(ts):
            return []
        out: list[tuple] = []
        same = np.empty(len(ts), bool)  # same key and slice as the event before
        same[1:] = (slc[1:] == slc[:-1]) & (key[1:] == key[:-1])
        fires = np.empty(len(ts), bool)  # the key's timer, set to the last event plus the gap, fires before this event
        fires[1:] = ts[1:] > ts[:-1] + self.gap_us
        repeat = np.zeros(len(ts), bool)
        repeat[1:] = same[1:] & (ids[1:] == ids[:-1]) & (ts[1:] == ts[:-1])
        o = self.open
        same[0] = o is not None and o[0] == key[0] and o[1] == slc[0]
        fires[0] = same[0] and ts[0] > o[5] + self.gap_us
        repeat[0] = same[0] and ids[0] == o[3] and ts[0] == o[5]
        begins = ~same | fires
        counts = np.add.reduceat(~repeat, np.flatnonzero(begins)) if begins.any() else np.zeros(0, int)
        at = np.flatnonzero(begins)
        upto = at[0] if len(at) else len(ts)
        if upto:  # updates of the open session
            o[3], o[5], o[6] = ids[upto - 1], ts[upto - 1], o[6] + int((~repeat[:upto]).sum())
        ends = np.append(at[1:], len(ts)) - 1
        for i, e, n in zip(at.tolist(), ends.tolist(), counts.tolist()):
            if self.open is not None:
                out.append((*self.open, not same[i]))
            self.open = [key[i], slc[i], ids[i], ids[e], ts[i], ts[e], n, not same[i]]
        return out

    def expire(self) -> list[tuple]:
        out = [(*self.open, True)] if self.open is not None else []
        self.open = None
        return out


def _replay(gap_us: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        timers = GapTimers(gap_us)
        for b in batches:
            yield _frame(timers.feed(*(b[c].to_numpy() for c in ("k", "slice", "us", "id"))))
        yield _frame(timers.expire())

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(GapTimers.COLUMNS))


def _names_something(c: Column) -> Column:
    return c.isNotNull() & c.rlike(r"\S")


def sessionize(df: DataFrame, spec: SessionSpec = SessionSpec()) -> DataFrame:
    """One row per session: key, first_id, last_id, start_ts, end_ts, duration_us, n_events.

    Events are ordered by time, then event id. A session ends where more than `gap_seconds` pass; exactly the gap does
    not end it. Repeated rows (same key, time and event id) count once. Events with null or blank key or null time
    or event id take no part; an empty table gives no sessions. The key column keeps its name; other columns of `df`
    are not read, so their names can't clash.
    """
    e = df.select(F.col(spec.key).cast("string").alias("k"), F.unix_micros(F.col(spec.ts).cast("timestamp")).alias("us"), F.col(spec.event_id).cast("bigint").alias("id"))
    e = e.where(_names_something(F.col("k")) & F.col("us").isNotNull() & F.col("id").isNotNull())
    e = e.withColumn("slice", F.floor(F.col("us") / F.lit(spec.slice_seconds * MICROS)).cast("bigint"))
    parts = (
        e.repartition("k", "slice")
        .sortWithinPartitions("k", "slice", "us", "id")
        .mapInPandas(_replay(spec.gap_seconds * MICROS), "key string, slice bigint, first_id bigint, last_id bigint, start_us bigint, end_us bigint, n bigint, at_head boolean, at_tail boolean")
    )
    return _named(_stitch(parts, spec.gap_seconds * MICROS), spec)


def _stitch(parts: DataFrame, gap_us: int) -> DataFrame:
    """Join sessions that go on across slices."""
    at = F.struct("start_us", "slice")
    aggs = [F.min_by("first_id", at).alias("first_id"), F.max_by("last_id", at).alias("last_id"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n")]
    return stitch(parts, ("start_us", "slice"), lambda lag: F.col("start_us") - lag("end_us") <= gap_us, aggs)


def _named(s: DataFrame, spec: SessionSpec) -> DataFrame:
    return s.select(
        F.col("key").alias(spec.key),
        "first_id",
        "last_id",
        F.timestamp_micros("start_us").cast("timestamp_ntz").alias("start_ts"),
        F.timestamp_micros("end_us").cast("timestamp_ntz").alias("end_ts"),
        (F.col("end_us") - F.col("start_us")).alias("duration_us"),
        F.col("n").alias("n_events"),
    )
