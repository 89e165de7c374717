"""Streaming forms of counters and sessions. Late rows beyond the watermark are dropped, as Spark's state rules have it."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timberline.functions.timebuckets import width_micros

SESSION = "span_id string, first_id bigint, last_id bigint, start_us bigint, end_us bigint, n_events bigint"
_STATE = "open string"  # JSON: [first us, first id, last us, last id, n] of every open session, in order of time


def _timestamped(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks need a timestamp with zone


def stream_counts(df: DataFrame, width: str, group_by: list[str], ts: str = "timestamp", delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Rows per group and (sliding) time bucket of a stream."""
    dur = lambda a: f"{width_micros(a)} microseconds"
    w = F.window(ts, dur(width), dur(slide)) if slide else F.window(ts, dur(width))
    g = _timestamped(df, ts).withWatermark(ts, delay).groupBy(w.alias("w"), *group_by).agg(F.count("*").alias("counts"))
    return g.select(F.col("w.start").alias(ts), *group_by, "counts")


def join_sessions(open_: list[list], events: list[tuple[int, int]], gap: int) -> list[list]:
    """Open sessions (first us, first id, last us, last id, n; in order, more than a gap apart) with events (us, id), in any order:
    an event extends the session it is within a gap of, joins two that it bridges, or opens one."""
    for us, i in events:
        at = bisect_right(open_, us + gap, key=lambda o: o[0])  # sessions before `at` begin early enough
        new = [us, i, us, i, 1]
        low = at
        while low and open_[low - 1][2] + gap >= us:
            low -= 1
            o = open_[low]
            new = [*min(new[:2], o[:2]), *max(new[2:4], o[2:4]), new[4] + o[4]]
        open_[low:at] = [new]
    return open_


def stream_sessions(df: DataFrame, key: str = "span_id", ts: str = "ts", event_id: str = "record_id", gap_seconds: int = 1800, delay: str = "30 minutes") -> DataFrame:
    """Sessions of a stream by keyed timers: an event extends its key's open session and resets its timer to the event's time
    plus the gap; when the watermark passes the timer, the session is emitted.

    Events may come in any order within the delay: a key keeps all its open sessions, a late event joins those it bridges,
    and nothing is emitted before the watermark rules out further events for it. So the result is that of `sessionize` on all
    rows that aren't later than the delay. Repeated ids within the delay are dropped. Rows with null or blank key,
    null time or id take no part.
    """
    gap = gap_seconds * 1_000_000
    d = _timestamped(df.select(F.col(key).alias("k"), F.col(ts).alias("t"), F.col(event_id).alias("i")), "t")
    d = d.where(F.col("k").rlike(r"\S") & F.col("t").isNotNull() & F.col("i").isNotNull()).withWatermark("t", delay).dropDuplicatesWithinWatermark(["k", "i"])
    d = d.withColumn("us", F.unix_micros("t"))

    def on_events(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = json.loads(state.get[0]) if state.exists else []
        if not state.hasTimedOut:
            for b in batches:
                open_ = join_sessions(open_, sorted(zip(b["us"].tolist(), b["i"].tolist())), gap)
        now = state.getCurrentWatermarkMs() * 1000
        done = [o for o in open_ if o[2] + gap < now]  # events to come are at the watermark or after it
        open_ = open_[len(done) :]
        if open_:
            state.update((json.dumps(open_),))
            state.setTimeoutTimestamp(max((open_[0][2] + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], o[1], o[3], o[0], o[2], o[4]) for o in done], columns=["span_id", "first_id", "last_id", "start_us", "end_us", "n_events"])

    return d.groupBy("k").applyInPandasWithState(on_events, SESSION, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def window_sessions(df: DataFrame, key: str = "span_id", ts: str = "timestamp", gap_seconds: int = 1800, delay: str = "1 hour") -> DataFrame:
    """Sessions by Spark's session window, of a stream or a table; a gap of exactly the limit doesn't end a session."""
    g = _timestamped(df, ts).withWatermark(ts, delay).groupBy(key, F.session_window(ts, f"{gap_seconds} seconds").alias("w")).agg(F.count("*").alias("n_events"), F.max(ts).alias("end_ts"))
    return g.select(key, F.col("w.start").alias("start_ts"), "end_ts", "n_events")
