"""Runs of the same or nearly the same event, by pruned dynamic programming (problem 6).

The events of an entity, in order, are cut into runs so that `weight * dissimilarity within runs + number of runs` is
least; a run's dissimilarity is that of its events to the run's best representative. The programme keeps, at each
event, the cheapest cost so far and the starts that can still be best (a start whose cost has reached the best cost can never
win again, since costs only add up over longer runs: the pruning rule), usually two of them.

With 0/1 dissimilarity and weight > 2 the optimum is exactly the maximal runs of equal messages: a run with m events that
differ from its representative splits into at most 2m + 1 uniform runs, which costs at most 2m more and saves weight * m.

Scale: with 0/1 dissimilarity an entity is cut into time slices replayed by different tasks, and runs at the edges of slices are
joined over the entity if they say the same: maximal runs don't depend on where they are cut. The optimum of graded dissimilarity
does, so there (`near`) an entity is one sequence, streamed through one task. Settled runs are emitted at once; a candidate
holds counts of the distinct messages since its start, not the events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.stitching import stitch

MICROS = 1_000_000


@dataclass(frozen=True)
class RunSpec:
    key: str = "span_id"
    ts: str = "ts"
    event_id: str = "record_id"
    message: str = "logline"
    weight: float = 3.0
    near: bool = False  # dissimilarity as the share of differing words instead of 0/1
    slice_seconds: int = 6 * 3600  # without effect on the result


def message_key(c: Column) -> Column:
    """What a message says: its words in lower case, without a closing full stop, words with a digit all the same."""
    c = F.trim(F.regexp_replace(F.lower(c), r"[\s\p{Z}]+", " "))
    c = F.rtrim(F.regexp_replace(c, r"\.$", ""))
    return F.regexp_replace(c, r"[^ ]*\p{Nd}[^ ]*", "0")


def word_distance(a: str, b: str) -> float:
    """Share of places where two messages differ, of the longer one's words."""
    if a == b:
        return 0.0
    x, y = a.split(" "), b.split(" ")
    return 1 - sum(p == q for p, q in zip(x, y)) / max(len(x), len(y))


class PrunedSegmentation:
    """Optimal runs of one entity's events, fed one by one; `settled` runs are returned as soon as they are certain."""

    def __init__(self, weight: float, distance: Callable | None):
        self.weight, self.distance = weight, distance
        self.reset()

    def reset(self) -> None:
        self.events: list[tuple] = []  # (message, id, us) from position `base` on
        self.base = self.t = 0
        self.best = {0: 0.0}  # cost of the first s events, for starts still in use
        self.came: dict[int, int] = {}  # start of the last run of the best segmentation of the first t events
        self.starts: list[list] = []  # start, n, events by message (representatives), their costs
        self.far: dict[tuple, float] = {}  # distances between messages since the last settled run

    def _far(self, a, b) -> float:
        if (d := self.far.get((a, b))) is None:
            d = self.far[a, b] = self.far[b, a] = self.distance(a, b)
        return d

    def push(self, message, event_id: int, us: int) -> list[tuple]:
        self.events.append((message, event_id, us))
        self.starts.append([self.t, 0, {}, {}])
        self.t += 1
        w, low, arg = self.weight, None, 0
        costs = []
        for s in self.starts:
            seen, reps = s[2], s[3]
            s[1] += 1
            if self.distance is None:  # 0/1: a representative's cost is the number of the other events
                seen[message] = seen.get(message, 0) + 1
                c = w * (s[1] - max(seen.values())) if len(seen) > 1 else 0.0
            else:
                if message not in reps:
                    reps[message] = sum(k * self._far(m, message) for m, k in seen.items())
                for r in reps:
                    if r != message:
                        reps[r] += self._far(message, r)
                seen[message] = seen.get(message, 0) + 1
                c = w * min(reps.values())
            c += self.best[s[0]]
            costs.append(c)
            if low is None or c < low:
                low, arg = c, s[0]
        total = low + 1.0
        self.best[self.t], self.came[self.t] = total, arg
        keep = []
        for s, c in zip(self.starts, costs):
            if c < total:
                keep.append(s)
            elif s[0] != arg:
                self.best.pop(s[0], None)
        self.starts = keep
        # settled: the two remaining starts (the next event's included) share all runs before the older one
        if len(keep) == 1 and keep[0][0] > self.base and self.came[self.t] == keep[0][0]:
            return self._emit(keep[0][0])
        return []

    def _emit(self, upto: int) -> list[tuple]:
        cuts, t = [], upto
        while t > self.base:
            cuts.append((self.came[t], t))
            t = self.came[t]
        out = []
        for a, b in reversed(cuts):
            run = self.events[a - self.base : b - self.base]
            out.append((self._says(run), run[0][1], run[-1][1], len(run), run[0][2], run[-1][2]))
        self.events = self.events[upto - self.base :]
        self.base = upto
        self.came = {t: s for t, s in self.came.items() if t > upto}
        self.best = {s: c for s, c in self.best.items() if s >= upto}
        self.far = {}
        return out

    def _says(self, run: list[tuple]):
        if self.distance is None or all(r[0] == run[0][0] for r in run):
            counts: dict = {}
            for m, _, _ in run:
                counts[m] = counts.get(m, 0) + 1
            return max(counts, key=counts.get)
        counts = {}
        for m, _, _ in run:
            counts[m] = counts.get(m, 0) + 1
        return min(counts, key=lambda m: (sum(k * self._far(m, x) for x, k in counts.items()), m))

    def finish(self) -> list[tuple]:
        out = self._emit(self.t) if self.t > self.base else []
        self.reset()
        return out


SCHEMA = "key string, slice bigint, says {says}, first_id bigint, last_id bigint, n bigint, start_us bigint, end_us bigint, at_head boolean, at_tail boolean"


def _segment(weight: float, near: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg = PrunedSegmentation(weight, word_distance if near else None)
        key = slc = last = held = None
        head = True
        for b in batches:
            out = []
            for k, s, us, i, m in zip(b["k"].tolist(), b["slice"].tolist(), b["us"].tolist(), b["id"].tolist(), b["says"].tolist()):
                if s != slc or k != key:
                    for r in seg.finish():
                        if held:
                            out.append((*held, False))
                        held, head = (key, slc, *r, head), False
                    if held:
                        out.append((*held, True))
                    key, slc, last, held, head = k, s, None, None, True
                if (us, i) == last:
                    continue  # delivered again
                last = (us, i)
                for r in seg.push(m, i, us):
                    if held:
                        out.append((*held, False))
                    held, head = (key, slc, *r, head), False
            yield _frame(out)
        out = []
        for r in seg.finish():
            if held:
                out.append((*held, False))
            held, head = (key, slc, *r, head), False
        yield _frame([*out, (*held, True)] if held else out)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "slice", "says", "first_id", "last_id", "n", "start_us", "end_us", "at_head", "at_tail"])


def collapse_runs(df: DataFrame, spec: RunSpec = RunSpec(), min_events: int = 1) -> DataFrame:
    """One row per run: key, first_id, last_id, start_ts, end_ts, duration_us, n_events; runs of at least `min_events`.

    Events are ordered by time, then event id; a repeated row (same key, time and id) counts once. Rows with null or blank
    key, null time, id or message take no part and interrupt no run; an empty message is a message. With `near` false the runs
    are the longest stretches of equal messages (see message_key); with `near` true those of least cost over the key's whole
    sequence (of several, what the programme finds first). An empty table gives no rows; other columns aren't read.
    """
    e = df.select(
        F.col(spec.key).cast("string").alias("k"),
        F.unix_micros(F.col(spec.ts).cast("timestamp")).alias("us"),
        F.col(spec.event_id).cast("bigint").alias("id"),
        F.col(spec.message).cast("string").alias("m"),
    )
    e = e.where(F.col("k").rlike(r"\S") & F.col("us").isNotNull() & F.col("id").isNotNull() & F.col("m").isNotNull())
    says = message_key(F.col("m"))
    piece = F.lit(0) if spec.near else F.floor(F.col("us") / F.lit(spec.slice_seconds * MICROS))
    e = e.select("k", piece.cast("bigint").alias("slice"), "us", "id", (says if spec.near else F.xxhash64(says)).alias("says"))
    runs = e.repartition("k", "slice").sortWithinPartitions("k", "slice", "us", "id").mapInPandas(_segment(spec.weight, spec.near), SCHEMA.format(says="string" if spec.near else "bigint"))
    at = F.struct("slice", "start_us")
    aggs = [F.min_by("first_id", at).alias("first_id"), F.max_by("last_id", at).alias("last_id"), F.sum("n").alias("n"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")]
    # the last run of a slice goes on in the first of the key's next slice if it says the same
    goes_on = lambda lag: (lag("slice") < F.col("slice")) & F.col("at_head") & lag("at_tail") & (lag("says") == F.col("says"))
    out = stitch(runs, ("slice", "start_us", "at_tail"), goes_on, aggs).where(F.col("n") >= min_events)
    return out.select(
        F.col("key").alias(spec.key),
        "first_id",
        "last_id",
        F.timestamp_micros("start_us").cast("timestamp_ntz").alias("start_ts"),
        F.timestamp_micros("end_us").cast("timestamp_ntz").alias("end_ts"),
        (F.col("end_us") - F.col("start_us")).alias("duration_us"),
        F.col("n").alias("n_events"),
    )
