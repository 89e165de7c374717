"""Abstract-execution-log template mining (AEL).

Lines are binned by their numbers of tokens and wildcards. A bin with more than `minEventCount` different events is
reconciled: events merge where at most `merge_percent` of their tokens differ, and differing places become wildcards. With
merge_percent >= 1 all events of a bin merge, so that a place of the template is its token if it is the bin's only one: a
minimum and a maximum per bin and place, combined map-side, in SQL throughout. A smaller merge_percent depends on the events' order: their
distinct texts are streamed bin by bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.text import tokens
from timberline.parsing.common import finish, lines_of, mask

WILD = "<*>"


@dataclass(frozen=True)
class AELParams:
    rex: tuple[str, ...] | None = None
    minEventCount: int = 2
    merge_percent: float = 1
    keep_para: bool = True


def ael(df: DataFrame, params: AELParams = AELParams(), row_id: str = "_id", text: str = "logline") -> DataFrame:
    """Row id, logline, parsed_logline, parameter_list, event_id of every line with text.

    Lines that differ in white space only are one event. Blank lines keep an empty template. An empty table gives no rows.
    """
    lines = lines_of(df, row_id, text).withColumn("toks", tokens(mask(F.col("line"), list(params.rex or ()), WILD)))
    lines = lines.withColumn("n", F.size("toks")).withColumn("w", F.size(F.filter("toks", lambda t: t == WILD)))
    events = lines.groupBy("n", "w", "toks").agg(F.min("id").alias("first"))
    if params.merge_percent >= 1:
        size = events.groupBy("n", "w").agg(F.count("*").alias("events"))
        place = lines.select("n", "w", F.posexplode("toks").alias("pos", "tok")).groupBy("n", "w", "pos").agg(F.min("tok").alias("lo"), F.max("tok").alias("hi"))
        place = place.groupBy("n", "w").agg(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit(WILD)).alias("t")))).alias("t"))
        bins = size.where(F.col("events") > params.minEventCount).join(place, ["n", "w"]).select("n", "w", F.array_join(F.transform("t", lambda x: x["t"]), " ").alias("merged"))
        out = lines.join(bins, ["n", "w"], "left").withColumn("template", F.coalesce("merged", F.array_join("toks", " ")))
        return finish(out, row_id, text)
    merged = events.repartition("n", "w").sortWithinPartitions("n", "w", "first").mapInPandas(_reconcile(params), "n int, w int, toks array<string>, template string")
    return finish(lines.join(merged, ["n", "w", "toks"]), row_id, text)


def _reconcile(p: AELParams):
    def merge(events: list[list[str]]) -> list[tuple[list[str], str]]:
        if len(events) <= p.minEventCount:
            return [(e, " ".join(e)) for e in events]
        out, open_ = [], list(events)
        while open_:
            head, rest, group = open_[0], [], [open_[0]]
            template = list(head)
            for e in open_[1:]:
                differ = sum(a != b for a, b in zip(head, e))
                if head and 0 < differ / len(head) <= p.merge_percent:
                    group.append(e)
                    template = [a if a == b else WILD for a, b in zip(template, e)]
                else:
                    rest.append(e)
            out += [(e, " ".join(template)) for e in group]
            open_ = rest
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def close() -> pd.DataFrame:
            return pd.DataFrame([(*key, e, t) for e, t in merge(held)], columns=["n", "w", "toks", "template"])

        for b in batches:
            for n, w, t in zip(b["n"].tolist(), b["w"].tolist(), b["toks"].tolist()):
                if (n, w) != key:
                    if held:
                        yield close()
                    key, held = (n, w), []
                held.append(list(t))
        if held:
            yield close()

    return run
