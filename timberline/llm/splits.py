"""Splits that keep related records together: components, label vectors, grouped iterative stratification (problem 5).

Entities are related if their names differ only in case or surrounding spaces, or if they share a trace; components of this
relation are found by alternating large-star and small-star steps (each is a groupBy-min and a join; the edges are written
to the shared folder after every round, which cuts the lineage). A hub of any size is only ever reduced or joined, never
gathered.

Placing: components with a large share of all rows (there are few: at most 1 / `large_share`) are placed first, one by
one, on the driver, which sees their label vectors only. The rest is spread by hash over blocks of bounded size, and each
block is stratified in a task of its own against its part of what is still needed; a block's error is at most one small
component per split and label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.runtime import cut

#: Ways to write "no trace", without case; likewise text of zeros or of punctuation only.
NO_TRACE = ("n/a", "na", "none", "null", "nil", "nan", "unknown", "undefined", "missing", "empty", "notrace", "no trace", "no-trace", "no_trace")


@dataclass(frozen=True)
class SplitSpec:
    names: tuple[str, ...] = ("train", "dev", "test")
    shares: tuple[float, ...] = (0.8, 0.1, 0.1)
    large_share: float = 0.001
    block_components: int = 4000
    max_rounds: int = 40


def names_a_trace(c: Column) -> Column:
    t = F.lower(F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " ")))
    return c.isNotNull() & t.rlike(r"[\p{L}1-9]") & ~t.isin(*NO_TRACE)


def plain_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(u, v) pairs of strings -> (node, component) for every node that is not its own component's least name."""
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _fingerprint(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # large star: everything above u goes to the least neighbour of u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and everything below it goes to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def entity_components(df: DataFrame, entity: str = "span_id", trace: str = "trace_id", max_rounds: int = 40) -> DataFrame:
    """(entity as written, component) of every entity; null entities take no part, placeholder traces join nothing."""
    pairs = df.where(F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), plain_name(F.col(entity)).alias("name"), F.when(names_a_trace(F.col(trace)), F.col(trace)).alias("trace")).distinct()
    of_trace = pairs.where(F.col("trace").isNotNull()).select("name", "trace").distinct()
    hub = of_trace.groupBy("trace").agg(F.min("name").alias("hub"))
    edges = of_trace.join(hub, "trace").select(F.col("name").alias("u"), F.col("hub").alias("v"))
    cc = connected_components(edges, max_rounds).withColumnRenamed("node", "name")
    return pairs.select("entity", "name").distinct().join(cc, "name", "left").select("entity", F.coalesce("component", "name").alias("component"))


def span_classes(df: DataFrame, entity: str = "span_id", trace: str = "trace_id") -> DataFrame:
    """span_id (as written) and class_id, the least of the spans that belong together: one row per span, however many are related."""
    c = entity_components(df, entity, trace)
    least = c.groupBy("component").agg(F.min("entity").alias("class_id"))
    return c.join(least, "component").select(F.col("entity").alias("span_id"), "class_id")


def related_pairs(df: DataFrame, entity: str = "span_id", trace: str = "trace_id") -> DataFrame:
    """Every pair of different entities, as written, of one component: span_a < span_b in byte order."""
    c = entity_components(df, entity, trace)
    a, b = c.select("component", F.col("entity").alias("span_a")), c.select("component", F.col("entity").alias("span_b"))
    return a.join(b, "component").where("span_a < span_b").select("span_a", "span_b")


def place(vectors: np.ndarray, need: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Iterative stratification of groups. vectors: rows by group and label; need: rows still wanted by split and label.

    The label with the fewest rows outstanding comes first; its groups, those with most of it first, go each to the split
    that needs this label most (ties: needs most rows, then the first split). `order` breaks ties between groups.
    """
    out = np.full(len(vectors), -1)
    need, left = need.astype(float).copy(), vectors.sum(axis=0).astype(float)
    for _ in range(vectors.shape[1]):
        open_labels = [j for j in range(vectors.shape[1]) if left[j] > 0]
        if not open_labels:
            break
        j = min(open_labels, key=lambda j: (left[j], j))
        mine = np.flatnonzero((out < 0) & (vectors[:, j] > 0))
        for g in mine[np.lexsort((order[mine], -vectors[mine].sum(axis=1), -vectors[mine, j]))]:
            total = need.sum(axis=1)
            s = max(range(len(need)), key=lambda s: (need[s, j], total[s], -s))
            out[g] = s
            need[s] -= vectors[g]
        left = vectors[out < 0].sum(axis=0).astype(float)
    out[out < 0] = 0
    return out


def _joined(rows: DataFrame, small: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """rows joined with a table of one row per key: keys with more than a share of all rows (fewer than 1 / share keys) by broadcast,
    so that a hot key's rows stay where they are; the others by a shuffle."""
    n = rows.groupBy(key).agg(F.count("*").alias("__n"))
    bar = share * rows.count()
    hot = F.broadcast(cut(small.join(n.where(F.col("__n") > bar).select(key), key)))
    cold = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(small, key))


def stratified_split(df: DataFrame, record_id: str = "seq_id", entity: str = "span_id", trace: str = "trace_id", label: str = "labels", spec: SplitSpec = SplitSpec()) -> DataFrame:
    """One row per record: seq_id, component, new_split, so that no component is divided and shares and labels are alike.

    A record with null entity is a component of its own. Null labels are a stratum of their own, as is every other value
    than 0 and 1 together. Repeated ids give a row each. An empty table gives no rows.
    """
    comp = entity_components(df, entity, trace, spec.max_rounds)
    lab = F.when(F.col(label).isNull(), 2).when(F.col(label) == 1, 1).when(F.col(label) == 0, 0).otherwise(3)
    r = df.select(F.col(record_id).alias("seq_id"), F.col(entity).alias("entity"), lab.alias("lab"))
    named = _joined(r.where(F.col("entity").isNotNull()), comp, "entity").withColumn("component", F.concat(F.lit("e:"), F.col("component")))
    own = r.where(F.col("entity").isNull()).withColumn("component", F.concat(F.lit("r:"), F.coalesce(F.col("seq_id").cast("string"), F.lit(""))))
    r = cut(named.select("seq_id", "component", "lab").unionByName(own.select("seq_id", "component", "lab")))
    vec = cut(r.groupBy("component").agg(*[F.sum((F.col("lab") == j).cast("bigint")).alias(f"l{j}") for j in range(4)]).withColumn("n", sum((F.col(f"l{j}") for j in range(1, 4)), F.col("l0"))))
    labels, k = [f"l{j}" for j in range(4)], len(spec.names)
    tot = vec.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in labels], F.count("*").alias("groups")).first()
    total = np.array([tot[c] for c in labels], float)
    need = np.outer(spec.shares, total)
    floor = max(1.0, spec.large_share * total.sum())
    large = vec.where(F.col("n") > floor).orderBy(F.col("n").desc(), "component").toPandas()  # fewer than 1 / large_share rows
    v = large[labels].to_numpy(float).reshape(-1, 4)
    placed = place(v, need, np.arange(len(v)))
    for s in range(k):
        need[s] -= v[placed == s].sum(axis=0)
    rest = np.maximum(total - v.sum(axis=0), 0)
    # what each split still needs, as a share of the rows that are left
    part = np.maximum(need, 0) / np.maximum(np.maximum(need, 0).sum(axis=0), 1e-9)
    part[:, rest == 0] = np.array(spec.shares)[:, None]
    blocks = max(1, -(-int(tot["groups"]) // spec.block_components))

    def stratify(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[labels].to_numpy(float)
        seed = pdf["component"].rank(method="first").to_numpy()
        return pd.DataFrame({"component": pdf["component"], "s": place(x, part * x.sum(axis=0), seed)})

    small = vec.where(F.col("n") <= floor).withColumn("block", F.pmod(F.xxhash64("component"), F.lit(blocks)))
    small = small.groupBy("block").applyInPandas(stratify, "component string, s int")
    fixed = df.sparkSession.createDataFrame(pd.DataFrame({"component": large["component"].astype(str), "s": placed.astype("int32")}), "component string, s int")
    names = F.array(*[F.lit(x) for x in spec.names])
    # rows of large components meet a broadcast of fewer than 1 / large_share rows; no other component has more than that share
    placed = r.join(F.broadcast(fixed.withColumnRenamed("s", "s0")), "component", "left")
    rest_of = placed.where(F.col("s0").isNull()).drop("s0").join(small, "component")
    return placed.where(F.col("s0").isNotNull()).withColumnRenamed("s0", "s").unionByName(rest_of).select("seq_id", "component", F.get(names, F.col("s")).alias("new_split"))


def split_report(df: DataFrame, assigned: DataFrame, record_id: str = "seq_id", label: str = "labels") -> DataFrame:
    """Per new split: rows, share of rows, share of rows with label 1 among those with a label."""
    j = df.select(F.col(record_id).alias("seq_id"), F.col(label).alias("lab")).join(assigned, "seq_id")
    g = j.groupBy("new_split").agg(F.count("*").alias("n_rows"), F.count_distinct("component").alias("n_components"), F.sum((F.col("lab") == 1).cast("int")).alias("n_positive"), F.count("lab").alias("n_labelled"))
    all_rows = F.sum("n_rows").over(Window.partitionBy())  # over one row per split
    return g.select("new_split", "n_rows", "n_components", "n_positive", F.round(F.col("n_rows") / all_rows, 6).alias("share"), F.round(F.col("n_positive") / F.col("n_labelled"), 6).alias("positive_share"))
