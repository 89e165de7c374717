"""Prefix-tree template mining (Drain), replayed per token count.

The tree's first level is the number of tokens and nothing below crosses it, so token counts are independent and each is
replayed in row order: exactly the sequential result. A task streams over its sorted partition and holds the templates of
one token count, not its lines; a line that has been seen since its leaf last changed is looked up, which most lines are. The
lines then meet the final templates in a second pass, which splits the lines of a token count over many tasks (each gets
that count's templates). Templates are a table: they can be kept, grown by further lines, and matched to lines they never saw.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.text import tokens
from timberline.parsing.common import finish, lines_of
from timberline.runtime import cut


@dataclass(frozen=True)
class DrainParams:
    depth: int = 3
    sim_th: float = 0.4
    max_children: int = 100
    max_clusters: int | None = None
    extra_delimiters: tuple[str, ...] = ()
    param_str: str = "*"

    def __post_init__(self):
        if self.depth < 3:
            raise ValueError("depth must be at least 3")


@dataclass
class Cluster:
    number: int
    template: list[str]
    size: int = 1
    used: int = 0


class Node:
    """A node of the tree. A leaf holds its clusters' templates as rows of token hashes, so that a line meets all of them in
    one array comparison."""

    def __init__(self):
        self.children: dict[str, Node] = {}
        self.clusters: list[Cluster] = []
        self.rows: np.ndarray | None = None
        self.version = 0  # changes of its templates

    def put(self, c: Cluster, row: np.ndarray) -> None:
        k = len(self.clusters)
        if self.rows is None or k == len(self.rows):
            more = np.zeros((max(8, 2 * k), len(row)), np.int64)
            if k:
                more[:k] = self.rows
            self.rows = more
        self.rows[k] = row
        self.clusters.append(c)
        self.version += 1

    def keep(self, live: dict[int, Cluster]) -> None:
        if self.rows is not None and any(c.number not in live for c in self.clusters):
            at = [i for i, c in enumerate(self.clusters) if c.number in live]
            self.rows = self.rows[at] if at else None
            self.clusters = [self.clusters[i] for i in at]
            self.version += 1


REMEMBERED = 200_000  # lines whose cluster a tree remembers; more are forgotten and looked for again


class TokenCountTree:
    """The tree of one token count. `max_clusters` bounds it by dropping the cluster unused for longest."""

    def __init__(self, n: int, p: DrainParams):
        self.n, self.p, self.root, self.clock, self.made = n, p, Node(), 0, 0
        self.levels = min(p.depth - 3, max(n - 1, 0))  # tokens that lead to a leaf
        self.live: dict[int, Cluster] = {}
        self.nodes = 0
        self.known: dict[str, tuple] = {}  # line -> number of nodes, leaf, its version, cluster
        self.wild = hash(p.param_str)

    def leaf(self, toks: list[str]) -> Node | None:
        node = self.root
        for t in toks[: self.levels]:
            node = node.children.get(t) or node.children.get(self.p.param_str)
            if node is None:
                return None
        return node

    def grow(self, toks: list[str]) -> Node:
        node, wild = self.root, self.p.param_str
        for t in toks[: self.levels]:
            if t not in node.children:
                # a token with a digit, or one that finds no room, goes the way of the wildcard; the last room is the wildcard's
                room = self.p.max_children - len(node.children) - (wild not in node.children)
                if any(ch.isdigit() for ch in t) or room <= 0:
                    t = wild
                if t not in node.children:
                    node.children[t] = Node()
                    self.nodes += 1
            node = node.children[t]
        return node

    def fit_line(self, line: str) -> Cluster:
        """`fit` of a line's tokens, joined by blanks. What would change nothing is looked up."""
        k = self.known.get(line)
        if k and k[0] == self.nodes and k[1].version == k[2]:
            self.clock += 1
            k[3].size, k[3].used = k[3].size + 1, self.clock
            return k[3]
        toks = split_line(line)
        node = self.leaf(toks)
        before = (self.nodes, node, node and node.version)
        c = self.fit(toks)
        if node and before == (self.nodes, node, node.version):
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[line] = (*before, c)
        return c

    def hashes(self, toks: list[str]) -> np.ndarray:
        return np.fromiter(map(hash, toks), np.int64, len(toks))

    def best(self, node: Node | None, row: np.ndarray, params_count: bool) -> tuple[int, float]:
        """Place of the most similar cluster in the leaf (ties: more wildcards, then the earlier) and its similarity."""
        if node is None or not node.clusters:
            return -1, -1.0
        if not self.n:
            return 0, 1.0
        rows = node.rows[: len(node.clusters)]
        wild = rows == self.wild
        wilds = wild.sum(axis=1)
        same = ((rows == row) & ~wild).sum(axis=1) + (wilds if params_count else 0)
        i = int((same * (self.n + 1) + wilds).argmax())
        return i, float(same[i]) / self.n

    def fit(self, toks: list[str]) -> Cluster:
        self.clock += 1
        row, node = self.hashes(toks), self.leaf(toks)
        i, score = self.best(node, row, False)
        if i >= 0 and score >= self.p.sim_th:
            c = node.clusters[i]
            for k in np.flatnonzero((node.rows[i] != row) & (node.rows[i] != self.wild)).tolist():
                c.template[k] = self.p.param_str
                node.rows[i, k] = self.wild
                node.version += 1
            c.size += 1
        else:
            c = Cluster(self.made, list(toks))
            self.made += 1
            self.live[c.number] = c
            self.grow(toks).put(c, row)
            if self.p.max_clusters and len(self.live) > self.p.max_clusters:
                old = min((x for x in self.live.values() if x is not c), key=lambda x: x.used)
                del self.live[old.number]
                self._purge(self.root)
        c.used = self.clock
        return c

    def _purge(self, node: Node) -> None:
        node.keep(self.live)
        for x in node.children.values():
            self._purge(x)

    def place(self, number: int, first: list[str], template: list[str], size: int = 0) -> Cluster:
        """Put a template where its cluster was created."""
        c = Cluster(number, template, size)
        self.live[number], self.made = c, max(self.made, number + 1)
        self.grow(first).put(c, self.hashes(template))
        return c

    def match_all(self, lines: list[list[str]]) -> list[Cluster | None]:
        """The cluster each line equals everywhere but at its wildcards (ties: more wildcards, then the earlier), if any."""
        by_leaf: dict[int, tuple[Node, list[int]]] = {}
        for k, toks in enumerate(lines):
            if (node := self.leaf(toks)) is not None and node.clusters:
                by_leaf.setdefault(id(node), (node, []))[1].append(k)
        out: list[Cluster | None] = [None] * len(lines)
        for node, at in by_leaf.values():
            rows = node.rows[: len(node.clusters)]
            wild = rows == self.wild
            mine = np.array([self.hashes(lines[k]) for k in at]).reshape(len(at), self.n)
            equal = np.ones((len(at), len(rows)), bool)
            for place in range(self.n):
                equal &= (rows[None, :, place] == mine[:, None, place]) | wild[None, :, place]
            best = np.where(equal, wild.sum(axis=1)[None, :], -1).argmax(axis=1)
            for k, b, hit in zip(at, best.tolist(), equal.any(axis=1).tolist()):
                if hit:
                    out[k] = node.clusters[b]
        return out


def split_line(line: str) -> list[str]:
    return line.split(" ") if line else []


FITTED = "n int, id {kind}, line string, number int, first string, template string, size bigint"


def _fit(p: DrainParams):
    """Of each token count its templates so far, then its lines in order -> a row per line with the cluster it went to, and, after
    a token count, a row per cluster."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = tree = None
        first: dict[int, str] = {}

        def close() -> list[tuple]:
            return [(n, None, None, c.number, first[c.number], " ".join(c.template), c.size) for c in tree.live.values()] if tree else []

        for b in batches:
            out: list[tuple] = []
            for k, i, line, toks, number, begun, template, size in zip(*(b[c].tolist() for c in ("n", "id", "line", "toks", "number", "first", "template", "size"))):
                if k != n:
                    out += close()
                    n, tree, first = k, TokenCountTree(k, p), {}
                if template is not None:
                    first[int(number)] = begun
                    tree.place(int(number), split_line(begun), split_line(template), int(size))
                    continue
                c = tree.fit_line(toks)
                first.setdefault(c.number, toks)
                out.append((k, i, line, c.number, None, None, 0))
            yield pd.DataFrame(out, columns=["n", "id", "line", "number", "first", "template", "size"])
        yield pd.DataFrame(close(), columns=["n", "id", "line", "number", "first", "template", "size"])

    return run


def _match(p: DrainParams):
    """Templates of a token count, then its lines. A line that equals none has the template of the cluster it was fitted to, if any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = tree = None
        by_number: dict[int, str] = {}
        known: dict[str, str | None] = {}
        for b in batches:
            out, held = [], []

            def settle() -> None:
                fresh = list({toks for *_, toks in held if toks not in known})
                for start in range(0, len(fresh), 2000):
                    part = fresh[start : start + 2000]
                    for toks, c in zip(part, tree.match_all([split_line(x) for x in part])):
                        known[toks] = " ".join(c.template) if c else None
                for i, line, number, toks in held:
                    out.append((i, line, known[toks] if known[toks] is not None else by_number.get(number)))
                held.clear()
                if len(known) > REMEMBERED:
                    known.clear()

            for n, salt, i, number, first, template, line, toks in zip(*(b[c].tolist() for c in ("n", "salt", "id", "number", "first", "template", "line", "toks"))):
                if (n, salt) != key:
                    if held:
                        settle()
                    key, tree, by_number, known = (n, salt), TokenCountTree(n, p), {}, {}
                if template is not None:
                    tree.place(int(number), split_line(first), split_line(template))
                    by_number[number] = template
                else:
                    held.append((i, line, number, toks))
            if held:
                settle()
            yield pd.DataFrame(out, columns=["id", "line", "template"])

    return run


def _joined(c: Column, params: DrainParams) -> Column:
    return F.array_join(tokens(c, params.extra_delimiters), " ")


def _token_count(c: Column) -> Column:
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))


def _fitted(df: DataFrame, params: DrainParams, row_id: str, text: str, start: DataFrame | None) -> DataFrame:
    lines = lines_of(df, row_id, text)
    kind = dict(lines.dtypes)["id"]
    rows = lines.withColumn("toks", _joined(F.col("line"), params)).withColumn("n", _token_count(F.col("toks")))
    none = lambda t: F.lit(None).cast(t)
    rows = rows.select("n", "id", "line", "toks", none("int").alias("number"), none("string").alias("first"), none("string").alias("template"), F.lit(0).cast("bigint").alias("size"))
    if start is not None:
        rows = rows.unionByName(start.select("n", none(kind).alias("id"), none("string").alias("line"), none("string").alias("toks"), "number", "first", "template", "size"))
    f = rows.repartition("n").sortWithinPartitions("n", F.col("template").isNull(), "number", "id")
    return cut(f.mapInPandas(_fit(params), FITTED.format(kind=kind)))


def fit_templates(df: DataFrame, params: DrainParams = DrainParams(), row_id: str = "_id", text: str = "logline", start: DataFrame | None = None) -> DataFrame:
    """The templates after one pass over the lines in order: n (tokens), number, first (the line it began with), template, size.

    start: templates to go on from (of this function, or read from where they were kept).
    """
    return _fitted(df, params, row_id, text, start).where(F.col("template").isNotNull()).select("n", "number", "first", "template", "size")


def _matched(lines: DataFrame, templates: DataFrame, params: DrainParams, split_lines: int) -> DataFrame:
    """lines (n, id, number, line) and templates -> id, line, template."""
    kind = dict(lines.dtypes)["id"]
    counts = lines.groupBy("n").agg(F.ceil(F.count("*") / split_lines).cast("int").alias("salts"))
    t = templates.join(counts, "n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    t = t.select("n", "salt", F.lit(None).cast(kind).alias("id"), "number", "first", "template", F.lit(None).cast("string").alias("line"), F.lit(None).cast("string").alias("toks"))
    j = lines.join(counts, "n")
    j = j.select("n", F.pmod(F.xxhash64("id", "line"), F.col("salts")).cast("int").alias("salt"), "id", "number", F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("template"), "line", _joined(F.col("line"), params).alias("toks"))
    both = t.unionByName(j).repartition("n", "salt").sortWithinPartitions("n", "salt", F.col("template").isNull(), "number")
    return both.mapInPandas(_match(params), f"id {kind}, line string, template string")


def match_templates(df: DataFrame, templates: DataFrame, params: DrainParams = DrainParams(), row_id: str = "_id", text: str = "logline", split_lines: int = 200_000) -> DataFrame:
    """Row id, logline, parsed_logline, parameter_list, event_id of every line with text, by templates that stay as they are.

    A line that equals no template everywhere but at its wildcards has a null template (and no parameters or event id).
    """
    lines = lines_of(df, row_id, text)
    lines = lines.select(_token_count(_joined(F.col("line"), params)).alias("n"), "id", F.lit(None).cast("int").alias("number"), "line")
    return finish(_matched(lines, templates, params, split_lines), row_id, text)


def drain(df: DataFrame, params: DrainParams = DrainParams(), row_id: str = "_id", text: str = "logline", split_lines: int = 200_000, start: DataFrame | None = None) -> DataFrame:
    """Row id, logline, parsed_logline, parameter_list, event_id of every line with text.

    All lines are fitted first, in the order of row ids (which should be unique), then each is matched to the final templates; a
    line whose way through the tree changed meanwhile keeps the cluster it was fitted to. Blank lines share an empty template.
    max_clusters bounds each token count by itself. start: templates to go on from. An empty table gives no rows.
    """
    f = _fitted(df, params, row_id, text, start)
    lines, templates = f.where(F.col("template").isNull()), f.where(F.col("template").isNotNull())
    return finish(_matched(lines.select("n", "id", "number", "line"), templates.select("n", "number", "first", "template"), params, split_lines), row_id, text)
