"""Clustering of feature vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.runtime import cut


def _checked(df: DataFrame, vector: str) -> DataFrame:
    d = df.where(F.col(vector).isNotNull())
    if d.isEmpty():
        raise ValueError("no vectors to cluster")
    return d


def kmeans(df: DataFrame, vector: str = "features", row_id: str = "_id", n_clusters: int = 8, max_iter: int = 300, tol: float = 1e-4, random_state: int = 7, n_init: int = 1) -> DataFrame:
    """Row id and `cluster_id` (text), k-means|| start, fixed seed; of `n_init` starts the one of least cost (ties: the first). Rows with
    null vector have no cluster; no rows: ValueError."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = cut(_checked(df, vector).select(row_id, array_to_vector(F.col(vector).cast("array<double>")).alias("features")))
    models = [KMeans(k=n_clusters, maxIter=max_iter, tol=tol, seed=random_state + i).fit(d) for i in range(max(1, n_init))]
    model = min(models, key=lambda m: m.summary.trainingCost)
    return model.transform(d).select(row_id, F.col("prediction").cast("string").alias("cluster_id"))


def _find(p: np.ndarray, i: int) -> int:
    while p[i] != i:
        p[i] = p[p[i]]
        i = p[i]
    return i


MOST_BLOCKS = 100_000  # of which two numbers each reach the driver, and go from there to all tasks


def _along_the_widest(df: DataFrame, vector: str) -> Column:
    """The place of a row's vector along the direction of greatest variance. A unit direction: places differ by no more than
    vectors do."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    pc = PCA(k=1, inputCol="f", outputCol="o").fit(df.select(array_to_vector(vector).alias("f"))).pc.toArray()[:, 0]
    pc = pc / max(float(np.linalg.norm(pc)), 1e-300)
    unit = F.array(*[F.lit(float(c)) for c in pc])
    return F.aggregate(F.zip_with(vector, unit, lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)


def dbscan(df: DataFrame, vector: str = "features", row_id: str = "_id", eps: float = 0.3, min_samples: int = 10, block: int = 2000, max_rounds: int = 50) -> DataFrame:
    """Row id and `cluster_id` (text): '-1' for noise, else the number of the cluster's least distinct vector.

    Equal vectors are one point with a weight. Points are cut into blocks along the direction in which they spread most, and meet in
    pairs of blocks (a bounded number each) that lie within eps of each other there; the pairs count neighbours; core points of a
    pair of blocks are united within their task, which emits one edge per point, not per pair; the edges' components are the
    clusters. A border point joins the cluster with the least number within reach. Where points lie within eps of most others
    along that direction the work grows with the square of the number of distinct vectors; its memory doesn't. More than
    MOST_BLOCKS blocks raise ValueError (choose larger ones). Rows with null vector have no cluster; no rows: ValueError.
    """
    d = _checked(df, vector).select(row_id, F.col(vector).cast("array<double>").alias("v"))
    from timberline.operators.positions import with_position

    pts = with_position(d.groupBy("v").agg(F.count("*").cast("bigint").alias("w")), ["v"], "p")
    pts = pts.withColumn("x", _along_the_widest(pts, "v") if pts.count() > block else F.lit(0.0))
    pts = cut(with_position(pts, ["x", "p"], "r").withColumn("b", F.floor(F.col("r") / block).cast("int")).drop("r"))
    # two numbers a block; blocks follow each other in x, so that those within reach of one are neighbours in number
    ends = pts.groupBy("b").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("b").limit(MOST_BLOCKS + 1).toPandas()
    if len(ends) > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} blocks of {block} points")
    reach_ = float(np.sqrt(eps * eps + 1e-9)) + 1e-6 * max(1.0, float(ends[["lo", "hi"]].abs().to_numpy().max()))
    first = np.searchsorted(ends["hi"].to_numpy(), ends["lo"].to_numpy() - reach_, "left")
    last = np.searchsorted(ends["lo"].to_numpy(), ends["hi"].to_numpy() + reach_, "right") - 1
    met = df.sparkSession.createDataFrame(pd.DataFrame({"b": ends["b"].astype("int32"), "first": first.astype("int32"), "last": last.astype("int32")}), "b int, first int, last int")

    def pairs(x: DataFrame) -> DataFrame:
        # each block goes to the pairs it is part of
        x = x.join(F.broadcast(met), "b").drop("x")
        i = F.explode(F.sequence("first", "last"))
        return x.withColumn("o", i).withColumn("lo", F.least("b", "o")).withColumn("hi", F.greatest("b", "o")).drop("first", "last")

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d2 = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
        return d2 <= eps * eps + 1e-9

    def sides(g: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        lo, hi = g["lo"].iloc[0], g["hi"].iloc[0]
        return g[g["b"] == lo], g[g["b"] == hi]

    def count(g: pd.DataFrame) -> pd.DataFrame:
        a, c = sides(g)
        m = near(np.array(a["v"].tolist()), np.array(c["v"].tolist()))
        out = [pd.DataFrame({"p": a["p"], "n": m @ c["w"].to_numpy()})]
        if a["b"].iloc[0] != c["b"].iloc[0]:
            out.append(pd.DataFrame({"p": c["p"], "n": m.T @ a["w"].to_numpy()}))
        return pd.concat(out)

    n = pairs(pts).groupBy("lo", "hi").applyInPandas(count, "p bigint, n bigint").groupBy("p").agg((F.sum("n") >= min_samples).alias("core"))
    pts = cut(pts.join(n, "p"))

    def unite(g: pd.DataFrame) -> pd.DataFrame:
        a, c = sides(g)
        a, c = a[a["core"]], c[c["core"]]
        if not len(a) or not len(c):
            return pd.DataFrame({"u": [], "v": []})
        ids = np.unique(np.concatenate((a["p"], c["p"])))
        at = {p: i for i, p in enumerate(ids)}
        parent = np.arange(len(ids))
        ai, ci = a["p"].map(at).to_numpy(), c["p"].map(at).to_numpy()
        for i, j in zip(*np.nonzero(near(np.array(a["v"].tolist()), np.array(c["v"].tolist())))):
            x, y = _find(parent, ai[i]), _find(parent, ci[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
        root = np.array([_find(parent, i) for i in range(len(ids))])
        return pd.DataFrame({"u": ids, "v": ids[root]})

    edges = cut(pairs(pts).groupBy("lo", "hi").applyInPandas(unite, "u bigint, v bigint").where("u <> v").distinct())
    label = pts.where("core").select("p", F.col("p").alias("c"))
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.join(label.withColumnRenamed("p", "v"), "v").groupBy("u").agg(F.min("c").alias("m"))
        nxt = cut(label.join(best.withColumnRenamed("u", "p"), "p", "left").select("p", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("moved")))
        label = nxt.select("p", "c")
        if nxt.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"clusters not settled after {max_rounds} rounds")
    lab = pts.join(label, "p", "left")

    def reach(g: pd.DataFrame) -> pd.DataFrame:
        a, c = sides(g)
        out = []
        for x, y in ((a, c), (c, a)):
            x, y = x[~x["core"]], y[y["core"]]
            if len(x) and len(y):
                m = near(np.array(x["v"].tolist()), np.array(y["v"].tolist()))
                low = np.where(m, y["c"].to_numpy()[None, :], np.iinfo(np.int64).max).min(axis=1)
                out.append(pd.DataFrame({"p": x["p"].to_numpy()[m.any(1)], "border": low[m.any(1)]}))
        return pd.concat(out) if out else pd.DataFrame({"p": [], "border": []})

    border = pairs(lab).groupBy("lo", "hi").applyInPandas(reach, "p bigint, border bigint").groupBy("p").agg(F.min("border").alias("border"))
    lab = lab.join(border, "p", "left").select("v", F.coalesce("c", "border", F.lit(-1).cast("bigint")).cast("string").alias("cluster_id"))
    return d.join(lab, "v").select(row_id, "cluster_id")


class FeatureTree:
    """Clustering features (n, linear sum, square sum) with a radius bound, absorbed in row order; leaves split at
    `branching` by their farthest pair. Its size follows the number of subclusters, not of rows."""

    def __init__(self, threshold: float, branching: int):
        self.threshold, self.branching = threshold, branching
        self.nodes: list[dict] = [{"leaf": True, "n": [], "ls": [], "ss": [], "kids": []}]
        self.root = 0

    def _nearest(self, node: dict, x: np.ndarray) -> int:
        c = np.array(node["ls"]) / np.array(node["n"])[:, None]
        return int(((c - x) ** 2).sum(axis=1).argmin())

    def add(self, x: np.ndarray, n: int = 1, ss: float | None = None) -> None:
        split = self._add(self.root, x * n, n, float(x @ x) * n if ss is None else ss)
        if split is not None:
            a, b = split
            self.nodes.append({"leaf": False, "n": [], "ls": [], "ss": [], "kids": []})
            self.root = len(self.nodes) - 1
            for k in (a, b):
                self._enter(self.nodes[self.root], k)

    def _enter(self, node: dict, k: int) -> None:
        kid = self.nodes[k]
        node["n"].append(sum(kid["n"]))
        node["ls"].append(np.sum(kid["ls"], axis=0))
        node["ss"].append(sum(kid["ss"]))
        node["kids"].append(k)

    def _add(self, at: int, ls: np.ndarray, n: int, ss: float) -> tuple[int, int] | None:
        node = self.nodes[at]
        if node["n"]:
            i = self._nearest(node, ls / n)
            if node["leaf"]:
                N, LS, SS = node["n"][i] + n, node["ls"][i] + ls, node["ss"][i] + ss
                if max(SS / N - float(LS @ LS) / N**2, 0.0) <= self.threshold**2:
                    node["n"][i], node["ls"][i], node["ss"][i] = N, LS, SS
                    return None
            else:
                split = self._add(node["kids"][i], ls, n, ss)
                if split is None:
                    node["n"][i] += n
                    node["ls"][i] = node["ls"][i] + ls
                    node["ss"][i] += ss
                    return None
                for c in ("n", "ls", "ss", "kids"):
                    node[c].pop(i)
                for k in split:
                    self._enter(node, k)
                return self._split(at) if len(node["n"]) > self.branching else None
        node["n"].append(n)
        node["ls"].append(ls)
        node["ss"].append(ss)
        return self._split(at) if len(node["n"]) > self.branching else None

    def _split(self, at: int) -> tuple[int, int]:
        node = self.nodes[at]
        c = np.array(node["ls"]) / np.array(node["n"])[:, None]
        d = ((c[:, None, :] - c[None, :, :]) ** 2).sum(-1)
        i, j = np.unravel_index(d.argmax(), d.shape)
        new = []
        for side in (d[i] <= d[j], d[i] > d[j]):
            pick = np.flatnonzero(side)
            self.nodes.append({"leaf": node["leaf"], **{k: [node[k][p] for p in pick] for k in ("n", "ls", "ss")}, "kids": [node["kids"][p] for p in pick] if not node["leaf"] else []})
            new.append(len(self.nodes) - 1)
        self.nodes[at] = {"leaf": node["leaf"], "n": [], "ls": [], "ss": [], "kids": []}
        return new[0], new[1]

    def leaves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n, linear sums and square sums of the subclusters, in tree order."""
        out, stack = [], [self.root]
        while stack:
            node = self.nodes[stack.pop()]
            if node["leaf"]:
                out += list(zip(node["n"], node["ls"], node["ss"]))
            else:
                stack += reversed(node["kids"])
        return np.array([o[0] for o in out]), np.array([o[1] for o in out]), np.array([o[2] for o in out])


def birch(df: DataFrame, vector: str = "features", row_id: str = "_id", threshold: float = 1.5, branching_factor: int = 50, n_clusters: int | None = None, max_subclusters: int = 20_000, seed: int = 7) -> DataFrame:
    """Row id and `cluster_id` (text): each row's nearest subcluster, or group of subclusters if n_clusters is given.

    Every partition builds its own feature tree in one pass; the trees' subclusters (summaries, at most `max_subclusters`
    in all, else ValueError) are absorbed by one tree on the driver. With one partition in row order this is the sequential method;
    with more, the order of absorption differs. Rows with null vector have no cluster; no rows: ValueError.
    """
    d = _checked(df, vector).select(row_id, F.col(vector).cast("array<double>").alias("v"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = FeatureTree(threshold, branching_factor)
        for b in batches:
            for v in b.sort_values("i")["v"] if "i" in b else b["v"]:
                t.add(np.asarray(v, float))
        n, ls, ss = t.leaves()
        yield pd.DataFrame({"n": n, "ls": list(ls), "ss": ss})

    parts = d.sortWithinPartitions(row_id).select("v").mapInPandas(build, "n bigint, ls array<double>, ss double").limit(max_subclusters + 1).toPandas()
    if len(parts) > max_subclusters:
        raise ValueError(f"more than {max_subclusters} subclusters; raise the threshold")
    tree = FeatureTree(threshold, branching_factor)
    for n, ls, ss in zip(parts["n"], parts["ls"], parts["ss"]):
        tree.add(np.asarray(ls, float) / n, int(n), float(ss))
    n, ls, _ = tree.leaves()
    centers = ls / n[:, None]
    groups = np.arange(len(centers))
    if n_clusters and n_clusters < len(centers):
        rng, c = np.random.default_rng(seed), None
        c = centers[rng.choice(len(centers), n_clusters, replace=False, p=n / n.sum())]
        for _ in range(50):
            groups = ((centers[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            c = np.array([np.average(centers[groups == k], axis=0, weights=n[groups == k]) if (groups == k).any() else c[k] for k in range(n_clusters)])
    kind = dict(d.dtypes)[row_id]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["v"].tolist()).reshape(len(b), -1)
            out = np.empty(len(b), int)
            for s in range(0, len(b), 1000):
                y = x[s : s + 1000]
                out[s : s + 1000] = ((centers * centers).sum(1)[None] - 2 * y @ centers.T).argmin(1) if len(y) else 0
            yield pd.DataFrame({row_id: b[row_id], "cluster_id": groups[out].astype(str)})

    return d.mapInPandas(assign, f"{row_id} {kind}, cluster_id string")
