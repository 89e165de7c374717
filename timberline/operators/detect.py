"""Anomaly detectors: fitted on bounded samples where a model is fitted, scored everywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.timebuckets import width_micros
from timberline.operators.positions import with_position
from timberline.runtime import cut, shuffle_partitions

MIN_SERIES = 10  # shorter series score zero


def _sample(df: DataFrame, vector: str, row_id: str, bound: int) -> np.ndarray:
    """At most about `bound` vectors, evenly by a hash of the row id."""
    d = df.where(F.col(vector).isNotNull())
    n = d.count()
    if not n:
        raise ValueError("no vectors to fit")
    every = max(1, -(-n // bound))
    rows = d.where(F.pmod(F.xxhash64(row_id), F.lit(every)) == 0).select(F.col(row_id).alias("i"), F.col(vector).cast("array<double>").alias("v")).orderBy("i").limit(2 * bound).collect()
    if not rows:
        rows = d.select(F.col(row_id).alias("i"), F.col(vector).cast("array<double>").alias("v")).orderBy("i").limit(bound).collect()
    return np.array([r["v"] for r in rows], float)


def _scores(df: DataFrame, vector: str, row_id: str, score, chunk: int = 2000) -> DataFrame:
    """row id and score `s` of every row with a vector, written once."""
    d = df.where(F.col(vector).isNotNull()).select(row_id, F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), chunk):
                part = b.iloc[s : s + chunk]
                yield pd.DataFrame({row_id: part[row_id].to_numpy(), "s": score(np.array(part["v"].tolist(), float).reshape(len(part), -1))})

    return cut(d.mapInPandas(run, f"{row_id} {dict(d.dtypes)[row_id]}, s double"))


def _flagged(d: DataFrame, row_id: str, raw: Column) -> DataFrame:
    """row id, anom_score (1 inlier, -1 outlier) and raw score."""
    return d.select(row_id, F.when(raw < 0, -1).otherwise(1).alias("anom_score"), raw.alias("raw_score"), F.lit(False).alias("trainval"))


def _quantile(d: DataFrame, q: float) -> float:
    """Quantile of the scores of all rows, between the two next to it in order."""
    at = (d.count() - 1) * q
    lo = int(at)
    two = [r["s"] for r in with_position(d.select("s"), ["s"]).where(F.col("pos").between(lo, lo + 1)).orderBy("pos").collect()]
    return two[0] + (two[-1] - two[0]) * (at - lo)


def one_class_svm(df: DataFrame, vector: str = "features", row_id: str = "_id", nu: float = 0.5, max_rows: int = 5000, rounds: int = 300) -> DataFrame:
    """Linear one-class machine. raw = w.x - rho, with w from at most `max_rows` sampled vectors and rho from all rows.

    The dual (the shortest combination of vectors with weights of at most 1 / (nu n)) by conditional gradient steps: each step
    moves towards the combination of the vectors with the least margins.
    """
    x = _sample(df, vector, row_id, max_rows)
    w, most = x.mean(axis=0), 1.0 / (nu * len(x))
    for t in range(rounds):
        order = np.argsort(x @ w, kind="stable")
        alpha = np.clip(1.0 - most * np.arange(len(x)), 0.0, most)
        w = w + (alpha @ x[order] - w) * 2.0 / (t + 2.0)
    d = _scores(df, vector, row_id, lambda y: y @ w)
    rho = _quantile(d, nu)
    return _flagged(d, row_id, F.col("s") - F.lit(rho - 1e-9 * max(1.0, abs(rho))))


def _c(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def isolation_forest(df: DataFrame, vector: str = "features", row_id: str = "_id", n_estimators: int = 100, max_samples: int | str = "auto", contamination: float | str = "auto", random_state: int = 7) -> DataFrame:
    """Isolation forest; raw = threshold - score, so that outliers are negative. Each tree draws its rows from all rows, and a
    threshold by contamination is a quantile of the scores of all rows."""
    rng = np.random.default_rng(random_state)
    d = with_position(df.where(F.col(vector).isNotNull()).select(row_id, F.col(vector).cast("array<double>").alias("v")), [row_id])
    n = d.count()
    if not n:
        raise ValueError("no vectors to fit")
    psi = min(256 if max_samples == "auto" else int(max_samples), n)
    draws = [rng.choice(n, psi, replace=False) for _ in range(n_estimators)]
    drawn = np.unique(np.concatenate(draws))  # at most n_estimators * psi rows
    wanted = df.sparkSession.createDataFrame(pd.DataFrame({"pos": drawn}), "pos bigint")
    x = np.array([r["v"] for r in d.join(F.broadcast(wanted), "pos").orderBy("pos").select("v").collect()], float)
    limit = int(np.ceil(np.log2(max(psi, 2))))
    forest = []
    for draw in draws:
        feature, at, kid, size = [], [], [], []

        def grow(rows: np.ndarray, depth: int) -> int:
            i = len(feature)
            for a, v in ((feature, -1), (at, 0.0), (kid, (0, 0)), (size, len(rows))):
                a.append(v)
            wide = np.flatnonzero(np.ptp(rows, axis=0) > 0) if len(rows) > 1 and depth < limit else []
            if len(wide):
                f = int(rng.choice(wide))
                c = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
                feature[i], at[i] = f, c
                kid[i] = (grow(rows[rows[:, f] <= c], depth + 1), grow(rows[rows[:, f] > c], depth + 1))
            return i

        grow(x[np.searchsorted(drawn, draw)], 0)
        forest.append((np.array(feature), np.array(at), np.array(kid), np.array([_c(s) for s in size])))

    def score(y: np.ndarray) -> np.ndarray:
        total = np.zeros(len(y))
        for feature, at, kid, extra in forest:
            node, depth = np.zeros(len(y), int), np.zeros(len(y))
            for _ in range(limit):
                f = feature[node]
                go = f >= 0
                right = (y[np.arange(len(y)), np.maximum(f, 0)] > at[node]).astype(int)
                node = np.where(go, kid[node, right], node)
                depth += go
            total += depth + extra[node]
        return 2 ** (-total / len(forest) / max(_c(psi), 1e-9))

    s = _scores(d, "v", row_id, score)
    bar = 0.5 if contamination == "auto" else _quantile(s, 1 - float(contamination))
    return _flagged(s, row_id, F.lit(bar) - F.col("s") if psi > 1 else F.lit(0.0))


def _least(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least values of each row, in their order; ties from the left."""
    if d.shape[1] <= k:
        return np.argsort(d, axis=1, kind="stable")
    at = np.sort(np.argpartition(d, k - 1, axis=1)[:, :k], axis=1)
    kept = np.take_along_axis(d, at, 1)
    tied = (d <= kept.max(axis=1)[:, None]).sum(axis=1) > k
    at = np.take_along_axis(at, np.argsort(kept, axis=1, kind="stable"), 1)
    at[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :k]
    return at


class _Nearest:
    """A block of points and, of all points it has met, the k nearest to each, itself left out."""

    def __init__(self, k: int):
        self.k, self.mine, self.d = k, [], None

    def add(self, p: np.ndarray, w: np.ndarray, v: np.ndarray) -> None:
        self.mine.append((p, w, v))

    def meet(self, q: np.ndarray, w: np.ndarray, y: np.ndarray) -> None:
        if self.d is None:
            self.p, self.w, self.x = (np.concatenate(c) for c in zip(*self.mine))
            self.d, self.q, self.m = np.zeros((len(self.p), 0)), np.zeros((len(self.p), 0), int), np.zeros((len(self.p), 0), int)
        d = np.sqrt(np.maximum((self.x * self.x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * self.x @ y.T, 0))
        self_ = self.p[:, None] == q[None]
        d = np.hstack((self.d, np.where(self_, np.inf, d)))
        q = np.hstack((self.q, np.where(self_, -1, q[None])))
        m = np.hstack((self.m, np.where(self_, 0, w[None])))
        at = _least(d, self.k)
        self.d, self.q, self.m = (np.take_along_axis(c, at, 1) for c in (d, q, m))

    def rows(self) -> pd.DataFrame:
        """p, its neighbour q at distance d, and how often q counts among p's k neighbours without (fit) and with p itself (used)."""
        one = lambda c: np.asarray(c)[:, None]
        d, q = np.hstack((np.zeros((len(self.p), 1)), self.d)), np.hstack((one(self.p), self.q))

        def taken(own: np.ndarray) -> np.ndarray:
            m = np.hstack((one(own), self.m))
            return np.clip(self.k - (m.cumsum(axis=1) - m), 0, m)

        fit, used = taken(self.w - 1), taken(self.w)
        on = (fit > 0) | (used > 0)
        return pd.DataFrame({"p": np.broadcast_to(one(self.p), q.shape)[on], "q": q[on], "d": d[on], "fit": fit[on], "used": used[on]})


def local_outlier_factor(df: DataFrame, vector: str = "features", row_id: str = "_id", n_neighbors: int = 20, bar: float = 1.5, block: int = 2000) -> DataFrame:
    """Novelty mode: each row against all rows; raw = bar - factor.

    Equal vectors are one point with a weight. Each block of points is met by all points, some at a time, and keeps the nearest of
    each; the densities come from joins of these lists. The work grows with the square of the number of distinct vectors, the
    memory of a task doesn't. Rows with null vector have no score; no rows: ValueError.
    """
    d = df.where(F.col(vector).isNotNull()).select(row_id, F.col(vector).cast("array<double>").alias("v"))
    n = d.count()
    if not n:
        raise ValueError("no vectors to fit")
    k = max(1, min(n_neighbors, n - 1))
    pts = d.groupBy("v").agg(F.count("*").cast("bigint").alias("w"), F.min(row_id).alias("i"))
    pts = cut(with_position(pts, ["i"], "p").select("p", "w", "v", F.floor(F.col("p") / block).cast("int").alias("b")))
    blocks = int(pts.agg(F.max("b")).first()[0]) + 1
    every = pts.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("own", F.lit(False))
    met = every.unionByName(pts.withColumn("to", F.col("b")).withColumn("own", F.lit(True))).drop("b")

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = near = None
        for batch in batches:
            for (to, own), g in batch.groupby(["to", "own"], sort=False):
                if to != at:
                    if near:
                        yield near.rows()
                    at, near = to, _Nearest(k)
                for s in range(0, len(g), block):
                    part = g.iloc[s : s + block]
                    (near.add if own else near.meet)(part["p"].to_numpy(), part["w"].to_numpy(), np.array(part["v"].tolist(), float).reshape(len(part), -1))
        if near:
            yield near.rows()

    met = met.repartition(max(2 * blocks, shuffle_partitions(df.sparkSession)), "to").sortWithinPartitions("to", F.col("own").desc(), "p")
    near = cut(met.mapInPandas(nearest, "p bigint, q bigint, d double, fit bigint, used bigint"))
    far = near.groupBy("p").agg(F.coalesce(F.max(F.when(F.col("fit") > 0, F.col("d"))), F.lit(0.0)).alias("kd"))
    near = near.join(far.withColumnRenamed("p", "q"), "q").withColumn("reach", F.greatest("d", "kd"))
    mean = lambda count, c: F.sum(F.when(F.col(count) > 0, F.col(count) * F.col(c))) / F.lit(float(k))
    density = lambda count: F.lit(1.0) / F.greatest(mean(count, "reach"), F.lit(1e-10))
    lrd = near.groupBy("p").agg(F.when(F.sum("fit") > 0, density("fit")).otherwise(1.0).alias("lrd"))
    near = near.join(lrd.withColumnRenamed("p", "q"), "q")
    raw = near.groupBy("p").agg((F.lit(bar) - mean("used", "lrd") / density("used")).alias("raw_score"))
    return _flagged(d.join(pts.join(raw, "p").select("v", "raw_score"), "v"), row_id, F.col("raw_score"))


def distribution_divergence(train: DataFrame, test: DataFrame, columns: list[str], n_bins: int = 100, kinds: list[str] | str = ("KL",)) -> DataFrame:
    """One row per kind ('KL', 'JS'): kind, anom_score, between the histograms of two sets of features.

    All columns share one set of equal bins over both sets' range; probabilities are floored at 1e-20. Nulls are left out.
    """
    kinds = [k.strip().upper() for k in (kinds.split(",") if isinstance(kinds, str) else ",".join(kinds).split(","))]
    if not set(kinds) <= {"KL", "JS"}:
        raise ValueError(f"unknown divergence in {kinds}")
    long = lambda d, which: d.select(F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("x")).where(F.col("x").isNotNull()).withColumn("q", F.lit(which))
    both = long(train, 0).unionByName(long(test, 1))
    lo, hi = both.agg(F.min("x"), F.max("x")).first()
    if lo is None:
        raise ValueError("no values to compare")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    b = F.least(F.floor((F.col("x") - lo) / F.lit((hi - lo) / n_bins)), F.lit(n_bins - 1))
    h = both.groupBy(b.alias("b")).agg(F.sum((F.col("q") == 0).cast("bigint")).alias("p"), F.sum((F.col("q") == 1).cast("bigint")).alias("q"))
    t = h.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq")).first()
    floor = lambda c, n: F.greatest(F.col(c) / F.lit(float(max(n or 0, 1))), F.lit(1e-20))
    h = h.select(floor("p", t["tp"]).alias("p"), floor("q", t["tq"]).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    kl = lambda x, y: F.col(x) * F.log(F.col(x) / F.col(y))
    one = {"KL": F.sum(kl("p", "q")), "JS": F.sum(kl("p", "m")) / 2 + F.sum(kl("q", "m")) / 2}
    r = h.agg(*[one[k].alias(k) for k in kinds])
    return r.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("anom_score")) for k in kinds])).alias("r")).select("r.*")


def _split(df: DataFrame, keys: list[str], ts: str, train_fraction: float) -> DataFrame:
    """Number of readings and whether a row is among the first fraction of its series, by time.

    The cut is a time per series from its sorted readings' count; series are counters per time bucket, which the time range bounds.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    d = df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).withColumn("__r", F.row_number().over(w))
    return d.withColumn("__train", F.col("__r") <= F.floor(F.col("__n") * train_fraction))


def dynamic_baseline(df: DataFrame, keys: list[str], ts: str = "timestamp", value: str = "counts", wind_sz: str = "1h", threshold: float = 0.0, trends: tuple[str, ...] | None = None, train_fraction: float = 0.7) -> DataFrame:
    """keys, timestamp, value, anom_score, trainval: z against mean and deviation of the training readings at that time of day.

    Baseline-like, not a re-implementation of a library. Buckets of `wind_sz` of the day (and the day of the week with trend 'weekly'); a
    bucket unseen in training falls back to the series' training readings. |z| < threshold and series of fewer than ten readings score 0;
    so do training rows. A deviation of zero counts as one.
    """
    d = _split(df.where(F.col(ts).isNotNull() & F.col(value).isNotNull()), keys, ts, train_fraction)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    slot = F.floor(F.pmod(us, F.lit(86_400_000_000)) / F.lit(width_micros(wind_sz))).cast("bigint")
    d = d.withColumn("__s", slot + (F.dayofweek(ts) * 100_000 if trends and "weekly" in trends else F.lit(0)))
    t = F.when(F.col("__train"), F.col(value).cast("double"))
    by_slot, by_series = Window.partitionBy(*keys, "__s"), Window.partitionBy(*keys)
    d = d.withColumns({"__m": F.coalesce(F.avg(t).over(by_slot), F.avg(t).over(by_series)), "__d": F.coalesce(F.stddev_pop(t).over(by_slot), F.stddev_pop(t).over(by_series))})
    z = (F.col(value) - F.col("__m")) / F.when(F.col("__d") > 0, F.col("__d")).otherwise(1.0)
    ok = ~F.col("__train") & (F.col("__n") >= MIN_SERIES) & (F.abs(z) >= threshold)
    return d.select(*keys, ts, value, F.when(ok, z).otherwise(0.0).alias("anom_score"), F.col("__train").alias("trainval"))


def _holt(y: np.ndarray, period: int | None, damped: bool, a: float, b: float, phi: float, g: float, relative: bool = False) -> np.ndarray:
    """One-step errors of additive smoothing with (damped) trend and, with a period, additive season; relative ones are shares of
    the forecast (of one at least)."""
    level, slope = y[0], 0.0
    season = np.zeros(period) if period else None
    if period and len(y) >= 2 * period:
        season = np.array([y[i::period].mean() for i in range(period)]) - y.mean()
        level = y[0] - season[0]
    err, phi = np.zeros(len(y)), phi if damped else 1.0
    for t, v in enumerate(y):
        s = season[t % period] if period else 0.0
        base = level + phi * slope
        e = v - base - s
        err[t] = e / max(abs(base + s), 1.0) if relative else e
        new = base + a * e
        slope = phi * slope + b * (new - level - phi * slope)
        level = new
        if period:
            season[t % period] = s + g * e
    return err


def ets(df: DataFrame, keys: list[str], ts: str = "timestamp", value: str = "counts", trend: str | None = "add", damped_trend: bool = True, seasonal: str | None = "add", seasonal_periods: int | None = None, train_fraction: float = 0.7, bar: float = 3.0, error: str = "add", refit: bool = False) -> DataFrame:
    """keys, timestamp, value, anom_score, trainval: residual z of damped additive smoothing, zero below `bar`.

    ETS-like: the weights of level, trend, damping and season by a grid on the training errors, which are differences ('add') or
    shares of the forecast ('mul'); with refit the weights are chosen again from all readings before the test readings are scored. Series are counters per time bucket, so one series, which a task
    holds, is bounded by its time range. Constant series and those of fewer than ten readings score 0; so do training rows.
    """
    if error not in ("add", "mul"):
        raise ValueError(f"no error type {error!r}; there are add and mul")
    d = df.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(*keys, ts, value)
    schema = ", ".join(f"{n} {t}" for n, t in d.dtypes) + ", anom_score double, trainval boolean"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable")
        y, n = pdf[value].to_numpy(float), len(pdf)
        cut = int(n * train_fraction)
        score = np.zeros(n)
        if n >= MIN_SERIES and cut >= 2 and np.ptp(y) > 0:
            period = seasonal_periods if seasonal else None
            seasons = (0.05, 0.1, 0.3) if period else (0.0,)
            grid = [(a, b, p, g) for a in (0.1, 0.3, 0.5, 0.8) for b in ((0.01, 0.1) if trend else (0.0,)) for p in ((0.8, 0.98) if damped_trend else (1.0,)) for g in seasons]
            fitted = y if refit else y[:cut]
            best = min(grid, key=lambda q: float((_holt(fitted, period, damped_trend, *q, error == "mul")[1:] ** 2).sum()))
            err = _holt(y, period, damped_trend, *best, error == "mul")
            sd = err[1:cut].std()
            z = (err - err[1:cut].mean()) / (sd if sd > 1e-9 else 1.0)
            score = np.where(np.abs(z) >= bar, z, 0.0)
            score[:cut] = 0.0
        return pdf.assign(anom_score=score, trainval=np.arange(n) < cut)

    return d.groupBy(*keys).applyInPandas(fit, schema)


SERIES = {"dbl": dynamic_baseline, "ets": ets}
VECTORS = {"one_class_svm": one_class_svm, "isolation_forest": isolation_forest, "lof": local_outlier_factor}


def per_attribute(df: DataFrame, attributes: list[str], algo: str = "dbl", ts: str = "timestamp", value: str = "counts", train_fraction: float = 0.3, params: dict | None = None) -> DataFrame:
    """Counter detectors for each series of attribute values: adds `attribute`, the values joined by '-'.

    Series with fewer than ten readings score 0. Defaults to 30 % for training; the anomaly application uses 70 %.
    """
    if algo not in SERIES:
        raise ValueError(f"{algo!r} is no detector of series; there are {sorted(SERIES)}")
    d = df.withColumn("attribute", F.concat_ws("-", *[F.col(a).cast("string") for a in attributes]))
    return SERIES[algo](d, ["attribute"], ts, value, train_fraction=train_fraction, **(params or {}))
