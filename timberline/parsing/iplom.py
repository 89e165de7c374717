"""Iterative-partitioning template mining (IPLoM), as joins and aggregates.

1. Lines are partitioned by their number of tokens. 2. Each part is split by the values of its place with the fewest
different tokens (the first of these), unless that is one. 3. Parts whose share of constant places is below CT are split by the
relation between two places; lines of two tokens always are. 4. A place of the template is its token if it is the part's only one.

With the default CT = 0 step 3 concerns lines of two tokens only: after step 2 one of their places is constant, and the part is
split by the other if that has few values for its lines (at most `lowerBound` of them). Everything is then map-side combined
counting; a part of any size is only counted. With CT > 0 step 3 works on the distinct pairs of the two places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.text import split_at
from timberline.parsing.common import finish, lines_of, mask
from timberline.runtime import cut

WILD = "<*>"


@dataclass(frozen=True)
class IPLoMParams:
    rex: tuple[str, ...] | None = None
    logformat: str | None = None
    maxEventLen: int = 200
    step2Support: int = 0
    PST: float = 0
    CT: float = 0
    lowerBound: float = 0.25
    upperBound: float = 0.9
    keep_para: bool = True


def _cardinalities(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, card: different tokens per part and place."""
    t = lines.select(*keys, F.posexplode("toks").alias("pos", "tok")).groupBy(*keys, "pos", "tok").agg(F.lit(1).alias("one"))
    return t.groupBy(*keys, "pos").agg(F.count("*").alias("card"))


def iplom(df: DataFrame, params: IPLoMParams = IPLoMParams(), row_id: str = "_id", text: str = "logline") -> DataFrame:
    """Row id, logline, parsed_logline, parameter_list, event_id of every line with text.

    Blank lines and lines of delimiters only have an empty template. Lines of more than maxEventLen tokens are parts of their own
    length like any others. PST > 0: a part with a smaller share of its parent's lines becomes 'Outlier'. An empty table gives
    no rows.
    """
    rows = lines_of(df, row_id, text).withColumn("toks", split_at(mask(F.col("line"), list(params.rex or ()), "")))
    # the distinct token lists with their numbers of lines are all that the steps need: written once, joined back at the end
    lines = cut(rows.groupBy("toks").agg(F.count("*").alias("lines")).withColumn("n", F.size("toks")))
    total = F.sum("lines")
    size1 = lines.groupBy("n").agg(total.alias("size1"))
    card = _cardinalities(lines, ["n"]).groupBy("n").agg(F.min(F.struct("card", "pos")).alias("c"))
    split2 = size1.join(card, "n", "left").select("n", "size1", F.when((F.col("c.card") > 1) & (F.col("size1") > params.step2Support), F.col("c.pos")).alias("p"))
    lines = lines.join(split2, "n").withColumn("k2", F.when(F.col("p").isNotNull(), F.get("toks", F.col("p"))))
    keys = ["n", "k2"]
    out = F.lit(False)
    if params.PST:
        n_all = lines.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
        size2 = lines.groupBy(*keys).agg(total.alias("size2"))
        lines = lines.join(size2, (lines["n"] == size2["n"]) & lines["k2"].eqNullSafe(size2["k2"]), "left").select(lines["*"], "size2")
        out = (F.col("size1") / (n_all + 1) < params.PST) | (F.col("k2").isNotNull() & (F.col("size2") / F.col("size1") < params.PST))
    lines = _step3(lines.withColumn("outlier", out), params)
    keys = ["n", "k2", "k3"]
    place = lines.where(~F.col("outlier")).select(*keys, F.posexplode("toks").alias("pos", "tok")).groupBy(*keys, "pos").agg(F.min("tok").alias("lo"), F.max("tok").alias("hi"))
    tpl = place.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit(WILD)).alias("t")))).alias("t"))
    tpl = tpl.select(*[F.col(k).alias(f"t_{k}") for k in keys], F.array_join(F.transform("t", lambda x: x["t"]), " ").alias("tt"))
    on = (F.col("n") == F.col("t_n")) & F.col("k2").eqNullSafe(F.col("t_k2")) & F.col("k3").eqNullSafe(F.col("t_k3"))
    res = lines.join(tpl, on, "left").withColumn("template", F.when(F.col("outlier"), F.lit("Outlier")).otherwise(F.coalesce("tt", F.lit(""))))
    return finish(rows.join(res.select("toks", "template"), "toks"), row_id, text)


def _step3(lines: DataFrame, p: IPLoMParams) -> DataFrame:
    """Add k3: what step 3 splits a part by, null where it doesn't."""
    keys = ["n", "k2"]
    live = lines.where(~F.col("outlier"))
    card = _cardinalities(live, keys)
    stats = card.groupBy(*keys).agg(F.sum((F.col("card") == 1).cast("int")).alias("const"), F.array_sort(F.collect_list(F.struct("pos", "card"))).alias("cards"))
    cards = F.col("cards")
    # positions to relate: of parts from step 2 the first two that share the most frequent cardinality above one; of parts
    # from step 1 the first two of the rarest cardinality (ties: the smaller cardinality)
    kinds = F.array_distinct(F.transform(F.filter(cards, lambda x: x["card"] > 1), lambda x: x["card"]))
    tally = lambda k: F.size(F.filter(cards, lambda x: x["card"] == k))
    shared = F.filter(kinds, lambda k: tally(k) >= 2)
    often = F.array_max(F.transform(shared, lambda k: F.struct(tally(k).alias("f"), (-k).alias("k"))))
    seldom = F.array_min(F.transform(kinds, lambda k: F.struct(tally(k).alias("f"), k.alias("k"))))
    of = lambda k: F.transform(F.filter(cards, lambda x: x["card"] == k), lambda x: x["pos"])
    low = F.transform(F.slice(F.array_sort(F.transform(F.filter(cards, lambda x: x["card"] > 1), lambda x: F.struct(tally(x["card"]).alias("f"), x["card"].alias("k"), x["pos"].alias("p")))), 1, 2), lambda x: x["p"])
    chosen = F.when(F.col("k2").isNotNull(), of(-often["k"])).when(seldom.isNotNull(), low)
    general = (F.col("n") > 2) & (F.col("const") / F.col("n") < p.CT) & (F.size(chosen) >= 2)
    pair = F.when(F.col("n") == 2, F.array(F.lit(0), F.lit(1))).when(general, F.slice(chosen, 1, 2))
    stats = stats.select(F.col("n").alias("s_n"), F.col("k2").alias("s_k2"), pair.alias("pair")).where(F.col("pair").isNotNull())
    lines = lines.join(stats, (F.col("n") == F.col("s_n")) & F.col("k2").eqNullSafe(F.col("s_k2")), "left").drop("s_n", "s_k2")
    ab = lines.where(F.col("pair").isNotNull() & ~F.col("outlier")).select(*keys, F.get("toks", F.get("pair", F.lit(0))).alias("a"), F.get("toks", F.get("pair", F.lit(1))).alias("b"), "lines")
    ab = ab.groupBy(*keys, "a", "b").agg(F.sum("lines").alias("c"))
    wa, wb, wp = Window.partitionBy(*keys, "a"), Window.partitionBy(*keys, "b"), Window.partitionBy(*keys)
    ab = ab.withColumns({"bs": F.count("*").over(wa), "as": F.count("*").over(wb), "la": F.sum("c").over(wa), "lb": F.sum("c").over(wb)})
    ab = ab.withColumns({"pure_a": F.max("as").over(wa) == 1, "pure_b": F.max("bs").over(wb) == 1})
    one = (F.col("bs") == 1) & (F.col("as") == 1)
    one_m = (F.col("bs") > 1) & F.col("pure_a")
    m_one = (F.col("as") > 1) & F.col("pure_b")
    mm = ~(one | one_m | m_one)
    side = lambda c: F.size(F.collect_set(F.when(mm, F.col(c))).over(wp))
    by_a, by_b = F.concat(F.lit("a"), "a"), F.concat(F.lit("b"), "b")
    k3 = (
        F.when(one, by_a)
        .when(one_m, F.when(F.col("bs") / F.col("la") <= p.lowerBound, by_b).otherwise(by_a))
        .when(m_one, F.when(F.col("as") / F.col("lb") <= p.lowerBound, by_a).otherwise(by_b))
        .when(F.col("k2").isNotNull(), F.lit("m"))
    )
    if p.CT > 0:
        k3 = F.coalesce(k3, F.when(side("a") < side("b"), by_a).otherwise(by_b))
    else:
        k3 = F.coalesce(k3, by_a)  # unreachable: of two tokens one is constant
    rel = ab.select(F.col("n").alias("r_n"), F.col("k2").alias("r_k2"), F.col("a").alias("r_a"), F.col("b").alias("r_b"), k3.alias("k3"))
    lines = lines.withColumns({"a": F.get("toks", F.get("pair", F.lit(0))), "b": F.get("toks", F.get("pair", F.lit(1)))})
    on = (F.col("n") == F.col("r_n")) & F.col("k2").eqNullSafe(F.col("r_k2")) & (F.col("a") == F.col("r_a")) & (F.col("b") == F.col("r_b"))
    return lines.join(rel, on, "left").drop("r_n", "r_k2", "r_a", "r_b", "a", "b", "pair")
