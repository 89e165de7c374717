"""Mixing sources to target weights by iterative proportional fitting (problem 9).

1. One pass over the documents gives each its size in tokens of a public tokenizer and its topic (nearest of a few
   centroids of hashed word counts, trained on all documents: each round sums the vectors by topic).
2. Sizes are summed by cell: source x language x topic. Languages are folded to a fixed list and topics are numbered, so the
   table of cells is bounded by (targets x languages x topics) and fits on the driver.
3. The wanted size of each source is its target share of the total; a source that cannot reach it even when
   repeated as often as allowed gives all it can, and the others share the rest in proportion. The cell sizes are then raked to
   the marginals of source, language and topic (the latter two as in the corpus) under the cap of copies, ending with the source.
4. A cell's factor is the expected number of copies of each of its documents. Documents are drawn systematically, in
   order of size, within hashed blocks of their cell: every document gets the whole part of the factor, and the
   calibrated fraction of them one copy more, spread over all sizes. No cell is gathered: blocks have a bounded size.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.tokens import TOKENIZER_DIR, WORDS
from timberline.runtime import cut

#: Languages with a code of two letters by their codes of three, terminological and bibliographic.
THREE_LETTERS = {
    "ara": "ar", "ben": "bn", "bul": "bg", "cat": "ca", "ces": "cs", "cze": "cs", "dan": "da", "deu": "de", "ger": "de", "ell": "el", "gre": "el", "eng": "en", "est": "et", "fas": "fa", "per": "fa",
    "fin": "fi", "fra": "fr", "fre": "fr", "heb": "he", "hin": "hi", "hrv": "hr", "hun": "hu", "ind": "id", "ita": "it", "jpn": "ja", "kor": "ko", "lav": "lv", "lit": "lt", "nld": "nl", "dut": "nl",
    "nor": "no", "pol": "pl", "por": "pt", "ron": "ro", "rum": "ro", "rus": "ru", "slk": "sk", "slo": "sk", "slv": "sl", "spa": "es", "srp": "sr", "swe": "sv", "tha": "th", "tur": "tr", "ukr": "uk", "vie": "vi", "zho": "zh", "chi": "zh",
}


@dataclass(frozen=True)
class MixSpec:
    total_tokens: int | None = None  # size of the mix; by default that of all documents of the targeted sources
    topics: int = 6
    dims: int = 64
    topic_rounds: int = 12
    rounds: int = 60
    block_docs: int = 20_000
    most_cells: int = 100_000  # sources x languages x topics that are raked on the driver
    seed: str = "mix"


def language(c: Column) -> Column:
    """A language code without case and region, in two letters where there is such a code; 'other' for what is no code."""
    code = F.lower(F.regexp_extract(F.trim(c), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    short = F.element_at(F.create_map(*[F.lit(x) for kv in THREE_LETTERS.items() for x in kv]), code)
    return F.coalesce(short, F.nullif(code, F.lit("")), F.lit("other"))


def word_counts(texts: list[str | None], dims: int) -> np.ndarray:
    x = np.zeros((len(texts), dims), np.int32)
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            x[i, zlib.crc32(w.encode("utf-8", "replace")) % dims] += 1
    return x


def unit(counts: np.ndarray) -> np.ndarray:
    """Unit vectors of hashed word counts (log scale)."""
    x = np.log1p(counts.astype(float))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _packed(v: pd.Series, dims: int) -> np.ndarray:
    return unit(np.frombuffer(b"".join(v), np.int32).reshape(len(v), dims))


def train_topics(counted: DataFrame, k: int, dims: int, rounds: int) -> np.ndarray:
    """Centroids by spherical k-means over all rows (doc_id, v) with words, started from far-apart rows; one zero centroid if there are none.

    To the driver come a row per task while starting, then one sum and count per topic and task.
    """
    rows = counted.where(F.col("v") != F.lit(bytes(4 * dims))).select("doc_id", "v")  # texts without words have no direction
    first = rows.orderBy("doc_id", "v").first()
    if first is None:
        return np.zeros((1, dims))
    c = _packed(pd.Series([first["v"]]), dims)

    def farthest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for b in batches:
            if len(b):
                near = (_packed(b["v"], dims) @ c.T).max(axis=1)
                i = np.lexsort((b["doc_id"].to_numpy(), near))[0]
                this = (float(near[i]), b["doc_id"].iloc[i], b["v"].iloc[i])
                best = this if best is None else min(best, this)
        if best:
            yield pd.DataFrame([best], columns=["near", "doc_id", "v"])

    while len(c) < k:
        far = min(map(tuple, rows.mapInPandas(farthest, "near double, doc_id bigint, v binary").collect()))
        if far[0] >= 1 - 1e-9:  # fewer directions than topics
            break
        c = np.vstack((c, _packed(pd.Series([far[2]]), dims)))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros(len(c), int), np.zeros(c.shape)
        for b in batches:
            if len(b):
                x = _packed(b["v"], dims)
                at = (x @ c.T).argmax(axis=1)
                n += np.bincount(at, minlength=len(c))
                s += (at[:, None] == np.arange(len(c))).T.astype(float) @ x
        yield pd.DataFrame({"j": np.arange(len(c)), "n": n, "s": list(s)})

    for _ in range(rounds):
        n, s = np.zeros(len(c), int), np.zeros(c.shape)
        for r in rows.mapInPandas(sums, "j int, n bigint, s array<double>").collect():
            n[r["j"]] += r["n"]
            s[r["j"]] += r["s"]
        was, c = c, np.where(n[:, None] > 0, s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-12), c)
        if np.allclose(was, c, rtol=0, atol=1e-12):
            break
    return c


def _counter(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = WORDS.replace(r"\P{White_Space}", r"\S").replace(r"\p{White_Space}", r"\s")
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def measured(docs: DataFrame, doc_id: str, text: str, source: str, lang: str, spec: MixSpec, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens of every document."""
    path = tokenizer or os.path.join(TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).alias("source"), language(F.col(lang)).alias("lang"), F.col(text).cast("string").alias("text"))
    dims = spec.dims

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _counter(path)
        for b in batches:
            texts = b["text"].tolist()
            yield b[["doc_id", "source", "lang"]].assign(v=[x.tobytes() for x in word_counts(texts, dims)], tokens=[len(enc.encode_ordinary(t)) if t else 0 for t in texts])

    counted = cut(src.mapInPandas(count, "doc_id bigint, source string, lang string, v binary, tokens bigint"))
    centroids = train_topics(counted, spec.topics, dims, spec.topic_rounds)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b[["doc_id", "source", "lang"]].assign(topic=(_packed(b["v"], dims) @ centroids.T).argmax(axis=1), tokens=b["tokens"])

    return counted.mapInPandas(assign, "doc_id bigint, source string, lang string, topic int, tokens bigint")


def wanted_sizes(share: np.ndarray, cap: np.ndarray, total: float) -> np.ndarray:
    """Sizes in proportion to the shares; what capped sources cannot give is shared by the others."""
    size, free = np.zeros(len(share)), cap > 0
    left = min(total, float(cap.sum()))
    while free.any() and left > 1e-9:
        give = left * share * free / max((share * free).sum(), 1e-300)
        over = free & (size + give >= cap)
        if not over.any():
            size += give
            break
        left -= (cap - size)[over].sum()
        size[over] = cap[over]
        free &= ~over
    return size


def rake(cells: pd.DataFrame, size: dict[str, float], cap: dict[str, float], rounds: int) -> np.ndarray:
    """Factor of each cell: its fitted over its own tokens. Columns of cells: source, lang, topic, tokens."""
    own = cells["tokens"].to_numpy(float)
    most = own * cells["source"].map(cap).to_numpy(float)
    fit = own * 1.0
    total = sum(size.values())
    margins = []
    for c in ("lang", "topic"):
        want = cells.groupby(c)["tokens"].sum()
        margins.append((cells[c].to_numpy(), {k: v * total / max(own.sum(), 1e-300) for k, v in want.items()}))
    margins.append((cells["source"].to_numpy(), size))
    for _ in range(rounds):
        for key, want in margins:
            for k, w in want.items():
                m = key == k
                for _ in range(8):  # what capped cells cannot take goes to the others of the margin
                    have = fit[m].sum()
                    room = m & (fit < most * (1 - 1e-12)) if w > have else m
                    if abs(have - w) <= 1e-9 * max(w, 1.0) or not room.any() or fit[room].sum() <= 0:
                        break
                    fit[room] = np.minimum(fit[room] * max(0.0, (w - have + fit[room].sum()) / fit[room].sum()), most[room])
    return np.divide(fit, own, out=np.zeros_like(fit), where=own > 0)


def mix(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", spec: MixSpec = MixSpec(), tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sample, report). sample: doc_id, source, lang, topic, tokens, copies of every document drawn at least once.

    report: per target source and source without a target: target_share, max_repeats, n_docs, tokens, drawn_docs,
    drawn_tokens, share reached, most_copies. Documents of sources without a target (or with null source, share or repeats)
    aren't drawn; targets without documents reach zero and the others take their place. Documents without tokens (null or
    empty text) have no size and aren't drawn. Repeated documents count each. Empty tables give an empty sample. More than
    `most_cells` combinations of source, language and topic raise ValueError.
    """
    m = cut(measured(docs, doc_id, text, source, lang, spec, tokenizer))
    t = targets.select(F.col("doc_source").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    t = t.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)).dropDuplicates(["source"])
    tp = t.toPandas()  # one row per target
    sized = m.where(F.col("tokens") > 0).join(F.broadcast(t.select("source")), "source")
    cells = sized.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).limit(spec.most_cells + 1).toPandas()
    if len(cells) > spec.most_cells:
        raise ValueError(f"more than {spec.most_cells} combinations of source, language and topic")
    have = cells.groupby("source")["tokens"].sum()
    cap = (tp["source"].map(have).fillna(0) * tp["max_repeats"]).to_numpy(float)
    total = float(spec.total_tokens if spec.total_tokens is not None else cells["tokens"].sum())
    size = dict(zip(tp["source"], wanted_sizes(tp["target_share"].to_numpy(float), cap, total)))
    cells["factor"] = rake(cells, size, dict(zip(tp["source"], tp["max_repeats"].astype(float))), spec.rounds)
    cells["blocks"] = np.maximum(1, -(-cells["docs"] // spec.block_docs))
    table = docs.sparkSession.createDataFrame(cells[["source", "lang", "topic", "factor", "blocks"]].astype({"topic": "int32", "blocks": "int64"}), "source string, lang string, topic int, factor double, blocks bigint")
    d = sized.join(F.broadcast(table), ["source", "lang", "topic"]).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(spec.seed)), F.col("blocks")))
    w = Window.partitionBy("source", "lang", "topic", "block").orderBy("tokens", "doc_id")
    start = F.pmod(F.xxhash64("source", "lang", "topic", "block", F.lit(spec.seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    upto = F.floor(start + F.row_number().over(w) * F.col("factor") + 1e-9)
    before = F.floor(start + (F.row_number().over(w) - 1) * F.col("factor") + 1e-9)
    sample = d.withColumn("copies", (upto - before).cast("int")).where(F.col("copies") > 0).select("doc_id", "source", "lang", "topic", "tokens", "copies")
    drawn = sample.groupBy("source").agg(F.sum("copies").alias("drawn_docs"), F.sum(F.col("copies") * F.col("tokens")).alias("drawn_tokens"), F.max("copies").alias("most_copies"))
    every = m.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens"))
    r = every.join(t, "source", "full_outer").join(drawn, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    whole = F.sum(F.coalesce("drawn_tokens", F.lit(0))).over(Window.partitionBy())  # over one row per source
    share = F.when(whole > 0, F.coalesce("drawn_tokens", F.lit(0)) / whole).otherwise(0.0)
    report = r.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), zero("max_repeats"), zero("n_docs"), zero("tokens"), zero("drawn_docs"), zero("drawn_tokens"), zero("most_copies"), share.alias("share"))
    return sample, report
