"""Repetition inside a single document, scored by boosted trees over document statistics (problem 10).

Every document becomes a row of statistics (`STATS`), computed for a whole Arrow batch with array operations; none of them is
the share that is asked for. Gradient-boosted trees, trained to tell that share on a bounded sample of measured documents and
constrained to be monotonic in chosen statistics, are flattened into node arrays and score whole batches level by level.

Selection is by score, and the bar loses nothing: a passage of k words that began earlier repeats k - 1 pairs of words, and
k - 2 triples, and each of its words has occurred before. So a repeated share of at least s implies shares of repeated pairs and
triples of at least s (k - 1) / k and s (k - 2) / k, and at most 1 - s of different words. The bar is the score of the least
repetitive row within these limits, which monotony makes the least score there. An exact word-by-word check decides about the
documents that reach it.

Map-side only: one pass for the sample, one over the corpus; no shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = regex.compile(r"\p{L}+")
CJK = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}ー]")
SENTENCE = regex.compile(r"[^.!?;\n。！？]+")
#: Statistics of a document, and the direction in which the score may move with each (+1 up, -1 down, 0 free).
STATS = {"pair_share": 1, "triple_share": 1, "sentence_share": 1, "top_word_share": 1, "distinct_ratio": -1, "log_words": 0}


@dataclass(frozen=True)
class RepetitionSpec:
    passage_words: int = 6
    passage_letters: int = 12  # where each kana or kanji is a word
    share: tuple[int, int] = (3, 10)  # threshold as a fraction, compared in integers
    sample_docs: int = 6000  # bound of the training sample
    trees: int = 24
    depth: int = 3
    rate: float = 0.3
    bins: int = 48


def words_of(text: str | None) -> tuple[list[str], bool]:
    """Words of a text, and whether they are single letters (mostly kana and kanji). Null and blank texts have none."""
    if not text:
        return [], False
    words = LETTERS.findall(text.lower())
    letters = sum(map(len, words))
    if letters and 2 * len(CJK.findall(text)) > letters:
        return list("".join(words)), True
    return words, False


def repeated_words(words: list[str], k: int) -> int:
    """Exact: how many words lie in a passage of k words that began at an earlier place too."""
    seen, upto, covered = set(), 0, 0
    for i in range(len(words) - k + 1):
        gram = tuple(words[i : i + k])
        if gram in seen:
            covered += i + k - max(i, upto)
            upto = i + k
        else:
            seen.add(gram)
    return covered


def _first_flags(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where a (doc, key) is seen for the first time in order."""
    order = np.lexsort((np.arange(len(doc)), key, doc))
    first = np.ones(len(doc), bool)
    first[order[1:]] = (doc[order[1:]] != doc[order[:-1]]) | (key[order[1:]] != key[order[:-1]])
    return first


class Words:
    """The words of a batch of texts as arrays: number, text and place of each, and the words left in its text."""

    def __init__(self, texts: list[str | None], spec: RepetitionSpec):
        split = [words_of(t) for t in texts]
        self.docs, self.n = len(texts), np.array([len(w) for w, _ in split], np.int64)
        self.size = np.where([c for _, c in split], spec.passage_letters, spec.passage_words).astype(np.int64)
        ids: dict[str, int] = {}
        self.word = np.fromiter((ids.setdefault(w, len(ids)) for ws, _ in split for w in ws), np.int64, int(self.n.sum()))
        self.doc = np.repeat(np.arange(self.docs), self.n)
        self.left = self.n[self.doc] - (np.arange(len(self.doc)) - (np.cumsum(self.n) - self.n)[self.doc])
        mix = (self.word.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        self.mix = mix ^ (mix >> np.uint64(31))

    def again(self, k: int, at: np.ndarray) -> np.ndarray:
        """Of places with k words left: whether these k words began earlier in the text."""
        h = np.zeros(len(self.mix), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(min(k, len(h))):
                h[: len(h) - j] = h[: len(h) - j] * np.uint64(0x100000001B3) + self.mix[j:]
        return ~_first_flags(self.doc[at], h[at])


def statistics(texts: list[str | None], spec: RepetitionSpec, words: Words | None = None) -> pd.DataFrame:
    """STATS and n_words of each text. Documents without words have zero shares and a distinct ratio of one."""
    w = words or Words(texts, spec)
    docs, n, doc, total = w.docs, w.n, w.doc, len(w.doc)
    safe = np.maximum(n, 1)
    begun = {}
    for k in (2, 3):
        at = np.flatnonzero(w.left >= k)
        begun[k] = np.bincount(doc[at], w.again(k, at), docs) if len(at) else np.zeros(docs)
    fresh = _first_flags(doc, w.mix) if total else np.zeros(0, bool)
    order = np.lexsort((w.word, doc))
    top = np.zeros(docs)
    if total:
        b = np.flatnonzero(np.concatenate(([True], (doc[order][1:] != doc[order][:-1]) | (w.word[order][1:] != w.word[order][:-1]))))
        np.maximum.at(top, doc[order][b], np.diff(np.append(b, total)))
    sentence = np.zeros(docs)
    for i, t in enumerate(texts):
        if t:
            s = [x.strip().lower() for x in SENTENCE.findall(t)]
            s = [x for x in s if x]
            sentence[i] = 1 - len(set(s)) / len(s) if s else 0
    distinct = np.where(n > 0, np.bincount(doc, fresh, docs) / safe, 1.0) if total else np.ones(docs)
    return pd.DataFrame({"pair_share": begun[2] / safe, "triple_share": begun[3] / safe, "sentence_share": sentence, "top_word_share": top / safe, "distinct_ratio": distinct, "log_words": np.log1p(n), "n_words": n})


def measured(texts: list[str | None], spec: RepetitionSpec, words: Words | None = None) -> np.ndarray:
    """The number of repeated words of each text, by passage hashes (of 64 bits) over the whole batch."""
    w = words or Words(texts, spec)
    covered = np.zeros(len(w.doc) + 1, np.int64)
    for k in np.unique(w.size):
        at = np.flatnonzero((w.left >= k) & (w.size[w.doc] == k))
        hit = at[w.again(int(k), at)] if len(at) else at
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + k, -1)
    return np.bincount(w.doc, np.cumsum(covered[:-1]) > 0, w.docs).astype(np.int64) if len(w.doc) else np.zeros(w.docs, np.int64)


@dataclass
class FlatTrees:
    """Boosted trees as node arrays: of each node its feature (-1: leaf), threshold, left child and value; right = left + 1."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Sum over the trees, for all rows at once."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            go = x[rows, np.maximum(f, 0)] > self.threshold[node]
            node = np.where(f >= 0, self.child[node] + go, node)
        return self.value[node].sum(axis=1)


def bars(trees: FlatTrees, x: np.ndarray, spec: RepetitionSpec) -> np.ndarray:
    """For each row of STATS the score it must reach: that of the least repetitive document of as many words whose repeated share
    is at the threshold. The trees are monotonic in all other statistics, so no document at or above it scores less."""
    s, k, slack = spec.share[0] / spec.share[1], min(spec.passage_words, spec.passage_letters), 1e-9
    least = {"pair_share": s * (k - 1) / k - slack, "triple_share": s * (k - 2) / k - slack, "sentence_share": 0.0, "top_word_share": 0.0, "distinct_ratio": 1 - s + slack}
    words, of = np.unique(x[:, list(STATS).index("log_words")], return_inverse=True)
    rows = np.array([[least.get(c, v) for c in STATS] for v in words]).reshape(-1, len(STATS))
    return trees.score(rows)[of] - slack


def train(x: np.ndarray, y: np.ndarray, monotone: list[int], spec: RepetitionSpec) -> FlatTrees:
    """Boosting of the squared error on binned features.

    A split on a constrained feature must order its two values accordingly, and the middle between them bounds all
    leaves below on either side; hence every tree, and the sum, is monotonic in that feature. Without rows the trees are constants.
    """
    cols = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, spec.bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(cols)]
    binned = [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]
    feature, threshold, child, value, roots = [], [], [], [], []
    margin = np.zeros(len(x))

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (child, -1), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    def grow(i: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, lo: float, hi: float) -> None:
        G, H = g[rows].sum(), h[rows].sum()
        value[i] = float(np.clip(-G / (H + 1.0), lo, hi)) * spec.rate
        best = (1e-6, None)
        if depth < spec.depth and len(rows) >= 20:
            for j in range(cols):
                k = len(cuts[j]) + 1
                if k < 2:
                    continue
                gl = np.cumsum(np.bincount(binned[j][rows], g[rows], k))[:-1]
                hl = np.cumsum(np.bincount(binned[j][rows], h[rows], k))[:-1]
                vl, vr = np.clip(-gl / (hl + 1), lo, hi), np.clip(-(G - gl) / (H - hl + 1), lo, hi)
                gain = -(gl * vl + (hl + 1) * vl**2 / 2) - ((G - gl) * vr + (H - hl + 1) * vr**2 / 2) + (G * value[i] / spec.rate + (H + 1) * (value[i] / spec.rate) ** 2 / 2)
                gain[(monotone[j] * (vr - vl) < 0) | (hl < 1e-3) | (H - hl < 1e-3)] = -1
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (float(gain[b]), (j, b, float(vl[b]), float(vr[b])))
        if best[1] is None:
            return
        j, b, vl, vr = best[1]
        feature[i], threshold[i] = j, float(cuts[j][b])
        child[i] = node()
        node()
        mid = (vl + vr) / 2
        bounds = {1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid)), 0: ((lo, hi), (lo, hi))}[monotone[j]]
        right = binned[j][rows] > b
        grow(child[i], rows[~right], g, h, depth + 1, *bounds[0])
        grow(child[i] + 1, rows[right], g, h, depth + 1, *bounds[1])

    for _ in range(spec.trees if len(x) else 1):
        roots.append(node())
        if len(x):
            grow(roots[-1], np.arange(len(x)), margin - y, np.ones(len(x)), 0, -8.0, 8.0)
        flat = FlatTrees(np.array(feature), np.array(threshold), np.array(child), np.array(value), np.array(roots), spec.depth)
        if len(x):
            margin = flat.score(x)
    return flat


def fit(df: DataFrame, doc_id: str, text: str, spec: RepetitionSpec) -> FlatTrees:
    """Train on about `sample_docs` documents (twice as many at most), taken evenly by a hash of their id, with their measured shares."""
    total = df.count()
    every = max(1, -(-total // spec.sample_docs))
    by_id, by_text = F.xxhash64(F.col(doc_id)), F.xxhash64(F.col(doc_id), F.col(text))
    sample = df.where(F.pmod(by_id, F.lit(every)) == 0).orderBy(by_text).limit(2 * spec.sample_docs).select(F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            words = Words(texts, spec)
            s = statistics(texts, spec, words)
            yield s[[*STATS]].assign(share=measured(texts, spec, words) / np.maximum(words.n, 1))

    rows = sample.mapInPandas(run, ", ".join(f"{c} double" for c in (*STATS, "share"))).toPandas()
    return train(rows[[*STATS]].to_numpy(float).reshape(-1, len(STATS)), rows["share"].to_numpy(float), list(STATS.values()), spec)


def repetition(df: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: RepetitionSpec = RepetitionSpec(), trees: FlatTrees | None = None, shares: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_repeated, share, score, is_repetitive.

    Words are runs of letters without case; in texts of mostly kana and kanji each letter is one. n_repeated counts the
    words in a passage of at least six (twelve) words that began earlier in the same text; share = n_repeated / n_words,
    zero without words (null, empty and blank texts). Without `shares` both are null for documents below the bar, which aren't
    measured. is_repetitive: the score reaches the bar and the exact check confirms a share at or above the threshold. Repeated
    rows each give a row; an empty table gives none. Texts of any length are processed whole.
    """
    src = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    trees = trees or fit(src, "doc_id", "text", spec)
    num, den = spec.share

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), 1000):
                part = b.iloc[start : start + 1000]
                texts = part["text"].tolist()
                words = Words(texts, spec)
                x = statistics(texts, spec, words)[[*STATS]].to_numpy(float)
                score = trees.score(x)
                flagged = score >= bars(trees, x, spec)
                repeated = measured(texts, spec, words) if shares else np.zeros(len(texts), np.int64)
                for i in np.flatnonzero(flagged):  # exact check of the selected
                    mine, letters = words_of(texts[i])
                    repeated[i] = repeated_words(mine, spec.passage_letters if letters else spec.passage_words)
                count, share = pd.Series(repeated, dtype="Int64"), pd.Series(repeated / np.maximum(words.n, 1), dtype="Float64")
                if not shares:
                    count[~flagged], share[~flagged] = pd.NA, pd.NA
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_words": words.n, "n_repeated": count, "share": share, "score": score, "is_repetitive": flagged & (den * repeated >= num * words.n) & (words.n > 0)})

    return src.mapInPandas(run, "doc_id bigint, n_words bigint, n_repeated bigint, share double, score double, is_repetitive boolean")
