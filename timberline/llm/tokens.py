"""Encoding a corpus with a public byte-level BPE, by an index of pair occurrences (problem 8).

All distinct words of a batch are laid out in one array of symbols. An index maps every mergeable pair to all its
positions in that array; the ranks that occur are taken in ascending order, each pair is merged at all its positions at
once, and only the lists of the pairs beside a merge change. A merge can only create pairs of a higher rank (a pair's merge
comes after those of its parts), so every word gets the merges it would get on its own.

Map-side only: no shuffle. Words already seen by the worker are kept in a bounded memory.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: The published split of this vocabulary; white space is Unicode's White_Space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
REMEMBER = 200_000  # distinct words a worker keeps


def byte_symbols() -> list[str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class PairIndexEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.base = np.array([vocab[s] for s in byte_symbols()], np.int64)
        self.rank: dict[int, int] = {}  # pair (left << 20 | right) -> rank
        self.pairs: list[tuple[int, int, int]] = []  # rank -> left, right, merged
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[vocab[a] << 20 | vocab[b]] = r
            self.pairs.append((vocab[a], vocab[b], vocab[a + b]))
        self.split = regex.compile(WORDS)
        self.seen: dict[str, tuple[int, ...]] = {}

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.base[np.frombuffer(b"".join(raw), np.uint8)].tolist()
        n, ends = len(sym), np.cumsum(lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[lengths > 0] - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1
        after, before = after.tolist(), before.tolist()
        rank, at, active = self.rank, {}, []
        for i in range(n):
            j = after[i]
            if j >= 0 and (r := rank.get(sym[i] << 20 | sym[j])) is not None:
                if (places := at.get(r)) is None:
                    at[r] = [i]
                    active.append(r)
                else:
                    places.append(i)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            left, right, merged = self.pairs[r]
            places = at.pop(r)
            places.sort()  # overlapping occurrences of a pair merge from the left
            for i in places:
                j = after[i]
                if sym[i] != left or j < 0 or sym[j] != right:
                    continue  # a part of it went into another merge
                sym[i], sym[j] = merged, -1
                k, h = after[j], before[i]
                after[i] = k
                if k >= 0:
                    before[k] = i
                    if (q := rank.get(merged << 20 | sym[k])) is not None:
                        if q in at:
                            at[q].append(i)
                        else:
                            at[q] = [i]
                            heapq.heappush(active, q)
                if h >= 0 and (q := rank.get(sym[h] << 20 | merged)) is not None:
                    if q in at:
                        at[q].append(h)
                    else:
                        at[q] = [h]
                        heapq.heappush(active, q)
        out, start = [], 0
        for e in ends.tolist():
            out.append(tuple(s for s in sym[start:e] if s >= 0))
            start = e
        return out

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and flat ids of the texts; null and empty texts have no ids."""
        if len(self.seen) > REMEMBER:
            self.seen.clear()
        split = [self.split.findall(t) if t else () for t in texts]
        fresh = list({w for ws in split for w in ws if w not in self.seen})
        self.seen.update(zip(fresh, self.encode_words(fresh)))
        seen, flat, offsets = self.seen, [], np.zeros(len(texts) + 1, np.int64)
        for i, ws in enumerate(split):
            for w in ws:
                flat.extend(seen[w])
            offsets[i + 1] = len(flat)
        return offsets, np.array(flat, np.int32)


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, batch_docs: int = 2000) -> DataFrame:
    """doc_id and ids (ARRAY<INT>) of every row's text under a byte-level BPE, without special tokens.

    A null and an empty text give an empty list; strings of special tokens in a text are ordinary text. One row per input
    row (repeated rows stay); an empty table gives an empty table. `tokenizer` is the path of the vocabulary file, which
    every worker reads from its own disk.
    """
    path = tokenizer or os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PairIndexEncoder(path)
        for b in batches:
            for start in range(0, b.num_rows, batch_docs):
                part = b.slice(start, batch_docs)
                offsets, flat = enc.encode_batch(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    src = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id bigint, ids array<int>")
