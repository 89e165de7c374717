"""Same or nearly the same records across splits, by a partitioned suffix array (problem 4).

Records with the same words are one text. Suffixes of texts are partitioned by the words they begin with and sorted
within the partitions: together the sorted partitions are the suffix array of the concatenated texts (of suffixes cut
at `SuffixSpec.depth` words). Neighbours from different splits with a long common prefix are shared spans.

* `coverage`: every suffix of both sides takes part; a record's spans of at least `min_span` words that also stand in
  train are merged into the share of its words they cover.
* `near_pairs`: pairs within a word edit distance of a tenth. A text of n words and any partner differ by at most
  d = floor(n / 9) edits, so of any d + t of its disjoint segments at least t stand unchanged in the partner, moved by at most d
  words. Of each train text d + t segments enter the array, with the suffixes of the dev and test texts; shared spans
  that agree in place and length are merged per pair of texts, pairs whose merged spans cover fewer words than t segments
  are out, and an exact edit distance decides about the others. Nothing is dropped: the segments are the rarest of the text, of four,
  two or one words as makes them rarest, and rarity only chooses among equally good ones. So texts of one
  beginning, or of one template, meet only if all but a ninth of their words are common.

Scale: how often words occur comes from count sketches of fixed size (four of 2^22 bytes, the only things broadcast but for pairs
whose number has been checked). Suffixes
are also partitioned by blocks of text length and place, whose sizes follow the text's length (a train segment goes to the few
blocks its partners can be in); suffixes whose partition has no segment stay at home; partitions that are still too large
are divided into a grid, the segments of each row meeting the suffixes of each column. Copies never multiply the work:
pairs are made of distinct texts and expanded at the very end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.runtime import cut

CELLS = 1 << 22  # of each sketch, a byte each
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class SuffixSpec:
    depth: int = 12  # words of a suffix that are compared (at least; coverage takes min_span where that is more)
    segments: tuple[int, ...] = (4, 2, 1)  # words of a segment, the first that is rare enough or else the rarest
    witnesses: int = 2  # segments that must stand in the partner, where the text has as many to spare
    rare: int = 4  # occurrences a segment may have on the other side, on average, before a shorter one is tried
    length_block: int = 16
    place_block: int = 32
    bucket_rows: int = 20_000  # rows of each side of a partition before it is divided
    sent_pairs: int = 100_000  # pairs (of some 60 bytes) that are broadcast at most; more are joined by shuffles
    tenth: int = 10  # one edit for so many words of the longer text
    min_span: int = 8  # words of a shared span in coverage


def _texts(hashes: bool):
    """id, split, in_train and text -> tid (digest of the words) and, if wanted, h (64-bit hashes of the words).

    A word is what stands between white space, in lower case.
    """

    def words(c: pa.Array) -> pa.ListArray:
        if pc.all(pc.string_is_ascii(c), min_count=0).as_py():
            return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.ascii_lower(c)))  # a blank text: one empty word
        return pa.array([t.lower().split() or [""] for t in c.to_pylist()], pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = words(b.column(3))
            tids = pa.array([md5(x).digest() for x in pc.binary_join(w, " ").cast(pa.binary()).to_pylist()], pa.binary())
            if not hashes:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), tids], ["id", "split", "in_train", "tid"])
                continue
            coded = w.flatten().dictionary_encode()
            mine, at = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
            h, blank = pd.util.hash_array(mine, categorize=False).view(np.int64)[at], (mine == "")[at]
            n = w.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            n = n - np.bincount(np.repeat(np.arange(len(n)), n), blank, len(n)).astype(np.int64)
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
            yield pa.RecordBatch.from_arrays([tids, b.column(2), pa.ListArray.from_arrays(offsets, pa.array(h[~blank], pa.int64()))], ["tid", "in_train", "h"])

    return run


def _read(df: DataFrame, record_id: str, split: str, text: str, train: str, others: tuple[str, ...]) -> DataFrame:
    """id, split, in_train, s of the records that take part."""
    m = df.where(F.col(record_id).isNotNull() & F.col(text).isNotNull() & F.col(split).isin(train, *others))
    return m.select(F.col(record_id).alias("id"), F.col(split).alias("split"), (F.col(split) == train).alias("in_train"), F.col(text).cast("string").alias("s"))


def members_of(m: DataFrame) -> DataFrame:
    """id, split, in_train, tid; a row for each record (repeated rows are repeated)."""
    return m.mapInArrow(_texts(False), f"id {dict(m.dtypes)['id']}, split string, in_train boolean, tid binary")


def texts_of(m: DataFrame) -> DataFrame:
    """tid, h (word hashes), in_train, in_other; a row for each distinct text, written once."""
    t = m.mapInArrow(_texts(True), "tid binary, in_train boolean, h array<bigint>").groupBy("tid")
    return cut(t.agg(F.first("h").alias("h"), F.max("in_train").alias("in_train"), F.max(~F.col("in_train")).alias("in_other")))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of all lists, length and start of each."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), n, np.cumsum(n) - n


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on (places without k words left get what is there)."""
    out = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(k, len(h))):
            out[: len(h) - j] = out[: len(h) - j] * _M1 + h[j:]
        out ^= out >> np.uint64(29)
        out *= _M2
        out ^= out >> np.uint64(32)
    return out


def _suffixes(h: np.ndarray, at: np.ndarray, left: np.ndarray, depth: int) -> pa.Array:
    """Suffixes as bytes that sort like their words: 4 bytes a word, zeros after the text's end."""
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
    idx = at[:, None] + np.arange(depth)
    inside = np.arange(depth) < left[:, None]
    m = np.where(inside, low[np.minimum(idx, max(len(h) - 1, 0))], 0).astype(">u4")
    offsets = pa.py_buffer((np.arange(len(at) + 1) * 4 * depth).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(m.tobytes())])


def _blocks(n: np.ndarray, spec: SuffixSpec) -> tuple[np.ndarray, np.ndarray]:
    """Block sizes of length and place for texts of n words: of one size between powers of two, and an eighth of the text at
    least, so that a partner's length and a segment's place fall in a few blocks whatever the length."""
    scale = 1 << np.maximum(np.frexp(np.maximum(n, 1).astype(float))[1] - 1, 0).astype(np.int64)
    return np.maximum(spec.length_block, scale // 8), np.maximum(spec.place_block, scale // 8)


def _parts(b: pa.RecordBatch, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many words (a longer text is a slice of its own)."""
    upto = np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield b.slice(at, to - at)
        at = to


def _bucket(key: np.ndarray, lb: np.ndarray, pb: np.ndarray, size: np.ndarray | int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        b = (key + lb.astype(np.uint64) * _M1) ^ ((pb.astype(np.uint64) + np.uint64(1 << 40) * np.asarray(size, np.uint64)) * _M2)
        b *= _M1
    return b.view(np.int64)


CHUNK = 100_000  # suffixes laid out at once
SUFFIX_SCHEMA = "bucket bigint, suffix binary, tid binary, place int, n int, slack int, need int, least int, often bigint"
_SUFFIX_NAMES = ["bucket", "suffix", "tid", "place", "n", "slack", "need", "least", "often"]


def _rows(bucket, suffix, tids, place, n, slack, need, least, often) -> pa.RecordBatch:
    """need: words a partner must share (0: this side is searched); least: words all spans of a pair must cover; often: how many
    suffixes of the searched side begin like this one, at most."""
    ints = [pa.array(np.broadcast_to(x, len(bucket)), pa.int32()) for x in (place, n, slack, need, least)]
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), suffix, tids, *ints, pa.array(np.broadcast_to(often, len(bucket)), pa.int64())], _SUFFIX_NAMES)


def _places(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of every word."""
    doc = np.repeat(np.arange(len(n)), n)
    return doc, np.arange(len(doc)) - (np.cumsum(n) - n)[doc]


# A counter is a byte: up to 15 as it is, beyond that four bits of mantissa and four of exponent, rounded up.
COUNT = np.array([c if c < 16 else (16 + c % 16) << (c // 16 - 1) for c in range(256)], np.int64)


def _counted(cells: Iterator[np.ndarray], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Partial counts (cell, c) of the cells, in pieces of bounded memory."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        cell, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(c, pa.int64())], ["cell", "c"])

    for x in cells:
        held.append(x)
        size += len(x)
        if size > most:
            yield flush()
            held, size = [], 0
    yield flush()


def _cell(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint64) % np.uint64(CELLS)).astype(np.int64)


def _sketch(lengths: tuple[int, ...]):
    """Counts of all beginnings of some lengths, by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells() -> Iterator[np.ndarray]:
            for part in (p for b in batches for p in _parts(b)):
                h, n, _ = _flat(part.column(1))
                doc, place = _places(n)
                for i, q in enumerate(lengths):
                    yield i * CELLS + _cell(_mixed(h, q)[n[doc] - place >= q])

        yield from _counted(cells())

    return run


def _bucket_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _counted(_cell(b.column(0).to_numpy()) for b in batches)


def _summed(counts: DataFrame, sketches: int = 1):
    """The broadcast sum of partial counts (cell, c) as COUNT codes: a byte for each of `sketches` * CELLS cells. They reach the driver
    as a few binary rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.minimum(np.searchsorted(COUNT, b.column(1).to_numpy()), 255)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (b.column(0).to_numpy().astype("<i4").tobytes(), code.astype(np.uint8).tobytes())], ["cells", "codes"])

    total = np.zeros(sketches * CELLS, np.uint8)
    for r in counts.groupBy("cell").agg(F.sum("c").alias("c")).mapInArrow(pack, "cells binary, codes binary").collect():
        total[np.frombuffer(r["cells"], "<i4")] = np.frombuffer(r["codes"], np.uint8)
    return counts.sparkSession.sparkContext.broadcast(total)


def _grid(seen: np.ndarray, often: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts of a partition's segments and of its suffixes, from (upper bounds of) their numbers: one, unless both together are many."""
    large = seen.astype(float) * often > float(rows) ** 2
    return np.where(large, -(-seen // rows), 1).astype(np.int64), np.where(large, -(-often // rows), 1).astype(np.int64)


def _spread(own: np.ndarray, across: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and places so that row r comes across[r] times, with places 0, 1, ..."""
    r = np.repeat(own, across)
    return r, np.arange(len(r)) - np.repeat(np.cumsum(across) - across, across)


def _divided(bucket: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        b = bucket.view(np.uint64) + (i.astype(np.uint64) * _M1) ^ (j.astype(np.uint64) * _M2)
    return np.where((i == 0) & (j == 0), bucket, b.view(np.int64))


def _hash_of(tids: pa.Array) -> np.ndarray:
    """Eight bytes of each text id."""
    return np.frombuffer(b"".join(x[:8] for x in tids.to_pylist()), np.uint64)


def _searched_suffixes(spec: SuffixSpec, counts, seen):
    """Suffixes of the searched side, once for each length of segment, if there are segments in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, held = counts.value, seen.value
        for b in batches:
            for part in _parts(b):
                h, n, _ = _flat(part.column(1))
                doc, place = _places(n)
                lsize, psize = _blocks(n, spec)
                for i, q in enumerate(spec.segments):
                    at = np.flatnonzero(n[doc] - place >= q)
                    key, dc = _mixed(h, q)[at], doc[at]
                    bucket = _bucket(key, n[dc] // lsize[dc], place[at] // psize[dc], lsize[dc])
                    there = COUNT[held[_cell(bucket)]]
                    hit = np.flatnonzero(there)
                    if not len(hit):
                        continue
                    at, dc, bucket, there = at[hit], dc[hit], bucket[hit], there[hit]
                    mine = COUNT[often[i * CELLS + _cell(key[hit])]]
                    rows, columns = _grid(there, mine, spec.bucket_rows)
                    for c in range(0, len(at), CHUNK):
                        r, row = _spread(np.arange(c, min(c + CHUNK, len(at))), rows[c : c + CHUNK])
                        column = at[r] % columns[r] if (columns > 1).any() else np.zeros(len(r), np.int64)
                        a, d = at[r], dc[r]
                        yield _rows(_divided(bucket[r], row, column), _suffixes(h, a, n[d] - place[a], spec.depth), part.column(0).take(pa.array(d)), place[a], n[d], 0, 0, 0, 0)

    return run


def _rare_segments(spec: SuffixSpec, counts):
    """Of each text the d + t segments that are rarest on the searched side, sent to every block a partner can be in.

    Segments that don't occur there at all need not be sent: no partner holds them.
    """

    def choose(h, n, start, d, often) -> tuple[np.ndarray, ...]:
        best, length = np.full(len(n), np.inf), np.zeros(len(n), np.int64)
        found, todo = [], np.flatnonzero(d > 0)  # texts without room for an edit have equal partners only
        for i, q in enumerate(spec.segments):
            k = n[todo] // q
            t = np.minimum(spec.witnesses, k - d[todo])
            doc, place = _places(k)
            place = place * q
            key = _mixed(h, q)[start[todo[doc]] + place]
            c = COUNT[often[i * CELLS + _cell(key)]]
            order = np.argsort((doc << 32) | c, kind="stable")
            rank = np.arange(len(doc)) - (np.cumsum(k) - k)[doc]
            order = order[rank < (d[todo] + t)[doc]]
            cost = np.where(t > 0, np.bincount(doc[order], c[order], len(todo)), np.inf)
            better = cost < best[todo]
            best[todo[better]], length[todo[better]] = cost[better], q
            order = order[c[order] > 0]
            found.append((todo[doc[order]], place[order], key[order], c[order], np.full(len(order), q), (t * q)[doc[order]]))
            todo = todo[best[todo] > spec.rare * (d[todo] + np.maximum(t, 1))]
        cols = [np.concatenate(x) for x in zip(*found)]
        return tuple(x[cols[4] == length[cols[0]]] for x in cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for b in batches:
            for part in _parts(b):
                h, n, start = _flat(part.column(1))
                d = n // (spec.tenth - 1)
                doc, place, key, c, q, least = choose(h, n, start, d, often)
                # partners are of lengths n - d to n + d, which two block sizes at most share
                sizes = [_blocks(np.maximum(n - d, 1), spec), _blocks(n + d, spec)]
                for side in (0, 1):
                    lsize, psize = sizes[side]
                    own = np.flatnonzero((sizes[1][0] != sizes[0][0])[doc]) if side else np.arange(len(doc))
                    for at in range(0, len(own), CHUNK // 16):
                        r0 = own[at : at + CHUNK // 16]
                        x = doc[r0]
                        lo_n, hi_n = (n - d)[x] // lsize[x], (n + d)[x] // lsize[x]
                        lo_p, hi_p = np.maximum(place[r0] - d[x], 0) // psize[x], (place[r0] + d[x]) // psize[x]
                        wide = hi_p - lo_p + 1
                        r, i = _spread(np.arange(len(r0)), (hi_n - lo_n + 1) * wide)
                        if not len(r):
                            continue
                        y, z = x[r], r0[r]
                        bucket = _bucket(key[z], lo_n[r] + i // wide[r], lo_p[r] + i % wide[r], lsize[y])
                        yield _rows(bucket, _suffixes(h, start[y] + place[z], n[y] - place[z], spec.depth), part.column(0).take(pa.array(y)), place[z], n[y], d[y], q[z], least[z], c[z])

    return run


def _covering_suffixes(spec: SuffixSpec, counts, train: bool):
    """Every suffix of at least min_span words: of train to all parts of its partition, of the searched side to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, q = counts.value, spec.min_span
        for b in batches:
            for part in _parts(b):
                h, n, _ = _flat(part.column(1))
                doc, place = _places(n)
                every, keys = np.flatnonzero(n[doc] - place >= q), _mixed(h, q)
                for c in range(0, len(every), CHUNK):
                    at = every[c : c + CHUNK]
                    parts = -(-COUNT[often[_cell(keys[at])]] // spec.bucket_rows)
                    if train:
                        r, i = _spread(np.arange(len(at)), parts)  # none, if no text of the other side has this beginning
                        at = at[r]
                    else:
                        i = (at * 31 + doc[at]) % np.maximum(parts, 1)
                    if not len(at):
                        continue
                    d, zero = doc[at], np.zeros(len(at), np.int64)
                    yield _rows(_divided(keys[at].view(np.int64), i, zero), _suffixes(h, at, n[d] - place[at], spec.depth), part.column(0).take(pa.array(d)), place[at], n[d], 0, q if train else 0, 0, 0)

    return run


def _divide_segments(spec: SuffixSpec, seen):
    """Segments of partitions that are too large go to one row of the partition's grid, and to all its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = seen.value
        for b in batches:
            bucket = b.column(0).to_numpy()
            there = COUNT[held[_cell(bucket)]]
            rows, columns = _grid(there, b.column(8).to_numpy(), spec.bucket_rows)
            if (rows * columns > 1).any():
                r, column = _spread(np.arange(len(bucket)), columns)
                row = (_hash_of(b.column(2)) % rows.astype(np.uint64)).astype(np.int64)[r]
                b = b.take(pa.array(r)).set_column(0, "bucket", pa.array(_divided(bucket[r], row, column), pa.int64()))
            yield b

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in pieces that end between buckets."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left")) if key[0] <= key[-1] else 0
        if cut or held and held[-1].column(0)[held[-1].num_rows - 1].as_py() != key[0]:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(t: pa.Table, depth: int) -> np.ndarray:
    c = t.column("suffix").combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    _, off, data = c.buffers()
    o = np.frombuffer(off, np.int32)[c.offset : c.offset + len(c) + 1]
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]].reshape(len(c), 4 * depth).view(">u4")


def _common(m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length in words of the common prefix of rows a and b (zeros after a text's end don't count)."""
    same = (m[a] == m[b]) & (m[a] != 0)
    return np.where(same.all(axis=1), m.shape[1], same.argmin(axis=1))


def _spans_of_pairs(spec: SuffixSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _buckets(batches):
            bucket, need = t.column("bucket").to_numpy(), t.column("need").to_numpy()
            place, n, slack, least = (t.column(c).to_numpy() for c in ("place", "n", "slack", "least"))
            if not len(bucket) or not (need > 0).any() or not (need == 0).any():
                continue
            m, tid = _matrix(t, spec.depth), t.column("tid").combine_chunks()
            rows = np.arange(len(bucket))
            lcp = np.concatenate(([0], np.where(bucket[1:] == bucket[:-1], _common(m, rows[1:], rows[:-1]), 0)))
            for q in np.unique(need[need > 0]):
                group = np.cumsum(lcp < q)
                seg, oth = np.flatnonzero(need == q), np.flatnonzero(need == 0)
                first, stop = np.searchsorted(group[oth], group[seg], "left"), np.searchsorted(group[oth], group[seg], "right")
                size = stop - first
                seg, first, size = seg[size > 0], first[size > 0], size[size > 0]
                upto = np.cumsum(size)
                at = 0
                while at < len(seg):  # about two million pairs at a time
                    to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 2_000_000, "right")))
                    sz = size[at:to]
                    a = np.repeat(seg[at:to], sz)
                    b = oth[np.repeat(first[at:to], sz) + np.arange(sz.sum()) - np.repeat(np.cumsum(sz) - sz, sz)]
                    ok = (np.abs(place[a] - place[b]) <= slack[a]) & (np.abs(n[a] - n[b]) <= slack[a])
                    a, b = a[ok], b[ok]
                    if len(a):
                        span = _common(m, a, b)
                        cols = [tid.take(pa.array(a)), tid.take(pa.array(b)), pa.array(place[b], pa.int32()), pa.array(span, pa.int32()), pa.array(least[a], pa.int32())]
                        yield from pa.Table.from_arrays(cols, ["tid_a", "tid_b", "place", "span", "least"]).to_batches()
                    at = to

    return run


def _spans_in_train(spec: SuffixSpec):
    """For each searched suffix the longest common prefix with a train suffix: one of its two nearest in the array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _buckets(batches):
            need, bucket, place = t.column("need").to_numpy(), t.column("bucket").to_numpy(), t.column("place").to_numpy()
            if not len(need) or not (need > 0).any() or not (need == 0).any():
                continue
            m, rows = _matrix(t, spec.depth), np.arange(len(need))
            before = np.maximum.accumulate(np.where(need > 0, rows, -1))
            behind = np.minimum.accumulate(np.where(need > 0, rows, len(rows))[::-1])[::-1]
            at = np.flatnonzero(need == 0)
            best = np.zeros(len(at), np.int64)
            for near in (before[at], behind[at]):
                safe = np.clip(near, 0, len(rows) - 1)
                ok = (near >= 0) & (near < len(rows)) & (bucket[safe] == bucket[at])
                best = np.maximum(best, np.where(ok, _common(m, at, safe), 0))
            hit = at[best >= spec.min_span]
            if len(hit):
                tid = t.column("tid").combine_chunks()
                cols = [tid.take(pa.array(hit)), pa.array(place[hit], pa.int32()), pa.array(best[best >= spec.min_span], pa.int32())]
                yield from pa.Table.from_arrays(cols, ["tid", "place", "span"]).to_batches()

    return run


def _array_of(rows: DataFrame) -> DataFrame:
    """The suffix array: partitioned by beginning, sorted within."""
    return rows.repartition("bucket").sortWithinPartitions("bucket", "suffix")


def merged_length(spans: Column) -> Column:
    """Words covered by an array of structs (place, span), sorted by place."""
    acc = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("covered"))

    def step(a: Column, s: Column) -> Column:
        end = s["place"] + s["span"]
        return F.struct(F.greatest(a["upto"], end).alias("upto"), (a["covered"] + F.greatest(F.lit(0), end - F.greatest(a["upto"], s["place"]))).alias("covered"))

    return F.aggregate(F.array_sort(spans), acc, step, lambda a: a["covered"])


def within_edits(a: list[int], b: list[int], limit: int) -> int:
    """Word edit distance, or limit + 1 if it is larger: a column of the table at a time, as differences in the bits of an integer."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    i, na, nb = 0, len(a), len(b)
    while i < na and i < nb and a[i] == b[i]:
        i += 1
    while na > i and nb > i and a[na - 1] == b[nb - 1]:
        na, nb = na - 1, nb - 1
    a, b = a[i:na], b[i:nb]
    if not a or not b:
        return min(max(len(a), len(b)), limit + 1)
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    whole, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, edits = whole, 0, len(a)
    for left, x in zip(range(len(b) - 1, -1, -1), b):
        same = at.get(x, 0)
        d = (((same & up) + up) ^ up) | same | down
        more, less = down | (whole & ~(d | up)), up & d
        if more & last:
            edits += 1
        elif less & last:
            edits -= 1
        if edits - left > limit:  # each column left takes away one at most
            return limit + 1
        more, less = (more << 1 | 1) & whole, less << 1 & whole
        v = same | down
        up, down = less | (whole & ~(v | more)), more & v
    return min(edits, limit + 1)


def near_pairs(texts: DataFrame, spec: SuffixSpec = SuffixSpec()) -> DataFrame:
    """Pairs of different texts (tid_a in train, tid_b in another split) within a tenth: with edits, n_words, covered (words of the
    merged spans of the segments that entered the array)."""
    other = texts.where("in_other").select("tid", "h")
    train = texts.where("in_train").select("tid", "h")
    counts = _summed(other.mapInArrow(_sketch(spec.segments), "cell int, c bigint"), len(spec.segments))
    segments = cut(train.mapInArrow(_rare_segments(spec, counts), SUFFIX_SCHEMA))
    seen = _summed(segments.select("bucket").mapInArrow(_bucket_sketch, "cell int, c bigint"))
    rows = segments.mapInArrow(_divide_segments(spec, seen), SUFFIX_SCHEMA).unionByName(other.mapInArrow(_searched_suffixes(spec, counts, seen), SUFFIX_SCHEMA))
    spans = _array_of(rows).mapInArrow(_spans_of_pairs(spec), "tid_a binary, tid_b binary, place int, span int, least int").where("tid_a <> tid_b")
    pairs = spans.groupBy("tid_a", "tid_b").agg(merged_length(F.collect_set(F.struct("place", "span"))).alias("covered"), F.max("least").alias("least")).where("covered >= least").drop("least")
    pairs = cut(pairs)
    # the texts of a pair meet under its name; few pairs go to the texts, not the texts through a shuffle to them
    side = lambda k, i: F.struct(F.col(k).alias("tid"), F.lit(i).alias("side"))
    wanted = pairs.withColumn("s", F.explode(F.array(side("tid_a", 0), side("tid_b", 1)))).select("s.*", "tid_a", "tid_b", "covered")
    whole = texts.select("tid", "h").join(_sent(wanted, pairs, spec), "tid").groupBy("tid_a", "tid_b")
    of = lambda i: F.first(F.when(F.col("side") == i, F.col("h")), ignorenulls=True)
    pairs = whole.agg(F.max("covered").alias("covered"), of(0).alias("a"), of(1).alias("b"))
    tenth = spec.tenth

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            edits = [within_edits(a.tolist(), b.tolist(), max(len(a), len(b)) // tenth) for a, b in zip(p["a"], p["b"])]
            n = np.array([max(len(a), len(b)) for a, b in zip(p["a"], p["b"])], np.int64)
            p = p.assign(edits=edits, n_words=n)
            yield p.loc[p["edits"] <= n // tenth, ["tid_a", "tid_b", "edits", "n_words", "covered"]]

    return pairs.mapInPandas(decide, "tid_a binary, tid_b binary, edits int, n_words bigint, covered int")


def _linked(texts: DataFrame, spec: SuffixSpec) -> DataFrame:
    same = texts.where("in_train and in_other").select(F.col("tid").alias("tid_a"), F.col("tid").alias("tid_b"), F.lit(0).alias("edits"))
    return near_pairs(texts, spec).select("tid_a", "tid_b", "edits").unionByName(same)


def _sent(small: DataFrame, counted: DataFrame, spec: SuffixSpec) -> DataFrame:
    """Broadcast what belongs to links or pairs, if they are few enough."""
    return F.broadcast(small) if counted.count() <= spec.sent_pairs else small


def cross_split_pairs(df: DataFrame, record_id: str = "seq_id", split: str = "split_name", text: str = "logline", train: str = "train", others: tuple[str, ...] = ("dev", "test"), spec: SuffixSpec = SuffixSpec()) -> DataFrame:
    """Every pair of records, one in train and one in another split, with the same or nearly the same words.

    Columns seq_a < seq_b (record ids) and edits. Near: letter case and white space aside, at most a tenth of the longer
    text's words inserted, deleted or replaced. Rows with null id, text or another split take no part; blank texts are equal
    to each other. Repeated rows count once. An empty table gives no rows; other columns aren't read.
    """
    m = _read(df, record_id, split, text, train, others)
    link = cut(_linked(texts_of(m), spec))
    sent = _sent(link, link, spec)
    of = lambda rows, i: members_of(rows).select(F.col("id").alias(f"id_{i}"), F.col("tid").alias(f"tid_{i}")).join(sent, f"tid_{i}").distinct()
    p = of(m.where("in_train"), "a").join(of(m.where("not in_train"), "b").drop("edits"), ["tid_a", "tid_b"]).where("id_a <> id_b")
    return p.select(F.least("id_a", "id_b").alias("seq_a"), F.greatest("id_a", "id_b").alias("seq_b"), "edits")


def overlap_classes(df: DataFrame, record_id: str = "seq_id", split: str = "split_name", text: str = "logline", train: str = "train", others: tuple[str, ...] = ("dev", "test"), spec: SuffixSpec = SuffixSpec()) -> tuple[DataFrame, DataFrame]:
    """The same links without expanded copies: (classes, members).

    A class is the records with the same words, named after its least record id. classes: class_a (in train), class_b (in another
    split), edits, one row per link between classes (equal if copies stand on both sides). members: seq_id, split_name,
    class_id and n_links, the classes of the other side it is linked to; one row per record that takes part.
    """
    m = _read(df, record_id, split, text, train, others)
    members, texts = cut(members_of(m).distinct()), texts_of(m)
    names = members.groupBy("tid").agg(F.min("id").alias("name"))
    link = cut(_linked(texts, spec))
    named = link.join(names.select(F.col("tid").alias("tid_a"), F.col("name").alias("class_a")), "tid_a").join(names.select(F.col("tid").alias("tid_b"), F.col("name").alias("class_b")), "tid_b")
    both = link.select(F.col("tid_a").alias("tid"), F.lit(True).alias("in_train")).unionByName(link.select(F.col("tid_b").alias("tid"), F.lit(False).alias("in_train")))
    n = both.groupBy("tid", "in_train").agg(F.count("*").alias("n_links"))
    of = members.join(names, "tid").join(n, ["tid", "in_train"], "left")
    return named.select("class_a", "class_b", "edits"), of.select(F.col("id").alias("seq_id"), F.col("split").alias("split_name"), F.col("name").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def overlap_report(df: DataFrame, record_id: str = "seq_id", split: str = "split_name", text: str = "logline", source: str = "dataset_name", train: str = "train", others: tuple[str, ...] = ("dev", "test"), spec: SuffixSpec = SuffixSpec()) -> DataFrame:
    """Per split and source: records, records that overlap train, those that are equal, and pairs; copies aren't expanded."""
    m = _read(df, record_id, split, text, train, others)
    members, texts = cut(members_of(m).distinct()), texts_of(m)
    in_train = members.where("in_train").groupBy("tid").agg(F.count("*").alias("copies"))
    per = _linked(texts, spec).join(in_train.withColumnRenamed("tid", "tid_a"), "tid_a").groupBy("tid_b").agg(F.sum("copies").alias("pairs"), F.max((F.col("tid_a") == F.col("tid_b")).cast("int")).alias("same"))
    src = df.where(F.col(record_id).isNotNull()).select(F.col(record_id).alias("id"), F.col(split).alias("split"), F.col(source).alias("source")).distinct()
    m = members.where(~F.col("in_train")).join(per.withColumnRenamed("tid_b", "tid"), "tid", "left").join(src, ["id", "split"])
    return m.groupBy(F.col("split").alias("split_name"), F.col("source").alias("dataset_name")).agg(
        F.count("*").alias("n_records"),
        F.count("pairs").alias("n_overlapping"),
        F.coalesce(F.sum("same"), F.lit(0)).alias("n_same"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"),
    )


def coverage(df: DataFrame, record_id: str = "seq_id", split: str = "split_name", text: str = "logline", train: str = "train", others: tuple[str, ...] = ("dev", "test"), spec: SuffixSpec = SuffixSpec()) -> DataFrame:
    """One row per record outside train: seq_id, split_name, n_words, covered_words, share of words in spans (of at least
    `min_span` words) that stand in train too. Records without words have share zero."""
    spec = replace(spec, depth=max(spec.depth, spec.min_span))
    m = _read(df, record_id, split, text, train, others)
    members, texts = members_of(m).distinct(), texts_of(m)
    in_train, in_other = (texts.where(c).select("tid", "h") for c in ("in_train", "in_other"))
    counts = _summed(in_other.mapInArrow(_sketch((spec.min_span,)), "cell int, c bigint"))
    # equal suffixes of train are one; a beginning that is frequent on the other side is spread, and train's suffixes with it
    train_rows = in_train.mapInArrow(_covering_suffixes(spec, counts, True), SUFFIX_SCHEMA).groupBy("bucket", "suffix").agg(*[F.min(c).alias(c) for c in ("place", "n", "slack", "need", "least", "often")])
    train_rows = train_rows.withColumn("tid", F.lit(None).cast("binary"))
    other_rows = in_other.mapInArrow(_covering_suffixes(spec, counts, False), SUFFIX_SCHEMA)
    spans = _array_of(train_rows.unionByName(other_rows)).mapInArrow(_spans_in_train(spec), "tid binary, place int, span int")
    cov = spans.groupBy("tid").agg(merged_length(F.collect_set(F.struct("place", "span"))).alias("c"))
    t = texts.where("in_other").select("tid", F.size("h").alias("n_words")).join(cov, "tid", "left")
    out = members.where(~F.col("in_train")).join(t, "tid")
    c = F.coalesce(F.col("c"), F.lit(0)).cast("bigint")
    return out.select(F.col("id").alias("seq_id"), F.col("split").alias("split_name"), F.col("n_words").cast("bigint").alias("n_words"), c.alias("covered_words"), F.when(F.col("n_words") > 0, c / F.col("n_words")).otherwise(0.0).alias("share"))
