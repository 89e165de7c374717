"""Corpus operators: against plain Python on the test tables, and edge cases."""

import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from timberline.llm import mixing, overlap, queries
from timberline.llm.overlap import SuffixSpec, coverage, cross_split_pairs, overlap_classes, texts_of, within_edits
from timberline.llm.repetition import STATS, RepetitionSpec, Words, bars, measured, repeated_words, repetition, statistics, train, words_of
from timberline.llm.runs import PrunedSegmentation, RunSpec, collapse_runs, word_distance
from timberline.llm.splits import connected_components, place, related_pairs, stratified_split
from timberline.llm.tokens import TOKENIZER_DIR, PairIndexEncoder, encode_corpus
from timberline.runtime import cut

T0 = datetime(2024, 1, 1)


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def table(d, sql):
    return duckdb.sql(sql.replace("@", d)).fetchall()


def test_p4_found(spark, tiny):
    assert found(queries.p4_found(spark, tiny)) == brute.near_pairs(table(tiny, "select seq_id, split_name, logline from '@/log_sequences.parquet'"))


def test_p5_found(spark, tiny):
    assert found(queries.p5_found(spark, tiny)) == brute.related(table(tiny, "select span_id, trace_id from '@/log_sequences.parquet'"))


def test_p6_found(spark, tiny):
    assert found(queries.p6_found(spark, tiny)) == brute.runs(table(tiny, "select record_id, ts, span_id, logline from '@/log_records.parquet'"))


def test_p10_found(spark, tiny):
    assert found(queries.p10_found(spark, tiny)) == brute.repetitive(table(tiny, "select doc_id, text from '@/documents.parquet'"))


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_p8_ids(spark, tiny):
    rows = table(tiny, "select doc_id, text from '@/documents.parquet'")
    expected = {i: e.ids for (i, _), e in zip(rows, library().encode_batch([t or "" for _, t in rows], add_special_tokens=False))}
    assert {r.doc_id: r.ids for r in queries.p8_ids(spark, tiny).collect()} == expected


SEQ = "seq_id bigint, split_name string, logline string, dataset_name string, tid string"


def random_text(rng, n):
    return [rng.choice(("alpha", "beta", "[sep]", str(rng.randrange(50)))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_of_random_edits(spark, seed):
    rng, rows = random.Random(seed), []
    for base in range(60):
        w = random_text(rng, rng.choice((1, 5, 8, 9, 10, 11, 18, 19, 20, 29, 35, 60, 120)))
        for copy in range(4):
            v = list(w)
            for _ in range(rng.randrange(0, len(w) // 9 + 2)):
                k = rng.randrange(len(v) + 1)
                op = rng.randrange(3)
                if op == 0:
                    v.insert(k, "new")
                elif v and k < len(v):
                    v[k : k + 1] = [] if op == 1 else ["other"]
            rows.append((len(rows), rng.choice(("train", "dev", "test")), rng.choice((" ", "  ", "\n")).join(v).upper() if copy % 2 else " ".join(v), "d", None))
    got = found(cross_split_pairs(spark.createDataFrame(rows, SEQ)).select("seq_a", "seq_b"))
    assert got == brute.near_pairs([r[:3] for r in rows])


def test_pairs_edge_cases(spark):
    long = " ".join(str(i) for i in range(20_000))
    rows = [
        (1, "train", "a b", "d", "x"), (1, "train", "a b", "d", "x"), (2, "dev", " A  B\n", "d", "x"), (3, "test", None, "d", None), (4, None, "a b", "d", None),
        (None, "dev", "a b", "d", None), (5, "train", "  ", "d", None), (6, "test", "", "d", None), (7, "train", long, "d", None), (8, "test", "0 " + long, "d", None), (9, "other", "a b", "d", None),
    ]
    df = spark.createDataFrame(rows, SEQ)
    assert found(cross_split_pairs(df).select("seq_a", "seq_b")) == {(1, 2), (5, 6), (7, 8)}
    cov = {r.seq_id: (r.n_words, r.covered_words) for r in coverage(df).collect()}
    assert cov == {2: (2, 0), 6: (0, 0), 8: (20001, 20000)}
    assert cross_split_pairs(df.limit(0)).count() == 0 and coverage(df.limit(0)).count() == 0


def candidates(spark, rows, spec=SuffixSpec()):
    texts = texts_of(overlap._read(spark.createDataFrame(rows, SEQ), "seq_id", "split_name", "logline", "train", ("dev", "test")))
    other, train_ = texts.where("in_other").select("tid", "h"), texts.where("in_train").select("tid", "h")
    counts = overlap._summed(other.mapInArrow(overlap._sketch(spec.segments), "cell int, c bigint"), len(spec.segments))
    segments = cut(train_.mapInArrow(overlap._rare_segments(spec, counts), overlap.SUFFIX_SCHEMA))
    seen = overlap._summed(segments.select("bucket").mapInArrow(overlap._bucket_sketch, "cell int, c bigint"))
    return segments.count(), other.mapInArrow(overlap._searched_suffixes(spec, counts, seen), overlap.SUFFIX_SCHEMA).count()


def test_texts_of_one_beginning_stay_apart(spark):
    """Templated texts: a common beginning of three fifths, in equal length. What meets grows with the texts, not their square."""
    rng, sizes = random.Random(2), []
    for n in (1000, 4000):
        rows = [(i, "train" if i % 2 else "dev", "a common beginning of every text here in this table of logs " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(8)), "d", None) for i in range(n)]
        sizes.append(candidates(spark, rows))
    assert sum(sizes[1]) <= 8 * max(sum(sizes[0]), 100)
    rows += [(10_000, "train", rows[0][2], "d", None), (10_001, "train", rows[2][2] + " more", "d", None)]
    assert found(cross_split_pairs(spark.createDataFrame(rows, SEQ)).select("seq_a", "seq_b")) == {(0, 10_000), (2, 10_001)}


def test_large_partitions_are_divided(spark):
    """The pairs don't depend on the bound of a partition's rows."""
    rng = random.Random(4)
    words_ = ["one", "two", "three"]
    rows = [(i, rng.choice(("train", "dev")), " ".join(rng.choice(words_) if k % 6 == 0 else "same" for k in range(20)), "d", None) for i in range(150)]
    df = spark.createDataFrame(rows, SEQ)
    a, b = (found(cross_split_pairs(df, spec=SuffixSpec(bucket_rows=n)).select("seq_a", "seq_b")) for n in (20_000, 3))
    assert a == b == brute.near_pairs([r[:3] for r in rows])
    c, d = ({(r.seq_id, r.covered_words) for r in coverage(df, spec=SuffixSpec(bucket_rows=n)).collect()} for n in (20_000, 3))
    assert c == d and len(c) == sum(r[1] == "dev" for r in rows)


@pytest.mark.parametrize("span", [3, 12, 13, 30])
def test_coverage_of_any_least_span(spark, span):
    shared = [f"s{i}" for i in range(40)]
    rows = [(1, "train", " ".join(shared), "d", None), (2, "dev", " ".join([*shared, "x"]), "d", None), (3, "dev", " ".join(shared[: span - 1]), "d", None)]
    got = {r.seq_id: r.covered_words for r in coverage(spark.createDataFrame(rows, SEQ), spec=SuffixSpec(min_span=span)).collect()}
    assert got == {2: 40, 3: 0}


def test_classes(spark):
    rows = [(i, "train" if i % 3 else "dev", "same words here again", "d", None) for i in range(60)] + [(99, "dev", "another text", "d", None)]
    classes, members = overlap_classes(spark.createDataFrame(rows, SEQ))
    assert found(classes) == {(0, 0, 0)}
    assert {(r.class_id, r.n_links) for r in members.where("seq_id < 60").collect()} == {(0, 1)} and members.count() == 61
    assert members.where("seq_id = 99").first().n_links == 0


def test_hot_copies(spark):
    """A third of all rows is one text."""
    rows = [(i, "train" if i % 3 else "dev", "same words here again", "d", None) for i in range(60)] + [(100 + i, "train" if i % 2 else "test", f"text {i} of its own", "d", None) for i in range(120)]
    assert cross_split_pairs(spark.createDataFrame(rows, SEQ)).count() == 20 * 40


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 6))
def test_bounded_edits(a, b, limit):
    assert within_edits(a, b, limit) == min(brute.edits(a, b), limit + 1)


SPAN = "seq_id bigint, span_id string, trace_id string, labels int, component string"


def test_related_spans(spark):
    rows = [(1, "a", "t1", 0, ""), (2, " A", "t2", 0, ""), (3, "b", "t2", 0, ""), (4, "c", "-", 0, ""), (5, "d", "-", 1, ""), (6, None, "t1", None, ""), (7, "e", "0000", 0, ""), (8, "f", "N/A ", 0, ""), (9, "g", " ", 0, ""), (10, "b", "t3", 0, ""), (11, "h", "t3", 5, "")]
    df = spark.createDataFrame(rows, SPAN)
    assert found(related_pairs(df)) == brute.related([(r[1], None if r[2] in ("0000", "N/A ") else r[2]) for r in rows])
    split = stratified_split(df)
    assert split.count() == len(rows)
    assert split.join(df, "seq_id").where("span_id in ('a', ' A', 'b', 'h')").select("new_split").distinct().count() == 1
    assert related_pairs(df.limit(0)).count() == 0 and stratified_split(df.limit(0)).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    edges = [(f"n{i:04}", f"n{i + 1:04}") for i in range(150)] + [("hub", f"x{i:04}") for i in range(500)] + [("q", "q")]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {f"n{i:04}": "n0000" for i in range(1, 151)} | {f"x{i:04}": "hub" for i in range(500)}


def test_split_shares_and_labels(spark):
    rng = random.Random(5)
    rows = [(i, "hub" if i % 3 == 0 else f"s{rng.randrange(900)}", None, int(rng.random() < 0.05), "") for i in range(6000)]
    df = spark.createDataFrame(rows, SPAN)
    s = stratified_split(df).join(df.select("seq_id", "span_id", "labels"), "seq_id")
    assert s.groupBy("span_id").agg({"new_split": "count"}).count() == s.select("span_id", "new_split").distinct().count()
    n = {r.new_split: (r.n, r.p) for r in s.groupBy("new_split").agg(__import__("pyspark.sql.functions", fromlist=["x"]).count("*").alias("n"), __import__("pyspark.sql.functions", fromlist=["x"]).avg("labels").alias("p")).collect()}
    for k, share in (("train", 0.8), ("dev", 0.1), ("test", 0.1)):
        assert abs(n[k][0] / 6000 - share) < 0.01 and abs(n[k][1] - sum(r[3] for r in rows) / 6000) < 0.01


def test_placing_rare_labels_first():
    v = np.array([[9, 1], [9, 1], [80, 0], [1, 0], [1, 0]])
    got = place(v, np.outer([0.8, 0.1, 0.1], v.sum(axis=0)), np.arange(5))
    assert got[2] == 0 and len(got) == 5 and (got >= 0).all()


LOG = "record_id bigint, ts timestamp_ntz, span_id string, logline string, n string"


def test_runs_edge_cases(spark):
    def at(i):
        return T0 + timedelta(hours=i)

    rows = [(i, at(i), "s", t, "") for i, t in enumerate(["A b 1", "a  B x9.", "a b 77", None, "a b 3", "a b", "q", "q.", " Q ", "", "", "  "])]
    rows += [(0, at(0), "s", "A b 1", ""), (50, None, "s", "q", ""), (51, at(3), " ", "q", ""), (None, at(3), "s", "zz", ""), (60, at(1), "u", "y" * 100_000, "")]
    out = {(r.span_id, r.first_id, r.last_id, r.n_events) for r in collapse_runs(spark.createDataFrame(rows, LOG), RunSpec(slice_seconds=7200)).collect()}
    assert out == {("s", 0, 4, 4), ("s", 5, 5, 1), ("s", 6, 8, 3), ("s", 9, 11, 3), ("u", 60, 60, 1)}
    assert collapse_runs(spark.createDataFrame([], LOG)).count() == 0


def segment(messages, weight, distance):
    seg, out = PrunedSegmentation(weight, distance), []
    for i, m in enumerate(messages):
        out += seg.push(m, i, i)
    return out + seg.finish()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30))
def test_equal_runs_are_maximal(messages):
    got = [(a, b) for _, a, b, *_ in segment(messages, 3.0, None)]
    cuts = [0] + [i for i in range(1, len(messages)) if messages[i] != messages[i - 1]] + [len(messages)]
    assert got == ([(a, b - 1) for a, b in zip(cuts, cuts[1:])] if messages else [])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a b c d", "a b c e", "a b x y", "q r s t"]), max_size=9), st.sampled_from([0.5, 1.5, 3.0]))
def test_pruned_optimum_is_the_optimum(messages, weight):
    def cost(i, j):
        return 1 + weight * min(sum(word_distance(m, r) for m in messages[i:j]) for r in messages[i:j])

    best = [0.0] + [float("inf")] * len(messages)
    for j in range(1, len(messages) + 1):
        best[j] = min(best[i] + cost(i, j) for i in range(j))
    got = sum(cost(a, b + 1) for _, a, b, *_ in segment(messages, weight, word_distance))
    assert got == pytest.approx(best[-1])


def test_near_runs(spark):
    rows = [(i, T0 + timedelta(minutes=i), "s", t, "") for i, t in enumerate(["disk full on alpha now"] * 3 + ["disk full on beta now"] + ["disk full on alpha now"] * 3 + ["link up"] * 2)]
    out = [(r.first_id, r.last_id) for r in collapse_runs(spark.createDataFrame(rows, LOG), RunSpec(near=True)).orderBy("first_id").collect()]
    assert out == [(0, 6), (7, 8)]


@pytest.mark.parametrize("near", [False, True])
def test_runs_do_not_depend_on_slices(spark, near):
    rng, rows, want = random.Random(11), [], {}
    kinds = ["disk full on alpha now", "disk full on beta now", "disk full on gamma", "link up", "link down again", "link up again"]
    for k in range(25):
        base = rng.choice(kinds)
        for i in range(40):
            base = rng.choice(kinds) if rng.random() < 0.3 else base
            rows.append((100 * k + i, T0 + timedelta(minutes=11 * i), f"s{k}", base if rng.random() < 0.8 else rng.choice(kinds[:3]), ""))
        mine = [r[3] for r in rows[-40:]]
        cost = lambda i, j, mine=mine: 1 + 3.0 * min(sum((word_distance(m, r) if near else float(m != r)) for m in mine[i:j]) for r in set(mine[i:j]))
        best = [0.0] + [float("inf")] * 40
        for j in range(1, 41):
            best[j] = min(best[i] + cost(i, j) for i in range(j))
        want[f"s{k}"] = (best[-1], cost)
    df, out = spark.createDataFrame(rows, LOG), []
    for hours in (1, 3, 48):
        got = collapse_runs(df, RunSpec(near=near, slice_seconds=3600 * hours)).collect()
        out.append({(r.span_id, r.first_id, r.last_id, r.n_events) for r in got})
        for k, (least, cost) in want.items():
            mine = sorted((r.first_id % 100, r.last_id % 100) for r in got if r.span_id == k)
            assert sum(cost(a, b + 1) for a, b in mine) == pytest.approx(least)
    assert out[0] == out[1] == out[2]


TEXTS = ["", " ", "\n\n  x", "hello hello", "<|endoftext|> a", "naïve café — „ß“", "日本語のテキスト", "ппппппп", "aaaaaaaaaaaaaaaa", "  tab\t\x1c\x85", "😀👍🏽", "x" * 5000, "don't WE'LL I'm", "123 456,789", "é́"]


def test_encoder_equals_library():
    enc = PairIndexEncoder(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    offsets, flat = enc.encode_batch(TEXTS)
    for i, t in enumerate(TEXTS):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == library().encode(t, add_special_tokens=False).ids, t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_encoder_round_trip(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    t, enc = _LIB, _ENC
    offsets, flat = enc.encode_batch(texts)
    for i, x in enumerate(texts):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids


_LIB, _ENC = library(), PairIndexEncoder(f"{TOKENIZER_DIR}/byte_bpe_50k.json")


def test_encode_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a", 0), (3, "a", 0), (None, "b", 0)], "doc_id bigint, text string, ids int")
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in encode_corpus(df).collect()) == [(0, (65,)), (1, ()), (2, ()), (3, (64,)), (3, (64,))]
    assert encode_corpus(df.limit(0)).count() == 0


DOC = "doc_id bigint, text string, source string, lang string"
TARGET = "doc_source string, target_share double, max_repeats int"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("sea", "ship", "market", "song")) for _ in range(rng.randrange(3, 60))), s, rng.choice(("en", "DE", "fra", None))) for i, s in enumerate(["big"] * 900 + ["mid"] * 250 + ["tiny"] * 10 + ["none"] * 40)]
    rows += [(5000, None, "big", "en"), (5001, "", "mid", "en"), (5002, "x", None, "en")]
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("tiny", 0.15, 2), ("absent", 0.05, 4), (None, 0.1, 1)], TARGET)
    sample, report = mixing.mix(docs(spark, rows), t)
    got = {r.source: r for r in report.collect()}
    assert got["tiny"].drawn_tokens == 2 * got["tiny"].tokens and got["tiny"].most_copies == 2  # all it can
    assert got["absent"].drawn_tokens == 0 == got["none"].drawn_tokens
    assert got["big"].most_copies == 1 and got["mid"].most_copies <= 3
    assert got["big"].drawn_tokens / got["mid"].drawn_tokens == pytest.approx(5 / 3, rel=0.03)
    assert sample.where("tokens = 0 or copies < 1").count() == 0
    empty = mixing.mix(docs(spark, []), t)
    assert empty[0].count() == 0 and empty[1].count() == 4
    assert mixing.mix(docs(spark, rows), t.limit(0))[0].count() == 0


def test_every_language_is_raked(spark):
    codes = ["en", "ENG", "en-US", "it", "ita", "nl_BE", "xx", "", None, "klingon", "1"]
    df = docs(spark, [(i, "some words", "big", c) for i, c in enumerate(codes)])
    got = {r.doc_id: r.l for r in df.select("doc_id", mixing.language(df["lang"]).alias("l")).collect()}
    assert [got[i] for i in range(len(codes))] == ["en", "en", "en", "it", "it", "nl", "xx", "other", "other", "other", "other"]
    t = spark.createDataFrame([("big", 1.0, 1)], TARGET)
    assert {r.lang for r in mixing.mix(df, t)[0].collect()} == {"en", "it", "nl", "xx", "other"}
    with pytest.raises(ValueError):
        mixing.mix(df, t, spec=mixing.MixSpec(most_cells=3))


def test_raking_meets_margins():
    import pandas as pd

    cells = pd.DataFrame([(s, l, t, n) for (s, n) in (("a", 100), ("b", 50)) for l in ("en", "de") for t in (0, 1)], columns=["source", "lang", "topic", "tokens"])
    f = mixing.rake(cells, {"a": 120.0, "b": 180.0}, {"a": 2.0, "b": 3.0}, 50)
    fit = cells["tokens"] * f
    assert fit[cells["source"] == "a"].sum() == pytest.approx(120) and fit[cells["source"] == "b"].sum() == pytest.approx(180)
    assert fit[cells["lang"] == "en"].sum() == pytest.approx(150)


def test_wanted_sizes():
    assert mixing.wanted_sizes(np.array([0.5, 0.3, 0.2]), np.array([100.0, 10.0, 0.0]), 80).tolist() == pytest.approx([70, 10, 0])
    assert mixing.wanted_sizes(np.array([0.5, 0.5]), np.array([10.0, 10.0]), 100).tolist() == [10, 10]


def test_topics_are_trained_on_all_documents(spark):
    # 4,200 documents in five topics, and a sixth of ten documents that a sample of every second one (by hash) misses
    words = [" ".join(f"t{t}w{j}" for j in range(12)) for t in range(6)]
    ids = spark.range(20_000).where("pmod(xxhash64(id), 2) = 1").orderBy("id").limit(10)
    rare = {r.id for r in ids.collect()}
    rows = [(i, words[5] if i in rare else words[i % 5], "s", "en") for i in range(4200)]
    m = mixing.measured(docs(spark, rows), "doc_id", "text", "source", "lang", mixing.MixSpec())
    sizes = sorted(r["count"] for r in m.groupBy("topic").count().collect())
    assert len(rare & set(range(4200))) == 10 and len(sizes) == 6 and sizes[0] == 10


def test_tokens_are_counted_as_encoded(spark):
    m = mixing.measured(docs(spark, [(i, t, "s", "en") for i, t in enumerate(TEXTS)]), "doc_id", "text", "source", "lang", mixing.MixSpec())
    ids = encode_corpus(docs(spark, [(i, t, "s", "en") for i, t in enumerate(TEXTS)]))
    assert {r.doc_id: r.tokens for r in m.collect()} == {r.doc_id: len(r.ids) for r in ids.collect()}


SPEC = RepetitionSpec()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab c.\nÄ日の1", max_size=120), max_size=4))
def test_statistics_equal_exact_counts(texts):
    s, repeated = statistics(texts, SPEC), measured(texts, SPEC)
    for t, n, r, pairs, distinct in zip(texts, s["n_words"], repeated, s["pair_share"], s["distinct_ratio"]):
        assert (n, r) == brute.repeated(t)
        if n:  # what the bar rests on
            assert pairs >= r / n * 5 / 6 - 1e-12 and distinct <= 1 - r / n + 1e-12
        w, cjk = words_of(t)
        assert repeated_words(w, 12 if cjk else 6) == r


def test_trees_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * rng.random(3000) > 0.7) & (x[:, 1] < 0.9)).astype(float)
    t = train(x, y, [1, -1, 0], RepetitionSpec(trees=15))
    base = rng.random((500, 3))
    for j, sign in ((0, 1), (1, -1)):
        hi = base.copy()
        hi[:, j] = np.minimum(1, hi[:, j] + 0.3)
        assert (sign * (t.score(hi) - t.score(base)) >= -1e-9).all()
    p = t.score(x) > 0.5
    assert (p == y).mean() > 0.9


def test_held_out_accuracy(tiny):
    """On documents the trees haven't seen, and whose repeated share they are not told: the bar loses none, and passes few others."""
    rows = table(tiny.replace("sf0.001", "sf0.1"), "select text from '@/documents.parquet'")
    texts = [r[0] for r in rows]
    s, n, r = statistics(texts, SPEC), Words(texts, SPEC).n, measured(texts, SPEC)
    x, y = s[[*STATS]].to_numpy(float), (10 * r >= 3 * n) & (n > 0)
    half = np.arange(len(x)) % 2 == 0
    t = train(x[half], (r / np.maximum(n, 1))[half], list(STATS.values()), SPEC)
    score = t.score(x[~half])
    assert ((score >= 0.3) == y[~half]).mean() > 0.99
    passed = score >= bars(t, x[~half], SPEC)
    assert passed[y[~half]].all() and passed.mean() < 0.25


def test_repetition_edge_cases(spark):
    once = "one two three four five six seven eight nine ten"
    df = docs(spark, [(1, None, "", ""), (2, "", "", ""), (3, " \n", "", ""), (4, once, "", ""), (5, f"{once}. {once.upper()}!", "", ""), (6, "あいうえおかきくけこさし" * 2, "", ""), (7, "1 2 3", "", ""), (8, f"{once} " * 3000, "", "")])
    got = {r.doc_id: (r.n_words, r.n_repeated, r.is_repetitive) for r in repetition(df).collect()}
    assert got == {1: (0, 0, False), 2: (0, 0, False), 3: (0, 0, False), 4: (10, 0, False), 5: (20, 10, True), 6: (24, 12, True), 7: (0, 0, False), 8: (30000, 29990, True)}
    assert {r.doc_id for r in repetition(df, shares=False).where("is_repetitive").collect()} == {5, 6, 8}
    assert repetition(df.limit(0)).count() == 0
