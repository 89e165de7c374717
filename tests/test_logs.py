"""Log operators: oracle comparison at the smallest scale, hand-made cases, and the decisions on quirks (named q<number>)."""

import random
import re
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import brute
from timberline.config import Config, DataLoaderConfig, OpenSetADWorkflowConfig, PreprocessorConfig, WorkFlowConfig, read_config
from timberline.functions import text as T
from timberline.functions.timebuckets import bucket_start, datetime_pattern, parse_time, width_micros
from timberline.operators import cluster, counters, detect, drill, encode, evaluate, splits, vectorize, windows
from timberline.operators.clean import clean, clean_bgl, clean_hdfs, clean_open_set
from timberline.operators.positions import with_position
from timberline.parsing.ael import AELParams, ael
from timberline.parsing.drain import DrainParams, TokenCountTree, drain
from timberline.parsing.model import LogParser
from timberline.parsing.iplom import IPLoMParams, iplom
from timberline.plans import logs
from timberline.record import LogRecord
from timberline.registry import Registry, registry
from timberline.sources.formats import line_pattern, preset
from timberline.sources.readers import load, read_text

T0 = datetime(2024, 1, 1)


def col(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c"))).first()[0]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if not isinstance(v, (int, type(None))) else v


@pytest.mark.parametrize("name", sorted(logs.ORACLE))
def test_equals_sql(spark, tiny, name):
    df = logs.QUERIES[name](spark, tiny)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in ("log_records", "log_sequences", "events", "embeddings"):
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    r = con.execute(logs.ORACLE[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    theirs = sorted(repr([plain(row[names.index(c)]) for c in cols]) for row in r.fetchall())
    assert sorted(repr([plain(row[c]) for c in cols]) for row in df.collect()) == theirs


# --- time


def test_widths():
    assert [width_micros(a) // 10**6 for a in ("s", "15s", "5min", "1h", "2H", "1d", "T")] == [1, 15, 300, 3600, 7200, 86400, 60]
    for bad in ("5x", "M", "", "0s"):
        with pytest.raises(ValueError):
            width_micros(bad)


def test_buckets(spark):
    ts = datetime(2023, 5, 17, 10, 7, 59)
    assert col(spark, ts, lambda c: bucket_start(c, "5min"), "timestamp_ntz") == datetime(2023, 5, 17, 10, 5)
    assert col(spark, ts, lambda c: bucket_start(c, "5min", "right"), "timestamp_ntz") == datetime(2023, 5, 17, 10, 10)
    assert col(spark, datetime(1969, 12, 31, 23, 59), lambda c: bucket_start(c, "1h"), "timestamp_ntz") == datetime(1969, 12, 31, 23)
    assert col(spark, ts, lambda c: bucket_start(c, "M"), "timestamp_ntz") == datetime(2023, 5, 1)
    assert col(spark, None, lambda c: bucket_start(c, "5min"), "timestamp_ntz") is None


@pytest.mark.parametrize(
    ("text", "fmt", "expected"),
    [
        ("081109 203518", "%y%m%d %H%M%S", datetime(2008, 11, 9, 20, 35, 18)),
        ("2005.06.03", "%Y.%m.%d", datetime(2005, 6, 3)),
        ("20171223-22:15:29:606", "%Y%m%d-%H:%M:%S:%f", datetime(2017, 12, 23, 22, 15, 29, 606000)),
        ("2005-06-03-15.42.50.363779", "%Y-%m-%d-%H.%M.%S.%f", datetime(2005, 6, 3, 15, 42, 50, 363779)),
        ("nonsense", "%Y.%m.%d", None),
        (None, "%Y.%m.%d", None),
    ],
)
def test_parsing_times(spark, text, fmt, expected):
    assert col(spark, text, lambda c: parse_time(c, fmt)) == expected


def test_q4_default_format_has_months():
    assert "%m" in DataLoaderConfig().datetime_format and datetime_pattern("%H:%M") == "HH:mm"
    with pytest.raises(ValueError):
        datetime_pattern("%U")


# --- scalar functions


def test_terms_with_zero_one_and_two_groups(spark):
    assert col(spark, "0x1f 0xab", lambda c: T.found_terms(c, "(0x)[0-9a-f]+")) == ["0x", "0x"]
    assert col(spark, "0x1f 0xab", lambda c: T.found_terms(c, "0x[0-9a-f]+")) == ["0x1f", "0xab"]
    with pytest.raises(ValueError):
        T.found_terms(F.lit(""), "(a)(b)")


def test_replacements_stand_for_themselves(spark):
    assert col(spark, "a1b", lambda c: T.replace_terms(c, [(r"\d", r"$1\2")])[0]) == r"a$1\2b"


def test_q14_placeholders_share_spaces(spark):
    for t in ("a INT  INT / INT b", "a INT / INT b", " INT  INT  INT "):
        assert col(spark, t, lambda c: T.collapse_placeholders(c, [" INT "])) == re.sub("(( INT )[ /=]*)+", " INT ", t)


def test_camel_digits_tokens(spark):
    assert col(spark, "MyCamelCase", T.split_camel) == re.sub("([A-Z][a-z]+)", r" \1", re.sub("([A-Z]+)", r" \1", "MyCamelCase")).strip()
    assert col(spark, "a 12  3b 4", T.mask_digits) == "a [DIGITS] 3b [DIGITS]"
    assert col(spark, "foo123,bar: 4", T.split_alpha) == "foo 123, bar 4"
    assert col(spark, "  ", T.tokens) == []
    assert col(spark, "a=b;c", lambda c: T.tokens(c, ("=", ";"))) == ["a", "b", "c"]


def test_alignment_of_parameters(spark):
    def p(line, template):
        return spark.createDataFrame([(line, template)], "a string, b string").select(T.parameters_by_alignment(F.col("a"), F.col("b"))).first()[0]

    assert p("load 12 of data set done", "load * of * done") == ["12", "data set"]
    assert p("x 1 2 y", "x * * y") == ["1", "2"]
    assert p("a b c", "a b c") == []
    assert p("a b c d", "a *") == ["b c d"]
    assert p(None, "a") == [] == p("a", None)


def test_q17_substring_rule_drops_what_the_template_contains(spark):
    df = spark.createDataFrame([("at 3 of 13", "at * of 13")], "a string, b string")
    assert df.select(T.parameters_by_substring(F.col("a"), F.col("b"))).first()[0] == []


def test_padding(spark):
    for a, e in (([1.0], [1.0, 0.0, 0.0]), ([1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0]), ([], [0.0] * 3)):
        assert col(spark, a, lambda c: T.pad(c, 3, F.lit(0.0)), "array<double>") == e


# --- windows: the table of modes, literally

LETTERS = [(i, x, "g", int(x == "d")) for i, x in enumerate("abcde")]
ROWS = "_id bigint, logline string, k string, labels int"


@pytest.mark.parametrize(
    ("last", "small", "expected"),
    [(False, False, ["a", "a|b", "b|c", "c|d", "d|e"]), (True, False, ["", "a", "a|b", "b|c", "c|d"]), (False, True, ["a|b", "b|c", "c|d", "d|e"]), (True, True, ["a|b", "b|c", "c|d"])],
)
@pytest.mark.parametrize("keys", [None, ["k"]])
def test_window_modes(spark, last, small, expected, keys):
    d = windows.sliding_windows(spark.createDataFrame(LETTERS, ROWS), 2, group_by=keys, separator="|", exclude_last_window=last, exclude_smaller_windows=small, label="labels").orderBy("_id")
    assert [r["window"] for r in d.collect()] == expected
    if last and small:
        assert [(r.next_logline, r.labels) for r in d.collect()] == [("c", 0), ("d", 1), ("e", 1)]


def test_q20_small_groups(spark):
    rows = [(1, "a", "one", 0), (2, "b", "two", 0), (3, "c", "two", 1), (4, "x", "three", 0), (5, "y", "three", 0), (6, "z", "three", 0), (7, "n", None, 0)]
    df = spark.createDataFrame(rows, ROWS)
    both = windows.sliding_windows(df, 2, group_by=["k"], separator="|", exclude_last_window=True, exclude_smaller_windows=True)
    assert {(r.k, r.window, r.next_logline) for r in both.collect()} == {("one", "", "a"), ("two", "b", "c"), ("three", "x|y", "z")}
    full = windows.sliding_windows(df, 2, group_by=["k"], separator="|", exclude_smaller_windows=True)
    assert {(r.k, r.window) for r in full.collect()} == {("one", "a"), ("two", "b|c"), ("three", "x|y"), ("three", "y|z")}


def test_q18_size_zero_returns_rows(spark):
    assert [r.window for r in windows.sliding_windows(spark.createDataFrame(LETTERS, ROWS), -1).orderBy("_id").collect()] == list("abcde")


def test_windows_across_blocks(spark):
    from timberline.operators.positions import neighbourhood
    from pyspark.sql import Window

    df = with_position(spark.range(100).withColumnRenamed("id", "_id"), ["_id"])
    d, own, w = neighbourhood(df, 3, 1, block=7)
    got = d.withColumn("a", F.collect_list("_id").over(w.rowsBetween(-3, 0))).withColumn("n", F.lead("_id").over(w)).where(own).orderBy("_id").collect()
    assert [r.a for r in got] == [list(range(max(0, i - 3), i + 1)) for i in range(100)] and [r.n for r in got] == [*range(1, 100), None]
    assert isinstance(w, type(Window.partitionBy("x")))


def test_strides(spark):
    rows = [(i, str(i), "a", 0) for i in range(7)] + [(10, "x", "b", 0), (11, None, "b", 0)]
    s = windows.strided_sequences(spark.createDataFrame(rows, ROWS), 3, 2, group_by=["k"])
    assert {(r.k, r.seq_no, r.sequence) for r in s.collect()} == {("a", 0, "0 1 2"), ("a", 1, "2 3 4"), ("a", 2, "4 5 6"), ("b", 0, "x ")}


def test_missing_columns_raise(spark):
    df = spark.createDataFrame(LETTERS, ROWS)
    with pytest.raises(ValueError):
        windows.sliding_windows(df, 2, group_by=["nope"])
    with pytest.raises(ValueError):
        counters.group_counts(df)


def test_empty_tables(spark):
    df = spark.createDataFrame([], ROWS)
    assert windows.sliding_windows(df, 2, exclude_last_window=True, exclude_smaller_windows=True).count() == 0
    assert windows.strided_sequences(df, 2, group_by=["k"]).count() == 0
    assert counters.frequency(df, "logline").count() == 0 and drain(df).count() == 0 and ael(df).count() == 0 and iplom(df).count() == 0
    assert encode.label_encode(df, ["k"]).count() == 0 and vectorize.tfidf(df).count() == 0
    assert evaluate.auroc(df.withColumn("s", F.lit(1.0)), "labels", "s").first().auroc is None


def test_q6_time_only_groups_and_zero_fill(spark):
    df = spark.createDataFrame([(1, T0), (2, T0 + timedelta(minutes=31)), (3, None)], "_id bigint, timestamp timestamp_ntz")
    assert counters.group_counts(df, group_by_time="15min").count() == 2
    assert [(r.timestamp.minute, r.counts) for r in counters.trend(df, "15min").orderBy("timestamp").collect()] == [(0, 1), (15, 0), (30, 1)]


def test_q22_both_labels(spark):
    df = spark.createDataFrame([(1, T0)], "_id bigint, timestamp timestamp_ntz")
    assert counters.trend(df, "1h").first().timestamp == T0 and counters.trend(df, "1h", label="right").first().timestamp == T0 + timedelta(hours=1)


def test_q5_dedup_takes_the_labels_maximum(spark):
    df = spark.createDataFrame([(1, "s", "a", 0, T0), (2, "s", "a", 1, T0)], "_id bigint, span_id string, logline string, labels int, timestamp timestamp_ntz")
    assert tuple(counters.dedup_with_counts(df).first())[2:4] == (2, 1)


def test_feature_means(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "a", [3.0]), (3, "b", None)], "_id bigint, k string, v array<double>")
    got = {r.k: (r.features, r.counts) for r in counters.feature_vector(df, "v", 3, ["k"]).collect()}
    assert got == {"a": ([2.0, 1.0, 0.0], 2), "b": ([0.0, 0.0, 0.0], 1)}


# --- cleaning


def test_cleaning_rules(spark):
    df = spark.createDataFrame([(1, "Got blk_-12: 10.0.0.1=7"), (2, None)], "_id bigint, logline string")
    rules = PreprocessorConfig([":", "="], [[r"(blk_-?\d+)", " BLOCK "], [r"\d+\.\d+\.\d+\.\d+", " IP "], [r"\d+", " INT "]])
    r = clean(df, rules).orderBy("_id").collect()
    assert (r[0].logline, r[0][" BLOCK "], r[0][" IP "], r[0][" INT "]) == ("Got  BLOCK    IP   INT ", ["blk_-12"], ["10.0.0.1"], ["7"]) and r[1].logline is None
    assert clean_open_set(df, rules).orderBy("_id").first().logline == "Got BLOCK IP INT "


def test_q13_no_rules(spark):
    df = spark.createDataFrame([(1, "a*  b")], "_id bigint, logline string")
    assert clean_open_set(df, PreprocessorConfig()).first().logline == "a b"


def test_q7_serial_ids_are_sorted(spark):
    df = spark.createDataFrame([(1, "blk_2 blk_1"), (2, "blk_1, blk_2"), (3, "blk_9"), (4, "none")], "_id bigint, logline string")
    bad = spark.createDataFrame([("blk_1", "Anomaly"), ("blk_9", "Normal")], "BlockId string, Label string")
    assert {r._id: (r.span_id, r.labels) for r in clean_hdfs(df, bad).collect()} == {1: (1, 1), 2: (1, 1), 3: (2, 0), 4: (0, 0)}


def test_minutes_since_the_first_row(spark):
    df = spark.createDataFrame([(1, "x", "100", "-"), (2, "y", "159", "FAIL"), (3, "z", "160", None), (4, "w", "30", "-")], "_id bigint, logline string, span_id string, labels string")
    assert [(r.span_id, r.labels) for r in clean_bgl(df).orderBy("_id").collect()] == [(0, 0), (0, 1), (1, None), (-1, 0)]


# --- parsers


def lines(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "_id bigint, logline string")


@pytest.mark.parametrize("depth", [3, 4, 5])
def test_drain_equals_the_sequential_run(spark, depth):
    rng = random.Random(depth)
    texts = [" ".join(rng.choice(("a", "b", "c1", "dd", "7")) for _ in range(rng.randrange(0, 6))) for _ in range(400)]
    p = DrainParams(depth=depth, max_children=3)
    got = [r.parsed_logline for r in drain(lines(spark, texts), p, split_lines=20).orderBy("_id").collect()]
    assert got == brute.drain(texts, depth, p.sim_th, p.max_children)
    for t, g in zip(texts, got):
        assert len(g.split()) == len(t.split())


def test_drain_rules(spark):
    assert [r.parsed_logline for r in drain(lines(spark, ["send 1 to a", "send 2 to a", "quit", "", " "])).orderBy("_id").collect()] == ["send * to a", "send * to a", "quit", "", ""]
    with pytest.raises(ValueError):
        DrainParams(depth=2)
    t = TokenCountTree(1, DrainParams(max_clusters=2, sim_th=1.0))
    for w in ("a", "b", "a", "c"):
        t.fit([w])
    assert sorted(c.template[0] for c in t.live.values()) == ["a", "c"]


def test_templates_are_kept_and_applied(spark, tmp_path):
    early, late = ["send 1 to a", "send 2 to a", "quit", ""], ["send 9 to a", "stop now", "quit"]
    parser = LogParser("drain", {"depth": 4}).fit(lines(spark, early))
    parser.save(spark, f"{tmp_path}/model")
    again = LogParser.load(spark, f"{tmp_path}/model")
    assert again.params == parser.params
    assert [r.parsed_logline for r in again.match(lines(spark, late)).orderBy("_id").collect()] == ["send * to a", None, "quit"]
    assert [r.parsed_logline for r in again.parse(lines(spark, late)).orderBy("_id").collect()] == ["send * to a", "stop now", "quit"]
    whole = {(r.template, r.size) for r in LogParser("drain", {"depth": 4}).fit(lines(spark, early + late)).templates.collect()}
    assert {(r.template, r.size) for r in again.templates.collect()} == whole
    assert {r.parsed_logline for r in LogParser("ael").fit_parse(lines(spark, early)).collect()} == {r.parsed_logline for r in ael(lines(spark, early)).collect()}
    with pytest.raises(ValueError):
        LogParser("none")
    with pytest.raises(ValueError):
        LogParser().match(lines(spark, late))


def test_remembered_lines_change_nothing():
    rng, p = random.Random(3), DrainParams(depth=5, max_children=3, max_clusters=6)
    texts = [" ".join(rng.choice(("a", "b", "c1", "dd", "7")) for _ in range(4)) for _ in range(3000)]
    one, two = TokenCountTree(4, p), TokenCountTree(4, p)
    assert [one.fit_line(t).number for t in texts] == [two.fit(t.split()).number for t in texts]
    assert one.known and {c.number: (c.template, c.size, c.used) for c in one.live.values()} == {c.number: (c.template, c.size, c.used) for c in two.live.values()}


def test_trained_subwords(spark):
    df = lines(spark, [f"disk{i % 3} is full on node{i % 5}" for i in range(60)] + [f"user{i} logged out" for i in range(20)] + [None, "* *"])
    got = {r._id: r.vector for r in vectorize.subword_vectors(df, vector_size=16).collect()}
    assert len(got[0]) == 5 * 16 and len(got[60]) == 3 * 16 and got[80] == [] == got[81]

    def cosine(a, b):
        return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))

    word = lambda i, k: np.array(got[i][16 * k : 16 * (k + 1)])
    assert cosine(word(0, 0), word(1, 0)) > cosine(word(0, 0), word(60, 1))  # disk0 and disk1 against logged
    assert vectorize.subword_vectors(lines(spark, ["", None])).collect()[0].vector == []


def test_smoothing_options(spark):
    rows = [("a", T0 + timedelta(hours=i), 50 + 20 * (i % 4) + (400 if i == 50 else 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, timestamp timestamp_ntz, counts bigint")
    for opts in ({}, {"error": "mul"}, {"refit": True}):
        s = detect.ets(df, ["k"], seasonal_periods=4, **opts)
        assert [r.timestamp for r in s.where("anom_score > 0").collect()][:1] == [T0 + timedelta(hours=50)]
    with pytest.raises(ValueError):
        detect.ets(df, ["k"], error="none")


def test_kmeans_takes_the_best_start(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, (rng.normal(size=2) / 10 + [i % 4, (i % 4) ** 2]).tolist()) for i in range(200)], "_id bigint, features array<double>")
    got = {r._id: r.cluster_id for r in cluster.kmeans(df, n_clusters=4, n_init=4).collect()}
    assert len({(i % 4, c) for i, c in got.items()}) == 4 == len(set(got.values()))


def test_bytes_that_are_no_text_are_dropped(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"a b\xff\xfec\nd \xc3\xa9\n")
    assert [(r.One, r.Two) for r in read_text(spark, str(tmp_path / "x.log"), "<One> <Two>").orderBy("_id").collect()] == [("a", "bc"), ("d", "é")]


def test_csv_configuration(tmp_path):
    (tmp_path / "c.csv").write_text("a,b\n1,x\n2,y\n")
    assert read_config(str(tmp_path / "c.csv")) == [{"a": "1", "b": "x"}, {"a": "2", "b": "y"}]


def test_tfidf_terms(spark):
    df = lines(spark, ["the disk is full", "disk full", "", None])
    term = lambda **k: {(r._id, r.term) for r in vectorize.tfidf(df, **k).collect()}
    assert term(ngram_range=(2, 2), stop_words=("the", "is")) == {(0, "disk full"), (1, "disk full")}
    assert term(vocabulary=["full", "absent"], min_df=5) == {(0, "full"), (1, "full")}
    assert term(min_df=0.5) == {(0, "disk"), (0, "full"), (1, "disk"), (1, "full")}
    assert {t for i, t in term(analyzer="char", ngram_range=(8, 9)) if i == 1} == {"disk ful", "isk full", "disk full"}
    with pytest.raises(ValueError):
        vectorize.tfidf(df, analyzer="none")


def test_drain_keeps_a_full_node_for_the_wildcard():
    t = TokenCountTree(3, DrainParams(depth=4, max_children=3, sim_th=0.9))
    for w in ("a", "b", "c", "d", "x1"):
        t.fit([w, "p", "q"])
    assert set(t.root.children) == {"a", "b", "*"}


def test_ael_bins(spark):
    got = [r.parsed_logline for r in ael(lines(spark, ["a 1", "a 2", "a 3", "x y z", "x y w", "", "  "])).orderBy("_id").collect()]
    assert got == ["a <*>"] * 3 + ["x y z", "x y w", "", ""]
    masked = ael(lines(spark, ["a 1", "b 1"]), AELParams(rex=(r"\d+",)))
    assert {r.parsed_logline for r in masked.collect()} == {"a <*>", "b <*>"}
    half = [r.parsed_logline for r in ael(lines(spark, ["a b 1", "a b 2", "x y 1", "a b 3"]), AELParams(merge_percent=0.5)).orderBy("_id").collect()]
    assert half == ["a b <*>", "a b <*>", "x y 1", "a b <*>"]


def test_iplom_steps(spark):
    got = [r.parsed_logline for r in iplom(lines(spark, ["get file 1", "get file 2", "put dir 1", "put dir 3", "", " :=,"])).orderBy("_id").collect()]
    assert got == ["get file <*>", "get file <*>", "put dir <*>", "put dir <*>", "", ""]


def test_iplom_two_tokens(spark):
    few = ["up a", "up b"] * 10
    assert {r.parsed_logline for r in iplom(lines(spark, few)).collect()} == {"up a", "up b"}
    assert {r.parsed_logline for r in iplom(lines(spark, [f"up {i}" for i in range(8)])).collect()} == {"up <*>"}


def test_iplom_options(spark):
    texts = [f"user {n} did {a} at {i}" for i in range(6) for n, a in (("ann", "login"), ("bob", "logout"))]
    assert {r.parsed_logline for r in iplom(lines(spark, texts), IPLoMParams(CT=0.9)).collect()} == {"user ann did login at <*>", "user bob did logout at <*>"}
    rare = [f"a b {i} d" for i in range(30)] + ["one two"]
    assert {r.parsed_logline for r in iplom(lines(spark, rare), IPLoMParams(PST=0.05)).collect()} >= {"Outlier"}


def test_q16_blank_lines_keep_their_rows(spark):
    assert iplom(lines(spark, ["", "a b c"])).count() == 2


def test_very_long_lines(spark):
    long = " ".join(str(i % 7) for i in range(5000))
    for parse in (drain, ael, iplom):
        assert parse(lines(spark, [long, long + " x", "a"])).count() == 3


# --- drill-downs


def test_drill_downs(spark):
    df = spark.createDataFrame([(1, "u 1", "u *", ["1"], "x"), (2, "u 2", "u *", ["2"], "y"), (3, "v", "v", [], "x"), (4, "u 1", "u *", ["1"], "x")], "_id bigint, logline string, parsed_logline string, parameter_list array<string>, a string")
    assert drill.patterns(df).count() == 4 and drill.patterns(df, {"a": "x"}).count() == 2 and drill.where_attributes(df, {"a": "*"}).count() == 4
    assert drill.lines_of_pattern(df, "u *").columns == ["_id", "logline", "a"]
    assert [tuple(r)[1:] for r in drill.parameter_summary(df, "u *").collect()] == [(0, 3, 2)]
    assert {tuple(r) for r in drill.parameter_values(df, "u *").collect()} == {(0, "1", 2), (0, "2", 1)}


def test_q9_first_match_by_id(spark):
    df = spark.createDataFrame([(9, "l", "late", []), (2, "l", "early", [])], "_id bigint, logline string, parsed_logline string, parameter_list array<string>")
    assert drill.pattern_of_line(df, "l", True).first().parsed_logline == "early" and drill.pattern_of_line(df, "none").count() == 0


# --- encoders, vectors


def test_encoders(spark):
    df = spark.createDataFrame([(1, "cat", "run"), (2, "dog", "fly"), (3, None, "run"), (4, "cat", "swim")], "_id bigint, animals string, moves string")
    assert [r.animals_categorical for r in encode.label_encode(df, ["animals"]).orderBy("_id").collect()] == [1, 2, 0, 1]
    assert dict(encode.ordinal_encode(df, ["moves"]).dtypes)["moves-categorical"] == "double"
    hot = encode.one_hot_encode(df, ["animals", "moves"])
    assert [c for c in hot.columns if c.startswith("animals-moves-")] == [f"animals-moves-{i}" for i in range(6)]
    assert encode.one_hot_encode(df, ["moves"], drop="first").columns[-1] == "moves-1"
    with pytest.raises(ValueError):
        encode.one_hot_encode(df, ["moves"], max_categories=2)
    with pytest.raises(ValueError):
        encode.encode(df, ["moves"], "nope")


def test_vectors(spark):
    df = lines(spark, ["alpha * beta", "", None, "alpha"])
    w = {r._id: r.vector for r in vectorize.word2vec(df, vector_size=3).collect()}
    assert [len(w[i]) for i in range(4)] == [6, 0, 0, 3] and w[0][:3] == w[3]
    s = {r._id: r.vector for r in vectorize.subword_vectors(df, vector_size=8).collect()}
    assert len(s[0]) == 16 and s[0][:8] == s[3] and s[1] == []
    ids = {r._id: r.ids for r in vectorize.semantic_ids(df, vectorize.word_vocabulary(df), max_token_len=3).collect()}
    assert ids == {0: [2, 3, 0], 1: [0] * 3, 2: [0] * 3, 3: [2, 0, 0]}
    seq = vectorize.sequential(lines(spark, ["a[SEP] b [SEP]zz", None]), vectorize.line_vocabulary(lines(spark, ["a", "b", None, " a "])), max_token_len=4)
    assert {r._id: r.ids for r in seq.collect()} == {0: [2, 3, 1, 0], 1: [1, 0, 0, 0]}
    assert vectorize.token_ids(lines(spark, ["a a b", ""]), max_vocab_size=1).orderBy("_id").first().ids == [2, 5, 5, 1, 3]


def test_sequences_keep_all_their_lines_unless_a_length_is_asked_for(spark):
    many = [f"l{i:02d}" for i in range(25)]
    seq = vectorize.sequential(lines(spark, ["[SEP]".join(many), "l03"]), vectorize.line_vocabulary(lines(spark, many)))
    assert {r._id: r.ids for r in seq.collect()} == {0: list(range(2, 27)), 1: [5]}


def test_query_of_subword_vectors_keeps_the_tail_of_long_lines(spark, tmp_path):
    r = [("r1", T0, "s", "INFO", "c", "d", " ".join("abcdefghijklmnopqrst"), 0)]
    spark.createDataFrame(r, "record_id string, ts timestamp_ntz, span_id string, severity_text string, component string, dataset_name string, logline string, labels int").write.parquet(f"{tmp_path}/log_records.parquet")
    assert len(logs.subword_vectors(spark, str(tmp_path)).first().vector) == 20 * 100


def test_query_of_line_lengths_counts_long_lines(spark, tmp_path):
    r = [(f"r{n}", T0, "s", "INFO", "c", "d", "x" * n, 0) for n in (3, 100, 101, 250)]
    spark.createDataFrame(r, "record_id string, ts timestamp_ntz, span_id string, severity_text string, component string, dataset_name string, logline string, labels int").write.parquet(f"{tmp_path}/log_records.parquet")
    assert {x.bin: x.counts for x in logs.length_histogram(spark, str(tmp_path)).collect()} == {0: 1, 19: 1, 20: 1, 50: 1}


# --- clusters and detectors

VEC = "_id bigint, features array<double>"


def blobs(spark, n=40, extra=()):
    rng = np.random.default_rng(1)
    pts = [list(map(float, c + rng.normal(0, 0.05, 2))) for c in (np.zeros(2), np.array([5.0, 5.0])) for _ in range(n)]
    return spark.createDataFrame([(i, p) for i, p in enumerate([*pts, *map(list, extra)])], VEC)


def purity(df):
    m = {r._id: r.cluster_id for r in df.collect()}
    return len({m[i] for i in range(40)}), len({m[i] for i in range(40, 80)}), m[0] != m[40]


def test_clusters(spark):
    df = blobs(spark)
    assert purity(cluster.kmeans(df, n_clusters=2)) == (1, 1, True)
    assert purity(cluster.birch(df, threshold=1.0)) == (1, 1, True)
    assert purity(cluster.dbscan(df, eps=0.5, min_samples=5)) == (1, 1, True)
    for run in (cluster.kmeans, cluster.birch, cluster.dbscan):
        with pytest.raises(ValueError):
            run(df.limit(0))
    with pytest.raises(ValueError):
        cluster.birch(df, threshold=0.0, max_subclusters=3)


def plain_dbscan(x, eps, k):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps + 1e-9
    core, label = near.sum(1) >= k, np.full(len(x), -1)
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], i
            while todo:
                j = todo.pop()
                for q in np.flatnonzero(near[j] & core & (label < 0)):
                    label[q] = i
                    todo.append(q)
    for i in np.flatnonzero(~core):
        c = [label[j] for j in np.flatnonzero(near[i] & core)]
        label[i] = min(c) if c else -1
    return label


def test_dbscan_equals_the_plain_method(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.random((160, 2)) * 3, 2)
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    df = spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(x)], VEC)
    got = {r._id: r.cluster_id for r in cluster.dbscan(df, eps=0.22, min_samples=5, block=30).collect()}
    want = plain_dbscan(x, 0.22, 5)
    for i in range(len(x)):
        assert (got[i] == "-1") == (want[i] == -1)
        for j in range(i):
            assert (got[i] == got[j]) == (want[i] == want[j])


@pytest.mark.parametrize("algo", ["isolation_forest", "lof", "one_class_svm"])
def test_detectors_flag_planted_outliers(spark, algo):
    df = blobs(spark, extra=[(60.0, -70.0)]) if algo != "one_class_svm" else spark.createDataFrame([(i, [5.0 + 0.01 * (i % 9), 5.0]) for i in range(80)] + [(80, [-9.0, -9.0])], VEC)
    run = detect.VECTORS[algo]
    got = {r._id: r for r in (run(df, nu=0.05) if algo == "one_class_svm" else run(df)).collect()}
    assert (got[80].anom_score, got[80].trainval) == (-1, False) and min(got.values(), key=lambda r: r.raw_score)._id == 80
    assert sum(r.anom_score == -1 for r in got.values()) <= 20
    with pytest.raises(ValueError):
        run(df.limit(0))


def plain_factors(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    other = d.copy()
    np.fill_diagonal(other, np.inf)
    near = np.argsort(other, axis=1, kind="stable")[:, :k]
    kd = np.take_along_axis(other, near[:, -1:], 1)[:, 0]
    density = lambda nb: 1 / np.maximum(np.maximum(np.take_along_axis(d, nb, 1), kd[nb]).mean(axis=1), 1e-10)
    lrd, with_self = density(near), np.argsort(d, axis=1, kind="stable")[:, :k]
    return lrd[with_self].mean(axis=1) / density(with_self)


def test_local_outlier_factor_has_all_rows_as_neighbours(spark):
    # a dense cluster of 25 beside a wide one: a sample of every second row leaves it without 20 neighbours of its own
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.normal(0, 1, (3200, 3)), 30 + rng.normal(0, 0.01, (25, 3)), rng.normal(0, 1, (3, 3)).repeat(12, axis=0), [[9.0, -9.0, 9.0]]))
    df = spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(x)], VEC)
    got = {r._id: r for r in detect.local_outlier_factor(df, block=1000).collect()}
    want = 1.5 - plain_factors(x, 20)
    assert len(got) == len(x) and np.allclose([got[i].raw_score for i in range(len(x))], want, atol=1e-6)
    assert all(got[i].anom_score == 1 for i in range(3200, 3225)) and got[len(x) - 1].anom_score == -1
    one = detect.local_outlier_factor(df.limit(1)).first()
    assert (one.anom_score, one.trainval) == (1, False)


def test_bars_are_quantiles_of_the_scores_of_all_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(3, 1, (6007, 2))
    df = spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(x)], VEC)
    forest = detect.isolation_forest(df, n_estimators=20, contamination=0.1).collect()
    assert len(forest) == 6007 and sum(r.anom_score == -1 for r in forest) == 601
    machine = detect.one_class_svm(df, nu=0.1, rounds=20).collect()
    assert sum(r.anom_score == -1 for r in machine) == 601


def series(spark, values, key="k"):
    return spark.createDataFrame([(key, T0 + timedelta(hours=i), v) for i, v in enumerate(values)], "k string, timestamp timestamp_ntz, counts bigint")


@pytest.mark.parametrize("algo", ["ets", "dbl"])
def test_series(spark, algo):
    run = lambda v: [r.anom_score for r in detect.per_attribute(series(spark, v), ["k"], algo, train_fraction=0.7, params={"threshold": 3.0} if algo == "dbl" else None).orderBy("timestamp").collect()]
    assert run([5, 6] * 30 + [500, 5]) [60] > 3
    assert set(run([5] * 40)) == {0.0} and set(run([1, 900, 3])) == {0.0}
    with pytest.raises(ValueError):
        detect.per_attribute(series(spark, [1]), ["k"], "nope")


def test_q3_divergence_per_kind(spark):
    a, b = spark.createDataFrame([(x / 10,) for x in range(100)], "x double"), spark.createDataFrame([(x / 10 + 3,) for x in range(100)], "x double")
    r = {v.kind: v.anom_score for v in detect.distribution_divergence(a, b, ["x"], 10, "KL,JS").collect()}
    assert r["KL"] > r["JS"] > 0
    same = detect.distribution_divergence(a, a, ["x"], 10, ["JS"]).first()
    assert same.anom_score == pytest.approx(0)
    with pytest.raises(ValueError):
        detect.distribution_divergence(a, b, ["x"], 10, "XX")


def test_q10_metrics_by_name(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0), (None, 1)], "y int, p int")
    assert tuple(evaluate.binary_metrics(df, "y", "p").first()) == (5, 0.6, 0.5, 0.5, 0.5)


def test_auroc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (0, 0.1), (1, 0.5)], "y int, s double")
    assert evaluate.auroc(df, "y", "s").first().auroc == pytest.approx(0.625)


def test_q12_spans_are_not_divided(spark):
    df = spark.createDataFrame([(i, f"s{i % 50}", int(i % 50 < 5)) for i in range(500)], "_id bigint, span_id string, labels int")
    s = splits.span_split(df)
    assert s.select("span_id", "split").distinct().count() == 50 and s.count() == 500
    u = splits.unsupervised_split(df, test_fraction_pos=0.5, test_fraction_neg=0.2)
    assert u.where("split = 'train' and labels = 1").count() == 0


def test_chronological_counts(spark):
    df = spark.createDataFrame([(i, 10 - i) for i in range(10)], "_id bigint, t bigint")
    assert {r._id for r in splits.chronological_split(df, ["t"], 0.35).where("is_train").collect()} == {9, 8, 7}


# --- records, sources, registry, configuration


def test_record(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x", [1, 2]), (2, None, "y", [])], "_id bigint, logline string, level string, n array<int>")
    r = LogRecord.from_dataframe(df, {"body": ["logline"], "attributes": ["level", "n"]})
    assert r.select_by_index([1]).df.count() == 1 and r.filter_by_index(df.where("_id = 1")).df.first()._id == 2 and r.dropna().df.count() == 1
    r.save(str(tmp_path / "r"))
    back = LogRecord.load(spark, str(tmp_path / "r"))
    assert back.columns == r.columns and sorted(back.df.collect()) == sorted(r.df.collect())
    r.save_to_csv(str(tmp_path / "r.csv"))
    assert LogRecord.load_from_csv(spark, str(tmp_path / "r.csv")).df.count() == 2
    with pytest.raises(ValueError):
        r.save_to_csv(str(tmp_path / "r.txt"))
    with pytest.raises(KeyError):
        LogRecord.from_dataframe(df, {"colour": ["level"]})
    assert LogRecord.from_dataframe(df.select("_id", "logline", "level")).df.where("_id = 1").first().logline == "a x"
    with pytest.raises(IndexError):
        LogRecord(df, {"body": ["nope"]})


def test_text_source(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"  081109  203518 143 INFO dfs.Data: hello  world\nnot a line\n081109 203519 7 WARN x\xff: bye\n")
    r = load(spark, DataLoaderConfig(str(tmp_path / "a.log"), open_dataset="HDFS"))
    rows = r.df.orderBy("_id").collect()
    assert [(x._id, x.timestamp, x.Level, x.span_id) for x in rows] == [(0, datetime(2008, 11, 9, 20, 35, 18), "INFO", "143"), (1, datetime(2008, 11, 9, 20, 35, 19), "WARN", "7")]
    assert rows[0].logline == "dfs.Data: hello  world"
    assert line_pattern("<A> [<B>]")[1] == ["A", "B"]
    assert read_text(spark, str(tmp_path / "a.log"), "<A> <B>", numbered=False).columns == ["A", "B"]
    with pytest.raises(ValueError):
        preset("nope", "")


def test_delimited_sources(spark, tmp_path):
    (tmp_path / "h.csv").write_text("t|a|i|d\n20171223-22:15:29:606|Step|30|x=1\n20171223-22:15:29:7|Step|31|y\n")
    r = load(spark, DataLoaderConfig(str(tmp_path / "h.csv"), open_dataset="healthapp"))
    assert [(x.timestamp.microsecond, x.Action, x.ID, x.logline) for x in r.df.orderBy("_id").collect()] == [(606000, "Step", "30", "x=1"), (700000, "Step", "31", "y")]
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n2\ty\n")
    t = load(spark, DataLoaderConfig(str(tmp_path / "t.tsv"), "tsv", {"body": ["b"], "span_id": ["a"]}))
    assert [(x.span_id, x.logline) for x in t.df.orderBy("_id").collect()] == [(1, "x"), (2, "y")]
    (tmp_path / "j.json").write_text('[{"m": "x", "n": 1}, {"m": "y", "n": 2}]')
    j = load(spark, DataLoaderConfig(str(tmp_path / "j.json"), "json", {"body": ["m", "n"]}))
    assert [x.logline for x in j.df.orderBy("_id").collect()] == ["x 1", "y 2"]
    with pytest.raises(ValueError):
        load(spark, DataLoaderConfig(str(tmp_path / "t.tsv"), "tsv", {"span_id": ["a", "b"]}))


def test_registry():
    assert registry.names("parsing") == ["ael", "drain", "iplom"]
    for name in ("lstm", "cnn", "transformer", "logbert"):
        with pytest.raises(ImportError):
            registry.get("detection", name)
    with pytest.raises(ValueError):
        registry.get("parsing", "nope")
    r = Registry()
    r.register("parsing", "x", lambda df: df)
    with pytest.raises(AssertionError):
        r.register("parsing", "x", lambda df: df)
    r.unregister("parsing", "x")
    assert r.names("parsing") == []


def test_configuration(tmp_path):
    c = WorkFlowConfig.from_dict({"preprocessor_config": {"custom_replace_list": [["a", "b"]], "unknown": 1}, "what": 2})
    assert c.preprocessor_config.custom_replace_list == [["a", "b"]] and isinstance(c, Config)
    assert OpenSetADWorkflowConfig.from_dict({"dataset_name": "bgl"}).test_data_frac_pos == 0.8
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert read_config(str(tmp_path / "c.json")) == {"a": 1}
    with pytest.raises(ValueError):
        read_config("x.pkl")


def test_q1_outliers_are_anomalies(spark, tiny):
    r = logs.app_vector_anomalies(spark, tiny).first()
    assert r.n > 0 and 0 <= r.accuracy <= 1


def test_arrays(spark):
    from timberline.functions import arrays as A

    one = spark.range(1).select(F.array(F.lit(1.0), F.lit(3.0), F.lit(2.0)).alias("s"), F.array(F.lit(5), F.lit(6), F.lit(7)).alias("i"))
    r = one.select(A.softmax(F.col("s")).alias("p"), A.top_k(F.col("s"), 2).alias("k"), A.in_top_k(F.col("s"), F.lit(0), 2).alias("t"), A.masked_windows(F.col("i"), 4, 2).alias("m")).first()
    assert sum(r.p) == pytest.approx(1) and r.k == [1, 2] and r.t is False and r.m == [[4, 4, 7], [5, 6, 4]]
    p = F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0))
    e = spark.range(1).select(A.entropy(p), A.log_probability(p, F.lit(2)), A.log_probability(p, F.lit(0)), A.divergence(p, p), A.softmax(F.array().cast("array<double>"))).first()
    assert e[0] == pytest.approx(np.log(2)) and e[1] is None and e[2] == pytest.approx(np.log(0.5)) and e[3] == pytest.approx(0) and e[4] is None


def test_parameter_forms():
    from timberline.config import parameter_info, typed_parameters

    assert parameter_info(DrainParams)["sim_th"] == ("float", 0.4)
    assert typed_parameters(DrainParams, {"depth": "5", "param_str": "<*>", "sim_th": " "}) == {"depth": 5, "param_str": "<*>"}
    with pytest.raises(KeyError):
        typed_parameters(DrainParams, {"nope": "1"})


def test_stages_are_kept(spark, tmp_path):
    from timberline.runtime import stage

    made = []

    def build():
        made.append(1)
        return spark.range(3)

    assert stage(spark, str(tmp_path / "s"), build).count() == 3 == stage(spark, str(tmp_path / "s"), build).count() and made == [1]
