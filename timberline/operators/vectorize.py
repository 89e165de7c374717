"""Vectorizers of log lines: TF-IDF, word embeddings, vocabulary ids, next-line data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.text import first_word, java_regex, pad, plain_tokens
from timberline.operators.encode import value_ids
from timberline.runtime import cut

PAD, OOV = "<pad>", "<oov>"
SPECIAL = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")


def _grams(items: Column, least: int, most: int, glue: str) -> Column:
    """Runs of least to most neighbouring items, joined."""
    n = F.size(items)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(items, i, F.lit(k)), glue))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[items if k == 1 else of(k) for k in range(least, most + 1)])


def terms_of(c: Column, analyzer: str = "word", ngram_range: tuple[int, int] = (1, 1), stop_words: tuple[str, ...] = (), token_pattern: str = r"(?u)\b\w\w+\b") -> Column:
    """The terms of a text: runs of words (without stop words), or of characters with white space as single blanks."""
    if analyzer == "word":
        words = F.regexp_extract_all(c, F.lit(java_regex(token_pattern)), F.lit(0))
        if stop_words:
            words = F.filter(words, lambda w: ~w.isin(*stop_words))
        return _grams(words, *ngram_range, " ")
    if analyzer == "char":
        return _grams(F.filter(F.split(F.regexp_replace(c, r"\s+", " "), ""), lambda x: x != ""), *ngram_range, "")
    raise ValueError(f"no analyzer {analyzer!r}; there are word and char")


def tfidf(df: DataFrame, text: str = "logline", row_id: str = "_id", token_pattern: str = r"(?u)\b\w\w+\b", lowercase: bool = True, norm: str | None = "l2", use_idf: bool = True, smooth_idf: bool = True, sublinear_tf: bool = False, binary: bool = False, min_df: int | float = 1, max_df: int | float = 1.0, max_features: int | None = None, analyzer: str = "word", ngram_range: tuple[int, int] = (1, 1), stop_words: tuple[str, ...] | None = None, vocabulary: list[str] | None = None) -> DataFrame:
    """Sparse TF-IDF in long form: row id, term, tf, weight. Rows without terms have no entries.

    idf = ln((1 + n) / (1 + df)) + 1 if smoothed, else ln(n / df) + 1, n counting all rows with text. min_df and max_df are numbers
    of rows, or shares of all if they are fractions. max_features keeps the terms that are most frequent in all (ties by
    term). A given vocabulary keeps its terms only, and leaves the limits aside.
    """
    d = df.where(F.col(text).isNotNull())
    n = d.count()
    src = F.lower(text) if lowercase else F.col(text)
    tf = d.select(row_id, F.explode(terms_of(src, analyzer, tuple(ngram_range), tuple(stop_words or ()), token_pattern)).alias("term")).groupBy(row_id, "term").agg(F.count("*").alias("tf"))
    if vocabulary is not None:
        keep = df.sparkSession.createDataFrame([(v,) for v in sorted(set(vocabulary))], "term string")
        tf = tf.join(keep, "term", "left_semi")
        min_df, max_df, max_features = 1, 1.0, None
    if binary:
        tf = tf.withColumn("tf", F.lit(1).cast("bigint"))
    rows = lambda x: x * n if isinstance(x, float) else x
    terms = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).where((F.col("df") >= rows(min_df)) & (F.col("df") <= rows(max_df)))
    if max_features is not None:
        terms = terms.orderBy(F.col("all").desc(), "term").limit(max_features)
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1 if smooth_idf else F.log(F.lit(float(n)) / F.col("df")) + 1
    w = (F.log("tf") + 1 if sublinear_tf else F.col("tf").cast("double")) * (idf if use_idf else F.lit(1.0))
    out = tf.join(terms, "term").select(row_id, "term", "tf", w.alias("w"))
    over = Window.partitionBy(row_id)
    length = {"l2": F.sqrt(F.sum(F.col("w") * F.col("w")).over(over)), "l1": F.sum(F.abs("w")).over(over), None: F.lit(1.0)}[norm]
    return out.select(row_id, "term", "tf", (F.col("w") / length).alias("weight"))


def _flattened(df: DataFrame, toks: Column, vectors: DataFrame, row_id: str, max_tokens: int) -> DataFrame:
    """The vectors of a row's first tokens, one after the other; tokens without vector are skipped."""
    t = df.select(row_id, F.posexplode(F.slice(toks, 1, max_tokens)).alias("pos", "word"))
    j = t.join(vectors, "word").groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("pos", "vec"))).alias("v"))
    empty = F.array().cast("array<double>")
    return df.select(row_id).join(j, row_id, "left").select(row_id, F.coalesce(F.flatten(F.transform("v", lambda x: x["vec"])), empty).alias("vector"))


def word2vec(df: DataFrame, text: str = "logline", row_id: str = "_id", max_token_len: int = 100, min_count: int = 1, vector_size: int = 3, window: int = 3, seed: int = 7) -> DataFrame:
    """Row id and `vector`: the embeddings of the line's first tokens, concatenated; wildcards are skipped."""
    from pyspark.ml.feature import Word2Vec

    toks = F.filter(F.transform(F.filter(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda t: (t != "") & (t != "*")), first_word), lambda t: t != "")
    d = df.select(row_id, toks.alias("toks"))
    model = Word2Vec(vectorSize=vector_size, windowSize=window, minCount=min_count, seed=seed, inputCol="toks", outputCol="v").fit(d.where(F.size("toks") > 0))
    from pyspark.ml.functions import vector_to_array

    return _flattened(d, F.col("toks"), model.getVectors().select("word", vector_to_array("vector").alias("vec")), row_id, max_token_len)


def _subwords(word: Column, least: int, most: int) -> Column:
    """A word in angle brackets, and its character n-grams."""
    w = F.concat(F.lit("<"), word, F.lit(">"))
    of = lambda k: F.when(F.length(w) > k, F.transform(F.sequence(F.lit(1), F.length(w) - (k - 1)), lambda i: F.substring(w, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(w), *[of(k) for k in range(least, most + 1)]))


def subword_vectors(df: DataFrame, text: str = "logline", row_id: str = "_id", vector_size: int = 100, max_token_len: int = 100, min_n: int = 3, max_n: int = 6, window: int = 5, epochs: int = 5, seed: int = 7) -> DataFrame:
    """Row id and `vector`: trained subword embeddings of the line's first tokens, concatenated.

    Skip-grams over the words of the distinct lines, each together with its character n-grams, so that a word and its parts are
    trained to tell the words around them; a word's vector is the mean of its own and its n-grams'. Words that share
    n-grams are near each other. Wildcards are skipped; a line without words has an empty vector.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    toks = F.filter(F.split(F.lower(F.trim(F.coalesce(F.col(text), F.lit("")))), r"\s+"), lambda t: (t != "") & (t != "*"))
    d = df.select(row_id, toks.alias("toks"))
    words = d.select(F.explode(F.slice("toks", 1, max_token_len)).alias("word")).distinct()
    units = words.select("word", F.explode(_subwords(F.col("word"), min_n, max_n)).alias("unit"))
    lines = cut(d.where(F.size("toks") > 0).select("toks").distinct().select(F.flatten(F.transform("toks", lambda w: _subwords(w, min_n, max_n))).alias("units")))
    if lines.isEmpty():
        return df.select(row_id, F.array().cast("array<double>").alias("vector"))
    # a window of words is about so many units
    per_word = lines.agg(F.avg(F.size("units"))).first()[0] / max(1.0, d.where(F.size("toks") > 0).agg(F.avg(F.size("toks"))).first()[0])
    model = Word2Vec(vectorSize=vector_size, windowSize=max(1, int(window * per_word)), minCount=1, maxIter=epochs, seed=seed, inputCol="units", outputCol="v").fit(lines)
    vectors = model.getVectors().select(F.col("word").alias("unit"), vector_to_array("vector").alias("x"))
    mean = units.join(vectors, "unit").groupBy("word").agg(F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(vector_size)]).alias("vec"))
    return _flattened(d, F.col("toks"), mean, row_id, max_token_len)


def line_vocabulary(df: DataFrame, text: str = "logline") -> DataFrame:
    """token, id of distinct trimmed lines in sorted order from 2; padding is 0, out of vocabulary 1."""
    return value_ids(df.where(F.col(text).isNotNull()).select(F.trim(text).alias("token")), "token", 2)


def _ids(df: DataFrame, pieces: Column, vocabulary: DataFrame, row_id: str, length: int | None) -> DataFrame:
    t = df.select(row_id, F.posexplode(pieces).alias("pos", "token")).join(vocabulary, "token", "left")
    g = t.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(1)).alias("id")))).alias("v"))
    a = F.coalesce(F.transform("v", lambda x: x["id"]), F.array().cast("array<bigint>"))
    return df.select(row_id).join(g, row_id, "left").select(row_id, (pad(a, length, F.lit(0).cast("bigint")) if length else a).alias("ids"))


def sequential(df: DataFrame, vocabulary: DataFrame, text: str = "logline", row_id: str = "_id", sep_token: str | None = "[SEP]", max_token_len: int | None = None) -> DataFrame:
    """Row id and `ids` of the lines of a sequence: unknown lines 1. Null text is an empty sequence.

    All lines have their id, unless the caller asks for a length: sequences are then cut, or filled with 0, to it."""
    src = F.coalesce(F.col(text), F.lit(""))
    pieces = F.transform(F.split(src, _quoted(sep_token)), lambda x: F.trim(x)) if sep_token else F.array(F.trim(src))
    return _ids(df, pieces, vocabulary, row_id, max_token_len)


def _quoted(literal: str) -> str:
    return "\\Q" + literal + "\\E"


def word_vocabulary(df: DataFrame, text: str = "logline", min_count: int = 1) -> DataFrame:
    """token, id of words in lower case without punctuation, sorted, from 2."""
    w = df.select(F.explode(plain_tokens(F.coalesce(F.col(text), F.lit("")))).alias("token")).groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") >= min_count)
    return value_ids(w, "token", 2)


def semantic_ids(df: DataFrame, vocabulary: DataFrame, text: str = "logline", row_id: str = "_id", max_token_len: int = 10) -> DataFrame:
    """Row id and `ids` of the line's words: unknown words 1, filled with 0."""
    return _ids(df, plain_tokens(F.coalesce(F.col(text), F.lit(""))), vocabulary, row_id, max_token_len)


def token_ids(df: DataFrame, text: str = "logline", row_id: str = "_id", max_token_len: int = 384, max_vocab_size: int = 5000, custom_tokens: tuple[str, ...] = ()) -> DataFrame:
    """Row id and `ids` under a vocabulary of the most frequent white-space tokens, with the special tokens first.

    It stands in for a trained word-piece model, which is not built here: rare words are unknown, not split.
    """
    special = [*SPECIAL, *custom_tokens]
    toks = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda t: (t != "") & ~t.isin(*special))
    top = df.select(F.explode(toks).alias("token")).groupBy("token").agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "token").limit(max_vocab_size)
    vocab = value_ids(top, "token", len(special))  # bounded by max_vocab_size
    t = df.select(row_id, F.posexplode(toks).alias("pos", "token")).where(F.col("pos") < max_token_len - 2).join(F.broadcast(vocab), "token", "left")
    g = t.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(1)).alias("id")))).alias("v"))
    a = F.coalesce(F.transform("v", lambda x: x["id"].cast("int")), F.array().cast("array<int>"))
    return df.select(row_id).join(g, row_id, "left").select(row_id, F.concat(F.array(F.lit(2)), a, F.array(F.lit(3))).alias("ids"))


def only_special(c: Column, special: tuple[str, ...] = SPECIAL) -> Column:
    """Whether a text has no token but special ones."""
    return F.size(F.array_except(F.filter(F.split(c, " "), lambda t: t != ""), F.array(*[F.lit(s) for s in special]))) == 0


def next_line_dataset(windows: DataFrame, vocabulary: DataFrame, row_id: str = "_id", span: str = "span_id", window: str = "window", next_line: str = "next_logline", label: str = "labels", sep_token: str = "[SEP]", max_token_len: int = 10) -> DataFrame:
    """session_idx, features, window_anomalies, window_labels (id of the next line) of sliding windows."""
    f = sequential(windows, vocabulary, window, row_id, sep_token, max_token_len)
    nxt = sequential(windows, vocabulary, next_line, row_id, None, 1).select(row_id, F.get("ids", F.lit(0)).alias("window_labels"))
    return windows.select(row_id, F.col(span).alias("session_idx"), F.col(label).cast("int").alias("window_anomalies")).join(f, row_id).join(nxt, row_id).select("session_idx", F.col("ids").alias("features"), "window_anomalies", "window_labels")
