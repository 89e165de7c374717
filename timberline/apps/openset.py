"""The data path of deep anomaly detection on open data sets, and a frequency-based next-line predictor.

The neural models themselves need a library that is absent: asking for them raises ImportError. The predictor here ranks the
next line by how often it follows the window's last line; it shares the models' top-k rule and is never reported as one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.apps.summarize import parsed
from timberline.config import OpenSetADWorkflowConfig, OpenSetPartitionerConfig, PreprocessorConfig
from timberline.operators.clean import BGL_RULES, HDFS_RULES, THUNDERBIRD_RULES, clean_bgl, clean_hdfs, clean_thunderbird
from timberline.operators.counters import dedup_with_counts
from timberline.operators.evaluate import binary_metrics
from timberline.operators.splits import span_split, unsupervised_split
from timberline.operators.vectorize import line_vocabulary, next_line_dataset
from timberline.operators.windows import id_sessions, sliding_windows
from timberline.record import ROW_ID, LogRecord
from timberline.runtime import stage
from timberline.sources.readers import load


def partition(df: DataFrame, config: OpenSetPartitionerConfig, text: str = "logline") -> DataFrame:
    """Session windows (one per span) or sliding windows with their next line."""
    if config.session_window:
        return id_sessions(df, text=text, separator=config.logsequence_delim)
    return sliding_windows(df, config.sliding_window, text, group_by=["span_id"], separator=config.logsequence_delim, exclude_last_window=True, exclude_smaller_windows=True, label="labels")


def predict_next(train: DataFrame, test: DataFrame, k: int = 10) -> DataFrame:
    """Test windows with `rank` (of the true next line among those seen after the window's last line; null if unseen) and
    `prediction` (1 if it is not among the first k)."""
    last = F.element_at(F.filter("features", lambda x: x > 0), -1)
    pairs = train.select(last.alias("last"), F.col("window_labels").alias("next")).where(F.col("last").isNotNull()).groupBy("last", "next").agg(F.count("*").alias("c"))
    w = Window.partitionBy("last").orderBy(F.col("c").desc(), "next")
    top = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("last", "next", "rank")
    t = test.withColumn("last", last)
    j = t.join(top, (t["last"] == top["last"]) & (t["window_labels"] == top["next"]), "left").select(t["*"], "rank")
    return j.withColumn("prediction", F.col("rank").isNull().cast("int"))


def best_over_k(predicted: DataFrame, k: int = 10) -> DataFrame:
    """Session metrics for every cut 1..k, the best F1 first. A session is predicted if any of its windows is."""
    ks = F.explode(F.sequence(F.lit(1), F.lit(k)))
    p = predicted.withColumn("k", ks).withColumn("p", (F.coalesce("rank", F.lit(k + 1)) > F.col("k")).cast("int"))
    s = p.groupBy("k", "session_idx").agg(F.max("p").alias("p"), F.max("window_anomalies").alias("y"))
    c = s.groupBy("k").agg(F.sum(((F.col("p") == 1) & (F.col("y") == 1)).cast("int")).alias("tp"), F.sum(((F.col("p") == 1) & (F.col("y") != 1)).cast("int")).alias("fp"), F.sum(((F.col("p") != 1) & (F.col("y") == 1)).cast("int")).alias("fn"), F.count("*").alias("n"))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return c.withColumn("f1", f1).orderBy(F.col("f1").desc(), "k")


class OpenSetWorkflow:
    def __init__(self, config: OpenSetADWorkflowConfig):
        self.config = config

    def prepare(self, spark: SparkSession | None = None, record: LogRecord | None = None, labels: DataFrame | None = None) -> DataFrame:
        """Cleaned (and parsed) records with span_id and labels."""
        c = self.config
        record = record or load(spark, c.data_loader_config)
        name = (c.dataset_name or "").lower()
        rules = c.preprocessor_config or {"hdfs": HDFS_RULES, "bgl": BGL_RULES, "thunderbird": THUNDERBIRD_RULES}.get(name, PreprocessorConfig())
        df = record.dropna().df
        if name == "hdfs":
            labels = labels if labels is not None else spark.read.option("header", True).csv(c.label_filepath)
            df = clean_hdfs(df, labels, rules)
        elif name == "bgl":
            df = clean_bgl(df, rules)
        elif name == "thunderbird":
            df = clean_thunderbird(df, rules)
        if c.parse_logline:
            df = parsed(df, c.log_parser_config).withColumn("logline", F.col("parsed_logline"))
        return df

    def windows(self, df: DataFrame) -> DataFrame:
        """Partitioned records with `split`; equal sequences of a span are counted once in test if so configured."""
        c = self.config
        split = unsupervised_split(df, test_fraction_pos=c.test_data_frac_pos, test_fraction_neg=c.test_data_frac_neg) if c.training_type == "unsupervised" else span_split(df)
        split = split.where(F.col("split").isNotNull())
        of_span = split.select("span_id", "split").distinct()
        w = partition(split, c.open_set_partitioner_config or OpenSetPartitionerConfig()).join(of_span, "span_id")
        if c.deduplicate_test and "window" not in w.columns:
            first = w.withColumn("timestamp", F.lit(None).cast("timestamp_ntz")).withColumn(ROW_ID, F.col("span_id"))
            test = dedup_with_counts(first.where("split = 'test'"), row_id=ROW_ID).withColumn("split", F.lit("test"))
            w = w.where("split <> 'test'").select("span_id", "logline", "counts", "labels", "split").unionByName(test.select("span_id", "logline", "counts", "labels", "split"))
        return w

    def kept(self, name: str, build, reuse: bool) -> DataFrame:
        """A stage as a table below output_dir, if there is one: read if it is whole, else built and written."""
        if not self.config.output_dir:
            return build()
        return stage(SparkSession.getActiveSession(), f"{self.config.output_dir}/{name}", build, reuse)

    def execute(self, spark: SparkSession | None = None, record: LogRecord | None = None, labels: DataFrame | None = None, k: int = 10, reuse: bool = True) -> DataFrame:
        """Session metrics of the next-line predictor on sliding windows, best first. With output_dir the prepared records, the
        windows, the vocabulary and the data sets are kept there and, unless `reuse` is off, read instead of built."""
        c = self.config
        p = c.open_set_partitioner_config or OpenSetPartitionerConfig(sliding_window=10, session_window=False)
        if p.session_window:
            raise ValueError("the next-line predictor needs sliding windows (session_window false)")
        df = self.kept("prepared", lambda: self.prepare(spark, record, labels), reuse)
        w = self.kept("windows", lambda: self.windows(df), reuse)
        vocab = self.kept("vocabulary", lambda: line_vocabulary(df), reuse)
        data = {s: self.kept(s, lambda s=s: next_line_dataset(w.where(F.col("split") == s), vocab, max_token_len=p.sliding_window), reuse) for s in ("train", "test")}
        return best_over_k(predict_next(data["train"], data["test"], k), k)


__all__ = ["OpenSetWorkflow", "best_over_k", "binary_metrics", "partition", "predict_next"]
