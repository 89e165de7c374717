"""Log anomaly detection on counters of groups, or on the groups' feature vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.apps.clustering import features
from timberline.apps.summarize import parsed, prepared
from timberline.config import AnomalyDetectionConfig, FeatureExtractorConfig, WorkFlowConfig
from timberline.functions.text import attribute_key
from timberline.functions.timebuckets import bucket_start
from timberline.operators.counters import feature_vector, group_counts
from timberline.operators.detect import SERIES, per_attribute
from timberline.operators.evaluate import binary_metrics
from timberline.record import ROW_ID, LogRecord
from timberline.registry import registry


class LogAnomalies:
    """results: rows with group_id and is_anomaly. A group is a combination of categories and a time bucket.

    Counter detectors (ets, dbl) score each attribute series, 70 % of it in training; a group with a score above zero is
    anomalous. Vector detectors fit and score all groups; a group they call an outlier (-1) is.
    """

    def __init__(self, config: WorkFlowConfig, train_fraction: float = 0.7):
        self.config, self.train_fraction = config, train_fraction
        self.results: DataFrame | None = None
        self.counter_df: DataFrame | None = None
        self.scores: DataFrame | None = None

    def execute(self, spark: SparkSession | None = None, record: LogRecord | None = None) -> DataFrame:
        c = self.config
        r = prepared(spark, c, record)
        p = parsed(r.df, c.log_parser_config)
        fx = c.feature_extractor_config or FeatureExtractorConfig()
        keys = list(fx.group_by_category or [])
        algo = c.anomaly_detection_config or AnomalyDetectionConfig()
        bucket = bucket_start(F.col("timestamp"), fx.group_by_time) if fx.group_by_time else F.col("timestamp").cast("timestamp_ntz")
        rows = p.withColumn("bucket", bucket).withColumn("group_id", F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("bucket").cast("string")))
        rows = rows.where(F.col("bucket").isNotNull())
        for k in keys:
            rows = rows.where(F.col(k).isNotNull())
        self.counter_df = group_counts(rows, [*keys, "bucket", "group_id"]).withColumnRenamed("bucket", "timestamp")
        if algo.algo_name in SERIES:
            attributes = [k for k in keys if k != "parsed_logline"] or keys or ["group_id"]
            # one series per attribute key; the counter's other keys are summed up
            series = self.counter_df.withColumn("attribute", attribute_key(*[F.col(a) for a in attributes])).groupBy("attribute", "timestamp").agg(F.sum("counts").alias("counts"))
            s = per_attribute(series, ["attribute"], algo.algo_name, train_fraction=self.train_fraction, params=algo.algo_params)
            self.scores = s
            hit = s.where(F.col("anom_score") > 0).select("attribute", F.col("timestamp").alias("bucket")).distinct()
            rows = rows.withColumn("attribute", attribute_key(*[F.col(a) for a in attributes]))
            out = rows.join(hit.withColumn("is_anomaly", F.lit(True)), ["attribute", "bucket"], "left").drop("attribute")
        else:
            f = features(p, c.log_vectorizer_config, c.categorical_encoder_config, r.columns.get("attributes", []), fx.max_feature_len)
            width = fx.max_feature_len + len(r.columns.get("attributes", []))
            g = feature_vector(rows.select(ROW_ID, "group_id").join(f, ROW_ID), "features", width, ["group_id"])
            s = registry.get("detection", algo.algo_name, algo.algo_params)(g, row_id="group_id")
            self.scores = s
            hit = s.where(F.col("anom_score") == -1).select("group_id")
            out = rows.join(hit.withColumn("is_anomaly", F.lit(True)), "group_id", "left")
        self.results = out.withColumn("is_anomaly", F.coalesce("is_anomaly", F.lit(False)))
        return self.results

    @property
    def anomaly_results(self) -> DataFrame:
        return self.results.where("is_anomaly")

    @property
    def event_group(self) -> DataFrame:
        """Rows and their groups."""
        return self.results.select(ROW_ID, "group_id")

    def evaluation(self, label: str = "labels") -> DataFrame:
        return binary_metrics(self.results.withColumn("__p", F.col("is_anomaly").cast("int")), label, "__p")
