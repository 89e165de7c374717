"""Log clustering: parse, vectorize, encode attributes, cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.apps.summarize import parsed, prepared
from timberline.config import CategoricalEncoderConfig, ClusteringConfig, VectorizerConfig, WorkFlowConfig
from timberline.functions.text import pad
from timberline.operators.encode import encode
from timberline.record import ROW_ID, LogRecord
from timberline.registry import registry

FEATURES = 100
DENSE = ("word2vec", "fasttext")


def hashed_tfidf(df: DataFrame, text: str, params: dict | None, length: int) -> DataFrame:
    """TF-IDF as a dense vector of `length` hashed terms."""
    w = registry.get("vectorization", "tfidf", params)(df, text=text)
    w = w.withColumn("h", F.pmod(F.xxhash64("term"), F.lit(length)).cast("int"))
    cells = w.groupBy(ROW_ID).agg(*[F.sum(F.when(F.col("h") == i, F.col("weight")).otherwise(0.0)).alias(f"f{i}") for i in range(length)])
    v = cells.select(ROW_ID, F.array(*[f"f{i}" for i in range(length)]).alias("vector"))
    return df.select(ROW_ID).join(v, ROW_ID, "left").withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0), length)))


def features(df: DataFrame, vectorizer: VectorizerConfig | None, encoder: CategoricalEncoderConfig | None, attributes: list[str], length: int = FEATURES, text: str = "parsed_logline") -> DataFrame:
    """_id and `features`: the line's vector, padded, and the encoded attributes."""
    vectorizer, encoder = vectorizer or VectorizerConfig(), encoder or CategoricalEncoderConfig()
    if vectorizer.algo_name == "tfidf":
        v = hashed_tfidf(df, text, vectorizer.algo_param, length)
    elif vectorizer.algo_name in DENSE:
        v = registry.get("vectorization", vectorizer.algo_name, vectorizer.algo_param)(df, text=text)
    else:
        v = registry.get("vectorization", vectorizer.algo_name, vectorizer.algo_param)(df, text=text).select(ROW_ID, F.transform("ids", lambda x: x.cast("double")).alias("vector"))
    v = v.withColumn("vector", pad(F.col("vector"), length, F.lit(0.0)))
    if attributes:
        e = encode(df.select(ROW_ID, *[F.col(a).cast("string").alias(a) for a in attributes]), attributes, encoder.name, encoder.params)
        extra = [c for c in e.columns if c not in (ROW_ID, *attributes)]
        v = v.join(e.select(ROW_ID, F.array(*[F.col(f"`{c}`").cast("double") for c in extra]).alias("__e")), ROW_ID)
        v = v.select(ROW_ID, F.concat("vector", "__e").alias("features"))
        return v
    return v.withColumnRenamed("vector", "features")


class LogClusters:
    def __init__(self, config: WorkFlowConfig):
        self.config = config
        self.logline_with_clusters: DataFrame | None = None

    def execute(self, spark: SparkSession | None = None, record: LogRecord | None = None) -> DataFrame:
        c = self.config
        r = prepared(spark, c, record)
        p = parsed(r.df, c.log_parser_config)
        f = features(p, c.log_vectorizer_config, c.categorical_encoder_config, r.columns.get("attributes", []))
        algo = c.clustering_config or ClusteringConfig()
        ids = registry.get("clustering", algo.algo_name, algo.algo_params)(f)
        self.logline_with_clusters = p.join(ids, ROW_ID)
        return self.logline_with_clusters

    @property
    def clusters(self) -> DataFrame:
        return self.logline_with_clusters.select(ROW_ID, "cluster_id")

    def sizes(self) -> DataFrame:
        return self.logline_with_clusters.groupBy("cluster_id").agg(F.count("*").alias("counts"))
