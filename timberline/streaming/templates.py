"""Online template mining on a stream: a prefix tree per token count, grown by each micro-batch and kept as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timberline.parsing.drain import DrainParams, fit_templates


class OnlineTemplates:
    """Templates grown from micro-batches with foreachBatch.

    The templates after batch n are the table `<path>/batch=<n>`; batch n reads those of the batch before and writes its own, so
    that a batch that is run again, after a restart from the checkpoint or a lost driver, gives the same table, and
    nothing is held in the driver. Batches are fitted like tables: a token count in a task, in the order of row ids. The two
    latest tables are kept. `path` must be reached by all executors.
    """

    def __init__(self, path: str, params: DrainParams = DrainParams(max_clusters=1000)):
        self.path, self.params = path, params

    def _batches(self, spark: SparkSession) -> list[int]:
        """Batches whose tables are whole."""
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[6:]) for n in names if n.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def feed(self, batch: DataFrame, number: int, text: str = "logline", row_id: str = "_id") -> None:
        """Fit a batch on the templates of the latest one before it."""
        spark = batch.sparkSession
        whole = self._batches(spark)
        before = [n for n in whole if n < number]
        start = spark.read.parquet(f"{self.path}/batch={before[-1]}") if before else None
        fit_templates(batch, self.params, row_id, text, start).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        jvm = spark.sparkContext._jvm
        for n in before[:-1]:
            old = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={n}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    def templates(self, spark: SparkSession) -> DataFrame | None:
        """The latest templates (n, number, first, template, size), None before the first batch."""
        whole = self._batches(spark)
        return spark.read.parquet(f"{self.path}/batch={whole[-1]}") if whole else None

    def start(self, stream: DataFrame, checkpoint: str, text: str = "logline", row_id: str = "_id", then: Callable | None = None):
        def each(batch: DataFrame, number: int) -> None:
            self.feed(batch, number, text, row_id)
            if then:
                then(self, number)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
