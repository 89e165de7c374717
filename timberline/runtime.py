"""Session helpers shared by every operator: shared-folder checkpoints, table access, partition sizing."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("timberline")
    for k, v in (DEFAULT_CONF | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": "8g"} | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    reach(spark)
    return spark


def reach(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever their working directory. Clusters whose
    machines don't share that path ship the package with --py-files."""
    root, env = os.path.dirname(package_root()), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where that is unset and all is one machine, as in
    tests. On a cluster without it RuntimeError: a folder of the driver's machine would be of no use to the executors."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    own = tempfile.mkdtemp(prefix="timberline-checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, so a lost executor costs a re-read only."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def package_root() -> str:
    return os.path.dirname(os.path.abspath(__file__))


def stage(spark: SparkSession, path: str, build, reuse: bool = True) -> DataFrame:
    """A workflow stage kept as a table: read it if it is whole at `path`, else build, write and read it."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not (reuse and done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
