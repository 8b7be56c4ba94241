"""Session helpers: a tuned local session and lineage cuts in shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build(cores: str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("taxaloom")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TAXALOOM_DRIVER_MEMORY", "12g"))
    )
    for key, value in extra.items():
        b = b.config(key, value)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach.

    It is the session's ``spark.checkpoint.dir``. Only a local session without that
    setting gets a folder of its own, since there the driver is the only machine.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="taxaloom-")
    spark.sparkContext.setCheckpointDir(at)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """A scan whose few splits would leave cores idle in costly work, over all cores.

    For plain scans in front of Python work. Large inputs have more splits than cores and
    are returned as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


class Scratch:
    """Tables written to the shared folder to cut the lineage of iterative plans.

    A written table survives the loss of an executor and is smaller than a checkpointed
    RDD of rows. ``cut`` writes and reads back, ``drop`` deletes what is no longer read.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._count = 0

    def write(self, df: DataFrame) -> str:
        self._count += 1
        path = f"{self.root}/{self._count}"
        df.write.mode("error").option("compression", "zstd").parquet(path)
        return path

    def cut_and_see(self, df: DataFrame, measure: Column) -> tuple[DataFrame, str, object]:
        """As `cut`, with an aggregate of the rows, taken on the way."""
        seen = Observation()
        out, path = self.cut(df.observe(seen, measure.alias("n")))
        return out, path, seen.get["n"]

    def cut_and_count(self, df: DataFrame, condition: Column) -> tuple[DataFrame, str, int]:
        """As `cut`, with the number of rows that meet the condition, counted on the way."""
        out, path, n = self.cut_and_see(df, F.count(F.when(condition, 1)))
        return out, path, int(n)

    def cut(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = self.write(df)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str) -> None:
        jvm = self.spark._jvm
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
