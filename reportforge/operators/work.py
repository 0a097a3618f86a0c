"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs on this machine, a temporary folder; else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Work:
    """Tables written once and read back, so that lineage ends there; all but what a result reads are dropped at the end."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.held = spark, f"{work_dir(spark)}/reportforge/{name}-{uuid.uuid4().hex}", []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.held)}"
        df.write.option("compression", "zstd").parquet(path)
        self.held.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """Delete all tables but the last `keep`."""
        for path in self.held[: len(self.held) - keep]:
            remove(self.spark, path)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` after checkpoint(), whose folder is found or set as `work_dir` says."""
    spark = df.sparkSession
    at = work_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint()
