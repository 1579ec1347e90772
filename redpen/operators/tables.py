"""Tables that several later steps read."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share (spark.checkpoint.dir); None without one on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.startswith("local"):
        import tempfile  # one process: tests and trials

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="redpen-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def materialized(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """A copy in the folder that driver and executors share, as Parquet, which is much smaller than a checkpoint, so that what it is made of runs once. Without such a folder on a cluster, the table as it is. The copy's path is added to ``made``, for ``remove``."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not folder:
        return df
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, made: list[str]) -> None:
    """Delete folders that nothing reads any more, and forget them."""
    jvm = spark.sparkContext._jvm
    while made:
        at = jvm.org.apache.hadoop.fs.Path(made.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settled(spark: SparkSession) -> None:
    """Let go of the shuffles of finished steps now. Else they stay on the disks until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
