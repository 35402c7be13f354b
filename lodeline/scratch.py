"""The folder that driver and executors share, and tables staged in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def is_local(spark: SparkSession) -> bool:
    """Whether everything runs in one process."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and
    everything runs in one process (tests), a temporary folder that this sets as the checkpoint
    folder; on a cluster an unset folder is an error, as no other one is surely shared."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = spark.conf.get("spark.lodeline.shared.dir", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="lodeline-")
        spark.conf.set("spark.lodeline.shared.dir", own)
        spark.sparkContext.setCheckpointDir(own)
    return own


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under one folder for each application."""
    return f"{shared_dir(spark)}/lodeline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again. This cuts the lineage: a lost
    executor costs the tasks that it ran, never the stages before, and what several consumers need is
    computed once."""
    spark, path = df.sparkSession, stage_path(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    spark, files = df.sparkSession, df.inputFiles()
    for folder in {f.rpartition("/")[0] for f in files}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it comes in no more parts than there are cores. That is a small table,
    often of one file with one row group, which one task would read: worth a shuffle before work on
    texts. A table of more parts stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


def release(spark: SparkSession) -> None:
    """Deletes this application's staged tables. Call it once no result is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lodeline-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
