"""Session settings and the shared folder that holds lineage cuts and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def builder(app_name: str = "barlake") -> SparkSession.Builder:
    """A builder with the SQL settings the operators are tuned for; the master is the caller's."""
    return (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the cluster. Only a local master may fall back to a temp folder."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.removeprefix("file:").rstrip("/")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/barlake-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a table in the shared folder.

    The plan runs once, lost executors cost no recomputation beyond a scan, readers prune columns,
    and Spark knows the table's true size when it chooses joins.
    """
    path = scratch(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
