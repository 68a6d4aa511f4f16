"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share, from spark.checkpoint.dir.

    Where the setting is absent only a local master may fall back to a temp folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "cadenza-stage")


def stage(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, a folder a value of column ``by``, and read it back.

    Cuts lineage in a form that survives lost executors; Hadoop removes the folder when the JVM exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cadenza-{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
