"""Reading the corpus tables and keeping intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``; a single Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a session without that setting (a test on one machine) gets a folder of its own.
    """
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if said:
        return said
    if spark.sparkContext.master.startswith("local"):
        own = os.path.join(tempfile.gettempdir(), f"storyloom-{os.getpid()}")
        return f"file://{own}"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be over; the folder is the cluster's to clear then
        pass


def scratch(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, cleared when the process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/storyloom-{label}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    Later readers prune columns and survive the loss of executors. The files go when the process ends.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores; for costly steps on tables of a few files.

    Tables with enough partitions, as all large ones, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
