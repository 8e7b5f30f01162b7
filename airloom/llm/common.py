"""What several of these operators need: tables, intermediate tables in the shared folder, row keys, plain words."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import configure

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(os.path.join(folder, f"{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one is chosen only in local mode and only if none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="airloom-shared-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def store(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts lineage, and what reads it twice gets the same rows.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/airloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(stored: DataFrame) -> None:
    """Removes the files of ``store`` once nothing reads them any more."""
    spark = stored.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(stored._stored_at)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def lower_ascii(c):
    return F.translate(c, UPPER, LOWER)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns of the input cannot clash with those that are made."""
    return df.select(*(F.col(f"`{c}`") for c in columns))
