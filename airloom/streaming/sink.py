"""Run a stream over everything that is there and read back what it wrote."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def work_folder(spark: SparkSession) -> str:
    """A new folder under the shared ``spark.checkpoint.dir``; a local one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="airloom-stream-")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def run_once(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Drain the source into Parquet (exactly once, restartable from its checkpoint) and return the table."""
    spark = stream.sparkSession
    base = folder or work_folder(spark)
    q = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_whole(stream: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """Drain an aggregated stream and return the last state of every key, open windows included.

    Each batch writes the groups that it has changed (update mode) to a folder of its own, which a repeated batch
    overwrites; of each key the row of the newest batch stays.
    """
    spark = stream.sparkSession
    base = folder or work_folder(spark)
    fields = [c for c in stream.columns if c not in keys]

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/part={number}")

    q = (stream.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/out")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "_batch").alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in fields])
