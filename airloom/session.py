"""Session defaults.

``configure`` sets only what results depend on (the time zone) or what AQE needs, on a session that the caller owns.
Shuffle parallelism is left to the caller: AQE coalesces small partitions, and a cluster sets its own number.
"""
from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    wanted = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # A union of branches hashed alike is taken as hashed too, but AQE may coalesce the branches differently; an
        # aggregate above then skips its shuffle and returns a key twice. Seen on 4.1.2 with ``memory.compact``.
        "spark.sql.unionOutputPartitioning": "false",
    }
    for key, value in wanted.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that Python workers find it wherever they start."""
    sc = spark.sparkContext
    if getattr(sc, "_airloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(here):  # not when it already runs from an archive
        path = os.path.join(tempfile.mkdtemp(prefix="airloom-package-"), "airloom_package.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for folder, _, names in os.walk(here):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        archive.write(full, os.path.join("airloom", os.path.relpath(full, here)))
        sc.addPyFile(path)
    sc._airloom_shipped = True


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench."""
    return configure(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("airloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def cut_lineage(df):
    """Checkpoint to the shared folder that the cluster names in ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="airloom-ckpt-")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)
