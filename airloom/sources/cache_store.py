"""The embedding cache as a table of generations: appends, exact eviction, compaction.

A generation is a manifest (see ``term_index``) that lists folders of (key, embedding, used_at). An append adds a folder of
entries and uses; of a key the newest row counts. When ``MOST_FOLDERS`` are listed they are merged, so the number of files
stays bounded. Eviction keeps the most recently used keys; each change is one new manifest.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.retrieval import cache_merge
from . import term_index as store

MOST_FOLDERS = 8
SCHEMA = "key string, embedding array<double>, used_at bigint"


def read(spark: SparkSession, path: str, state: dict | None = None) -> DataFrame:
    """(key, embedding, used_at), unique by key: the newest embedding and use."""
    folders = [f"{path}/data/{b['folder']}" for b in (state or store.manifest(spark, path))["batches"]]
    rows = spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)
    return cache_merge(rows, rows.limit(0))


def append(entries: DataFrame, path: str) -> dict:
    """Adds entries and uses. A row without embedding only marks a use of its key; repeated keys of one call are one."""
    spark = entries.sparkSession
    now = store.manifest(spark, path)
    batches = now["batches"] + [_write(_one_per_key(entries), path)]
    if len(batches) > MOST_FOLDERS:
        batches = [_write(read(spark, path, {"batches": batches}), path)]
    return store.commit(spark, path, now["generation"], batches)


def evict(spark: SparkSession, path: str, max_size: int) -> dict:
    """Keeps the ``max_size`` most recently used keys (ties: the lesser key)."""
    now = store.manifest(spark, path)
    rows = read(spark, path, now)
    return store.commit(spark, path, now["generation"], [_write(cache_merge(rows, rows.limit(0), max_size), path)])


def _one_per_key(rows: DataFrame) -> DataFrame:
    return cache_merge(rows, rows.limit(0))


def _write(rows: DataFrame, path: str) -> dict:
    folder = uuid.uuid4().hex
    rows.select("key", F.col("embedding").cast("array<double>").alias("embedding"), F.col("used_at").cast("bigint").alias("used_at")).write.parquet(f"{path}/data/{folder}")
    return {"name": folder, "folder": folder}
