"""Streaming forms of the polled refresh: the same column functions on ``readStream``."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import index as I
from ..sources import index_store


def hourly_rollup(stream: DataFrame, watermark: str = "1 hour", ts: str = "date_utc") -> DataFrame:
    """Tumbling hourly mean per parameter; readings later than the watermark drop."""
    return (
        stream.withWatermark(ts, watermark)
        .groupBy(F.window(ts, "1 hour"), "parameter")
        .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("readings"))
        .select(F.col("window.start").alias("date_utc"), "parameter", "value", "readings")
    )


def sub_indices(stream: DataFrame) -> DataFrame:
    """Stateless: sub-index and band of each reading."""
    return I.with_sub_index(stream).withColumn("category", I.band(F.rint("sub_index")))


def latest_per_key(stream: DataFrame, ts: str = "date_utc") -> DataFrame:
    """Newest reading per station and parameter (complete or update mode); state is one row per key."""
    return stream.groupBy("parameter", "location").agg(
        F.max_by(F.struct("value", "unit"), F.struct(ts, "seq")).alias("r"), F.max(ts).alias(ts)
    ).select("parameter", "location", "r.value", "r.unit", ts)


def sliding_change(stream: DataFrame, watermark: str = "1 hour", ts: str = "date_utc") -> DataFrame:
    """Six-hour windows every hour: mean of the later against the earlier three hours, in percent."""
    rows = stream.withWatermark(ts, watermark).select("parameter", "value", ts, F.window(ts, "6 hours", "1 hour").alias("w"))
    late = F.col(ts) >= F.col("w.start") + F.expr("INTERVAL 3 HOURS")
    out = rows.groupBy("w", "parameter").agg(
        F.avg(F.when(late, F.col("value"))).alias("recent"), F.avg(F.when(~late, F.col("value"))).alias("earlier"))
    change = F.when(F.col("earlier") > 0, (F.col("recent") - F.col("earlier")) / F.col("earlier") * 100.0)
    return out.select(F.col("w.end").alias("date_utc"), "parameter", "recent", "earlier", change.alias("pct_change"))


def index_new_pages(path: str, stream: str):
    """``foreachBatch`` function: chunk and append the documents that the index does not know yet.

    ``stream`` names the stream (one name per checkpoint): a batch that is run again overwrites its own folder.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        index_store.append(batch.dropDuplicates(["doc_name", "page"]), path, f"{stream}-{batch_id}")
    return run


__all__ = ["hourly_rollup", "sub_indices", "latest_per_key", "sliding_change", "index_new_pages"]
