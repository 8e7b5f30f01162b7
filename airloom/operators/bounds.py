"""Size-checked broadcasts and bounded top-k."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                       max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` for broadcast if it measures small; otherwise ``df`` as it is, for the optimizer to join.

    At most ``max_rows + 1`` rows are materialised for the measurement, and a small side is then used as materialised,
    so it is computed once. Beyond the bound the same equi-join runs shuffled, where AQE splits skewed keys.
    """
    probe = cut_lineage(df.limit(max_rows + 1))
    return F.broadcast(probe) if is_small(probe, max_rows, max_bytes) else df


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    width = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in _columns(df)), F.lit(16))
    rows, size = df.select(width.alias("w")).limit(max_rows + 1).agg(F.count("*"), F.sum("w")).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def _columns(df: DataFrame) -> list[str]:
    return [f"`{f.name}`" for f in df.schema.fields]


def spread_if_few(df: DataFrame) -> DataFrame:
    """Give CPU-heavy text work to all cores when the input has fewer splits than cores (small files only; a large
    input has far more splits and is left as it is)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key. ``order`` must end in a unique column.

    Spark applies the row_number limit before the shuffle too, so each task sends at most ``k`` rows per key.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
