"""Synthetic readings for runs without a live source, generated in parallel from ``spark.range``."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .. import constants as K
from ..functions.numeric import rough_local_hour


def _grid(spark: SparkSession, hours: int, base: dict[str, float], as_of: str) -> DataFrame:
    rows = spark.range(hours * len(base))
    names, levels = F.lit(list(base)), F.lit([float(v) for v in base.values()])
    p = (F.col("id") / hours).cast("int")
    start = F.date_trunc("hour", F.lit(as_of).cast("timestamp"))
    i = F.pmod("id", F.lit(hours))
    return rows.select(
        F.element_at(names, p + 1).alias("parameter"), F.element_at(levels, p + 1).alias("base"), i.alias("i"),
        (start - F.make_dt_interval(hours=(F.lit(hours - 1) - i).cast("int"))).alias("date_utc"), F.col("id").alias("seq"))


def hourly(spark: SparkSession, as_of: str, hours: int = 24, current: dict[str, float] | None = None,
           seed: int = 99) -> DataFrame:
    """Two daily peaks (local hours 8 and 20) and 8 % noise; each series ends at its live value, never below 1."""
    base = {p: max(float((current or {}).get(p, v)), 1.0) if current and p in current else v
            for p, v in K.DEMO_BASE.items()}
    g = _grid(spark, hours, base, as_of)

    def peak(h: int) -> Column:
        z = (rough_local_hour(F.col("date_utc")) - h) / 2.5
        return F.exp(-0.5 * z * z)

    raw = F.col("base") * (1.0 + 0.12 * (peak(8) + peak(20)) + 0.08 * F.randn(seed))
    last = F.max_by("raw", "i").over(W.partitionBy("parameter"))
    g = g.withColumn("raw", raw).withColumn("value", F.bround(F.greatest(F.col("raw") + F.col("base") - last, F.lit(1.0)), 1))
    return g.select("parameter", "value", F.lit("µg/m³").alias("unit"), "date_utc", F.lit("synthetic").alias("location"), "seq")


def historical(spark: SparkSession, as_of: str, days: int = 7, seed: int = 42) -> DataFrame:
    hours = days * 24
    g = _grid(spark, hours, K.DEMO_BASE, as_of)
    wave = F.sin(F.lit(days * 2.0) * F.pi() * F.col("i") / max(hours - 1, 1))
    value = F.greatest(F.col("base") * (1.0 + 0.2 * F.randn(seed) + 0.15 * wave), F.lit(0.0))
    return g.select("parameter", F.bround(value, 1).alias("value"), F.lit("µg/m³").alias("unit"), "date_utc",
                    F.lit("Delhi Demo Station").alias("location"), "seq")


def latest(spark: SparkSession, as_of: str) -> DataFrame:
    rows = [(p, v, "µg/m³", "Delhi Demo Station", i) for i, (p, v) in enumerate(K.DEMO_LATEST.items())]
    df = spark.createDataFrame(rows, "parameter string, value double, unit string, location string, seq bigint")
    return df.withColumn("date_utc", F.lit(as_of).cast("timestamp"))


def or_else(live: DataFrame, fallback: DataFrame) -> DataFrame:
    """``live`` unless it is empty (one bounded probe)."""
    return fallback if live.isEmpty() else live
