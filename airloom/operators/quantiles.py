"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one task. Here a mergeable sketch first brackets each wanted
rank, and only the few values inside the bracket are ranked; everything below it is only counted. A group therefore
sends O(values in the bracket) rows, about 6/accuracy of its size, and small groups are ranked whole.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .bounds import broadcast_if_small


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    accuracy: int = 10_000) -> DataFrame:
    """One row per key with a column per name in ``probs`` (linear interpolation between order statistics)."""
    if not keys:
        return exact_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probs, accuracy).drop("_all")
    data = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    margin = 3.0 / accuracy
    lows = [max(p - margin, 0.0) for p in probs.values()]
    highs = [min(p + margin, 1.0) for p in probs.values()]
    sketch = data.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", lows, accuracy).alias("_lo"),
        F.percentile_approx("_v", highs, accuracy).alias("_hi"),
    )
    whole = F.col("_n") <= accuracy
    brackets = F.array(*[
        F.struct(
            F.lit(name).alias("name"), ((F.col("_n") - 1) * F.lit(float(p))).alias("rank"),
            F.when(whole | F.lit(p <= margin), F.col("_min")).otherwise(F.col("_lo")[i]).alias("lo"),
            F.when(whole | F.lit(p >= 1 - margin), F.col("_max")).otherwise(F.col("_hi")[i]).alias("hi"),
        )
        for i, (name, p) in enumerate(probs.items())
    ])
    bounds = sketch.select(*keys, brackets.alias("_b"))
    joined = data.join(broadcast_if_small(bounds), keys)  # a row per key
    counted = (
        joined.select(*keys, "_v", F.explode("_b").alias("_b"))
        .where(F.col("_v") <= F.col("_b.hi"))
        .groupBy(*keys, F.col("_b.name").alias("_name"), F.col("_b.rank").alias("_rank"),
                 F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v")).alias("_x"))
        .agg(F.count("*").alias("_c"))
    )
    w = W.partitionBy(*keys, "_name").orderBy(F.col("_x").asc_nulls_first())
    running = counted.withColumn("_cum", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    low_rank, high_rank = F.floor("_rank"), F.ceil("_rank")
    picked = running.groupBy(*keys, "_name", "_rank").agg(
        F.min(F.when(F.col("_cum") > low_rank, F.col("_x"))).alias("_x0"),
        F.min(F.when(F.col("_cum") > high_rank, F.col("_x"))).alias("_x1"),
    )
    q = F.col("_x0") + (F.col("_x1") - F.col("_x0")) * (F.col("_rank") - F.floor("_rank"))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == name, q)).alias(name) for name in probs]
    )


def winsorize(df: DataFrame, keys: list[str], value: str, lower: float = 0.001, upper: float = 0.999) -> DataFrame:
    """Clip ``value`` to its quantiles per key; NULL stays NULL."""
    from ..functions.numeric import clamp

    if not keys:
        return winsorize(df.withColumn("_all", F.lit(1)), ["_all"], value, lower, upper).drop("_all")
    bounds = exact_quantiles(df, keys, value, {"_q_lo": lower, "_q_hi": upper})
    return df.join(broadcast_if_small(bounds), keys, "left").withColumn(value, clamp(F.col(value), F.col("_q_lo"), F.col("_q_hi"))).drop("_q_lo", "_q_hi")
