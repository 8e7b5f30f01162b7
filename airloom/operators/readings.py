"""Operators on long readings (parameter, value, unit, date_utc, location, seq)."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions import index as I
from .bounds import top_k
from .quantiles import exact_quantiles

# Arrival order, used wherever the answer depends on "the first row".
SEQ = "seq"


def latest_per_key(df: DataFrame, keys: list[str] = ("parameter", "location"), ts: str = "date_utc") -> DataFrame:
    """Newest non-NULL value of every other column per key."""
    rest = [c for c in df.columns if c not in keys]

    def newest(c):
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.col(ts), F.col(SEQ)))).alias(c)

    return df.groupBy(*keys).agg(*[newest(c) for c in rest])


def first_by(column: str, order: Column) -> Column:
    """First non-NULL value in a given order."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), order))


def exact_mean(column: str) -> Column:
    """Mean that does not depend on the order of the rows, for numbers that are rounded later: a sum of doubles ends on either
    side of a half, as rows are spread. Decimals of 18 places add up without error; a group with a value beyond 1e9 (or none)
    keeps the plain mean."""
    v = F.col(column)
    fits = F.abs(v) < 1e9  # not so for NaN
    total = F.sum(F.when(fits, v).cast("decimal(28,18)")).cast("double")
    return F.when(F.count_if(fits) == F.count(v), F.try_divide(total, F.count(v))).otherwise(F.avg(v))


def since(df: DataFrame, as_of: Column, hours: int, ts: str = "date_utc") -> DataFrame:
    return df.where(F.col(ts) >= as_of - F.make_dt_interval(hours=F.lit(hours + 1)))


def hourly_rollup(df: DataFrame, keys: list[str] = ("parameter",), ts: str = "date_utc") -> DataFrame:
    """Mean value, first unit and "N stations" per hour and key."""
    return df.groupBy(F.date_trunc("hour", ts).alias(ts), *keys).agg(
        exact_mean("value").alias("value"),
        first_by("unit", F.col(SEQ)).alias("unit"),
        F.concat(F.count_distinct("location").cast("string"), F.lit(" stations")).alias("location"),
    )


def city_concentrations(hourly: DataFrame, latest: DataFrame) -> DataFrame:
    """24-hour median per pollutant from the hourly table, else the median of the latest readings.

    The hourly table counts only if its first row (by parameter, then time) is not synthetic. It has one row per hour
    and parameter, so its median is small; the latest table grows with the stations and goes through exact_quantiles.
    """
    first_location = hourly.agg(F.min_by("location", F.struct("parameter", "date_utc"))).scalar()
    usable = hourly.where(F.coalesce(first_location != "synthetic", F.lit(False)))
    order = F.struct("date_utc", "location")
    from_hourly = usable.groupBy("parameter").agg(
        F.median("value").alias("value"), first_by("unit", order).alias("unit")).withColumn("src", F.lit(0))
    units = latest.groupBy("parameter").agg(first_by("unit", F.struct("location", "date_utc")).alias("unit"))
    from_latest = exact_quantiles(latest, ["parameter"], "value", {"value": 0.5}).join(units, "parameter").withColumn(
        "src", F.lit(1))
    both = from_hourly.unionByName(from_latest).where(F.col("parameter").isin(K.POLLUTANTS) & F.col("value").isNotNull())
    picked = both.groupBy("parameter").agg(F.min_by(F.struct("value", "unit"), "src").alias("r"))
    return picked.select("parameter", "r.value", "r.unit")


def current_means(latest: DataFrame) -> DataFrame:
    """Mean and first unit per pollutant (the tool's variant; the dashboard uses medians)."""
    return latest.where(F.col("parameter").isin(K.POLLUTANTS)).groupBy("parameter").agg(
        exact_mean("value").alias("value"), first_by("unit", F.struct("location", "date_utc")).alias("unit"))


def value_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("parameter").agg(
        F.avg("value").alias("average"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.count("value").alias("readings"))


def history_summary(df: DataFrame) -> DataFrame:
    """As ``value_summary`` but counting rows, NULL values included."""
    return df.groupBy("parameter").agg(
        F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"),
        F.count(F.lit(1)).alias("readings"))


def station_means(df: DataFrame) -> DataFrame:
    return df.groupBy("parameter", "location").agg(F.avg("value").alias("value"))


def newest_sensor(sensors: DataFrame, keys: list[str] = ("location_id", "parameter")) -> DataFrame:
    """Highest sensor id per location and parameter."""
    rest = [c for c in sensors.columns if c not in keys]
    picked = sensors.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("sensor_id")).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def index_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """Index per key from rows (parameter, value, unit), one row per key and parameter.

    The highest rounded sub-index decides; on a tie the parameter first in the display order is dominant.
    """
    rows = I.with_sub_index(df, "_raw").withColumn("_si", F.rint("_raw").cast("int")).drop("_raw")
    known = F.col("_si") >= 0
    order = F.struct(F.col("_si"), -I.display_rank(F.col("parameter")))
    out = rows.groupBy(*keys).agg(
        F.max(F.when(known, F.col("_si"))).alias("_aqi"),
        F.max_by("parameter", F.when(known, order)).alias("_dominant"),
        *[F.max(F.when(known & (F.col("parameter") == p), F.col("_si"))).alias(f"{p}_si") for p in K.POLLUTANTS],
    )
    category = F.coalesce(I.band(F.col("_aqi")), F.lit("Unknown"))
    return out.select(
        *keys,
        F.coalesce(F.col("_aqi"), F.lit(0)).alias("aqi"),
        category.alias("category"),
        F.when(category == "Unknown", "#999").otherwise(I.band_colour(category)).alias("color"),
        F.coalesce(F.col("_dominant"), F.lit("")).alias("dominant"),
        *[f"{p}_si" for p in K.POLLUTANTS],
    )


def sub_index_map(df: DataFrame) -> Column:
    """MAP<parameter, sub-index> from the ``*_si`` columns of ``index_of``."""
    entries = [F.struct(F.lit(p).alias("key"), F.col(f"{p}_si").alias("value")) for p in K.POLLUTANTS]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def snapshot(concentrations: DataFrame, city: DataFrame) -> DataFrame:
    """Key/value rows for the chat context: values, units, sub-indices and the index itself."""
    p, shown = F.col("parameter"), I.display_value(F.col("parameter"), F.col("value"), F.col("unit"))
    values = concentrations.select(F.explode(F.array(
        F.struct(p.alias("key"), shown.cast("string").alias("value")),
        F.struct(F.concat(p, F.lit("_unit")).alias("key"), I.display_unit(p).alias("value")),
    )).alias("e")).select("e.*")
    smoke = concentrations.where((p == "pm25") & (F.col("value") != 0)).select(
        F.lit("cigarette_equivalent_per_day").alias("key"),
        I.cigarettes_per_day(F.col("value")).cast("string").alias("value"))
    facts = city.select(F.explode(F.array(
        F.struct(F.lit("AQI").alias("key"), F.col("aqi").cast("string").alias("value")),
        F.struct(F.lit("AQI_category").alias("key"), F.col("category").alias("value")),
        F.struct(F.lit("dominant_pollutant").alias("key"), F.col("dominant").alias("value")),
        *[F.struct(F.lit(f"{q}_subindex").alias("key"), F.col(f"{q}_si").cast("string").alias("value"))
          for q in K.POLLUTANTS],
    )).alias("e")).select("e.*").where(F.col("value").isNotNull())
    return values.unionByName(facts).unionByName(smoke)


def station_index(latest: DataFrame) -> DataFrame:
    """Index per station from the mean of each parameter."""
    means = latest.groupBy("location", "parameter").agg(
        exact_mean("value").alias("value"), first_by("unit", F.struct("date_utc", SEQ)).alias("unit"))
    return index_of(means, ["location"])


def station_against_city(stations: DataFrame, city: DataFrame) -> DataFrame:
    """Difference to the city index with the ±20 banding."""
    city_aqi = city.select("aqi").scalar()
    diff = F.col("aqi") - F.col("city_aqi")
    return stations.withColumn("city_aqi", city_aqi).select(
        "location", "aqi", "category", "dominant", "city_aqi", diff.alias("difference"),
        F.when(diff > 20, "worse").when(diff < -20, "better").otherwise("similar").alias("standing"))


def last_n(df: DataFrame, keys: list[str], n: int, ts: str = "date_utc", rank: str = "_rn") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.col(ts).desc())
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def decayed_by_key(df: DataFrame, keys: list[str], value: str, ties: list[str], ratio: float = 0.9) -> DataFrame:
    """``decayed``: mean of all values of a key, highest first, with weights ratio^0, ratio^1, ...

    From some rank on a weight is 0 as a double; a task sends a key's values up to there only, which leaves nothing out.
    NULL values take no part.
    """
    ranks = math.ceil(math.log(5e-324) / math.log(ratio)) + 1
    best = top_k(df.where(F.col(value).isNotNull()).select(*keys, *ties, value), keys, [F.col(value).desc(), *ties], ranks, "_rank")
    weight = F.pow(F.lit(ratio), F.col("_rank") - 1)
    return best.groupBy(*keys).agg((F.sum(F.col(value) * weight) / (F.sum(weight) + 1e-9)).alias("decayed"))
