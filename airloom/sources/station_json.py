"""Nested JSON of a public sensor API (v3 envelopes) to flat tables. Input: a DataFrame with the raw body per row."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..operators import readings as R
from ..operators.bounds import broadcast_if_small

LOCATIONS_BODY = (
    "STRUCT<results: ARRAY<STRUCT<id: BIGINT, name: STRING, locality: STRING, country: STRUCT<code: STRING>, "
    "coordinates: STRUCT<latitude: DOUBLE, longitude: DOUBLE>, datetimeLast: STRING, "
    "sensors: ARRAY<STRUCT<id: BIGINT, parameter: STRUCT<name: STRING, units: STRING>>>>>>"
)
# ``datetime`` and ``datetimeFrom`` come as an object or as a plain string; kept as text and read by ``_instant``.
LATEST_BODY = "STRUCT<results: ARRAY<STRUCT<sensorsId: BIGINT, value: DOUBLE, datetime: STRING>>>"
SERIES_BODY = (
    "STRUCT<results: ARRAY<STRUCT<value: DOUBLE, period: STRUCT<datetimeFrom: STRING>, "
    "parameter: STRUCT<name: STRING, units: STRING>>>>"
)


def _instant_text(c: Column) -> Column:
    return F.coalesce(F.get_json_object(c, "$.utc"), F.when(~c.startswith("{"), c))


def locations(bodies: DataFrame, as_of: Column, active_days: int = 30, body: str = "body") -> DataFrame:
    """Stations seen in the last ``active_days``: a missing stamp drops the station, an unreadable one keeps it."""
    rows = bodies.select(F.explode(F.from_json(body, LOCATIONS_BODY)["results"]).alias("l")).select("l.*")
    last_text = F.get_json_object("datetimeLast", "$.utc")
    fresh = F.coalesce(F.try_to_timestamp(last_text) >= as_of - F.make_dt_interval(days=F.lit(active_days)), F.lit(True))
    sensors = F.transform(
        F.coalesce("sensors", F.array().cast("array<struct<id:bigint,parameter:struct<name:string,units:string>>>")),
        lambda s: F.struct(s["id"].alias("id"), F.coalesce(s["parameter"]["name"], F.lit("")).alias("parameter"),
                           F.coalesce(s["parameter"]["units"], F.lit("")).alias("units")))
    names = F.array_sort(F.array_distinct(F.filter(F.transform(sensors, lambda s: s["parameter"]), lambda p: p != "")))
    empty = F.lit("")
    return rows.where(last_text.isNotNull() & (last_text != "") & fresh).select(
        "id", F.coalesce("name", empty).alias("name"), F.coalesce("locality", empty).alias("locality"),
        F.coalesce(F.col("country.code"), empty).alias("country"), "coordinates", sensors.alias("sensors"),
        names.alias("parameters"), last_text.alias("last_updated"))


def sensor_table(stations: DataFrame, parameters: list[str] = K.POLLUTANTS) -> DataFrame:
    """(location_id, location, sensor_id, parameter, units) of the wanted parameters."""
    s = stations.select(F.col("id").alias("location_id"), F.col("name").alias("location"), F.explode("sensors").alias("s"))
    return s.select("location_id", "location", F.col("s.id").alias("sensor_id"), F.col("s.parameter").alias("parameter"),
                    F.col("s.units").alias("units")).where(
        F.col("parameter").isin(list(parameters)) & F.col("sensor_id").isNotNull())


def station_list(stations: DataFrame) -> DataFrame:
    """Selector rows, by name."""
    return stations.select(
        "id", "name", "locality", "parameters", F.col("coordinates.latitude").alias("lat"),
        F.col("coordinates.longitude").alias("lon"), "last_updated").orderBy("name", "id")


def latest_readings(bodies: DataFrame, sensors: DataFrame, body: str = "body") -> DataFrame:
    """Readings of /latest bodies (location_id, body) joined to their sensor; unknown sensors drop out."""
    rows = bodies.select("location_id", F.explode(F.from_json(body, LATEST_BODY)["results"]).alias("r")).select(
        "location_id", F.col("r.sensorsId").alias("sensor_id"), F.col("r.value").alias("value"),
        F.try_to_timestamp(_instant_text(F.col("r.datetime"))).alias("date_utc"))
    known = broadcast_if_small(sensors)
    return rows.join(known, ["location_id", "sensor_id"]).select(
        "parameter", "value", F.col("units").alias("unit"), "date_utc", "location", F.col("sensor_id").alias(R.SEQ))


def latest_city(bodies: DataFrame, sensors: DataFrame) -> DataFrame:
    return R.latest_per_key(latest_readings(bodies, sensors))


def station_latest(bodies: DataFrame, sensors: DataFrame, location_id: int) -> DataFrame:
    """One station, every reading."""
    only = F.col("location_id") == location_id
    return latest_readings(bodies.where(only), sensors.where(only))


def series_readings(bodies: DataFrame, sensors: DataFrame, body: str = "body") -> DataFrame:
    """Readings of /days or /measurements bodies (sensor_id, body). NULL values drop; the record's own parameter and
    unit win over the sensor's."""
    rows = bodies.select("sensor_id", F.explode(F.from_json(body, SERIES_BODY)["results"]).alias("r"))
    rows = rows.where(F.col("r.value").isNotNull()).join(broadcast_if_small(sensors), "sensor_id")
    return rows.select(
        F.coalesce("r.parameter.name", "parameter").alias("parameter"), F.col("r.value").alias("value"),
        F.coalesce("r.parameter.units", "units").alias("unit"),
        F.try_to_timestamp(_instant_text(F.col("r.period.datetimeFrom"))).alias("date_utc"), "location",
        F.col("sensor_id").alias(R.SEQ))


def hourly_readings(bodies: DataFrame, sensors: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Hourly means of the newest sensor per station and parameter within ``hours`` + 1 hours of ``as_of``."""
    newest = R.newest_sensor(sensors)
    rows = series_readings(bodies, newest).where(F.col("date_utc").isNotNull())
    return R.hourly_rollup(R.since(rows, as_of, hours))
