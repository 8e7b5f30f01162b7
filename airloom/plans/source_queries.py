"""Queries on nested API bodies (built from the events by Spark), models and streams."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

from ..operators import readings as R
from ..operators import timeseries as TS
from ..session import configure
from ..sources import station_json as J
from ..sources.tables import EVENT_PARAMETERS, readings, table
from ..streaming import flows, sink
from . import sql_parts as S
from .catalog import near, query
from .index_queries import hourly

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
PARAMS = list(EVENT_PARAMETERS.values())


def _sensed(spark, sf) -> DataFrame:
    """Readings with station and sensor numbers: two sensors per station and parameter."""
    r = readings(spark, sf)
    station = F.substring_index("location", "-", -1).cast("bigint")
    kind = F.array_position(F.lit(PARAMS), F.col("parameter")) - 1
    return r.withColumns({"location_id": station, "sensor_id": station * 100 + kind * 10 + F.col("seq") % 2})


def _utc(ts):
    return F.struct(F.date_format(ts, STAMP).alias("utc"))


def location_bodies(spark, sf) -> DataFrame:
    s = _sensed(spark, sf)
    flags = [F.max(((F.col("parameter") == p) & (F.col("seq") % 2 == b)).cast("int")).alias(f"{p}_{b}") for p in PARAMS for b in (0, 1)]
    per = s.groupBy("location_id").agg(F.max("date_utc").alias("last"), F.first("location").alias("name"), *flags)
    sensors = F.filter(F.array(*[
        F.when(F.col(f"{p}_{b}") == 1, F.struct(
            (F.col("location_id") * 100 + i * 10 + b).alias("id"),
            F.struct(F.lit(p).alias("name"), F.lit("µg/m³").alias("units")).alias("parameter")))
        for i, p in enumerate(PARAMS) for b in (0, 1)]), lambda x: x.isNotNull())
    loc = F.struct(
        F.col("location_id").alias("id"), F.col("name"), F.struct(F.lit("IN").alias("code")).alias("country"),
        F.struct((F.col("location_id") / 10.0).alias("latitude"), (F.col("location_id") / 5.0).alias("longitude")).alias("coordinates"),
        _utc(F.col("last")).alias("datetimeLast"), sensors.alias("sensors"))
    return per.select(F.to_json(F.struct(F.array(loc).alias("results"))).alias("body"))


def _as_of(spark, sf):
    return readings(spark, sf).agg(F.max("date_utc").alias("m")).scalar()


def stations(spark, sf, days: int = 1) -> DataFrame:
    return J.locations(location_bodies(spark, sf), _as_of(spark, sf), days)


ACTIVE = S.READINGS + """,
sensed AS (SELECT *, CAST(substr(location, 9) AS BIGINT) AS location_id, CAST(substr(location, 9) AS BIGINT) * 100 + (list_position(['pm25', 'pm10', 'no2', 'so2', 'co'], parameter) - 1) * 10 + seq % 2 AS sensor_id FROM readings),
lim AS (SELECT max(date_utc) AS now FROM readings),
act AS (SELECT location_id, any_value(location) AS name, max(date_utc) AS last FROM sensed, lim GROUP BY 1, now HAVING max(date_utc) >= now - INTERVAL 1 DAY),
sens AS (SELECT DISTINCT location_id, location, sensor_id, parameter FROM sensed WHERE location_id IN (SELECT location_id FROM act))"""


@query("src_locations_active", f"""WITH {ACTIVE}
SELECT act.location_id AS id, name, 'IN' AS country, count(*)::INTEGER AS sensors, string_agg(DISTINCT parameter, ',' ORDER BY parameter) AS parameters FROM act JOIN sens USING (location_id) GROUP BY 1, 2""")
def src_locations_active(spark, sf):
    return stations(spark, sf).select("id", "name", "country", F.size("sensors").alias("sensors"), F.array_join("parameters", ",").alias("parameters"))


@query("src_station_list", f"WITH {ACTIVE} SELECT location_id AS id, name, location_id / 10.0::DOUBLE AS lat, location_id / 5.0::DOUBLE AS lon FROM act")
def src_station_list(spark, sf):
    return J.station_list(stations(spark, sf)).select("id", "name", "lat", "lon")


def latest_bodies(spark, sf) -> DataFrame:
    """One /latest body per station; at most ten sensors each."""
    s = _sensed(spark, sf).groupBy("location_id", "sensor_id").agg(
        F.max_by("value", F.struct("date_utc", "seq")).alias("value"), F.max("date_utc").alias("t"))
    item = F.struct(F.col("sensor_id").alias("sensorsId"), "value", _utc(F.col("t")).alias("datetime"))
    return s.groupBy("location_id").agg(F.collect_list(item).alias("results")).select("location_id", F.to_json(F.struct("results")).alias("body"))


LAST = f"""{ACTIVE},
ls AS (SELECT location_id, location, sensor_id, parameter, arg_max(value, (date_utc, seq)) AS value, max(date_utc) AS date_utc FROM sensed JOIN act USING (location_id) GROUP BY 1, 2, 3, 4)"""


@query("src_latest_readings", f"WITH {LAST} SELECT location, parameter, sensor_id AS seq, value, date_utc FROM ls")
def src_latest_readings(spark, sf):
    rows = J.latest_readings(latest_bodies(spark, sf), J.sensor_table(stations(spark, sf)))
    return rows.select("location", "parameter", "seq", "value", "date_utc")


@query("src_latest_city", f"WITH {LAST} SELECT location, parameter, arg_max(value, (date_utc, sensor_id)) AS value, 'µg/m³' AS unit, max(date_utc) AS date_utc FROM ls GROUP BY 1, 2")
def src_latest_city(spark, sf):
    rows = J.latest_city(latest_bodies(spark, sf), J.sensor_table(stations(spark, sf)))
    return rows.select("location", "parameter", "value", "unit", "date_utc")


def series_bodies(spark, sf) -> DataFrame:
    """One body per reading; every seventh has no value, every other one names its own parameter."""
    s = _sensed(spark, sf)
    own = F.when(F.col("seq") % 2 == 0, F.struct(F.upper("parameter").alias("name"), F.lit("mg/m³").alias("units")))
    item = F.struct(F.when(F.col("seq") % 7 != 0, F.col("value")).alias("value"),
                    F.struct(_utc(F.col("date_utc")).alias("datetimeFrom")).alias("period"), own.alias("parameter"))
    return s.select("sensor_id", F.to_json(F.struct(F.array(item).alias("results"))).alias("body"))


@query("src_historical_readings", f"""WITH {ACTIVE}
SELECT location, CASE WHEN seq % 2 = 0 THEN upper(parameter) ELSE parameter END AS parameter, CASE WHEN seq % 2 = 0 THEN 'mg/m³' ELSE 'µg/m³' END AS unit, value, date_utc
FROM sensed WHERE location_id IN (SELECT location_id FROM act) AND seq % 7 <> 0""")
def src_historical_readings(spark, sf):
    rows = J.series_readings(series_bodies(spark, sf), J.sensor_table(stations(spark, sf)))
    return rows.select("location", "parameter", "unit", "value", "date_utc")


@query("src_hourly_window", f"""WITH {ACTIVE},
newest AS (SELECT location_id, parameter, max(sensor_id) AS sensor_id FROM sens GROUP BY 1, 2),
r AS (SELECT sensed.*, CASE WHEN seq % 2 = 0 THEN upper(sensed.parameter) ELSE sensed.parameter END AS p FROM sensed JOIN newest USING (sensor_id), lim WHERE seq % 7 <> 0 AND date_utc >= now - INTERVAL 49 HOUR)
SELECT date_trunc('hour', date_utc) AS date_utc, p AS parameter, round(avg(value) + 1e-9, 6) AS value, count(DISTINCT location) || ' stations' AS location FROM r GROUP BY 1, 2""")
def src_hourly_window(spark, sf):
    rows = J.hourly_readings(series_bodies(spark, sf), J.sensor_table(stations(spark, sf)), _as_of(spark, sf), 48)
    return rows.select("date_utc", "parameter", near("value").alias("value"), "location")


# --- Streams --------------------------------------------------------------------------------

def reading_stream(spark, sf) -> DataFrame:
    schema = configure(spark).read.parquet(os.path.join(sf, "events.parquet")).schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    pairs = [F.lit(x) for kv in EVENT_PARAMETERS.items() for x in kv]
    return e.select(F.create_map(*pairs)[F.col("event_type")].alias("parameter"), "value", F.lit("µg/m³").alias("unit"),
                    F.col("ts").cast("timestamp").alias("date_utc"), F.col("user_id").cast("string").alias("location"), F.col("event_id").alias("seq"))


@query("str_hourly_rollup", f"""WITH {S.READINGS}
SELECT date_trunc('hour', date_utc) AS date_utc, parameter, round(avg(value) + 1e-9, 6) AS value, count(*) AS readings FROM readings GROUP BY 1, 2""")
def str_hourly_rollup(spark, sf):
    """Every hour of the drained stream, the ones that the watermark has not closed included."""
    out = sink.run_whole(flows.hourly_rollup(reading_stream(spark, sf)), ["date_utc", "parameter"])
    return out.withColumn("value", near("value"))


@query("str_sub_indices", f"""SELECT event_id AS seq, round({S.sub_index("value", "p")} + 1e-9, 6) AS sub_index FROM (SELECT event_id,
  CASE event_type WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'pm10' WHEN 'purchase' THEN 'no2' WHEN 'error' THEN 'so2' ELSE 'co' END AS p, CASE WHEN event_type = 'signup' THEN value / 1000 ELSE value END AS value FROM events)""")
def str_sub_indices(spark, sf):
    out = sink.run_once(flows.sub_indices(reading_stream(spark, sf)), "append")
    return out.select("seq", near("sub_index").alias("sub_index"))


__all__ = ["R"]
