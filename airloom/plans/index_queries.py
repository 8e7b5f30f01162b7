"""Queries on readings: conversion, index, rollups, summaries, charts."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions import index as I
from ..functions import numeric as N
from ..operators import readings as R
from ..operators.quantiles import exact_quantiles, winsorize
from ..sources.tables import readings, table
from . import sql_parts as S
from .catalog import near, query

def hourly(spark, sf) -> DataFrame:
    return R.hourly_rollup(readings(spark, sf))


def latest(spark, sf) -> DataFrame:
    return R.latest_per_key(readings(spark, sf))


@query("src_hourly_rollup", f"""WITH {S.HOURLY}
SELECT date_utc, parameter, round(value + 1e-9, 6) AS value, unit, location FROM hourly""")
def src_hourly_rollup(spark, sf):
    return hourly(spark, sf).withColumn("value", near("value", 6))


@query("aqi_hourly_index", f"""WITH {S.HOURLY}
SELECT date_utc, aqi, category, dominant FROM ({S.index_rows("hourly", "date_utc")})""")
def aqi_hourly_index(spark, sf):
    """Flagship: hourly rollup, unit conversion, sub-index, highest with its pollutant, band."""
    return R.index_of(hourly(spark, sf), ["date_utc"]).select("date_utc", "aqi", "category", "dominant")


@query("aqi_station_index", f"""WITH {S.READINGS},
m AS (SELECT location, parameter, avg(value) AS value, arg_min(unit, (date_utc, seq)) FILTER (unit IS NOT NULL) AS unit
      FROM readings GROUP BY 1, 2)
SELECT location, aqi, category, dominant FROM ({S.index_rows("m", "location")})""")
def aqi_station_index(spark, sf):
    return R.station_index(readings(spark, sf)).select("location", "aqi", "category", "dominant")


@query("aqi_station_vs_city", f"""WITH {S.LATEST},
m AS (SELECT location, parameter, avg(value) AS value, arg_min(unit, date_utc) FILTER (unit IS NOT NULL) AS unit
      FROM latest GROUP BY 1, 2),
s AS ({S.index_rows("m", "location")}),
cm AS (SELECT parameter, avg(value) AS value, arg_min(unit, (location, date_utc)) FILTER (unit IS NOT NULL) AS unit
       FROM latest GROUP BY 1),
c AS ({S.index_rows("cm", "")})
SELECT location, s.aqi, s.category, s.dominant, c.aqi AS city_aqi, s.aqi - c.aqi AS difference,
       CASE WHEN s.aqi - c.aqi > 20 THEN 'worse' WHEN s.aqi - c.aqi < -20 THEN 'better' ELSE 'similar' END AS standing
FROM s, c""")
def aqi_station_vs_city(spark, sf):
    now = latest(spark, sf)
    return R.station_against_city(R.station_index(now), R.index_of(R.current_means(now), []))


@query("prj_unit_convert", f"""WITH {S.READINGS}
SELECT seq, parameter, round({S.index_unit()} + 1e-9, 6) AS concentration FROM readings""")
def prj_unit_convert(spark, sf):
    return readings(spark, sf).select("seq", "parameter", near(I.to_index_unit(F.col("parameter"), F.col("value"), F.col("unit")), 6).alias("concentration"))


def _shown(x, digits: int):
    """Whether a number is not within a millionth of half a step, where engines may round it to different sides."""
    step = F.lit(10.0 ** digits)
    return F.abs(F.abs(x * step) % 1 - 0.5) > 1e-6


def _shown_sql(x: str, digits: int) -> str:
    return f"abs(abs({x} * {10 ** digits}::DOUBLE) % 1 - 0.5) > 1e-6"


@query("prj_display_value", f"""WITH {S.READINGS}
SELECT seq, CASE WHEN parameter = 'co' THEN 'mg/m³' ELSE 'µg/m³' END AS shown_unit,
       CASE WHEN parameter = 'co' THEN CASE WHEN {_shown_sql("c", 2)} THEN round_even(c, 2) END
            WHEN {_shown_sql("c", 1)} THEN round_even(c, 1) END AS shown
FROM (SELECT *, {S.index_unit()} AS c FROM readings)""")
def prj_display_value(spark, sf):
    r = readings(spark, sf)
    p = F.col("parameter")
    c = I.to_index_unit(p, F.col("value"), F.col("unit"))
    sure = F.when(p == "co", _shown(c, 2)).otherwise(_shown(c, 1))
    return r.select("seq", I.display_unit(p).alias("shown_unit"),
                    F.when(sure, I.display_value(p, F.col("value"), F.col("unit"))).alias("shown"))


@query("prj_sub_index", f"""WITH {S.READINGS}
SELECT seq, parameter, round({S.sub_index("c")} + 1e-9, 6) AS sub_index, {S.band("round_even(" + S.sub_index("c") + ", 0)")} AS category
FROM (SELECT *, {S.index_unit()} AS c FROM readings)""")
def prj_sub_index(spark, sf):
    return I.with_sub_index(readings(spark, sf), "si").select(
        "seq", "parameter", near("si", 6).alias("sub_index"), I.band(F.rint("si")).alias("category"))


@query("prj_pm25_band", f"""SELECT event_id, {S.band("CAST(trunc(" + S.curve("pm25", "value") + ") AS INTEGER)")} AS category
FROM events""")
def prj_pm25_band(spark, sf):
    return table(spark, sf, "events").select("event_id", I.band_of_pm25(F.col("value")).alias("category"))


@query("prj_band_texts", "SELECT b AS category, c AS color, a AS advice, n AS readings FROM (SELECT category AS b, count(*) AS n, "
       "CASE category " + " ".join(f"WHEN '{b}' THEN '{c}'" for b, _, c in K.BANDS) + " END AS c, "
       "CASE category " + " ".join(f"WHEN '{b}' THEN '{a}'" for b, a in K.BAND_ADVICE.items()) + " END AS a "
       f"FROM (SELECT {S.band('CAST(trunc(' + S.curve('pm25', 'value') + ') AS INTEGER)')} AS category FROM events) GROUP BY category)")
def prj_band_texts(spark, sf):
    counts = table(spark, sf, "events").groupBy(I.band_of_pm25(F.col("value")).alias("category")).agg(F.count(F.lit(1)).alias("readings"))
    c = F.col("category")
    return counts.select("category", I.band_colour(c).alias("color"), I.band_advice(c).alias("advice"), "readings")


@query("prj_range_join_breakpoints", """WITH bp(i, lo, hi, ilo, ihi) AS (VALUES (1, 0.0, 30.0, 0.0, 50.0), (2, 30.0, 60.0, 50.0, 100.0),
  (3, 60.0, 90.0, 100.0, 200.0), (4, 90.0, 120.0, 200.0, 300.0), (5, 120.0, 250.0, 300.0, 400.0), (6, 250.0, 380.0, 400.0, 500.0))
SELECT coalesce(i, 7)::INTEGER AS segment, count(*) AS readings, round(avg(coalesce(ilo::DOUBLE + (ihi - ilo)::DOUBLE * (value - lo) / (hi - lo)::DOUBLE, 500)) + 1e-9, 6) AS mean_index
FROM events LEFT JOIN bp ON (value > lo OR i = 1) AND value <= hi GROUP BY 1""")
def prj_range_join_breakpoints(spark, sf):
    """Value to segment as a CASE chain (the range join without a join)."""
    b = K.BREAKPOINTS["pm25"]
    segment = F.lit(7)
    for i in range(6, 0, -1):
        segment = F.when(F.col("value") <= b[i], i).otherwise(segment)
    return table(spark, sf, "events").groupBy(segment.alias("segment")).agg(
        F.count(F.lit(1)).alias("readings"), near(F.avg(I.sub_index("pm25", F.col("value"))), 6).alias("mean_index"))


@query("prj_parameter_alias", """SELECT p AS parameter, count(*) AS readings FROM (SELECT CASE event_type WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'o3'
  WHEN 'purchase' THEN 'no2' WHEN 'error' THEN 'wind_speed' END AS p FROM events) WHERE p IS NOT NULL GROUP BY 1""")
def prj_parameter_alias(spark, sf):
    raw = F.when(F.col("event_type") == "view", " PM2.5").when(F.col("event_type") == "click", "Ozone ").when(
        F.col("event_type") == "purchase", "Nitrogen Dioxide").when(F.col("event_type") == "error", "WS").otherwise("unknown")
    rows = table(spark, sf, "events").select(I.canonical_parameter(raw).alias("parameter"))
    return rows.where(F.col("parameter").isNotNull()).groupBy("parameter").agg(F.count(F.lit(1)).alias("readings"))


@query("prj_calendar", """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(month(ts) AS INTEGER) AS month,
  CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, round(sin(2 * pi() * hour(ts) / 24) + 1e-9, 6) + 0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24) + 1e-9, 6) + 0 AS hour_cos,
  round(sin(2 * pi() * (isodow(ts) - 1) / 7) + 1e-9, 6) + 0 AS dow_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7) + 1e-9, 6) + 0 AS dow_cos,
  round(sin(2 * pi() * month(ts) / 12) + 1e-9, 6) + 0 AS month_sin, round(cos(2 * pi() * month(ts) / 12) + 1e-9, 6) + 0 AS month_cos,
  CAST(hour(ts + INTERVAL '5 hours 30 minutes') AS INTEGER) AS local_hour, CAST((hour(ts) + 5) % 24 AS INTEGER) AS rough_hour FROM events""")
def prj_calendar(spark, sf):
    ts = F.col("ts")
    cal = {k: (near(v, 6) + F.lit(0.0) if k.endswith(("sin", "cos")) else v) for k, v in N.calendar(ts).items()}
    return table(spark, sf, "events").select(
        "event_id", *[v.alias(k) for k, v in cal.items()], F.hour(N.local_time(ts)).alias("local_hour"),
        N.rough_local_hour(ts).alias("rough_hour"))


@query("prj_wind_interactions", """SELECT event_id, round(value * sin(radians(d)) + 1e-9, 6) AS wind_u, round(value * cos(radians(d)) + 1e-9, 6) AS wind_v,
  round(value * d / 100 + 1e-9, 6) AS temp_hum_interaction, round(d * value / 1000 + 1e-9, 6) AS solar_temp
FROM (SELECT event_id, value, CAST(user_id AS DOUBLE) AS d FROM events)""")
def prj_wind_interactions(spark, sf):
    from ..operators.timeseries import with_meteo

    d = F.col("user_id").cast("double")
    rows = table(spark, sf, "events").select(
        "event_id", F.col("value").alias("wind_speed"), d.alias("wind_dir"), F.col("value").alias("temperature"), d.alias("humidity"), d.alias("solar_rad"))
    out = with_meteo(rows)
    return out.select("event_id", *[near(c, 6).alias(c) for c in ("wind_u", "wind_v", "temp_hum_interaction", "solar_temp")])


@query("prj_uncertainty_band", """SELECT event_id, h AS hour_offset, round(greatest(0, value * (1 - (0.1::DOUBLE + 0.05::DOUBLE * h))) + 1e-9, 6) AS lower, round(value * (1 + (0.1::DOUBLE + 0.05::DOUBLE * h)) + 1e-9, 6) AS upper
FROM events, (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS h)""")
def prj_uncertainty_band(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("hour_offset"))
    low, high = N.horizon_band(F.col("value"), F.col("hour_offset"))
    return rows.select("event_id", "hour_offset", near(low, 6).alias("lower"), near(high, 6).alias("upper"))


@query("prj_limit_ratios", f"""SELECT event_id, CASE WHEN {_shown_sql("value / 22", 1)} THEN round_even(value / 22, 1) END AS cigarettes,
  CASE WHEN value <> 0 AND {_shown_sql("value / 15", 1)} THEN round_even(value / 15, 1) END AS who_ratio,
  round(least(value / 500 * 100, 100) + 1e-9, 6) AS bar_pct, round(1 / (1 + exp(-(value - 50) / 10)) + 1e-9, 6) AS logistic FROM events""")
def prj_limit_ratios(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", F.when(_shown(v / K.CIGARETTE_PM25, 1), I.cigarettes_per_day(v)).alias("cigarettes"),
        F.when(_shown(v / 15.0, 1), I.who_ratio(v, I.who_limit(F.lit("pm25")))).alias("who_ratio"),
        near(I.bar_percent(v), 6).alias("bar_pct"), near(N.sigmoid((v - 50) / 10.0), 6).alias("logistic"))


@query("agg_latest_per_key", f"""WITH {S.LATEST} SELECT parameter, location, value, unit, date_utc FROM latest""")
def agg_latest_per_key(spark, sf):
    return latest(spark, sf).select("parameter", "location", "value", "unit", "date_utc")


@query("agg_distinct_stations", f"""WITH {S.READINGS}
SELECT parameter, count(DISTINCT location) AS stations FROM readings GROUP BY 1""")
def agg_distinct_stations(spark, sf):
    return readings(spark, sf).groupBy("parameter").agg(F.count_distinct("location").alias("stations"))


@query("agg_summary_stats", f"""WITH {S.LATEST}
SELECT parameter, round(avg(value) + 1e-9, 6) AS average, min(value) AS min, max(value) AS max, count(value) AS readings FROM latest GROUP BY 1""")
def agg_summary_stats(spark, sf):
    return R.value_summary(latest(spark, sf)).withColumn("average", near("average", 6))


@query("agg_history_summary", f"""WITH {S.READINGS}
SELECT parameter, round(avg(value) + 1e-9, 6) AS mean, max(value) AS max, min(value) AS min, count(*) AS readings FROM readings GROUP BY 1""")
def agg_history_summary(spark, sf):
    return R.history_summary(readings(spark, sf)).withColumn("mean", near("mean", 6))


@query("agg_current_index_tool", f"""WITH {S.LATEST},
m AS (SELECT parameter, avg(value) AS value, arg_min(unit, (location, date_utc)) FILTER (unit IS NOT NULL) AS unit FROM latest GROUP BY 1)
SELECT aqi, category, dominant, (SELECT count(DISTINCT location) FROM latest) AS stations FROM ({S.index_rows("m", "")})""")
def agg_current_index_tool(spark, sf):
    now = latest(spark, sf)
    stations = now.agg(F.count_distinct("location").alias("stations")).scalar()
    return R.index_of(R.current_means(now), []).select("aqi", "category", "dominant", stations.alias("stations"))


@query("agg_city_medians", f"""WITH {S.HOURLY}
SELECT parameter, round(median(value) + 1e-9, 6) AS value, arg_min(unit, date_utc) FILTER (unit IS NOT NULL) AS unit FROM hourly GROUP BY 1""")
def agg_city_medians(spark, sf):
    out = R.city_concentrations(hourly(spark, sf), latest(spark, sf))
    return out.withColumn("value", near("value", 6))


@query("agg_city_medians_fallback", f"""WITH {S.LATEST}
SELECT parameter, round(median(value) + 1e-9, 6) AS value, arg_min(unit, (location, date_utc)) FILTER (unit IS NOT NULL) AS unit FROM latest GROUP BY 1""")
def agg_city_medians_fallback(spark, sf):
    """The hourly table is synthetic, so the latest readings decide."""
    fake = hourly(spark, sf).withColumn("location", F.lit("synthetic"))
    return R.city_concentrations(fake, latest(spark, sf)).withColumn("value", near("value", 6))


@query("agg_exact_quantiles", f"""WITH {S.READINGS}
SELECT parameter, round(quantile_cont(value, 0.001) + 1e-9, 6) AS q001, round(median(value) + 1e-9, 6) AS q500, round(quantile_cont(value, 0.999) + 1e-9, 6) AS q999 FROM readings GROUP BY 1""")
def agg_exact_quantiles(spark, sf):
    q = exact_quantiles(readings(spark, sf), ["parameter"], "value", {"q001": 0.001, "q500": 0.5, "q999": 0.999})
    return q.select("parameter", *[near(c, 6).alias(c) for c in ("q001", "q500", "q999")])


@query("agg_winsorize", f"""WITH {S.READINGS},
b AS (SELECT parameter, quantile_cont(value, 0.001) AS lo, quantile_cont(value, 0.999) AS hi FROM readings GROUP BY 1)
SELECT seq, parameter, round(greatest(least(value, hi), lo) + 1e-9, 6) AS value FROM readings JOIN b USING (parameter)""")
def agg_winsorize(spark, sf):
    return winsorize(readings(spark, sf), ["parameter"], "value").select("seq", "parameter", near("value", 6).alias("value"))


@query("agg_station_means", f"""WITH {S.READINGS}
SELECT parameter, location, round(avg(value) + 1e-9, 6) AS value FROM readings GROUP BY 1, 2""")
def agg_station_means(spark, sf):
    return R.station_means(readings(spark, sf)).withColumn("value", near("value", 6))


@query("flt_recent_window", f"""WITH {S.READINGS}, r AS (SELECT * FROM readings WHERE date_utc >= (SELECT max(date_utc) FROM readings) - INTERVAL 25 HOUR)
SELECT parameter, count(*) AS readings, round(avg(value) + 1e-9, 6) AS mean FROM r GROUP BY 1""")
def flt_recent_window(spark, sf):
    r = readings(spark, sf)
    now = r.agg(F.max("date_utc").alias("m")).scalar()
    return R.since(r, now, 24).groupBy("parameter").agg(F.count(F.lit(1)).alias("readings"), near(F.avg("value"), 6).alias("mean"))


@query("join_dim_limits", f"""WITH {S.READINGS}
SELECT parameter, count(*) AS readings, count(*) FILTER (value > w) AS over_who, count(*) FILTER (value > i) AS over_india
FROM (SELECT parameter, value, CASE parameter WHEN 'pm25' THEN 15 WHEN 'pm10' THEN 45 WHEN 'no2' THEN 25 WHEN 'so2' THEN 40 WHEN 'o3' THEN 100 WHEN 'co' THEN 4000 END AS w,
  CASE parameter WHEN 'pm25' THEN 60 WHEN 'pm10' THEN 100 WHEN 'no2' THEN 80 WHEN 'so2' THEN 80 WHEN 'o3' THEN 100 WHEN 'co' THEN 4000 END AS i FROM readings) GROUP BY 1""")
def join_dim_limits(spark, sf):
    return readings(spark, sf).groupBy("parameter").agg(
        F.count(F.lit(1)).alias("readings"), F.count_if(F.col("value") > I.who_limit(F.col("parameter"))).alias("over_who"),
        F.count_if(F.col("value") > I.india_limit(F.col("parameter"))).alias("over_india"))


@query("topk_newest_sensor", """SELECT n_regionkey AS location_id, upper(substr(n_name, 1, 1)) AS parameter, max(n_nationkey) AS sensor_id, arg_max(n_name, n_nationkey) AS name FROM nation GROUP BY 1, 2""")
def topk_newest_sensor(spark, sf):
    s = table(spark, sf, "nation").select(
        F.col("n_regionkey").alias("location_id"), F.upper(F.substring("n_name", 1, 1)).alias("parameter"),
        F.col("n_nationkey").alias("sensor_id"), F.col("n_name").alias("name"))
    return R.newest_sensor(s)


# --- Tables behind the charts ---------------------------------------------------------------

@query("viz_sub_index_bars", f"""WITH {S.HOURLY},
c AS (SELECT parameter, median(value) AS value, arg_min(unit, date_utc) FILTER (unit IS NOT NULL) AS unit FROM hourly GROUP BY 1)
SELECT parameter, {S.label()} AS label, si AS sub_index, {S.band("si")} AS category
FROM (SELECT parameter, CAST(round_even({S.sub_index("c")}, 0) AS INTEGER) AS si FROM (SELECT *, {S.index_unit()} AS c FROM c))""")
def viz_sub_index_bars(spark, sf):
    c = R.city_concentrations(hourly(spark, sf), latest(spark, sf))
    rows = I.with_sub_index(c, "si").withColumn("sub_index", F.rint("si").cast("int"))
    return rows.select("parameter", I.label_of(F.col("parameter")).alias("label"), "sub_index", I.band(F.col("sub_index")).alias("category")).orderBy(
        F.col("sub_index").desc(), I.display_rank(F.col("parameter")))


@query("viz_measured_vs_who", f"""WITH {S.LATEST}
SELECT parameter, round(avg(CASE WHEN parameter = 'co' THEN c * 1000 ELSE c END) + 1e-9, 4) AS measured, max(w)::DOUBLE AS who_limit, round(avg(c), 1) > max(w) AS exceeds
FROM (SELECT parameter, {S.index_unit()} AS c, CASE parameter WHEN 'pm25' THEN 15 WHEN 'pm10' THEN 45 WHEN 'no2' THEN 25 WHEN 'so2' THEN 40 WHEN 'o3' THEN 100 END AS w FROM latest)
WHERE w IS NOT NULL GROUP BY 1""")
def viz_measured_vs_who(spark, sf):
    rows = latest(spark, sf).where(F.col("parameter").isin("pm25", "pm10", "no2", "so2", "o3"))
    v = I.limit_unit_value(F.col("parameter"), F.col("value"), F.col("unit"))
    out = rows.groupBy("parameter").agg(F.avg(v).alias("m")).withColumn("who_limit", I.who_limit(F.col("parameter")))
    return out.select("parameter", near("m", 4).alias("measured"), "who_limit", (F.bround("m", 1) > F.col("who_limit")).alias("exceeds"))


@query("viz_time_series", f"""WITH {S.HOURLY}
SELECT parameter, date_utc, round(value + 1e-9, 6) AS value, round(max(value) OVER (PARTITION BY parameter) * 1.15::DOUBLE + 1e-9, 6) AS y_max FROM hourly""")
def viz_time_series(spark, sf):
    h = hourly(spark, sf).dropna(subset=["date_utc", "value"])
    y_max = h.groupBy("parameter").agg((F.max("value") * 1.15).alias("y_max"))
    return h.join(y_max, "parameter").select("parameter", "date_utc", near("value", 6).alias("value"), near("y_max", 6).alias("y_max"))


@query("viz_radar", f"""WITH {S.READINGS},
m AS (SELECT location, parameter, avg(value) AS value, arg_min(unit, (date_utc, seq)) FILTER (unit IS NOT NULL) AS unit FROM readings GROUP BY 1, 2),
s AS (SELECT location, parameter, CAST(round_even({S.sub_index("c")}, 0) AS INTEGER) AS si FROM (SELECT *, {S.index_unit()} AS c FROM m))
SELECT location, count(*) AS axes, sum(si)::BIGINT AS total FROM s WHERE si >= 0 GROUP BY 1 HAVING count(*) >= 3""")
def viz_radar(spark, sf):
    s = R.station_index(readings(spark, sf))
    axes = sum((F.col(f"{p}_si").isNotNull().cast("bigint") for p in K.POLLUTANTS[1:]), F.col("pm25_si").isNotNull().cast("bigint"))
    total = sum((F.coalesce(F.col(f"{p}_si"), F.lit(0)).cast("bigint") for p in K.POLLUTANTS[1:]), F.coalesce(F.col("pm25_si"), F.lit(0)).cast("bigint"))
    return s.select("location", axes.alias("axes"), total.alias("total")).where("axes >= 3")


@query("viz_daily_trend", f"""WITH {S.READINGS},
d AS (SELECT CAST(CAST(date_utc + INTERVAL '5 hours 30 minutes' AS DATE) AS VARCHAR) AS local_date, date_trunc('hour', date_utc) AS hour, parameter,
        arg_max(value, seq) AS value, arg_max(coalesce(unit, ''), seq) AS unit FROM readings GROUP BY 1, 2, 3)
SELECT local_date, hour, aqi, category, dominant FROM ({S.index_rows("d", "local_date, hour")})""")
def viz_daily_trend(spark, sf):
    """Index per hour of each local day from the last reading of each parameter."""
    r = readings(spark, sf).withColumn("unit", F.coalesce("unit", F.lit("")))
    keys = [F.to_date(N.local_time(F.col("date_utc"))).cast("string").alias("local_date"), F.date_trunc("hour", "date_utc").alias("hour"), "parameter"]
    last = r.groupBy(*keys).agg(F.max_by(F.struct("value", "unit"), "seq").alias("r")).select("local_date", "hour", "parameter", "r.*")
    return R.index_of(last, ["local_date", "hour"]).select("local_date", "hour", "aqi", "category", "dominant")


@query("viz_station_bars", f"""WITH {S.READINGS},
m AS (SELECT parameter, location, avg(c) AS value FROM (SELECT *, {S.index_unit()} AS c FROM readings) GROUP BY 1, 2)
SELECT parameter, location, round(value + 1e-9, 4) AS value, {S.band("CAST(trunc(" + S.sub_index("value") + ") AS INTEGER)")} AS category FROM m""")
def viz_station_bars(spark, sf):
    r = readings(spark, sf).withColumn("value", I.to_index_unit(F.col("parameter"), F.col("value"), F.col("unit")))
    m = R.station_means(r).withColumn("si", I.sub_index(F.col("parameter"), F.col("value")))
    return m.select("parameter", "location", near("value", 4).alias("value"), I.band(F.col("si").cast("int")).alias("category"))


@query("viz_station_heatmap", f"""WITH {S.READINGS},
m AS (SELECT location, parameter, avg(c) AS v FROM (SELECT *, {S.index_unit()} AS c FROM readings) GROUP BY 1, 2),
s AS (SELECT location, parameter, {S.sub_index("v")} AS si FROM m)
SELECT location, {", ".join(f"round(coalesce(max(si) FILTER (parameter = '{p}'), 0) + 1e-9, 4) AS {p}" for p in K.POLLUTANTS)} FROM s GROUP BY 1""")
def viz_station_heatmap(spark, sf):
    """Stations × pollutants, 0 where a station does not measure one; a pivot instead of a cross product."""
    m = R.station_means(readings(spark, sf).withColumn("value", I.to_index_unit(F.col("parameter"), F.col("value"), F.col("unit"))))
    wide = m.groupBy("location").pivot("parameter", K.POLLUTANTS).agg(F.max(I.sub_index(F.col("parameter"), F.col("value"))))
    return wide.select("location", *[near(F.coalesce(F.col(p), F.lit(0.0)), 4).alias(p) for p in K.POLLUTANTS])


@query("viz_station_detail", f"""WITH {S.READINGS},
m AS (SELECT location, parameter, avg(c) AS value FROM (SELECT *, {S.index_unit()} AS c FROM readings) GROUP BY 1, 2),
s AS (SELECT *, {S.sub_index("value")} AS si FROM m)
SELECT location, parameter, {S.label()} AS label, round(si + 1e-9, 4) AS sub_index, {S.band("CAST(trunc(si) AS INTEGER)")} AS category FROM s""")
def viz_station_detail(spark, sf):
    m = R.station_means(readings(spark, sf).withColumn("value", I.to_index_unit(F.col("parameter"), F.col("value"), F.col("unit"))))
    m = m.withColumn("si", I.sub_index(F.col("parameter"), F.col("value")))
    return m.select("location", "parameter", I.label_of(F.col("parameter")).alias("label"), near("si", 4).alias("sub_index"), I.band(F.col("si").cast("int")).alias("category"))


@query("viz_gauge_bands", "SELECT category, lo, hi, readings FROM (SELECT category, count(*) AS readings FROM (SELECT "
       + S.band("CAST(trunc(" + S.curve("pm25", "value") + ") AS INTEGER)") + " AS category FROM events) GROUP BY 1) JOIN (VALUES ('Good', 0, 50), ('Satisfactory', 51, 100), "
       "('Moderate', 101, 200), ('Poor', 201, 300), ('Very Poor', 301, 400), ('Severe', 401, 500)) b(category, lo, hi) USING (category)")
def viz_gauge_bands(spark, sf):
    """Scale bar: the bands with their bounds and how many readings fall in each."""
    upper = {b: hi for b, hi, _ in K.BANDS}
    lower = {b: (0 if i == 0 else K.BANDS[i - 1][1] + 1) for i, (b, _, _) in enumerate(K.BANDS)}
    c = F.col("category")
    counts = table(spark, sf, "events").groupBy(I.band_of_pm25(F.col("value")).alias("category")).agg(F.count(F.lit(1)).alias("readings"))
    return counts.select("category", I._lookup(lower, c).alias("lo"), I._lookup(upper, c).alias("hi"), "readings")


@query("snapshot_rows", f"""WITH {S.HOURLY},
c AS (SELECT parameter, median(value) AS value, arg_min(unit, date_utc) FILTER (unit IS NOT NULL) AS unit FROM hourly GROUP BY 1),
v AS (SELECT *, {S.index_unit()} AS v FROM c), i AS ({S.index_rows("c", "")}),
rows AS (SELECT 'AQI' AS key, NULL AS value, aqi::DOUBLE AS number FROM i UNION ALL SELECT 'AQI_category', category, NULL FROM i UNION ALL SELECT 'dominant_pollutant', dominant, NULL FROM i
  UNION ALL SELECT parameter || '_unit', CASE WHEN parameter = 'co' THEN 'mg/m³' ELSE 'µg/m³' END, NULL FROM c
  UNION ALL SELECT parameter, NULL, CASE WHEN parameter = 'co' THEN round_even(v, 2) ELSE round_even(v, 1) END FROM v
  UNION ALL SELECT 'cigarette_equivalent_per_day', NULL, round_even(value / 22, 1) FROM c WHERE parameter = 'pm25' AND value <> 0
  UNION ALL SELECT parameter || '_subindex', NULL, round_even({S.sub_index("v")}, 0) FROM v)
SELECT key, value, round(number + 1e-9, 4) AS number FROM rows""")
def snapshot_rows(spark, sf):
    """Every row of the snapshot; numbers as numbers, since engines write them differently."""
    c = R.city_concentrations(hourly(spark, sf), latest(spark, sf))
    number = F.col("value").try_cast("double")
    return R.snapshot(c, R.index_of(c, [])).select(
        "key", F.when(number.isNull(), F.col("value")).alias("value"), near(number, 4).alias("number"))


@query("sql_functions", f"""WITH {S.READINGS}
SELECT parameter, {S.band("si")} AS category, count(*) AS readings FROM (SELECT parameter, {S.sub_index("c")} AS si FROM (SELECT *, {S.index_unit()} AS c FROM readings)) GROUP BY 1, 2""")
def sql_functions(spark, sf):
    """The same arithmetic through SQL functions."""
    from ..functions import sql

    r = readings(spark, sf)
    sql.register(spark)
    c = r.select("parameter", F.expr("to_index_unit(parameter, value, unit)").alias("c"))
    return c.select("parameter", F.expr("sub_index(parameter, c)").alias("si")).select("parameter", F.expr("index_band(si)").alias("category")).groupBy(
        "parameter", "category").agg(F.count(F.lit(1)).alias("readings"))
