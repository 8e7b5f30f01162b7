"""Queries on hourly series: grid, gaps, lags, rolling statistics, profiles, forecasts, insights."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import constants as K
from ..operators import forecast as FC
from ..operators import insights as INS
from ..operators import learning as L
from ..operators import readings as R
from ..operators import timeseries as TS
from ..operators.bounds import top_k
from ..sources.tables import EVENT_PARAMETERS, readings, table
from . import sql_parts as S
from .catalog import near, query
from .index_queries import hourly, latest

SERIES = ["parameter"]


def grid(spark, sf) -> DataFrame:
    """Hourly mean per parameter on a gap-free grid, as ``aqi``."""
    h = hourly(spark, sf).select("parameter", F.col("date_utc").alias("ts"), F.col("value").alias("aqi"))
    return TS.densify(h, SERIES)


GRID = S.HOURLY + """,
span AS (SELECT parameter, min(date_utc) AS a, max(date_utc) AS b FROM hourly GROUP BY 1),
hours AS (SELECT parameter, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM span),
grid AS (SELECT hours.parameter, hours.ts, hourly.value AS aqi FROM hours LEFT JOIN hourly ON hourly.parameter = hours.parameter AND hourly.date_utc = hours.ts)"""


def _r(c: str, digits: int = 6) -> str:
    return f"round({c} + 1e-9, {digits})"


@query("ded_keep_last", """SELECT user_id, date_trunc('hour', ts) AS ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def ded_keep_last(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.date_trunc("hour", "ts").alias("ts"), "event_id", "value")
    return TS.keep_last(e, ["user_id", "ts"], "event_id")


@query("win_densify", f"WITH {GRID} SELECT parameter, ts, {_r('aqi')} AS aqi FROM grid")
def win_densify(spark, sf):
    return grid(spark, sf).withColumn("aqi", near("aqi"))


@query("agg_hourly_median_grid", f"""WITH {S.READINGS},
m AS (SELECT parameter, date_trunc('hour', date_utc) AS h, median(value) AS v FROM readings GROUP BY 1, 2),
span AS (SELECT parameter, min(h) AS a, max(h) AS b FROM m GROUP BY 1),
hours AS (SELECT parameter, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM span)
SELECT hours.parameter, hours.ts, {_r('m.v')} AS value FROM hours LEFT JOIN m ON m.parameter = hours.parameter AND m.h = hours.ts""")
def agg_hourly_median_grid(spark, sf):
    """Median of the last reading per stamp, then the grid. Cells may hold any number of readings here, so the exact
    bracketed median is used."""
    from ..operators.quantiles import exact_quantiles

    r = readings(spark, sf).select("parameter", F.date_trunc("hour", "date_utc").alias("ts"), "value")
    m = exact_quantiles(r, ["parameter", "ts"], "value", {"value": 0.5})
    return TS.densify(m, SERIES).withColumn("value", near("value"))


@query("win_interpolate_gap6", f"""WITH {GRID},
p AS (SELECT *, row_number() OVER w AS pos FROM grid WINDOW w AS (PARTITION BY parameter ORDER BY ts)),
q AS (SELECT *, last_value(CASE WHEN aqi IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0, last_value(aqi IGNORE NULLS) OVER b AS v0,
        first_value(CASE WHEN aqi IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p1, first_value(aqi IGNORE NULLS) OVER a AS v1
      FROM p WINDOW b AS (PARTITION BY parameter ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    a AS (PARTITION BY parameter ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT parameter, ts, {_r('CASE WHEN aqi IS NOT NULL THEN aqi WHEN pos - p0 > 6 THEN NULL WHEN p1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (pos - p0)::DOUBLE / (p1 - p0)::DOUBLE END')} AS aqi FROM q""")
def win_interpolate_gap6(spark, sf):
    return TS.interpolate(grid(spark, sf), SERIES, ["aqi"]).withColumn("aqi", near("aqi"))


@query("win_fill_forward_backward", f"""WITH {GRID}
SELECT parameter, ts, {_r('last_value(aqi IGNORE NULLS) OVER (PARTITION BY parameter ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS forward,
  {_r('first_value(aqi IGNORE NULLS) OVER (PARTITION BY parameter ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS backward FROM grid""")
def win_fill_forward_backward(spark, sf):
    g = grid(spark, sf).withColumns({"forward": F.col("aqi"), "backward": F.col("aqi")})
    out = TS.backward_fill(TS.forward_fill(g, SERIES, ["forward"]), SERIES, ["backward"])
    return out.select("parameter", "ts", near("forward").alias("forward"), near("backward").alias("backward"))


@query("win_lag_features", f"WITH {GRID} SELECT parameter, ts, " + ", ".join(
    _r(f"lag(aqi, {h}) OVER w") + f" AS aqi_lag{h}" for h in K.LAG_HOURS) + " FROM grid WINDOW w AS (PARTITION BY parameter ORDER BY ts)")
def win_lag_features(spark, sf):
    out = TS.lags(grid(spark, sf), SERIES, "aqi", K.LAG_HOURS)
    return out.select("parameter", "ts", *[near(f"aqi_lag{h}").alias(f"aqi_lag{h}") for h in K.LAG_HOURS])


@query("win_rolling_mean_std", f"WITH {GRID} SELECT parameter, ts, " + ", ".join(
    f"{_r(f'avg(aqi) OVER (PARTITION BY parameter ORDER BY ts ROWS BETWEEN {h} PRECEDING AND 1 PRECEDING)')} AS aqi_rmean{h}, "
    f"{_r(f'coalesce(stddev_samp(aqi) OVER (PARTITION BY parameter ORDER BY ts ROWS BETWEEN {h} PRECEDING AND 1 PRECEDING), 0)', 5)} AS aqi_rstd{h}"
    for h in K.ROLL_HOURS) + " FROM grid")
def win_rolling_mean_std(spark, sf):
    out = TS.rolling(grid(spark, sf), SERIES, "aqi", K.ROLL_HOURS)
    return out.select("parameter", "ts", *[near(f"aqi_rmean{h}").alias(f"aqi_rmean{h}") for h in K.ROLL_HOURS],
                      *[near(f"aqi_rstd{h}", 5).alias(f"aqi_rstd{h}") for h in K.ROLL_HOURS])


@query("win_delta_accel", f"""WITH {GRID} SELECT parameter, ts, {_r('aqi - lag(aqi, 1) OVER w')} AS aqi_delta1, {_r('aqi - lag(aqi, 3) OVER w')} AS aqi_delta3,
  {_r('aqi - lag(aqi, 6) OVER w')} AS aqi_delta6, {_r('(aqi - lag(aqi, 1) OVER w) - (lag(aqi, 1) OVER w - lag(aqi, 2) OVER w)')} AS aqi_accel
FROM grid WINDOW w AS (PARTITION BY parameter ORDER BY ts)""")
def win_delta_accel(spark, sf):
    out = TS.deltas(grid(spark, sf), SERIES, "aqi")
    names = ["aqi_delta1", "aqi_delta3", "aqi_delta6", "aqi_accel"]
    return out.select("parameter", "ts", *[near(c).alias(c) for c in names])


@query("win_override_last", f"""WITH {GRID}
SELECT parameter, ts, {_r('CASE WHEN lead(1) OVER (PARTITION BY parameter ORDER BY ts) IS NULL THEN 123.5 ELSE aqi END')} AS aqi FROM grid""")
def win_override_last(spark, sf):
    return TS.set_last(grid(spark, sf), SERIES, "aqi", F.lit(123.5)).withColumn("aqi", near("aqi"))


PIVOT = S.READINGS + """,
wide AS (SELECT location, date_trunc('hour', date_utc) AS ts, """ + ", ".join(
    f"avg(value) FILTER (parameter = '{p}') AS {p}" for p in ("pm25", "pm10", "no2", "so2", "co")) + """ FROM readings GROUP BY 1, 2)"""


@query("piv_long_to_wide", f"WITH {PIVOT} SELECT location, ts, " + ", ".join(f"{_r(p)} AS {p}" for p in ("pm25", "pm10", "no2", "so2", "co")) + " FROM wide")
def piv_long_to_wide(spark, sf):
    names = ["pm25", "pm10", "no2", "so2", "co"]
    out = TS.pivot_hourly(readings(spark, sf), ["location"], parameters=names)
    return out.select("location", "ts", *[near(p).alias(p) for p in names])


@query("aqi_wide_hourly", f"WITH {PIVOT} SELECT location, ts, {_r('greatest(' + ', '.join(S.curve(p, p) for p in ('pm25', 'pm10', 'no2', 'so2', 'co')) + ')', 5)} AS aqi FROM wide")
def aqi_wide_hourly(spark, sf):
    wide = TS.pivot_hourly(readings(spark, sf), ["location"], parameters=["pm25", "pm10", "no2", "so2", "co"])
    return wide.select("location", "ts", near(TS.hourly_index(wide), 5).alias("aqi"))


WIDE = list(EVENT_PARAMETERS.values())
_LAGGED = [f"{p}_lag{h}" for p in WIDE for h in (1, 3)]


@query("feature_frame", f"""WITH {S.READINGS},
wide AS (SELECT 'city' AS station, date_trunc('hour', date_utc) AS ts, {", ".join(f"avg(value) FILTER (parameter = '{p}') AS {p}" for p in WIDE)} FROM readings GROUP BY 2),
a AS (SELECT *, greatest({", ".join(S.curve(p, p) for p in WIDE)}) AS aqi FROM wide)
SELECT ts, {_r('aqi', 5)} AS aqi, {_r('lag(aqi, 24) OVER w', 5)} AS aqi_lag24, {", ".join(f"{_r(f'lag({p}, {h}) OVER w', 5)} AS {p}_lag{h}" for p in WIDE for h in (1, 3))},
  {_r('avg(aqi) OVER (ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)', 5)} AS aqi_rmean6, {_r('aqi - lag(aqi, 6) OVER w', 5)} AS aqi_delta6, {_r('sin(2 * pi() * hour(ts) / 24)', 5)} AS hour_sin
FROM a WINDOW w AS (ORDER BY ts)""")
def feature_frame(spark, sf):
    """Features of the city's series of all measured pollutants."""
    wide = TS.pivot_hourly(readings(spark, sf).withColumn("station", F.lit("city")), ["station"], parameters=WIDE)
    out = TS.features(wide.withColumn("aqi", TS.hourly_index(wide)), ["station"])
    cols = ["aqi", "aqi_lag24", *_LAGGED, "aqi_rmean6", "aqi_delta6", "hour_sin"]
    return out.select("ts", *[near(c, 5).alias(c) for c in cols])


@query("flt_time_split", """SELECT o_orderstatus, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'val' ELSE 'test' END AS split,
  count(*) AS rows FROM orders GROUP BY 1, 2""")
def flt_time_split(spark, sf):
    o = table(spark, sf, "orders")
    train, val, test = TS.split_by_year(o, "o_orderdate", "1998-01-01", "2000-01-01")
    parts = [df.withColumn("split", F.lit(n)) for n, df in (("train", train), ("val", val), ("test", test))]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("o_orderstatus", "split").agg(F.count(F.lit(1)).alias("rows"))


@query("agg_daily_profile", """WITH d AS (SELECT o_orderpriority, date_trunc('day', o_orderdate) AS ts, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, max(o_totalprice) AS mx, min(o_totalprice) AS mn, avg(o_custkey::DOUBLE) AS c FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, ts, round(m + 1e-9, 4) AS price_mean, round(s + 1e-9, 3) AS price_std, mx AS price_max, mn AS price_min, round(c + 1e-9, 4) AS cust_mean, round(mx - mn + 1e-9, 4) AS price_range FROM d WHERE s IS NOT NULL""")
def agg_daily_profile(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"),
                                          F.col("o_custkey").cast("double").alias("cust"))
    p = TS.daily_profile(o, ["o_orderpriority"], "ts", "price", ("cust",))
    return p.select("o_orderpriority", "ts", near("price_mean", 4).alias("price_mean"), near("price_std", 3).alias("price_std"), "price_max", "price_min",
                    near("cust_mean", 4).alias("cust_mean"), near("price_range", 4).alias("price_range"))


@query("join_asof_regime", f"""WITH {GRID},
d AS (SELECT parameter, date_trunc('day', ts) AS day, avg(aqi) AS m, stddev_samp(aqi) AS s FROM grid GROUP BY 1, 2),
r AS (SELECT parameter, day, CASE WHEN m < 30 THEN 1 WHEN m < 45 THEN 2 ELSE 3 END AS regime FROM d WHERE s IS NOT NULL AND day_ok(day))
SELECT grid.parameter, grid.ts, coalesce(r.regime, 0) AS regime FROM grid ASOF LEFT JOIN r ON grid.parameter = r.parameter AND grid.ts >= r.day""".replace("day_ok(day)", "isodow(day) <> 1"))
def join_asof_regime(spark, sf):
    """Daily label to hours; Mondays have no label and inherit the day before."""
    g = grid(spark, sf)
    d = g.groupBy("parameter", F.date_trunc("day", "ts").alias("ts")).agg(F.avg("aqi").alias("m"), F.stddev_samp("aqi").alias("s"))
    d = d.where(F.col("s").isNotNull() & (F.weekday("ts") != 0))
    marks = d.select("parameter", "ts", F.when(F.col("m") < 30, 1).when(F.col("m") < 45, 2).otherwise(3).alias("regime"))
    return TS.as_of(g, marks, SERIES, "regime", default=0).select("parameter", "ts", "regime")


@query("win_last3_vs_prev3", f"""WITH {S.HOURLY},
k AS (SELECT *, row_number() OVER (PARTITION BY parameter ORDER BY date_utc DESC) AS rn, count(*) OVER (PARTITION BY parameter) AS n FROM hourly)
SELECT parameter, {_r('avg(value) FILTER (rn <= 3)')} AS recent, {_r('avg(value) FILTER (rn BETWEEN 4 AND 6)')} AS earlier FROM k WHERE n >= 6 GROUP BY 1""")
def win_last3_vs_prev3(spark, sf):
    return INS.recent_change(hourly(spark, sf)).select("parameter", near("recent").alias("recent"), near("earlier").alias("earlier"))


STATION_HOURLY = S.READINGS + """,
sh AS (SELECT location, parameter, date_trunc('hour', date_utc) AS date_utc, avg(value) AS value, arg_min(unit, seq) FILTER (unit IS NOT NULL) AS unit FROM readings GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY location, parameter ORDER BY date_utc DESC) AS rn, count(*) OVER (PARTITION BY location, parameter) AS n FROM sh)"""


def station_hourly(spark, sf) -> DataFrame:
    return readings(spark, sf).groupBy("location", "parameter", F.date_trunc("hour", "date_utc").alias("date_utc")).agg(
        F.avg("value").alias("value"), R.first_by("unit", F.col("seq")).alias("unit"))


@query("win_station_change", f"""WITH {STATION_HOURLY}
SELECT location, parameter, {_r('avg(value) FILTER (rn <= 3)')} AS recent,
  {_r('avg(value) FILTER (CASE WHEN n >= 6 THEN rn BETWEEN 4 AND 6 ELSE rn > n - 3 END)')} AS earlier
FROM k WHERE n >= 4 GROUP BY 1, 2""")
def win_station_change(spark, sf):
    """Per station and parameter, including series of four and five hours."""
    out = INS.recent_change(station_hourly(spark, sf), ["location", "parameter"])
    return out.select("location", "parameter", near("recent").alias("recent"), near("earlier").alias("earlier"))


@query("agg_half_window_trend", f"""WITH {STATION_HOURLY},
h AS (SELECT location, parameter, least(n, 6) AS m, n,
   avg(value) FILTER (rn <= 6 AND rn > least(n, 6) - least(n, 6) // 2) AS first, avg(value) FILTER (rn <= least(n, 6) - least(n, 6) // 2) AS second FROM k WHERE n >= 3 GROUP BY 1, 2, 3, 4),
p AS (SELECT *, CASE WHEN first = 0 THEN 0 ELSE (second - first) / first * 100 / greatest(m // 2, 1) END AS pct FROM h)
SELECT location, parameter, CASE WHEN pct > 3 THEN 'rising' WHEN pct < -3 THEN 'falling' ELSE 'stable' END AS trend FROM p""")
def agg_half_window_trend(spark, sf):
    s = FC.series_state(station_hourly(spark, sf), ["location", "parameter"])
    return FC.with_recent_trend(s).select("location", "parameter", "trend")


def _line_parts() -> str:
    steps, before = [], "v1"
    for h in (1, 2, 3):
        raw = f"(icept + slope * (n + {h - 1}))"
        steps.append(f"l{h} AS (SELECT *, least(greatest(least(greatest({raw}, {before} - {before} * 0.12::DOUBLE), {before} + {before} * 0.12::DOUBLE), 0), top) AS p{h} FROM {'line' if h == 1 else f'l{h - 1}'})")
        before = f"p{h}"
    return f"""x AS (SELECT location, parameter, value, n, rn, (n - rn)::DOUBLE AS x, exp(2.0::DOUBLE * (n - rn) / greatest(n - 1, 1)) AS w FROM k WHERE n BETWEEN 3 AND 5),
m AS (SELECT location, parameter, max(n) AS n, max(value) FILTER (rn = 1) AS v1, sum(w * x) / sum(w) AS xm, sum(w * value) / sum(w) AS ym FROM x GROUP BY 1, 2),
s AS (SELECT location, parameter, CASE WHEN sum(w * (x - xm) * (x - xm)) > 0 THEN sum(w * (x - xm) * (value - ym)) / sum(w * (x - xm) * (x - xm)) ELSE 0 END AS slope FROM x JOIN m USING (location, parameter) GROUP BY 1, 2),
line AS (SELECT *, ym - slope * xm AS icept, CASE parameter {" ".join(f"WHEN '{p}' THEN {v}" for p, v in K.PHYSICAL_MAX.items())} ELSE v1 * 3 END::DOUBLE AS top FROM m JOIN s USING (location, parameter)),
{", ".join(steps)}"""


@query("agg_weighted_regression", f"""WITH {STATION_HOURLY}, {_line_parts()}
SELECT location, parameter, n, {", ".join(f"round({c} + 1e-9, 4) AS {c}" for c in ("slope", "p1", "p2", "p3"))} FROM l3""")
def agg_weighted_regression(spark, sf):
    """Slope and forecasts of the series of three to five hours, which take the regression branch."""
    f = FC.forecast_values(station_hourly(spark, sf), ["location", "parameter"]).where("n < 6")
    return f.select("location", "parameter", "n", *[near(c, 4).alias(c) for c in ("slope", "p1", "p2", "p3")])


def _forecast_sql(final: str, more: str = "") -> str:
    prof = "[" + ", ".join(f"{x}::DOUBLE" for x in K.DIURNAL) + "]"
    mult = f"({prof})[CAST(hour(date_utc + INTERVAL '5 hours 30 minutes') AS INTEGER) + 1]"
    steps = []
    level, trend = "f1", "0::DOUBLE"
    ctes = []
    prev = "s0"
    ctes.append("s0 AS (SELECT *, f6 AS level, 0::DOUBLE AS trend FROM base)")
    for i, f in enumerate(["f5", "f4", "f3", "f2", "f1"], start=1):
        ctes.append(f"s{i} AS (SELECT * EXCLUDE (level, trend), nl AS level, 0.3::DOUBLE * (nl - level) + 0.7::DOUBLE * 0.75::DOUBLE * trend AS trend FROM "
                    f"(SELECT *, 0.35::DOUBLE * {f} + 0.65::DOUBLE * (level + 0.75::DOUBLE * trend) AS nl FROM {prev}))".replace("EXCLUDE (level, trend)", "EXCLUDE (level, trend, nl)"))
        prev = f"s{i}"
    ctes.append(f"w0 AS (SELECT *, current AS ref FROM {prev})")
    for h in range(3):
        raw = f"(base + trend * pow(0.75::DOUBLE, {h + 1}) * {h + 1}) * ({prof})[(h0 + {h + 1}) % 24 + 1]"
        ctes.append(f"w{h + 1} AS (SELECT * EXCLUDE (ref), p{h + 1} AS ref FROM (SELECT *, least(greatest(least(greatest({raw}, ref - ref * 0.12::DOUBLE), ref + ref * 0.12::DOUBLE), 0), top) AS p{h + 1} FROM w{h}))")
    return f"""WITH {STATION_HOURLY},
r AS (SELECT *, {mult} AS mult, value / {mult} AS flat FROM k WHERE n >= 6 AND rn <= 12),
b0 AS (SELECT location, parameter, max(n) AS n, median(flat) AS base, {", ".join(f"max(flat) FILTER (rn = {i}) AS f{i}" for i in range(1, 7))},
  max(value) FILTER (rn = 1) AS current, CAST(hour(max(date_utc) + INTERVAL '5 hours 30 minutes') AS INTEGER) AS h0 FROM r GROUP BY 1, 2),
b1 AS (SELECT r.location, r.parameter, stddev_pop(r.value - base * mult) AS spread FROM r JOIN b0 USING (location, parameter) GROUP BY 1, 2),
base AS (SELECT *, CASE parameter WHEN 'pm25' THEN 999 WHEN 'pm10' THEN 999 WHEN 'no2' THEN 600 WHEN 'so2' THEN 800 WHEN 'co' THEN 50000 END::DOUBLE AS top FROM b0 JOIN b1 USING (location, parameter)),
{", ".join(ctes)}{more}
{final}"""


@query("fc_diurnal_forecast", _forecast_sql("""SELECT location, parameter, h AS hour_offset, round(p, 3) AS value FROM (
  SELECT location, parameter, 1 AS h, p1 + 1e-9 AS p FROM w3 UNION ALL SELECT location, parameter, 2, p2 + 1e-9 FROM w3 UNION ALL SELECT location, parameter, 3, p3 + 1e-9 FROM w3)"""))
def fc_diurnal_forecast(spark, sf):
    """Unrounded diurnal forecasts of every station series with six hours and more."""
    s = FC.forecast_values(station_hourly(spark, sf), ["location", "parameter"])
    return s.where("n >= 6").select("location", "parameter", F.posexplode_outer(F.array("p1", "p2", "p3")).alias("h", "v")).select(
        "location", "parameter", (F.col("h") + 1).alias("hour_offset"), near("v", 3).alias("value"))


def _spark_half(h: int) -> str:
    return f"{K.CI_Z}::DOUBLE * spread * sqrt({h}::DOUBLE)"


@query("viz_sparklines", _forecast_sql(f"""SELECT location, parameter, label, hour_offset, round(value + 1e-9, 3) AS value, round(lower + 1e-9, 3) AS lower, round(upper + 1e-9, 3) AS upper FROM (
  SELECT location, parameter, 'Now' AS label, 0 AS hour_offset, current AS value, current AS lower, current AS upper FROM w3 {" ".join(
    f"UNION ALL SELECT location, parameter, '+{h}h', {h}, p{h}, greatest(p{h} - {_spark_half(h)}, 0), least(p{h} + {_spark_half(h)}, top) FROM w3" for h in (1, 2, 3))})"""))
def viz_sparklines(spark, sf):
    """Per station series of six hours and more: the value now and the hours ahead with their bounds."""
    return FC.sparkline_points(FC.forecast_values(station_hourly(spark, sf), ["location", "parameter"]).where("n >= 6"), ["location"]).select(
        "location", "parameter", "label", "hour_offset", *[near(c, 3).alias(c) for c in ("value", "lower", "upper")])


@query("viz_forecast_chart")
def viz_forecast_chart(spark, sf):
    """The city's index now and for the hours ahead, with bounds, category and colour."""
    h = hourly(spark, sf)
    c = R.city_concentrations(h, latest(spark, sf))
    return FC.chart_points(R.index_of(c, []), FC.forecast_index(FC.forecast_series(h)))


SERIES_POINTS = f""", {_line_parts()},
lv AS (SELECT location, parameter, sqrt(var_pop(value - icept - slope * x)) AS spread FROM x JOIN line USING (location, parameter) GROUP BY 1, 2),
t AS (SELECT location, parameter, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS deviation, max(date_utc) AS last, arg_min(unit, date_utc) FILTER (unit IS NOT NULL) AS unit,
  avg(value) FILTER (rn <= 6 AND rn > least(n, 6) - least(n, 6) // 2) AS first, avg(value) FILTER (rn <= least(n, 6) - least(n, 6) // 2) AS second FROM k WHERE n >= 3 GROUP BY 1, 2),
every AS (SELECT location, parameter, 'diurnal' AS method, [p1, p2, p3] AS p, spread, top, 1.0::DOUBLE AS extra FROM w3
  UNION ALL SELECT location, parameter, 'linear', [p1, p2, p3], spread, top, 1.5::DOUBLE FROM l3 JOIN lv USING (location, parameter)),
u AS (SELECT *, CASE WHEN first = 0 THEN 0 ELSE (second - first) / first * 100 / greatest(least(n, 6) // 2, 1) END AS pct,
  least(n / 12::DOUBLE, 1) - greatest(0, least(deviation / (mean + 1e-6) / 0.5::DOUBLE, 0.4::DOUBLE)) AS trust FROM t),
h AS (SELECT *, p[hour_offset] AS v, {K.CI_Z}::DOUBLE * spread * sqrt(hour_offset - 1 + extra) AS half FROM every, (SELECT unnest([1, 2, 3]) AS hour_offset)),
i AS (SELECT *, greatest(v - half, 0) AS lo, least(v + half, top) AS hi FROM h),
pt AS (SELECT location, parameter, method, CASE WHEN pct > 3 THEN 'rising' WHEN pct < -3 THEN 'falling' ELSE 'stable' END AS trend, round_even(pct, 1) AS trend_pct, hour_offset,
  last + hour_offset * INTERVAL 1 HOUR AS ts, round_even(v, 1) AS value, round_even(lo, 1) AS lower, round_even(hi, 1) AS upper,
  round_even(greatest(0.1::DOUBLE, trust - least((hi - lo) / (v + 1e-6) / 2, 0.3::DOUBLE) - 0.05::DOUBLE * hour_offset), 2) AS confidence, unit FROM i JOIN u USING (location, parameter))"""
INDEX_POINTS = SERIES_POINTS + f""",
kinds AS (SELECT location, hour_offset, parameter, unit, unnest(['aqi', 'lo', 'hi']) AS kind, unnest([value, lower, upper]) AS value FROM pt),
ix AS ({S.index_rows("kinds", "location, hour_offset, kind")}),
tr AS (SELECT location, hour_offset, round_even(avg(confidence), 2) AS confidence FROM pt GROUP BY 1, 2),
fi AS (SELECT location, hour_offset, max(aqi) FILTER (kind = 'aqi') AS aqi, max(category) FILTER (kind = 'aqi') AS category,
  least(max(aqi) FILTER (kind = 'lo'), max(aqi) FILTER (kind = 'hi')) AS lower, greatest(max(aqi) FILTER (kind = 'lo'), max(aqi) FILTER (kind = 'hi')) AS upper,
  max(confidence) AS confidence, max(dominant) FILTER (kind = 'aqi') AS dominant FROM ix JOIN tr USING (location, hour_offset) GROUP BY 1, 2)"""


@query("fc_series_forecast", _forecast_sql("SELECT * EXCLUDE (unit) FROM pt", SERIES_POINTS))
def fc_series_forecast(spark, sf):
    """Points with bounds and confidence."""
    f = FC.forecast_series(station_hourly(spark, sf), ["location", "parameter"])
    return f.select("location", "parameter", "method", "trend", "trend_pct", F.inline_outer("points"))


@query("fc_index_forecast", _forecast_sql("SELECT * FROM fi", INDEX_POINTS))
def fc_index_forecast(spark, sf):
    f = FC.forecast_series(station_hourly(spark, sf), ["location", "parameter"])
    return FC.forecast_index(f, ["location"])


@query("fc_index_outlook", _forecast_sql("""SELECT location, trend AS overall_trend, CASE WHEN c >= 0.65 THEN 'high' WHEN c >= 0.4 THEN 'medium' ELSE 'low' END AS confidence_level,
  'AQI is expected to be **' || a1 || '** (' || c1 || ') in the next hour. and **' || a3 || '** (' || c3 || ') in 3 hours. ' || chr(10) || chr(10) || 'Overall trend: **' || trend || '** '
  || CASE trend WHEN 'worsening' THEN '[UP]' WHEN 'improving' THEN '[DN]' ELSE '[=]' END AS summary
FROM (SELECT *, CASE WHEN a3 > a1 * 1.05::DOUBLE THEN 'worsening' WHEN a3 < a1 * 0.95::DOUBLE THEN 'improving' ELSE 'stable' END AS trend FROM (
  SELECT location, avg(confidence) AS c, max(aqi) FILTER (hour_offset = 1) AS a1, max(category) FILTER (hour_offset = 1) AS c1,
    max(aqi) FILTER (hour_offset = 3) AS a3, max(category) FILTER (hour_offset = 3) AS c3 FROM fi GROUP BY 1))""", INDEX_POINTS))
def fc_index_outlook(spark, sf):
    f = FC.forecast_series(station_hourly(spark, sf), ["location", "parameter"])
    return FC.index_outlook(FC.forecast_index(f, ["location"]), ["location"])


@query("fc_horizon_outlook", f"""WITH {S.HOURLY},
k AS (SELECT parameter, value, row_number() OVER (PARTITION BY parameter ORDER BY date_utc DESC) AS rn, count(*) OVER (PARTITION BY parameter) AS n FROM hourly),
a AS (SELECT parameter, arg_max(value, 7 - rn) AS final, min(value) AS least, max(value) AS most, max(n) AS n FROM k WHERE rn <= 6 GROUP BY 1),
b AS (SELECT parameter, value AS base FROM k WHERE rn = 7),
c AS (SELECT *, (final - base) / greatest(base, 1) * 100 AS change FROM a JOIN b USING (parameter)),
d AS (SELECT *, CASE WHEN change > 10 THEN 'worsening' WHEN change < -10 THEN 'improving' ELSE 'stable' END AS trend, CASE WHEN n >= 24 THEN 'high' WHEN n >= 12 THEN 'medium' ELSE 'low' END AS level FROM c)
SELECT d.parameter, round(base + 1e-9, 4) AS current_aqi, trend AS overall_trend, level AS confidence_level,
  'AQI is expected to ' || CASE trend WHEN 'worsening' THEN 'increase' WHEN 'improving' THEN 'decrease' ELSE 'remain stable' END || ' over the next 6 hours. Predicted range: '
    || CAST(round_even(least, 0) AS BIGINT) || '-' || CAST(round_even(most, 0) AS BIGINT) || ' (' || {S.band("least")} || ' to ' || {S.band("most")} || '). Confidence: ' || level || '.' AS summary,
  (7 - rn)::INTEGER AS hour_offset, round_even(value, 1) AS aqi, {S.band("value")} AS category,
  round_even(greatest(value * (1 - (0.1::DOUBLE + 0.05::DOUBLE * (7 - rn))), 0), 1) AS lower, round_even(value * (1 + (0.1::DOUBLE + 0.05::DOUBLE * (7 - rn))), 1) AS upper
FROM d JOIN k ON k.parameter = d.parameter AND rn <= 6""")
def fc_horizon_outlook(spark, sf):
    """Outlook with its points; the last six hours of each parameter stand for the hours ahead of the one before them."""
    newest = W.partitionBy("parameter").orderBy(F.col("date_utc").desc())
    k = hourly(spark, sf).select("parameter", "value", F.row_number().over(newest).alias("rn"), F.count(F.lit(1)).over(W.partitionBy("parameter")).alias("hours_of_data"))
    base = k.where("rn = 7").select("parameter", F.col("value").alias("base_aqi"))
    made = k.where("rn <= 6").join(base, "parameter").select(
        "parameter", (7 - F.col("rn")).cast("int").alias("hour_offset"), F.col("value").alias("prediction"), "base_aqi", "hours_of_data")
    out = FC.horizon_outlook(made, ["parameter"])
    return out.select("parameter", near("current_aqi", 4).alias("current_aqi"), "overall_trend", "confidence_level", "summary", F.inline_outer("points"))


@query("agg_persistence_metrics", f"""WITH {GRID},
l AS (SELECT parameter, aqi AS y, lag(aqi) OVER (PARTITION BY parameter ORDER BY ts) AS p FROM grid),
v AS (SELECT * FROM l WHERE y IS NOT NULL AND p IS NOT NULL),
q AS (SELECT parameter, quantile_cont(y, 0.9) AS t FROM v GROUP BY 1)
SELECT parameter, {_r('avg(abs(y - p))')} AS mae, {_r('sqrt(avg((y - p) * (y - p)))')} AS rmse, {_r('1 - avg((y - p) * (y - p)) / var_pop(y)')} AS r2,
  {_r('CASE WHEN count(*) FILTER (y >= t) > 10 THEN avg(abs(y - p)) FILTER (y >= t) END')} AS spike_mae, count(*) AS rows FROM v JOIN q USING (parameter) GROUP BY 1""")
def agg_persistence_metrics(spark, sf):
    out = L.persistence_metrics(TS.lags(grid(spark, sf), SERIES, "aqi", [1]), SERIES)
    return out.select("parameter", *[near(c).alias(c) for c in ("mae", "rmse", "r2", "spike_mae")], "rows")


@query("topk_best_model", f"""WITH {GRID},
l AS (SELECT aqi AS y, lag(aqi, 1) OVER w AS p1, lag(aqi, 24) OVER w AS p24, avg(aqi) OVER (PARTITION BY parameter ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS m6 FROM grid WINDOW w AS (PARTITION BY parameter ORDER BY ts)),
e AS (SELECT 'lag1' AS model, avg(abs(y - p1)) AS mae FROM l UNION ALL SELECT 'lag24', avg(abs(y - p24)) FROM l UNION ALL SELECT 'mean6', avg(abs(y - m6)) FROM l)
SELECT model, {_r('mae')} AS mae FROM e ORDER BY e.mae LIMIT 1""")
def topk_best_model(spark, sf):
    g = TS.rolling(TS.lags(grid(spark, sf), SERIES, "aqi", [1, 24]), SERIES, "aqi", [6])
    long = g.select("aqi", F.explode(F.create_map(
        F.lit("lag1"), F.col("aqi_lag1"), F.lit("lag24"), F.col("aqi_lag24"), F.lit("mean6"), F.col("aqi_rmean6"))).alias("model", "p"))
    results = long.groupBy("model").agg(F.avg(F.abs(F.col("aqi") - F.col("p"))).alias("mae"))
    return L.best_model(results).withColumn("mae", near("mae"))


@query("topk_systematic_sample", f"""WITH {GRID},
n AS (SELECT *, row_number() OVER (PARTITION BY parameter ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY parameter) AS n FROM grid),
s AS (SELECT *, greatest(1, (n - 6 - 168) // CASE WHEN n < 6 + 168 + 50 THEN greatest(50, n - 6 - 168) ELSE 50 END) AS step FROM n)
SELECT parameter, ts FROM s WHERE rn >= 168 AND rn < n - 6 AND (rn - 168) % step = 0""")
def topk_systematic_sample(spark, sf):
    return L.every_nth(grid(spark, sf), SERIES, points=50).select("parameter", "ts")


@query("agg_feature_importance", """WITH c AS (SELECT avg(abs(l_quantity)) AS aqi_lag1, avg(abs(l_discount)) AS hour_sin, avg(abs(l_tax)) AS wind_u, avg(abs(l_extendedprice)) AS pm25 FROM lineitem),
l AS (UNPIVOT c ON aqi_lag1, hour_sin, wind_u, pm25 INTO NAME feature VALUE importance)
SELECT CASE feature WHEN 'aqi_lag1' THEN 'AQI Lags & Rolling Stats' WHEN 'hour_sin' THEN 'Temporal Encoding' WHEN 'wind_u' THEN 'Meteorological' ELSE 'Pollutant Concentrations' END AS class,
  round(importance + 1e-9, 4) AS importance, round(importance / (SELECT sum(importance) FROM l) * 100 + 1e-9, 6) AS percent FROM l""")
def agg_feature_importance(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("aqi_lag1"), F.col("l_discount").alias("hour_sin"),
                                             F.col("l_tax").alias("wind_u"), F.col("l_extendedprice").alias("pm25"))
    out = L.importance_classes(L.mean_absolute(li, li.columns))
    return out.select("class", near("importance", 4).alias("importance"), near("percent").alias("percent"))


@query("flt_spike_mask", """WITH t AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.9) AS p90 FROM orders GROUP BY 1)
SELECT o_orderpriority, count(*) AS spikes, round(avg(o_totalprice) + 1e-9, 4) AS mean FROM orders JOIN t USING (o_orderpriority) WHERE o_totalprice >= p90 GROUP BY 1""")
def flt_spike_mask(spark, sf):
    from ..operators.quantiles import exact_quantiles

    o = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice")
    q = exact_quantiles(o, ["o_orderpriority"], "o_totalprice", {"p90": 0.9})
    return o.join(q, "o_orderpriority").where("o_totalprice >= p90").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("spikes"), near(F.avg("o_totalprice"), 4).alias("mean"))


# --- Insights -------------------------------------------------------------------------------

NAME = S.label()
CHANGE = f"""{STATION_HOURLY},
ch AS (SELECT location, parameter, avg(value) FILTER (rn <= 3) AS recent, avg(value) FILTER (CASE WHEN n >= 6 THEN rn BETWEEN 4 AND 6 ELSE rn > n - 3 END) AS earlier FROM k WHERE n >= 4 GROUP BY 1, 2),
pc AS (SELECT *, (recent - earlier) / earlier * 100 AS pct FROM ch WHERE earlier > 0)"""


@query("ins_trend_alerts", f"""WITH {CHANGE}
SELECT location, parameter AS watched, CASE WHEN pct > 25 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN pct > 25 THEN {NAME} || ' Spike Detected' ELSE {NAME} || ' Improving' END AS title,
  CASE WHEN pct > 25 THEN 80 + CAST(trunc(pct) AS INTEGER) ELSE 40 END AS priority FROM pc WHERE abs(pct) > 25 AND parameter IN ('pm25', 'pm10', 'no2', 'o3')""")
def ins_trend_alerts(spark, sf):
    a = INS.trend_alerts(station_hourly(spark, sf), ["location"])
    watched = F.element_at(F.lit(["pm25", "pm10", "no2", "o3"]), F.col("seq") - 100)
    return a.select("location", watched.alias("watched"), "severity", "title", "priority")


@query("ins_trend_alert_texts", f"""WITH {S.HOURLY},
k AS (SELECT *, row_number() OVER (PARTITION BY parameter ORDER BY date_utc DESC) AS rn FROM hourly),
pc AS (SELECT parameter, avg(value) FILTER (rn <= 3) AS recent, avg(value) FILTER (rn BETWEEN 4 AND 6) AS earlier FROM k GROUP BY 1),
p AS (SELECT *, (recent - earlier) / earlier * 100 AS pct FROM pc)
SELECT CASE WHEN pct > 25 THEN {NAME} || ' has risen **' || {S.text0('pct')} || '%** in the last 3 hours (from ' || {S.text0('earlier')} || ' to ' || {S.text0('recent')} || ' µg/m³). ' ||
    CASE WHEN parameter IN ('pm25', 'pm10') THEN 'This may be due to evening traffic and boundary layer collapse.' ELSE 'Monitor conditions closely.' END
  ELSE {NAME} || ' has dropped **' || {S.text0('abs(pct)')} || '%** in the last 3 hours (from ' || {S.text0('earlier')} || ' to ' || {S.text0('recent')} || ' µg/m³). Air quality is getting better.' END AS body
FROM p WHERE abs(pct) > 25 AND parameter IN ('pm25', 'pm10', 'no2', 'o3')""")
def ins_trend_alert_texts(spark, sf):
    return INS.trend_alerts(hourly(spark, sf)).select("body")


@query("ins_limit_comparison", f"""WITH {S.READINGS},
m AS (SELECT location, parameter, avg(value) AS value, arg_min(unit, (date_utc, seq)) FILTER (unit IS NOT NULL) AS unit FROM readings GROUP BY 1, 2),
v AS (SELECT location, parameter, CASE WHEN parameter = 'co' THEN c * 1000 ELSE c END AS v FROM (SELECT *, {S.index_unit()} AS c FROM m)),
r AS (SELECT *, v / CASE parameter WHEN 'pm25' THEN 15 WHEN 'pm10' THEN 45 WHEN 'no2' THEN 25 WHEN 'so2' THEN 40 WHEN 'co' THEN 4000 END AS ratio FROM v)
SELECT location, parameter, CASE WHEN ratio > 10 THEN 'critical' WHEN ratio > 5 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN ratio > 10 THEN 95 WHEN ratio > 5 THEN 75 ELSE 50 END AS priority FROM r WHERE ratio > 1""")
def ins_limit_comparison(spark, sf):
    m = readings(spark, sf).groupBy("location", "parameter").agg(
        F.avg("value").alias("value"), R.first_by("unit", F.struct("date_utc", "seq")).alias("unit"))
    out = INS.limit_comparison(m, ["location"])
    return out.select("location", F.element_at(F.lit(K.POLLUTANTS), F.col("seq") - 299).alias("parameter"), "severity", "priority")


@query("ins_station_spread", f"""WITH {S.LATEST},
m AS (SELECT parameter, location, avg(value) AS v FROM latest WHERE parameter IN ('pm25', 'pm10') GROUP BY 1, 2),
e AS (SELECT parameter, max(v) AS hi, min(v) AS lo, arg_min(location, (-v, location)) AS worst, arg_min(location, (v, location)) AS best FROM m GROUP BY 1)
SELECT {NAME} || ' Varies Across Stations' AS title, '**' || worst || '** reads ' || {S.text0('hi')} || ' µg/m³ while **' || best || '** reads ' || {S.text0('lo')} || ' µg/m³ — a **' || {S.text1('hi / lo')} ||
  '×** difference. Hyperlocal factors (traffic, construction) may be at play.' AS body, 45 AS priority FROM e WHERE lo > 0 AND hi / lo > 2""")
def ins_station_spread(spark, sf):
    return INS.station_spread(latest(spark, sf)).select("title", "body", "priority")


@query("ins_health_rules", f"""WITH {S.HOURLY}, i AS ({S.index_rows("hourly", "date_utc")})
SELECT date_utc, 'Respiratory Risk Elevated' AS title, CASE WHEN aqi > 300 THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN aqi > 300 THEN 90 ELSE 70 END AS priority FROM i WHERE aqi > 200
UNION ALL SELECT date_utc, 'Outdoor Exercise Advisory', 'warning', 65 FROM i WHERE aqi > 150
UNION ALL SELECT date_utc, 'Sensitive Groups Take Care', 'info', 50 FROM i WHERE aqi BETWEEN 100 AND 200""")
def ins_health_rules(spark, sf):
    city = R.index_of(hourly(spark, sf), ["date_utc"])
    return INS.health_rules(city, ["date_utc"]).select("date_utc", "title", "severity", "priority")


@query("ins_diurnal_notes", f"""WITH {S.HOURLY}, h AS (SELECT DISTINCT date_utc, CAST((hour(date_utc) + 5) % 24 AS INTEGER) AS l FROM hourly)
SELECT date_utc, CASE WHEN l BETWEEN 7 AND 10 THEN 'Morning Rush Hour' WHEN l BETWEEN 17 AND 21 THEN 'Evening Pollution Peak' WHEN l >= 23 OR l <= 4 THEN 'Nighttime Inversion' ELSE 'Midday Mixing' END AS title,
  CASE WHEN l BETWEEN 7 AND 10 THEN 50 WHEN l BETWEEN 17 AND 21 THEN 60 WHEN l >= 23 OR l <= 4 THEN 35 ELSE 30 END AS priority
FROM h WHERE l BETWEEN 7 AND 10 OR l BETWEEN 17 AND 21 OR l >= 23 OR l <= 4 OR l BETWEEN 11 AND 15""")
def ins_diurnal_notes(spark, sf):
    moments = hourly(spark, sf).select("date_utc").distinct()
    return INS.diurnal_notes(moments, ["date_utc"], "date_utc").select("date_utc", "title", "priority")


def _all_insights(spark, sf) -> DataFrame:
    h, now = hourly(spark, sf), latest(spark, sf)
    conc = R.city_concentrations(h, now)
    city = R.index_of(conc, [])
    pm25 = conc.where("parameter = 'pm25'").select("value").scalar()
    moment = h.agg(F.max("date_utc").alias("as_of"))
    fc = FC.forecast_series(h)
    return INS.ranked([
        INS.trend_alerts(h), INS.diurnal_notes(moment, []), INS.limit_comparison(conc),
        INS.emergency(city.withColumn("pm25", pm25)), INS.forecast_notes(FC.forecast_index(fc), city, fc),
        INS.station_spread(now), INS.health_rules(city)])


@query("ins_priority_topk")
def ins_priority_topk(spark, sf):
    """The six most urgent insights of the whole city."""
    return _all_insights(spark, sf).select(*INS.COLUMNS)


@query("ins_markdown")
def ins_markdown(spark, sf):
    return INS.markdown(_all_insights(spark, sf))


@query("ins_hourly_topk", f"""WITH {S.HOURLY}, i AS ({S.index_rows("hourly", "date_utc")}),
r AS (SELECT date_utc, 'Respiratory Risk Elevated' AS title, CASE WHEN aqi > 300 THEN 90 ELSE 70 END AS priority, 600 AS seq FROM i WHERE aqi > 200
UNION ALL SELECT date_utc, 'Outdoor Exercise Advisory', 65, 601 FROM i WHERE aqi > 150
UNION ALL SELECT date_utc, 'Sensitive Groups Take Care', 50, 602 FROM i WHERE aqi BETWEEN 100 AND 200
UNION ALL SELECT date_utc, 'AQI Emergency Level', 100, 399 FROM i WHERE aqi > 300)
SELECT date_utc, title, priority, rank FROM (SELECT *, row_number() OVER (PARTITION BY date_utc ORDER BY priority DESC, seq) AS rank FROM r) WHERE rank <= 2""")
def ins_hourly_topk(spark, sf):
    """Union of generators, then the two most urgent per hour."""
    h = hourly(spark, sf)
    city = R.index_of(h, ["date_utc"])
    pm = h.where("parameter = 'pm25'").select("date_utc", F.col("value").alias("pm25"))
    parts = [INS.health_rules(city, ["date_utc"]), INS.emergency(city.join(pm, "date_utc", "left"), ["date_utc"])]
    return INS.ranked(parts, ["date_utc"], 2).select("date_utc", "title", "priority", "rank")


__all__ = ["grid", "station_hourly", "top_k", "W"]
