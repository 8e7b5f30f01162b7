"""Hourly series: grid, gaps, lags, rolling statistics, features.

Every window here runs per series over *hourly* rows. The hourly rollup comes first, so a series has at most one row
per hour of its time range: the window group is bounded by the calendar, not by the number of readings.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .. import constants as K
from ..functions import numeric as N

FEATURE_COLUMNS = sorted(
    [f"aqi_lag{h}" for h in K.LAG_HOURS]
    + [f"aqi_r{s}{w}" for w in K.ROLL_HOURS for s in ("mean", "std")]
    + ["aqi_delta1", "aqi_delta3", "aqi_delta6", "aqi_accel"]
    + ["pm25", "pm10", "no", "no2", "nox", "nh3", "so2", "co", "o3"]
    + [f"{p}_lag{h}" for p in K.LAGGED_POLLUTANTS for h in (1, 3)]
    + [f"{p}_{f}" for p in ("hour", "dow", "month") for f in ("sin", "cos")] + ["is_weekend"]
    + ["temperature", "humidity", "wind_speed", "wind_dir", "rainfall", "solar_rad", "pressure"]
    + ["wind_u", "wind_v", "temp_hum_interaction", "solar_temp"]
)


def by_time(series: list[str], ts: str = "ts") -> W:
    return W.partitionBy(*series).orderBy(ts)


def keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key, the one with the highest ``seq``. An aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def hourly_median(df: DataFrame, series: list[str], ts: str, values: list[str]) -> DataFrame:
    """Median per series and hour. Rows must be unique per (series, ts), so a cell holds at most an hour of stamps."""
    return df.groupBy(*series, F.date_trunc("hour", ts).alias(ts)).agg(*[F.median(v).alias(v) for v in values])


def densify(df: DataFrame, series: list[str], ts: str = "ts") -> DataFrame:
    """Add a row of NULLs for each missing hour between the first and last hour of a series.

    The gap after a row is filled from the row itself (next hour known by ``lead``), so no calendar join is needed and
    the partitioning by series is kept for the windows that follow.
    """
    rest = [c for c in df.columns if c not in series + [ts]]
    nxt = F.lead(ts).over(by_time(series, ts))
    last = F.coalesce(F.col("_next") - F.expr("INTERVAL 1 HOUR"), F.col(ts))
    filled = df.withColumn("_next", nxt).withColumn(
        "_hour", F.explode(F.sequence(F.col(ts), last, F.expr("INTERVAL 1 HOUR"))))
    own = F.col("_hour") == F.col(ts)
    return filled.select(*series, F.col("_hour").alias(ts), *[F.when(own, F.col(c)).alias(c) for c in rest])


def interpolate(df: DataFrame, series: list[str], values: list[str], ts: str = "ts", limit: int = 6,
                strict_gap: bool = False) -> DataFrame:
    """Linear in time, forward, at most ``limit`` rows after the last value.

    The first ``limit`` rows of any gap are filled and the last value is carried into trailing NULLs; leading NULLs
    stay. ``strict_gap=True`` instead fills only gaps of at most ``limit`` rows that have a value on both sides.
    """
    forward = by_time(series, ts).rowsBetween(W.unboundedPreceding, 0)
    # A descending window with a growing frame: a frame that ends at the last row would be recomputed for every row.
    backward = W.partitionBy(*series).orderBy(F.col(ts).desc()).rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumn("_pos", F.row_number().over(by_time(series, ts)))

    def point(v):
        return F.when(F.col(v).isNotNull(), F.struct(F.col("_pos").alias("p"), F.unix_micros(F.col(ts)).alias("t"),
                                                     F.col(v).cast("double").alias("v")))

    out = out.select("*", *[F.last(point(v), ignorenulls=True).over(forward).alias(f"_prev_{v}") for v in values])
    out = out.select("*", *[F.last(point(v), ignorenulls=True).over(backward).alias(f"_next_{v}") for v in values])

    def filled(v) -> Column:
        prev, nxt = F.col(f"_prev_{v}"), F.col(f"_next_{v}")
        share = (F.unix_micros(F.col(ts)) - prev["t"]) / (nxt["t"] - prev["t"])
        line = prev["v"] + (nxt["v"] - prev["v"]) * share
        if strict_gap:
            inside = nxt["p"] - prev["p"] - 1 <= limit
            return F.when(F.col(v).isNotNull(), F.col(v)).when(inside, line)
        near = F.col("_pos") - prev["p"] <= limit
        return F.when(F.col(v).isNotNull(), F.col(v)).when(near & nxt.isNotNull(), line).when(near, prev["v"])

    keep = [c for c in df.columns if c not in values]
    return out.select(*keep, *[filled(v).alias(v) for v in values]).select(*df.columns)


def forward_fill(df: DataFrame, series: list[str], values: list[str], ts: str = "ts",
                 default: float | None = None) -> DataFrame:
    w = by_time(series, ts).rowsBetween(W.unboundedPreceding, 0)
    cols = {v: F.last(v, ignorenulls=True).over(w) for v in values}
    if default is not None:
        cols = {v: F.coalesce(c, F.lit(default)) for v, c in cols.items()}
    return df.withColumns(cols)


def backward_fill(df: DataFrame, series: list[str], values: list[str], ts: str = "ts") -> DataFrame:
    w = W.partitionBy(*series).orderBy(F.col(ts).desc()).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})


def set_last(df: DataFrame, series: list[str], column: str, value: Column, ts: str = "ts") -> DataFrame:
    """Replace the newest row's ``column`` by ``value`` where ``value`` is not NULL."""
    newest = F.lead(F.lit(1)).over(by_time(series, ts)).isNull()
    return df.withColumn(column, F.when(newest, F.coalesce(value, F.col(column))).otherwise(F.col(column)))


def lags(df: DataFrame, series: list[str], column: str, hours: list[int], ts: str = "ts") -> DataFrame:
    w = by_time(series, ts)
    return df.withColumns({f"{column}_lag{h}": F.lag(column, h).over(w) for h in hours})


def rolling(df: DataFrame, series: list[str], column: str, hours: list[int], ts: str = "ts") -> DataFrame:
    """Mean and sample deviation of the ``w`` rows before the current one; fewer than two values give deviation 0."""
    cols = {}
    for h in hours:
        w = by_time(series, ts).rowsBetween(-h, -1)
        cols[f"{column}_rmean{h}"] = F.avg(column).over(w)
        cols[f"{column}_rstd{h}"] = F.coalesce(F.stddev_samp(column).over(w), F.lit(0.0))
    return df.withColumns(cols)


def deltas(df: DataFrame, series: list[str], column: str, ts: str = "ts", lagged: bool = False) -> DataFrame:
    """Changes over 1, 3 and 6 rows and the change of the one-row change.

    ``lagged=True`` measures up to the previous row, so the current target does not enter its own features.
    """
    w = by_time(series, ts)
    at = (lambda k: F.lag(column, k + 1).over(w)) if lagged else (
        lambda k: F.lag(column, k).over(w) if k else F.col(column))
    cols = {f"{column}_delta{k}": at(0) - at(k) for k in (1, 3, 6)}
    cols[f"{column}_accel"] = (at(0) - at(1)) - (at(1) - at(2))
    return df.withColumns(cols)


def features(df: DataFrame, series: list[str], target: str = "aqi", ts: str = "ts", meteo: bool = True,
             lagged_delta: bool = False) -> DataFrame:
    """The whole feature table: one shuffle by series, one sort, then row-wise expressions."""
    out = lags(df, series, target, K.LAG_HOURS, ts)
    for p in (p for p in K.LAGGED_POLLUTANTS if p in df.columns):
        out = lags(out, series, p, [1, 3], ts)
    out = rolling(out, series, target, K.ROLL_HOURS, ts)
    out = deltas(out, series, target, ts, lagged_delta)
    out = out.withColumns(N.calendar(F.col(ts)))
    return with_meteo(out) if meteo else out


def with_meteo(df: DataFrame) -> DataFrame:
    have, cols = set(df.columns), {}
    if {"wind_speed", "wind_dir"} <= have:
        cols["wind_u"], cols["wind_v"] = N.wind_components(F.col("wind_speed"), F.col("wind_dir"))
    if {"temperature", "humidity"} <= have:
        cols["temp_hum_interaction"] = F.col("temperature") * F.col("humidity") / 100.0
    if {"solar_rad", "temperature"} <= have:
        cols["solar_temp"] = F.col("solar_rad") * F.col("temperature") / 1000.0
    return df.withColumns(cols) if cols else df


def feature_columns(df: DataFrame, target: str = "aqi", series: list[str] = ()) -> list[str]:
    """Double and long columns except the target and labels, sorted. Calendar parts are ints and stay out, apart from
    the weekend flag."""
    skip = {target, "Timestamp", *K.LABEL_COLUMNS, *series}
    return sorted(
        f.name for f in df.schema.fields
        if f.name not in skip and (isinstance(f.dataType, (T.DoubleType, T.LongType)) or f.name == "is_weekend")
    )


def split_by_year(df: DataFrame, ts: str = "ts", train_until: str = "2023-01-01",
                  test_from: str = "2024-01-01") -> tuple[DataFrame, DataFrame, DataFrame]:
    t = F.col(ts)
    first, second = F.lit(train_until).cast("timestamp"), F.lit(test_from).cast("timestamp")
    return df.where(t < first), df.where((t >= first) & (t < second)), df.where(t >= second)


def split_label(ts: Column, train_until: str, test_from: str) -> Column:
    return F.when(ts < F.lit(train_until).cast("timestamp"), "train").when(
        ts < F.lit(test_from).cast("timestamp"), "val").otherwise("test")


def as_of(left: DataFrame, right: DataFrame, series: list[str], column: str, ts: str = "ts",
          default=None) -> DataFrame:
    """Last ``right.column`` at or before each ``left`` row of the same series (union and one window, no range join)."""
    rows = left.withColumn("_v", F.lit(None).cast(right.schema[column].dataType)).withColumn("_side", F.lit(1))
    marks = right.select(*series, ts, F.col(column).alias("_v")).withColumn("_side", F.lit(0))
    w = W.partitionBy(*series).orderBy(ts, "_side").rowsBetween(W.unboundedPreceding, 0)
    out = (
        rows.unionByName(marks, allowMissingColumns=True)
        .withColumn(column, F.last("_v", ignorenulls=True).over(w))
        .where(F.col("_side") == 1).drop("_v", "_side")
    )
    return out if default is None else out.withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def daily_profile(df: DataFrame, series: list[str], ts: str = "ts", target: str = "aqi",
                  means: tuple = ("pm25", "pm10", "temperature", "humidity", "wind_speed")) -> DataFrame:
    """Per day: mean, deviation, max, min and range of the target and means of other columns; incomplete days drop."""
    day = F.date_trunc("day", ts).alias(ts)
    out = df.groupBy(*series, day).agg(
        F.avg(target).alias(f"{target}_mean"), F.stddev_samp(target).alias(f"{target}_std"),
        F.max(target).alias(f"{target}_max"), F.min(target).alias(f"{target}_min"),
        *[F.avg(c).alias(f"{c}_mean") for c in means],
    )
    out = out.withColumn(f"{target}_range", F.col(f"{target}_max") - F.col(f"{target}_min"))
    return out.dropna(subset=[c for c in out.columns if c not in series + [ts]])


def pivot_hourly(readings: DataFrame, series: list[str], ts: str = "date_utc",
                 parameters: list[str] | None = None) -> DataFrame:
    """Long readings to one row per series and hour with the mean of each parameter; unknown names are dropped."""
    from ..functions.index import canonical_parameter

    names = parameters or sorted(set(K.PARAMETER_ALIASES.values()))
    clean = readings.withColumn("_p", canonical_parameter(F.col("parameter"))).where(
        F.col("_p").isNotNull() & F.col(ts).isNotNull())
    return (
        clean.groupBy(*series, F.date_trunc("hour", ts).alias("ts"))
        .pivot("_p", names).agg(F.avg("value"))
    )


def hourly_index(df: DataFrame) -> Column:
    """Unrounded index of a wide row, CO in mg/m³ and the others in µg/m³; NULL when no pollutant is present."""
    from ..functions.index import sub_index

    parts = [sub_index(p, F.col(p)) for p in K.POLLUTANTS if p in df.columns]
    if not parts:
        return F.lit(None).cast("double")
    return F.greatest(*parts, F.lit(None).cast("double"))


def live_frame(readings: DataFrame, series: list[str], current_aqi: Column | None = None,
               ts: str = "date_utc") -> DataFrame:
    """Long (parameter, value) or wide readings to an interpolated, feature-complete hourly frame.

    Series of fewer than three hours are dropped.
    """
    if {"parameter", "value"} <= set(readings.columns):
        wide = pivot_hourly(readings, series, ts)
        wide = wide.withColumn("aqi", hourly_index(wide))
    else:
        wide = normalise_wide(readings, series)
    if current_aqi is not None:
        wide = set_last(wide, series, "aqi", current_aqi)
    wide = backward_fill(forward_fill(wide, series, ["aqi"]), series, ["aqi"])
    size = F.count(F.lit(1)).over(W.partitionBy(*series))
    wide = wide.withColumn("_size", size).where(F.col("_size") >= 3).drop("_size")
    values = [f.name for f in wide.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return features(interpolate(wide, series, values), series)


def normalise_wide(df: DataFrame, series: list[str], seq: str | None = None) -> DataFrame:
    """Time column and known names of an already wide frame; the last row of a repeated stamp wins."""
    stamp = next((c for c in ("date", "date_utc", "timestamp", "Timestamp") if c in df.columns), "ts")
    out = df.withColumnRenamed(stamp, "ts").withColumn("ts", F.expr("try_cast(ts AS TIMESTAMP)"))
    names = {c: K.PARAMETER_ALIASES[c.lower().strip()] for c in out.columns if c.lower().strip() in K.PARAMETER_ALIASES}
    out = out.withColumnsRenamed(names)
    if "aqi" not in out.columns:
        out = out.withColumn("aqi", F.lit(None).cast("double"))
    if seq:
        out = keep_last(out, series + ["ts"], seq)
    return out
