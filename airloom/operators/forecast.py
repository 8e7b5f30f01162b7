"""Short-horizon forecasts of many series at once.

Only the last twelve hours of a series and three totals enter a forecast. They are reduced to scalar columns by one
aggregate, and the smoothing and the hour-by-hour walk are unrolled over those columns, so everything stays in
generated code. (Array lambdas would be re-evaluated per element once the optimizer merges projections.)
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions import index as I
from ..functions.numeric import local_time, text1
from .readings import first_by, index_of
from .timeseries import keep_last

RECENT = 12
SMOOTHED = 6


def _profile(hour: Column) -> Column:
    """Diurnal multiplier of a local hour."""
    return F.element_at(F.lit(K.DIURNAL), hour + 1)


def series_state(hourly: DataFrame, keys: list[str], ts: str = "date_utc", seq: str | None = None) -> DataFrame:
    """Per series of at least three points: totals, the last six values ``v1`` (newest) .. ``v6`` and their
    deseasonalised forms ``f1`` .. ``f6``, and moments of the last twelve."""
    rows = keep_last(hourly, keys + [ts], seq) if seq else hourly
    newest_first = W.partitionBy(*keys).orderBy(F.col(ts).desc())
    tail = rows.select(*keys, ts, "value").withColumn("_rn", F.row_number().over(newest_first)).where(
        F.col("_rn") <= RECENT)
    tail = tail.withColumn("_m", _profile(F.hour(local_time(F.col(ts)))))
    tail = tail.withColumn("_f", F.col("value") / F.greatest("_m", F.lit(0.5)))

    def nth(c, i):
        return F.max(F.when(F.col("_rn") == i, F.col(c)))

    recent = tail.groupBy(*keys).agg(
        F.max(ts).alias("last_ts"), F.median("_f").alias("base"),
        F.var_pop("value").alias("var_v"), F.var_pop("_m").alias("var_m"), F.covar_pop("value", "_m").alias("cov_vm"),
        *[nth("value", i).alias(f"v{i}") for i in range(1, SMOOTHED + 1)],
        *[nth("_f", i).alias(f"f{i}") for i in range(1, SMOOTHED + 1)])
    totals = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"),
        first_by("unit", F.col(ts)).alias("unit"))
    return totals.where(F.col("n") >= 3).join(recent, keys)


def with_damped_trend(state: DataFrame, alpha: float = K.HOLT_ALPHA, phi: float = K.HOLT_PHI) -> DataFrame:
    """``momentum``: trend left after exponential smoothing with a damped trend over ``f6`` .. ``f1``."""
    s = state.withColumns({"_level": F.col(f"f{SMOOTHED}"), "_trend": F.lit(0.0)})
    for i in range(SMOOTHED - 1, 0, -1):
        s = s.withColumn("_new", alpha * F.col(f"f{i}") + (1 - alpha) * (F.col("_level") + phi * F.col("_trend")))
        s = s.withColumn("_trend", K.HOLT_BETA * (F.col("_new") - F.col("_level"))
                         + (1 - K.HOLT_BETA) * phi * F.col("_trend")).withColumn("_level", F.col("_new"))
    return s.withColumnRenamed("_trend", "momentum").drop("_level", "_new")


def with_recent_trend(state: DataFrame) -> DataFrame:
    """``trend`` and ``trend_pct``: change between the halves of the last six values, in percent per hour."""
    v = {i: F.col(f"v{i}") for i in range(1, SMOOTHED + 1)}
    n = F.col("n")
    first = F.when(n == 3, v[3]).when(n == 4, (v[4] + v[3]) / 2).when(n == 5, (v[5] + v[4]) / 2).otherwise(
        (v[6] + v[5] + v[4]) / 3)
    second = F.when(n <= 4, (v[1] + v[2]) / 2).otherwise((v[1] + v[2] + v[3]) / 3)
    half = F.when(n == 3, 1.0).when(n <= 5, 2.0).otherwise(3.0)
    s = state.withColumns({"_first": first, "_second": second, "_half": half})
    s = s.withColumn("_pct", F.when(F.col("_first") == 0, 0.0).otherwise(
        (F.col("_second") - F.col("_first")) / F.col("_first") * 100.0 / F.col("_half")))
    return s.withColumns({
        "trend": F.when(F.col("_pct") > 3, "rising").when(F.col("_pct") < -3, "falling").otherwise("stable"),
        "trend_pct": F.bround("_pct", 1),
    }).drop("_first", "_second", "_half", "_pct")


def with_regression(state: DataFrame) -> DataFrame:
    """``slope``, ``icept`` and residual variance ``line_var`` of the weighted line through three to five values.

    Positions count from the oldest value; weights rise from 1 to e² towards the newest.
    """
    n = F.col("n")
    ranks = range(1, 6)

    def total(term) -> Column:
        return sum((F.when(n >= i, term(i)).otherwise(0.0) for i in ranks[1:]), F.when(n >= 1, term(1)).otherwise(0.0))

    x, y = (lambda i: (n - i).cast("double")), (lambda i: F.col(f"v{i}"))
    s = state.withColumns({f"_w{i}": F.exp(2.0 * x(i) / F.greatest(n - 1, F.lit(1))) for i in ranks})
    w = lambda i: F.col(f"_w{i}")
    s = s.withColumn("_ws", total(w))
    s = s.withColumns({"_xm": total(lambda i: w(i) * x(i)) / F.col("_ws"), "_ym": total(lambda i: w(i) * y(i)) / F.col("_ws")})
    dx, dy = (lambda i: x(i) - F.col("_xm")), (lambda i: y(i) - F.col("_ym"))
    s = s.withColumns({"_cov": total(lambda i: w(i) * dx(i) * dy(i)), "_var": total(lambda i: w(i) * dx(i) * dx(i))})
    s = s.withColumn("slope", F.when(F.col("_var") > 0, F.col("_cov") / F.col("_var")).otherwise(0.0))
    s = s.withColumn("icept", F.col("_ym") - F.col("slope") * F.col("_xm"))
    resid = lambda i: y(i) - F.col("icept") - F.col("slope") * x(i)
    s = s.withColumn("_rm", total(resid) / n)
    s = s.withColumn("line_var", total(lambda i: (resid(i) - F.col("_rm")) * (resid(i) - F.col("_rm"))) / n)
    return s.drop("_ws", "_xm", "_ym", "_cov", "_var", "_rm", *[f"_w{i}" for i in ranks])


def forecast_values(hourly: DataFrame, keys: list[str] = ("parameter",), horizon: int = 3, ts: str = "date_utc",
                    seq: str | None = None) -> DataFrame:
    """The unrounded forecasts ``p1`` .. with the series state they come from.

    Six points and more use the diurnal profile with a damped trend; three to five use the weighted line. Each step
    may move ±12 % from the one before (the first from the current value), within [0, physical maximum].
    """
    s = with_regression(with_damped_trend(series_state(hourly, list(keys), ts, seq)))
    diurnal = F.col("n") >= SMOOTHED
    spread = F.when(diurnal, F.col("var_v") + F.col("base") * F.col("base") * F.col("var_m")
                    - 2.0 * F.col("base") * F.col("cov_vm")).otherwise(F.col("line_var"))
    s = s.withColumns({
        "top": I.physical_max(F.col("parameter"), F.col("v1")), "_h0": F.hour(local_time(F.col("last_ts"))),
        "spread": F.sqrt(F.greatest(spread, F.lit(0.0))),
    })
    before = F.col("v1")
    for h in range(1, horizon + 1):
        cyclic = (F.col("base") + F.col("momentum") * K.HOLT_PHI ** h * h) * _profile(F.pmod(F.col("_h0") + h, F.lit(24)))
        line = F.col("icept") + F.col("slope") * (F.col("n") + (h - 1))
        s = s.withColumn("_raw", F.when(diurnal, cyclic).otherwise(line))
        move = before * K.MAX_HOURLY_CHANGE
        near = F.least(F.greatest(F.col("_raw"), before - move), before + move)
        s = s.withColumn(f"p{h}", F.least(F.greatest(near, F.lit(0.0)), F.col("top")))
        before = F.col(f"p{h}")
    return s.drop("_raw", "_h0")


def forecast_series(hourly: DataFrame, keys: list[str] = ("parameter",), horizon: int = 3, ts: str = "date_utc",
                    seq: str | None = None) -> DataFrame:
    """One row per series: method, trend, current value and ``points`` (one struct per hour ahead).

    ``keys`` must contain ``parameter``. Fewer than three points give no row.
    """
    s = with_recent_trend(forecast_values(hourly, keys, horizon, ts, seq))
    diurnal = F.col("n") >= SMOOTHED
    volatility = F.greatest(F.lit(0.0), F.least(F.col("deviation") / (F.col("mean") + 1e-6) / 0.5, F.lit(0.4)))
    s = s.withColumn("_trust", F.least(F.col("n") / 12.0, F.lit(1.0)) - volatility)
    for h in range(1, horizon + 1):
        half = F.lit(K.CI_Z) * F.col("spread") * F.sqrt(F.lit(h - 1) + F.when(diurnal, 1.0).otherwise(1.5))
        s = s.withColumn("_half", half)
        s = s.withColumns({f"lo{h}": F.greatest(F.col(f"p{h}") - F.col("_half"), F.lit(0.0)),
                           f"hi{h}": F.least(F.col(f"p{h}") + F.col("_half"), F.col("top"))})
    points = []
    for h in range(1, horizon + 1):
        p, lo, hi = F.col(f"p{h}"), F.col(f"lo{h}"), F.col(f"hi{h}")
        width = F.least((hi - lo) / (p + 1e-6) / 2.0, F.lit(0.3))
        trust = F.greatest(F.lit(0.1), F.col("_trust") - width - 0.05 * h)
        points.append(F.struct(
            F.lit(h).alias("hour_offset"), (F.col("last_ts") + F.expr(f"INTERVAL {h} HOUR")).alias("ts"),
            F.bround(p, 1).alias("value"), F.bround(lo, 1).alias("lower"), F.bround(hi, 1).alias("upper"),
            F.bround(trust, 2).alias("confidence")))
    mark = F.when(F.col("trend") == "rising", "^").when(F.col("trend") == "falling", "v").otherwise("=")
    return s.select(
        *keys, "unit", "n", F.when(diurnal, "diurnal").otherwise("linear").alias("method"),
        F.bround("v1", 1).alias("current_value"), "trend", "trend_pct", mark.alias("trend_mark"),
        F.array(*points).alias("points"))


def sparkline_points(values: DataFrame, keys: list[str] = (), horizon: int = 3) -> DataFrame:
    """keys, parameter, label, hour_offset, value, lower, upper: the value now (its own bounds) and the hours ahead, from
    ``forecast_values``."""
    diurnal = F.col("n") >= SMOOTHED
    points = [F.struct(F.lit("Now").alias("label"), F.lit(0).alias("hour_offset"), F.col("v1").alias("value"), F.col("v1").alias("lower"), F.col("v1").alias("upper"))]
    for h in range(1, horizon + 1):
        half = F.lit(K.CI_Z) * F.col("spread") * F.sqrt(F.lit(h - 1) + F.when(diurnal, 1.0).otherwise(1.5))
        points.append(F.struct(F.lit(f"+{h}h").alias("label"), F.lit(h).alias("hour_offset"), F.col(f"p{h}").alias("value"),
                               F.greatest(F.col(f"p{h}") - half, F.lit(0.0)).alias("lower"), F.least(F.col(f"p{h}") + half, F.col("top")).alias("upper")))
    return values.select(*keys, "parameter", F.inline_outer(F.array(*points)))


def chart_points(current: DataFrame, hours: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, hour_offset, label, aqi, lower, upper, category, colour: the index now, then ``forecast_index`` rows."""
    now = current.select(*keys, F.lit(0).alias("hour_offset"), "aqi", F.col("aqi").alias("lower"), F.col("aqi").alias("upper"))
    both = now.unionByName(hours.select(*keys, "hour_offset", "aqi", "lower", "upper"))
    label = F.when(F.col("hour_offset") == 0, "Now").otherwise(F.concat(F.lit("+"), F.col("hour_offset").cast("string"), F.lit("h")))
    return both.select(*keys, "hour_offset", label.alias("label"), "aqi", "lower", "upper", I.band(F.col("aqi")).alias("category"), I.band_colour(I.band(F.col("aqi"))).alias("colour"))


def forecast_index(forecasts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Per hour ahead: the index of the forecast values, its bounds and the mean confidence.

    ``forecasts`` comes from ``forecast_series``; ``keys`` are its keys without the parameter. The outer form of the
    generator is used because the plain one adds a filter on the array, which the optimizer pushes down through every
    step of the forecast, multiplying the expressions on its way. The array is never empty.
    """
    keys = list(keys)
    by_hour = keys + ["hour_offset"]
    flat = forecasts.where(F.col("parameter").isin(K.POLLUTANTS)).select(
        *keys, "parameter", "unit", F.inline_outer("points")).drop("ts")
    # The three variants ride along as a key, so the index is computed in one aggregate.
    kinds = flat.select(*by_hour, "parameter", "unit", "confidence", F.explode(F.create_map(
        F.lit("aqi"), F.col("value"), F.lit("lo"), F.col("lower"), F.lit("hi"), F.col("upper"))).alias("kind", "value"))
    indexed = index_of(kinds, by_hour + ["kind"])
    pick = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    rows = indexed.groupBy(*by_hour).agg(
        pick("aqi", "aqi").alias("aqi"), pick("aqi", "category").alias("category"),
        pick("lo", "aqi").alias("_a"), pick("hi", "aqi").alias("_b"), pick("aqi", "dominant").alias("dominant"))
    trust = flat.groupBy(*by_hour).agg(F.bround(F.avg("confidence"), 2).alias("confidence"))
    return rows.join(trust, by_hour).select(
        *by_hour, "aqi", "category", F.least("_a", "_b").alias("lower"), F.greatest("_a", "_b").alias("upper"),
        "confidence", "dominant")


def index_outlook(hours: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Trend, confidence level and summary sentence of ``forecast_index`` rows."""
    keys = list(keys)
    first = F.min_by(F.struct("aqi", "category"), "hour_offset")
    last = F.max_by(F.struct("aqi", "category"), "hour_offset")
    out = hours.groupBy(*keys).agg(
        first.alias("f"), last.alias("l"), F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"),
        F.max(F.when(F.col("hour_offset") == 3, F.struct("aqi", "category"))).alias("h3"))
    trend = F.when(F.col("n") < 2, "stable").when(F.col("l.aqi") > F.col("f.aqi") * 1.05, "worsening").when(
        F.col("l.aqi") < F.col("f.aqi") * 0.95, "improving").otherwise("stable")
    mark = F.when(trend == "worsening", "[UP]").when(trend == "improving", "[DN]").otherwise("[=]")
    summary = F.concat_ws(
        ". ",
        F.concat(F.lit("AQI is expected to be **"), F.col("f.aqi").cast("string"), F.lit("** ("), F.col("f.category"),
                 F.lit(") in the next hour")),
        F.concat(F.lit("and **"), F.col("h3.aqi").cast("string"), F.lit("** ("), F.col("h3.category"),
                 F.lit(") in 3 hours")),
        F.concat(F.lit("\n\nOverall trend: **"), trend, F.lit("** "), mark))
    level = F.when(F.col("c") >= 0.65, "high").when(F.col("c") >= 0.4, "medium").otherwise("low")
    return out.select(*keys, trend.alias("overall_trend"), level.alias("confidence_level"), summary.alias("summary"))


def pollutant_notes(forecasts: DataFrame) -> DataFrame:
    """Notes on pollutants that move more than five percent per hour."""
    sign = F.when(F.col("trend_pct") >= 0, "+").otherwise("")
    text = F.concat(F.lit("\n"), F.col("trend_mark"), F.lit(" "), I.label_of(F.col("parameter")), F.lit(" is **"),
                    F.col("trend"), F.lit("** ("), sign, text1(F.col("trend_pct")), F.lit("%/hr)"))
    return forecasts.where((F.col("trend") != "stable") & (F.abs("trend_pct") > 5)).withColumn("note", text)


def horizon_outlook(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Summary of a recursive model forecast.

    Input rows: keys, ``hour_offset``, ``prediction``, ``base_aqi``, ``hours_of_data``.
    """
    from ..functions.numeric import horizon_band, text0

    low, high = horizon_band(F.col("prediction"), F.col("hour_offset"))
    point = F.struct(
        "hour_offset", F.bround("prediction", 1).alias("aqi"), I.band(F.col("prediction")).alias("category"),
        F.bround(low, 1).alias("lower"), F.bround(high, 1).alias("upper"))
    rows = predictions.withColumn("_p", point).groupBy(*keys).agg(
        F.array_sort(F.collect_list("_p")).alias("points"),  # one element per forecast hour
        F.max_by("prediction", "hour_offset").alias("_final"), F.min("prediction").alias("_min"),
        F.max("prediction").alias("_max"), F.max("base_aqi").alias("current_aqi"),
        F.max("hours_of_data").alias("_hours"), F.max("hour_offset").alias("_h"))
    change = (F.col("_final") - F.col("current_aqi")) / F.greatest("current_aqi", F.lit(1.0)) * 100.0
    trend = F.when(change > 10, "worsening").when(change < -10, "improving").otherwise("stable")
    level = F.when(F.col("_hours") >= 24, "high").when(F.col("_hours") >= 12, "medium").otherwise("low")
    verb = F.when(trend == "worsening", "increase").when(trend == "improving", "decrease").otherwise("remain stable")
    summary = F.concat(
        F.lit("AQI is expected to "), verb, F.lit(" over the next "), F.col("_h").cast("string"),
        F.lit(" hours. Predicted range: "), text0(F.col("_min")), F.lit("-"), text0(F.col("_max")), F.lit(" ("),
        I.band(F.col("_min")), F.lit(" to "), I.band(F.col("_max")), F.lit("). Confidence: "), level, F.lit("."))
    return rows.select(*keys, "current_aqi", "points", trend.alias("overall_trend"), level.alias("confidence_level"),
                       summary.alias("summary"))
