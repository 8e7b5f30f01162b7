"""Rule-based insights. Every generator returns (keys, category, severity, emoji, title, body, priority, seq)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions import index as I
from ..functions.numeric import rough_local_hour, text0, text1
from .bounds import top_k
from .readings import last_n, station_means

COLUMNS = ["category", "severity", "emoji", "title", "body", "priority", "seq"]

# Fixed order of the generators; ``seq`` = 100 * generator + position keeps the priority sort stable.
TREND, DIURNAL, COMPARISON, FORECAST, STATION, HEALTH = range(1, 7)


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _row(df: DataFrame, keys: list[str], category: str, severity, title, body, priority, seq) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        *keys, F.lit(category).alias("category"), as_col(severity).alias("severity"), F.lit("").alias("emoji"),
        as_col(title).alias("title"), as_col(body).alias("body"), as_col(priority).cast("int").alias("priority"),
        as_col(seq).cast("int").alias("seq"))


def recent_change(hourly: DataFrame, keys: list[str] = ("parameter",), ts: str = "date_utc") -> DataFrame:
    """Mean of the last three hours against the three before (or the first three of a series of four or five)."""
    keys = list(keys)
    tail = last_n(hourly, keys, 6, ts).withColumn("n", F.max("_rn").over(W.partitionBy(*keys)))
    recent = F.col("_rn") <= 3
    earlier = F.when(F.col("n") >= 6, F.col("_rn") > 3).otherwise(F.col("_rn") > F.col("n") - 3)
    out = tail.where(F.col("n") >= 4).groupBy(*keys).agg(
        F.avg(F.when(recent, F.col("value"))).alias("recent"), F.avg(F.when(earlier, F.col("value"))).alias("earlier"))
    return out.where(F.col("earlier") > 0).withColumn(
        "pct_change", (F.col("recent") - F.col("earlier")) / F.col("earlier") * 100.0)


def trend_alerts(hourly: DataFrame, keys: list[str] = (), ts: str = "date_utc") -> DataFrame:
    keys, watched = list(keys), ["pm25", "pm10", "no2", "o3"]
    p, pct = F.col("parameter"), F.col("pct_change")
    change = recent_change(hourly.where(p.isin(watched)), keys + ["parameter"], ts).where(F.abs("pct_change") > 25)
    name, rise = I.label_of(p), pct > 0
    hint = F.when(p.isin("pm25", "pm10"), "This may be due to evening traffic and boundary layer collapse.").otherwise(
        "Monitor conditions closely.")
    span = _cat(" in the last 3 hours (from ", text0(F.col("earlier")), " to ", text0(F.col("recent")), " µg/m³). ")
    body = F.when(rise, _cat(name, " has risen **", text0(pct), "%**", span, hint)).otherwise(
        _cat(name, " has dropped **", text0(F.abs(pct)), "%**", span, "Air quality is getting better."))
    position = F.array_position(F.lit(watched), p)
    return _row(
        change, keys, "trend_alert", F.when(rise, "warning").otherwise("info"),
        F.when(rise, _cat(name, " Spike Detected")).otherwise(_cat(name, " Improving")), body,
        F.when(rise, 80 + pct.cast("int")).otherwise(40), 100 * TREND + position)


# (first hour, last hour, severity, title, body, priority); hours are rough local hours and may wrap midnight.
DIURNAL_RULES = [
    (7, 10, "info", "Morning Rush Hour",
     "Traffic emissions typically peak between 8-10 AM. PM2.5 and NO₂ may rise. "
     "Avoid outdoor exercise if AQI is elevated.", 50),
    (17, 21, "warning", "Evening Pollution Peak",
     "Evening hours see the highest pollution in Delhi due to traffic, cooking emissions, and atmospheric boundary "
     "layer collapse trapping pollutants near the surface.", 60),
    (23, 4, "info", "Nighttime Inversion",
     "Night-time temperature inversions can trap pollutants at ground level. "
     "PM2.5 often stays elevated until morning winds begin.", 35),
    (11, 15, "info", "Midday Mixing",
     "Solar heating improves atmospheric mixing, which typically disperses pollutants. "
     "This is usually the best window for outdoor activity.", 30),
]


def diurnal_notes(moments: DataFrame, keys: list[str], as_of: str = "as_of") -> DataFrame:
    """``moments``: one row per key with the time the report is made for."""
    hour = rough_local_hour(F.col(as_of))

    def inside(a, b):
        return hour.between(a, b) if a <= b else (hour >= a) | (hour <= b)

    rules = F.filter(F.array(*[
        F.struct(inside(a, b).alias("on"), F.lit(sev).alias("severity"), F.lit(t).alias("title"),
                 F.lit(body).alias("body"), F.lit(prio).alias("priority"))
        for a, b, sev, t, body, prio in DIURNAL_RULES]), lambda r: r["on"])
    hit = moments.select(*keys, F.explode(rules).alias("r"))
    return _row(hit, keys, "diurnal", F.col("r.severity"), F.col("r.title"), F.col("r.body"), F.col("r.priority"),
                100 * DIURNAL)


def limit_comparison(concentrations: DataFrame, keys: list[str] = (), convert: bool = True) -> DataFrame:
    """Readings above the 24-hour guideline. ``convert=False`` compares the raw number whatever its unit."""
    p = F.col("parameter")
    value = I.limit_unit_value(p, F.col("value"), F.col("unit")) if convert else F.col("value")
    unit = F.lit("µg/m³") if convert else F.col("unit")
    rows = concentrations.select(*keys, "parameter", value.alias("v"), unit.alias("u"), I.who_limit(p).alias("limit"))
    rows = rows.where(F.col("v") > F.col("limit")).withColumn("ratio", F.col("v") / F.col("limit"))
    ratio, name = F.col("ratio"), I.label_of(p)
    tail = F.when(ratio > 5, "This level poses serious health risks.").otherwise(
        "Sensitive groups should take precautions.")
    return _row(
        rows, list(keys), "comparison",
        F.when(ratio > 10, "critical").when(ratio > 5, "warning").otherwise("info"),
        _cat(name, ": ", text1(ratio), "× WHO Limit"),
        _cat("Current ", name, " is **", text0(F.col("v")), " ", F.col("u"), "**, which is **", text1(ratio),
             "×** the WHO 24-hour guideline of ", F.col("limit").cast("int").cast("string"), " ", F.col("u"), ". ", tail),
        F.when(ratio > 10, 95).when(ratio > 5, 75).otherwise(50), 100 * COMPARISON + I.display_rank(p))


def emergency(city: DataFrame, keys: list[str] = ()) -> DataFrame:
    """``city``: one row per key with ``aqi`` and the ``pm25`` concentration."""
    smoke = text1(F.coalesce(F.col("pm25"), F.lit(0.0)) / K.CIGARETTE_PM25)
    body = _cat("AQI **", F.col("aqi").cast("string"), "** is in the emergency range. "
                "This is equivalent to smoking **", smoke, "** cigarettes per day. Avoid all outdoor exposure.")
    return _row(city.where(F.col("aqi") > 300), list(keys), "comparison", "critical", "AQI Emergency Level", body, 100,
                100 * COMPARISON + 99)


def forecast_notes(hours: DataFrame, city: DataFrame, forecasts: DataFrame | None = None,
                   keys: list[str] = ()) -> DataFrame:
    """Expected change of the index (first hour 15 % up, else last hour 15 % down) and fast-rising pollutants.

    ``hours``: keys, hour_offset, aqi, category. ``city``: keys, aqi (current).
    """
    keys = list(keys)
    ends = hours.groupBy(*keys).agg(
        F.min_by(F.struct("aqi", "category"), "hour_offset").alias("f"),
        F.max_by("aqi", "hour_offset").alias("l"), F.count(F.lit(1)).alias("n"))
    now = city.select(*keys, F.col("aqi").alias("now"))
    rows = ends.join(now, keys) if keys else ends.withColumn("now", now.scalar())
    worse = F.col("f.aqi") > F.col("now") * 1.15
    better = F.col("l") < F.col("now") * 0.85
    now_text = F.col("now").cast("string")
    rows = rows.where(worse | better)
    out = _row(
        rows, keys, "forecast_note", F.when(worse, "warning").otherwise("info"),
        F.when(worse, "AQI Expected to Worsen").otherwise("AQI Expected to Improve"),
        F.when(worse, _cat("AQI is predicted to rise from **", now_text, "** to **", F.col("f.aqi").cast("string"),
                           "** (", F.col("f.category"), ") in the next hour. Consider moving outdoor activities indoors."))
        .otherwise(_cat("AQI is predicted to drop from **", now_text, "** to **", F.col("l").cast("string"),
                        "** in the next ", F.col("n").cast("string"), " hours. Outdoor conditions should get better.")),
        F.when(worse, 85).otherwise(55), 100 * FORECAST)
    if forecasts is None:
        return out
    fast = forecasts.where((F.col("trend") == "rising") & (F.col("trend_pct") > 8))
    name = I.label_of(F.col("parameter"))
    rising = _row(
        fast, keys, "forecast_note", "warning", _cat(name, " Rising Rapidly"),
        _cat(name, " is increasing at **+", text1(F.col("trend_pct")), "%/hr**. Current: ",
             text1(F.col("current_value")), " → Predicted: ", text1(F.element_at("points", -1)["value"]), " in ",
             F.size("points").cast("string"), "h."),
        70, 100 * FORECAST + 1 + I.display_rank(F.col("parameter")))
    return out.unionByName(rising)


def station_extremes(latest: DataFrame) -> DataFrame:
    """Highest and lowest station mean per particulate; the first station by name wins a tie."""
    means = station_means(latest.where(F.col("parameter").isin("pm25", "pm10")))
    # Comparing (value, name) takes the last name on a tie of the maximum, so the names of the maximum are re-reduced.
    top = means.groupBy("parameter").agg(
        F.max("value").alias("worst_val"), F.min(F.struct("value", "location")).alias("low"),
        F.count(F.lit(1)).alias("stations"))
    worst = means.join(top, "parameter").where(F.col("value") == F.col("worst_val")).groupBy("parameter").agg(
        F.min("location").alias("worst"), F.max("worst_val").alias("worst_val"),
        F.max("low").alias("low"), F.max("stations").alias("stations"))
    return worst.select("parameter", "worst", "worst_val", F.col("low.location").alias("best"),
                        F.col("low.value").alias("best_val"), "stations")


def station_spread(latest: DataFrame) -> DataFrame:
    e = station_extremes(latest)
    ratio = F.col("worst_val") / F.col("best_val")
    e = e.where((F.col("stations") >= 2) & (F.col("best_val") > 0)).withColumn("ratio", ratio).where("ratio > 2")
    return _row(
        e, [], "station_insight", "info", _cat(I.label_of(F.col("parameter")), " Varies Across Stations"),
        _cat("**", F.col("worst"), "** reads ", text0(F.col("worst_val")), " µg/m³ while **", F.col("best"),
             "** reads ", text0(F.col("best_val")), " µg/m³ — a **", text1(F.col("ratio")),
             "×** difference. Hyperlocal factors (traffic, construction) may be at play."),
        45, 100 * STATION + I.display_rank(F.col("parameter")))


def health_rules(city: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Overlapping rules on the index."""
    a = F.col("aqi")
    rules = [
        (a > 200, F.when(a > 300, "critical").otherwise("warning"), "Respiratory Risk Elevated",
         "People with asthma, COPD, or other respiratory conditions should **stay indoors** with air purifiers. "
         "Even healthy individuals may experience throat irritation and coughing.", F.when(a > 300, 90).otherwise(70)),
        (a > 150, F.lit("warning"), "Outdoor Exercise Advisory",
         "Avoid prolonged outdoor exercise. Heavy breathing during exercise increases particulate intake by 5-10×. "
         "If exercising, choose early afternoon when mixing is best.", F.lit(65)),
        (a.between(100, 200), F.lit("info"), "Sensitive Groups Take Care",
         "Children, elderly, and those with pre-existing conditions should limit prolonged outdoor exposure. "
         "Use N95 masks if going outdoors.", F.lit(50)),
    ]
    table = F.filter(F.array(*[
        F.struct(on.alias("on"), sev.alias("severity"), F.lit(t).alias("title"), F.lit(b).alias("body"),
                 prio.alias("priority"), F.lit(i).alias("i")) for i, (on, sev, t, b, prio) in enumerate(rules)]),
        lambda r: r["on"])
    hit = city.select(*keys, F.explode(table).alias("r"))
    return _row(hit, list(keys), "health_context", F.col("r.severity"), F.col("r.title"), F.col("r.body"),
                F.col("r.priority"), 100 * HEALTH + F.col("r.i"))


def ranked(parts: list[DataFrame], keys: list[str] = (), limit: int = 6) -> DataFrame:
    """All insights in one table, highest priority first, ``limit`` per key."""
    every = reduce(lambda a, b: a.unionByName(b), parts)
    order = [F.col("priority").desc(), F.col("seq"), F.col("title")]
    if keys:
        return top_k(every, list(keys), order, limit)
    return every.orderBy(*order).limit(limit)


def markdown(insights: DataFrame) -> DataFrame:
    """One text of an already limited insight list."""
    badge = F.upper(_cat("[", F.col("severity"), "]"))
    block = F.struct((-F.col("priority")).alias("p"), F.col("seq"), _cat(
        "**", F.col("title"), "** ", badge, "\n\n", F.col("body")).alias("text"))
    blocks = F.array_sort(F.collect_list(block))
    text = F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n---\n\n")
    return insights.agg(
        F.when(F.count(F.lit(1)) == 0, "*No notable insights at this time.*").otherwise(text).alias("markdown"))
