"""Unit conversion and the piecewise-linear index."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from .numeric import not_null


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[key]


def to_index_unit(parameter: Column, value: Column, unit: Column) -> Column:
    """CO in mg/m³, everything else in µg/m³."""
    u = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    mg = u.isin(K.MG_UNITS)
    factor = _lookup(K.PPB_FACTORS, parameter)
    co = (
        F.when(mg, value)
        .when((u == "ppm") | ((u == "ppb") & (value < K.CO_PPB_IS_PPM_BELOW)), value * K.CO_PPM_FACTOR)
        .when(u == "ppb", value * K.PPB_FACTORS["co"])
        .otherwise(value / 1000.0)
    )
    other = (
        F.when(mg, value * 1000.0)
        .when((u == "ppb") & factor.isNotNull(), value * factor)
        .when((u == "ppm") & factor.isNotNull(), value * factor * 1000.0)
        .otherwise(value)
    )
    return F.when(parameter == "co", co).otherwise(other)


def display_value(parameter: Column, value: Column, unit: Column) -> Column:
    v = to_index_unit(parameter, value, unit)
    return F.when(parameter == "co", F.bround(v, 2)).otherwise(F.bround(v, 1))


def display_unit(parameter: Column) -> Column:
    return F.when(parameter == "co", "mg/m³").otherwise("µg/m³")


def _curve(breaks: list[float], c: Column) -> Column:
    out = F.when(c <= breaks[0], F.lit(0.0))
    for k in range(1, len(breaks)):
        c0, c1 = breaks[k - 1], breaks[k]
        i0, i1 = K.INDEX_STEPS[k - 1], K.INDEX_STEPS[k]
        out = out.when(c <= c1, F.lit((i1 - i0) / (c1 - c0)) * (c - c0) + F.lit(i0))
    return out.otherwise(F.lit(500.0))


def sub_index(parameter: Column | str, concentration: Column) -> Column:
    """Unrounded sub-index; -1 for a parameter without a table, NULL for a NULL reading.

    ``parameter`` may be a plain string when it is known while the plan is built (wide frames).
    """
    if isinstance(parameter, str):
        if parameter not in K.BREAKPOINTS:
            return not_null(concentration, F.lit(-1.0))
        return not_null(concentration, _curve(K.BREAKPOINTS[parameter], concentration))
    chain = None
    for name, breaks in K.BREAKPOINTS.items():
        curve = _curve(breaks, concentration)
        chain = F.when(parameter == name, curve) if chain is None else chain.when(parameter == name, curve)
    return not_null(concentration, chain.otherwise(F.lit(-1.0)))


def with_concentration(df: DataFrame, out: str = "concentration") -> DataFrame:
    """Reading in index units as its own column. The sub-index refers to it once per segment, so it must be a column
    of a projection below and not an inlined expression (the generated code would outgrow the JVM's method limit)."""
    return df.withColumn(out, to_index_unit(F.col("parameter"), F.col("value"), F.col("unit")))


def with_sub_index(df: DataFrame, out: str = "sub_index") -> DataFrame:
    """Unrounded sub-index of (parameter, value, unit) rows."""
    rows = with_concentration(df, "_conc")
    return rows.withColumn(out, sub_index(F.col("parameter"), F.col("_conc"))).drop("_conc")


def band(index: Column) -> Column:
    """Band of an index value; only the upper bounds matter."""
    out = None
    for label, upper, _ in K.BANDS[:-1]:
        out = F.when(index <= upper, label) if out is None else out.when(index <= upper, label)
    return not_null(index, out.otherwise(K.BANDS[-1][0]))


def band_of_pm25(concentration: Column) -> Column:
    """Band of the truncated PM2.5 sub-index. Truncation keeps a value at or under a bound only below bound + 1, so the
    comparison is with bound + 1 exclusive."""
    si, out = sub_index("pm25", concentration), None
    for label, upper, _ in K.BANDS[:-1]:
        out = F.when(si < upper + 1, label) if out is None else out.when(si < upper + 1, label)
    return not_null(concentration, out.otherwise(K.BANDS[-1][0]))


def band_colour(label: Column) -> Column:
    return F.coalesce(_lookup({b: colour for b, _, colour in K.BANDS}, label), F.lit("#999999"))


def band_advice(label: Column) -> Column:
    return F.coalesce(_lookup(K.BAND_ADVICE, label), F.lit(""))


def band_actions(label: Column) -> Column:
    chain = None
    for name, actions in K.BAND_ACTIONS.items():
        value = F.array(*[F.lit(a) for a in actions])
        chain = F.when(label == name, value) if chain is None else chain.when(label == name, value)
    return chain.otherwise(F.array().cast("array<string>"))


def band_risks(label: Column) -> Column:
    chain = None
    for name, risks in K.BAND_RISKS.items():
        value = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(b).alias("body")) for t, b in risks])
        chain = F.when(label == name, value) if chain is None else chain.when(label == name, value)
    return chain.otherwise(F.array().cast("array<struct<title:string,body:string>>"))


def label_of(parameter: Column) -> Column:
    return F.coalesce(_lookup(K.LABELS, parameter), F.upper(parameter))


def display_rank(parameter: Column) -> Column:
    """Position in the display order; unknown names come last."""
    return F.coalesce(_lookup({p: i for i, p in enumerate(K.POLLUTANTS)}, parameter), F.lit(len(K.POLLUTANTS)))


def canonical_parameter(raw: Column) -> Column:
    """Alias -> canonical name, NULL when unknown."""
    return _lookup(K.PARAMETER_ALIASES, F.lower(F.trim(raw)))


def who_limit(parameter: Column) -> Column:
    return _lookup(K.WHO_LIMITS, parameter)


def india_limit(parameter: Column) -> Column:
    return _lookup(K.INDIA_LIMITS, parameter)


def physical_max(parameter: Column, current: Column) -> Column:
    return F.coalesce(_lookup(K.PHYSICAL_MAX, parameter), current * 3.0)


def limit_unit_value(parameter: Column, value: Column, unit: Column) -> Column:
    """Reading in µg/m³, the unit in which the 24-hour limits are stated (CO included)."""
    v = to_index_unit(parameter, value, unit)
    return F.when(parameter == "co", v * 1000.0).otherwise(v)


def cigarettes_per_day(pm25: Column) -> Column:
    return F.bround(pm25 / K.CIGARETTE_PM25, 1)


def who_ratio(value: Column, limit: Column) -> Column:
    """NULL stands for the "?" shown when there is no reading or limit."""
    return F.when(value != 0, F.bround(F.try_divide(value, limit), 1))


def bar_percent(index: Column) -> Column:
    return not_null(index, F.least(index / 500.0 * 100.0, F.lit(100.0)))
