"""Numeric and calendar expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once. A column used several times inside a conditional is otherwise
    evaluated at each use."""
    return F.transform(F.array(value), body)[0]


def not_null(guard: Column, value: Column) -> Column:
    """``value`` where ``guard`` is not NULL (``greatest``/``least`` skip NULLs, which would turn NULL into a bound)."""
    return F.when(guard.isNotNull(), value)


def number_or_null(c: Column) -> Column:
    """NaN becomes NULL; the library never stores NaN."""
    return F.when(~F.isnan(c), c)


def clamp(c: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    out = c
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(float(high)))
    return not_null(c, out)


def sigmoid(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def squared_l2(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v * v)


def cyclic(x: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2.0 * math.pi) * x / float(period)
    return F.sin(angle), F.cos(angle)


def calendar(ts: Column) -> dict[str, Column]:
    hour, dow, month = F.hour(ts), F.weekday(ts), F.month(ts)
    out = {"hour": hour, "dow": dow, "month": month, "is_weekend": (dow >= 5).cast("int")}
    for name, part, period in (("hour", hour, 24), ("dow", dow, 7), ("month", month, 12)):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclic(part, period)
    return out


def wind_components(speed: Column, direction: Column) -> tuple[Column, Column]:
    angle = F.radians(direction)
    return speed * F.sin(angle), speed * F.cos(angle)


def local_time(ts: Column) -> Column:
    """UTC+5:30 wall clock."""
    return ts + F.expr("INTERVAL '05:30' HOUR TO MINUTE")


def rough_local_hour(ts: Column) -> Column:
    """Whole-hour approximation (UTC+5); differs from ``local_time`` for minutes >= 30."""
    return F.pmod(F.hour(ts) + 5, F.lit(24))


def horizon_band(prediction: Column, hour_offset: Column) -> tuple[Column, Column]:
    spread = F.lit(0.10) + F.lit(0.05) * hour_offset
    return clamp(prediction * (1.0 - spread), low=0.0), prediction * (1.0 + spread)


def text0(x: Column) -> Column:
    """Number as text without decimals, half to even."""
    return F.bround(x, 0).cast("bigint").cast("string")


def text1(x: Column) -> Column:
    """Number as text with one decimal."""
    return F.format_string("%.1f", F.bround(x, 1))
