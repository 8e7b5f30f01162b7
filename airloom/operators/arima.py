"""ARIMA(p, 1, q) of many series by two stages of least squares.

A long autoregression of the differenced series gives residuals; the differences are then regressed on their own p last
values and the q last residuals. Both regressions need sums of products only, which are one aggregate per series each; the
small equations are solved per series. Lags are windows over hourly rows, so a window group is bounded by the calendar.
Forecasts are a fold over the hours ahead.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .timeseries import by_time


def solve(gram: np.ndarray, width: int) -> list[float] | None:
    """Coefficients of the last column on the others from the upper triangle of sums of products (row by row); the
    least-norm ones if the columns depend on each other. None without rows."""
    full = np.zeros((width, width))
    full[np.triu_indices(width)] = gram
    full = full + np.triu(full, 1).T
    if not full[0, 0] > 0:
        return None
    return np.linalg.lstsq(full[:-1, :-1], full[:-1, -1], rcond=1e-12)[0].tolist()


def _solver(width: int):
    @F.arrow_udf("array<double>")
    def made(gram: pa.Array) -> pa.Array:
        return pa.array([solve(np.array(g.as_py(), float), width) if g.is_valid else None for g in gram], pa.list_(pa.float64()))

    return made


def regressions(rows: DataFrame, series: list[str], terms: list[Column], target: Column, output: str) -> DataFrame:
    """series, ``output``: constant and coefficients of the target on the terms, over rows where none is NULL."""
    every = [F.lit(1.0), *terms, target]
    kept = rows.select(*series, *[c.cast("double").alias(f"_t{i}") for i, c in enumerate(every)]).dropna(subset=[f"_t{i}" for i in range(len(every))])
    pairs = [(i, j) for i in range(len(every)) for j in range(i, len(every))]
    sums = kept.groupBy(*series).agg(*[F.sum(F.col(f"_t{i}") * F.col(f"_t{j}")).alias(f"_s{n}") for n, (i, j) in enumerate(pairs)])
    return sums.select(*series, _solver(len(every))(F.array(*[F.col(f"_s{n}") for n in range(len(pairs))])).alias(output))


def _combined(coefficients: str, terms: list[Column]) -> Column:
    out = F.col(coefficients)[0]
    for i, t in enumerate(terms):
        out = out + F.col(coefficients)[i + 1] * t
    return out


def fit(df: DataFrame, series: list[str], value: str, ts: str = "ts", p: int = 2, q: int = 2, long: int = 12,
        last: int | None = None) -> DataFrame:
    """series, coefficients (constant, p of the differences, q of the residuals), state: what a forecast starts from.

    ``df``: one row per series and hour; NULL values are left out, so that neighbours stand side by side. ``last`` fits on
    that many newest rows only. A series too short for a regression has NULL coefficients, which forecast its last value.
    """
    w = by_time(series, ts)
    known = df.where(F.col(value).isNotNull()).select(*series, ts, F.col(value).cast("double").alias("y"))
    if last is not None:
        newest = by_time(series, ts).rowsBetween(0, last)
        known = known.withColumn("_left", F.count(F.lit(1)).over(newest)).where(F.col("_left") <= last).drop("_left")
    steps = known.withColumn("d", F.col("y") - F.lag("y").over(w))
    lags = lambda c, n: [F.lag(c, i).over(w) for i in range(1, n + 1)]
    wide = steps.withColumns({f"d{i + 1}": c for i, c in enumerate(lags("d", max(long, p)))})
    wide = cut_lineage(wide)
    own = lambda n: [F.col(f"d{i}") for i in range(1, n + 1)]
    first = regressions(wide, series, own(long), F.col("d"), "_long")
    errors = wide.join(_small(first), series, "left").withColumn("e", F.col("d") - _combined("_long", own(long)))
    errors = errors.withColumns({f"e{i + 1}": c for i, c in enumerate(lags("e", q))})
    errors = cut_lineage(errors.select(*series, ts, "y", "d", *[f"d{i}" for i in range(1, p + 1)], "e", *[f"e{i}" for i in range(1, q + 1)]))
    terms = own(p) + [F.col(f"e{i}") for i in range(1, q + 1)]
    second = regressions(errors, series, terms, F.col("d"), "coefficients")
    # What the forecast starts from: the last value, the newest differences and the newest residuals of the second stage.
    recent = lambda c, n: [F.coalesce(c if i == 0 else F.lag(c, i).over(w), F.lit(0.0)) for i in range(n)]
    made = errors.join(_small(second), series, "left").withColumn("u", F.col("d") - _combined("coefficients", terms))
    rows = made.select(*series, ts, "coefficients", "y", F.array(*recent(F.col("d"), p)).alias("d"), F.array(*recent(F.col("u"), q)).alias("u"))
    state = F.struct("y", "d", "u")
    out = rows.groupBy(*series).agg(F.max_by(F.struct("coefficients", state.alias("state")), ts).alias("m"), F.max(ts).alias("at"))
    return out.select(*series, "at", "m.coefficients", "m.state")


def _small(df: DataFrame) -> DataFrame:
    from .bounds import broadcast_if_small

    return broadcast_if_small(df)


def forecast(fitted: DataFrame, series: list[str], horizon: int, ts: str = "ts", p: int = 2, q: int = 2) -> DataFrame:
    """series, ts, prediction for ``horizon`` hours after the last row; residuals ahead are 0."""
    c = F.col("coefficients")
    start = F.struct(F.col("state.y").alias("y"), F.col("state.d").alias("d"), F.col("state.u").alias("u"),
                     F.array().cast("array<double>").alias("made"))

    def ahead(a, _):
        step = F.coalesce(c[0], F.lit(0.0))
        for i in range(p):
            step = step + F.coalesce(c[1 + i], F.lit(0.0)) * a["d"][i]
        for i in range(q):
            step = step + F.coalesce(c[1 + p + i], F.lit(0.0)) * a["u"][i]
        y = a["y"] + step
        shifted = lambda new, old, n: F.array(new, *[old[i] for i in range(n - 1)]) if n else old
        return F.struct(y.alias("y"), shifted(step, a["d"], p).alias("d"), shifted(F.lit(0.0), a["u"], q).alias("u"),
                        F.concat(a["made"], F.array(y)).alias("made"))

    made = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, ahead, lambda a: a["made"])
    each = fitted.select(*series, "at", F.posexplode(made).alias("_h", "prediction"))
    at = F.timestamp_micros(F.unix_micros("at") + (F.col("_h") + 1).cast("bigint") * 3_600_000_000)
    return each.select(*series, at.alias(ts), "prediction")
