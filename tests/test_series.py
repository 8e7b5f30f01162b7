import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airloom.operators import forecast as FC, insights as INS, learning as L, timeseries as TS
from airloom.operators.quantiles import exact_quantiles, winsorize

START = datetime(2024, 1, 1)


def series(spark, values, name="s", step=1):
    rows = [(name, START + timedelta(hours=i * step), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "s string, ts timestamp, v double")


def column(df, c="v"):
    return [r[c] for r in df.orderBy("ts").collect()]


def test_interpolation_golden(spark):
    values = [None, 1] + [None] * 8 + [10] + [None] * 3
    got = column(TS.interpolate(series(spark, values), ["s"], ["v"]))
    assert got == [None, 1, 2, 3, 4, 5, 6, 7, None, None, 10, 10, 10, 10]
    strict = column(TS.interpolate(series(spark, values), ["s"], ["v"], strict_gap=True))
    assert strict[2:10] == [None] * 8 and strict[-1] is None


def test_rolling_golden(spark):
    out = TS.rolling(series(spark, [1, None, 3, 5]), ["s"], "v", [3])
    assert column(out, "v_rmean3") == [None, 1, 1, 2]
    assert column(out, "v_rstd3") == pytest.approx([0, 0, 0, math.sqrt(2)])


def test_densify_and_lag_have_no_skipped_hour(spark):
    rows = [("a", START, 1.0), ("a", START + timedelta(hours=3), 4.0), ("b", START, 9.0)]
    g = TS.densify(spark.createDataFrame(rows, "s string, ts timestamp, v double"), ["s"])
    assert g.where("s = 'a'").count() == 4 and g.where("s = 'b'").count() == 1
    assert column(TS.lags(g.where("s = 'a'"), ["s"], "v", [1]), "v_lag1") == [None, 1.0, None, None]


def test_features_match_pandas(spark):
    rng = np.random.default_rng(1)
    n = 200
    v = rng.uniform(10, 300, n).round(2)
    rows = [("x", START + timedelta(hours=i), float(v[i]), float(i % 7), float(i * 3 % 360)) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, aqi double, wind_speed double, wind_dir double")
    got = TS.features(df, ["s"]).orderBy("ts").toPandas()
    a = pd.Series(v)
    assert np.allclose(got.aqi_lag168.to_numpy(float), a.shift(168), equal_nan=True)
    assert np.allclose(got.aqi_rmean24.to_numpy(float), a.shift(1).rolling(24, min_periods=1).mean(), equal_nan=True)
    assert np.allclose(got.aqi_rstd6.to_numpy(float), a.shift(1).rolling(6, min_periods=1).std().fillna(0))
    assert np.allclose(got.aqi_accel.to_numpy(float), a.diff().diff(), equal_nan=True)
    assert np.allclose(got.wind_u, [r[3] * math.sin(math.radians(r[4])) for r in rows])
    assert list(got.dow[:1]) == [0]


def test_feature_list(spark):
    names = ["pm25", "pm10", "no", "no2", "nox", "nh3", "so2", "co", "o3", "temperature", "humidity", "wind_speed",
             "wind_dir", "rainfall", "solar_rad", "pressure", "aqi"]
    df = spark.createDataFrame([], "s string, ts timestamp, " + ", ".join(f"{n} double" for n in names))
    assert TS.feature_columns(TS.features(df, ["s"]), series=["s"]) == TS.FEATURE_COLUMNS
    assert len(TS.FEATURE_COLUMNS) == 58


def test_as_of_and_default(spark):
    left = series(spark, [0] * 5)
    right = spark.createDataFrame([("s", START + timedelta(hours=2), 7)], "s string, ts timestamp, k int")
    assert column(TS.as_of(left, right, ["s"], "k", default=0), "k") == [0, 0, 7, 7, 7]


def test_exact_quantiles_through_brackets(spark):
    rng = np.random.default_rng(3)
    hot, cold = rng.normal(50, 20, 30_000).round(1), rng.exponential(5, 700)
    rows = [("hot", float(x)) for x in hot] + [("cold", float(x)) for x in cold] + [("one", 4.0), ("nul", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    probs = {"a": 0.001, "m": 0.5, "z": 0.999, "lo": 0.0, "hi": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs, accuracy=200).collect()}
    for k, data in (("hot", hot), ("cold", cold)):
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(data, p)), (k, name)
    assert got["one"].m == 4.0 and "nul" not in got
    assert exact_quantiles(df, [], "v", {"m": 0.5}, 200).first().m == pytest.approx(np.median(np.concatenate([hot, cold, [4.0]])))


def test_winsorize(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1001)] + [(None,)], "v double")
    r = winsorize(df, [], "v", 0.01, 0.99).agg(F.min("v"), F.max("v"), F.count_if(F.col("v").isNull())).first()
    assert tuple(r) == (10.0, 990.0, 1)


def test_live_frame_long(spark):
    rows = [("d", p, v, START + timedelta(hours=h, minutes=30)) for h in range(4) for p, v in (("PM2.5", 30.0 + h), ("xx", 1.0))]
    df = spark.createDataFrame(rows, "city string, parameter string, value double, date_utc timestamp")
    out = TS.live_frame(df, ["city"], F.lit(222.0)).orderBy("ts").collect()
    assert len(out) == 4 and out[0].aqi == pytest.approx(50.0) and out[-1].aqi == 222.0 and out[1].aqi_lag1 == out[0].aqi
    assert TS.live_frame(df.where(F.hour("date_utc") < 2), ["city"]).count() == 0


# --- Forecast against a plain fold -----------------------------------------------------------

from airloom import constants as K  # noqa: E402


def plain_forecast(param, hours, values, horizon):
    """Independent statement of the forecast of one series, for checking."""
    local = [int(((h + timedelta(hours=5, minutes=30)).hour)) for h in hours]
    v, n = np.array(values), len(values)
    top = K.PHYSICAL_MAX.get(param, v[-1] * 3)
    mult = np.array([K.DIURNAL[h] for h in local])
    if n >= 6:
        flat = v / mult
        base = np.median(flat[-12:])
        level, trend = flat[-6], 0.0
        for x in flat[-5:]:
            new = 0.35 * x + 0.65 * (level + 0.75 * trend)
            trend, level = 0.3 * (new - level) + 0.7 * 0.75 * trend, new
        raw = [(base + trend * 0.75 ** h * h) * K.DIURNAL[(local[-1] + h) % 24] for h in range(1, horizon + 1)]
        spread = np.std((v - base * mult)[-12:])
        shift = 0.0
    else:
        x = np.arange(n)
        slope, icept = np.polyfit(x, v, 1, w=np.sqrt(np.exp(np.linspace(0, 2, n))))
        raw = [icept + slope * (n + h) for h in range(horizon)]
        spread = np.std(v - icept - slope * x)
        shift = 0.5
    out, ref = [], v[-1]
    for h, r in enumerate(raw):
        ref = min(max(min(max(r, ref * 0.88), ref * 1.12), 0), top)
        half = 1.65 * spread * math.sqrt(h + 1 + shift)
        out.append((ref, max(ref - half, 0), min(ref + half, top)))
    return out


@pytest.mark.parametrize("n", [3, 4, 5, 6, 9, 30])
def test_forecast_matches_plain_fold(spark, n):
    rng = np.random.default_rng(n)
    rows, expected = [], {}
    for param in ("pm25", "co", "nh3"):
        hours = [START + timedelta(hours=i) for i in range(n)]
        values = rng.uniform(20, 200, n).round(2).tolist()
        rows += [(param, v, "µg/m³", h) for v, h in zip(values, hours)]
        expected[param] = plain_forecast(param, hours, values, 4)
    df = spark.createDataFrame(rows, "parameter string, value double, unit string, date_utc timestamp")
    for r in FC.forecast_series(df, ["parameter"], 4).collect():
        assert r.method == ("diurnal" if n >= 6 else "linear")
        for p, (v, lo, hi) in zip(r.points, expected[r.parameter]):
            assert (p.value, p.lower, p.upper) == pytest.approx((v, lo, hi), abs=0.0501)
            assert 0.1 <= p.confidence <= 1


def test_forecast_needs_three_points(spark):
    df = spark.createDataFrame([("pm25", 1.0, "u", START)] * 1, "parameter string, value double, unit string, date_utc timestamp")
    assert FC.forecast_series(df).count() == 0


def test_index_forecast_and_notes(spark):
    rows = [(p, 50.0 + 30 * i, "µg/m³", START + timedelta(hours=i)) for i in range(8) for p in ("pm25", "pm10")]
    df = spark.createDataFrame(rows, "parameter string, value double, unit string, date_utc timestamp")
    f = FC.forecast_series(df)
    hours = FC.forecast_index(f)
    assert [r.hour_offset for r in hours.orderBy("hour_offset").collect()] == [1, 2, 3]
    assert all(r.lower <= r.aqi <= r.upper for r in hours.collect())
    out = FC.index_outlook(hours).first()
    assert out.summary.startswith("AQI is expected to be **") and out.overall_trend in ("stable", "worsening", "improving")
    assert FC.pollutant_notes(f).count() == 2
    city = spark.createDataFrame([(10,)], "aqi int")
    titles = [r.title for r in INS.forecast_notes(hours, city, f).orderBy("seq").collect()]
    assert titles[0] == "AQI Expected to Worsen" and len(titles) == 3


def test_insight_rules(spark):
    rows = [("pm25", v, START + timedelta(hours=i)) for i, v in enumerate([10.0, 10.0, 10.0, 20.0])]
    h = spark.createDataFrame(rows, "parameter string, value double, date_utc timestamp")
    r = INS.recent_change(h).first()
    assert (r.recent, r.earlier) == (pytest.approx(40 / 3), 10.0)
    assert INS.trend_alerts(h).first().priority == 113
    city = spark.createDataFrame([(200, 30.0), (301, 30.0)], "aqi int, pm25 double")
    assert {r.priority for r in INS.health_rules(city).collect()} == {65, 50, 90}
    assert INS.emergency(city).count() == 1
    empty = INS.ranked([INS.health_rules(city.limit(0))])
    assert INS.markdown(empty).first()[0] == "*No notable insights at this time.*"
    m = spark.createDataFrame([("2024-01-01 18:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("as_of"))
    assert INS.diurnal_notes(m, []).first().title == "Nighttime Inversion"


def test_recursive_forecast_matches_loop(spark):
    """One step at a time with a linear stand-in model."""
    class Fake:
        def transform(self, df):
            return df.withColumn("_x", F.lit(0)).withColumn(
                "prediction", 0.5 * F.col("aqi_lag1") + 0.3 * F.col("aqi_rmean3") + 0.1 * F.col("aqi_rstd3") + F.col("hour_cos"))

    v = np.random.default_rng(5).uniform(50, 150, 30)
    df = spark.createDataFrame([("a", START + timedelta(hours=i), float(x)) for i, x in enumerate(v)], "s string, ts timestamp, aqi double")
    f = L.forecast_origins(TS.features(df, ["s"]), ["s"])
    last = f.orderBy(F.col("ts").desc()).limit(1)
    got = [r.prediction for r in L.recursive_forecast(last, Fake(), TS.feature_columns(f, series=["s"]), ["s"], horizon=5).orderBy("hour_offset").collect()]
    hist, state = list(v), {"lag1": v[-2], "m": np.mean(v[-4:-1]), "s": np.std(v[-4:-1], ddof=1), "hour": 29 % 24}
    want = []
    for h in range(1, 6):
        p = max(0.5 * state["lag1"] + 0.3 * state["m"] + 0.1 * state["s"] + math.cos(2 * math.pi * state["hour"] / 24), 0)
        want.append(p)
        state = {"lag1": hist[-1], "m": np.mean(hist[-3:]), "s": np.std(hist[-3:], ddof=1), "hour": (29 + h) % 24}
        hist.append(p)
    assert got == pytest.approx(want)
