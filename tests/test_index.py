import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from airloom import constants as K
from airloom.functions import index as I, numeric as N, sql
from airloom.operators import readings as R

UNITS = [
    ("co", 2.0, "mg/m³", 2.0), ("co", 1500.0, "µg/m³", 1.5), ("co", 1500.0, "μg/m³", 1.5), ("co", 2.0, "ppm", 2.29),
    ("co", 2.0, "ppb", 2.29), ("co", 100.0, "ppb", 0.1145), ("co", 1500.0, None, 1.5), ("no2", 10.0, "ppb", 18.8),
    ("no2", 0.01, "ppm", 18.8), ("pm25", 0.05, " MG/M3", 50.0), ("pm25", 50.0, "ppb", 50.0), ("o3", 1.0, "", 1.0),
]
EDGES = [("pm25", -5.0, 0.0), ("pm25", 0.0, 0.0), ("pm25", 15.0, 25.0), ("pm25", 30.0, 50.0), ("pm25", 60.0, 100.0),
         ("pm25", 90.0, 200.0), ("pm25", 120.0, 300.0), ("pm25", 250.0, 400.0), ("pm25", 380.0, 500.0),
         ("pm25", 381.0, 500.0), ("pm10", 175.0, 150.0), ("co", 6.0, 150.0), ("nh3", 10.0, -1.0), ("pm25", None, None)]
BANDS = [(50, "Good"), (51, "Satisfactory"), (100, "Satisfactory"), (101, "Moderate"), (200, "Moderate"), (201, "Poor"),
         (300, "Poor"), (301, "Very Poor"), (400, "Very Poor"), (401, "Severe"), (500, "Severe"), (600, "Severe")]


def test_unit_matrix(spark):
    df = spark.createDataFrame(UNITS, "parameter string, value double, unit string, expected double")
    sql.register(spark)
    out = df.select("expected", I.to_index_unit(F.col("parameter"), F.col("value"), F.col("unit")).alias("a"), F.expr("to_index_unit(parameter, value, unit)").alias("b"))
    for r in out.collect():
        assert r.a == pytest.approx(r.expected) and r.b == pytest.approx(r.expected)


def test_sub_index_edges(spark):
    df = spark.createDataFrame(EDGES, "parameter string, value double, expected double")
    for r in df.select("expected", I.sub_index(F.col("parameter"), F.col("value")).alias("a"), F.expr("sub_index(parameter, value)").alias("b")).collect():
        for got in (r.a, r.b):
            assert got == pytest.approx(r.expected) if r.expected is not None else got in (None, -1.0)


def test_sub_index_is_monotone(spark):
    df = spark.range(0, 6000).select((F.col("id") / 10.0).alias("c"))
    for p in K.BREAKPOINTS:
        values = [r[0] for r in df.orderBy("c").select(I.sub_index(p, F.col("c"))).collect()]
        assert values == sorted(values) and values[-1] <= 500


def test_bands(spark):
    df = spark.createDataFrame(BANDS, "i int, b string")
    assert all(r.b == r.x for r in df.select("b", I.band(F.col("i")).alias("x")).collect())
    # 50.9 truncates to 50, 51.0 does not
    c = spark.createDataFrame([(30.5,), (30.7,)], "c double")
    assert [r[0] for r in c.select(I.band_of_pm25(F.col("c"))).collect()] == ["Good", "Satisfactory"]


def test_texts_and_ratios(spark):
    one = spark.range(1)
    r = one.select(I.band_colour(F.lit("x")).alias("c"), I.band_advice(F.lit("x")).alias("a"),
                   F.size(I.band_actions(F.lit("Poor"))).alias("n"), F.size(I.band_risks(F.lit("Good"))).alias("k"),
                   I.who_ratio(F.lit(30.0), F.lit(0.0)).alias("z"), I.who_ratio(F.lit(31.0), F.lit(15.0)).alias("q"),
                   I.cigarettes_per_day(F.lit(150.0)).alias("s"), I.canonical_parameter(F.lit(" PM2.5 ")).alias("p"),
                   I.display_value(F.lit("co"), F.lit(1234.0), F.lit("µg/m³")).alias("d")).first()
    assert (r.c, r.a, r.n, r.k, r.z, r.q, r.s, r.p, r.d) == ("#999999", "", 3, 0, None, 2.1, 6.8, "pm25", 1.23)


def test_index_tie_and_unknown(spark):
    rows = [("a", "no2", 40.0, "µg/m³"), ("a", "pm25", 30.0, "µg/m³"), ("b", "nh3", 5.0, "µg/m³"), ("c", "pm10", None, None)]
    out = {r.k: r for r in R.index_of(spark.createDataFrame(rows, "k string, parameter string, value double, unit string"), ["k"]).collect()}
    assert (out["a"].aqi, out["a"].dominant, out["a"].category) == (50, "pm25", "Good")
    assert (out["b"].aqi, out["b"].category, out["b"].dominant, out["b"].color) == (0, "Unknown", "", "#999")
    assert out["c"].category == "Unknown"
    m = R.index_of(spark.createDataFrame(rows[:2], "k string, parameter string, value double, unit string"), ["k"])
    assert m.select(R.sub_index_map(m)).first()[0] == {"pm25": 50, "no2": 50}


def test_latest_skips_nulls_per_column(spark):
    rows = [("pm25", "s", 1.0, "a", "2024-01-01 00:00:00", 1), ("pm25", "s", None, "b", "2024-01-02 00:00:00", 2)]
    df = spark.createDataFrame(rows, "parameter string, location string, value double, unit string, t string, seq bigint")
    r = R.latest_per_key(df.withColumn("date_utc", F.col("t").cast("timestamp")).drop("t")).first()
    assert (r.value, r.unit, r.seq) == (1.0, "b", 2)


def test_local_time_variants(spark):
    r = spark.range(1).select(F.lit("2024-01-01 18:45:00").cast("timestamp").alias("t")).select(
        F.hour(N.local_time(F.col("t"))), N.rough_local_hour(F.col("t"))).first()
    assert tuple(r) == (0, 23)


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-1.0,)], "v double")
    assert [r[0] for r in df.select(N.clamp(F.col("v"), 0.0, 3.0)).collect()] == [None, 3.0, 0.0]


def test_means_do_not_depend_on_row_order(spark):
    values = [67.57, 0.82, 38.11]  # 106.5 = 3 * 35.5, but 35.49999999999999 if added in this order
    assert sum(values) / 3 < 35.5
    schema = "parameter string, value double, unit string, date_utc timestamp, location string, seq long"
    when = datetime.datetime(2024, 1, 1)
    for v in itertools.permutations(values):
        df = spark.createDataFrame([("pm10", x, "µg/m³", when, "a", i) for i, x in enumerate(v)], schema).coalesce(1)
        assert [r.pm10_si for r in R.station_index(df).collect()] == [36]
        assert [r.value for r in R.hourly_rollup(df).collect()] == [r.value for r in R.current_means(df).collect()] == [35.5]
    odd = spark.createDataFrame([("a", 1e12), ("a", 3e12), ("b", None), ("c", None), ("c", -2.0), ("d", float("nan")), ("d", 1.0)], "k string, v double")
    got = {r.k: r.m for r in odd.groupBy("k").agg(R.exact_mean("v").alias("m")).collect()}
    assert (got["a"], got["b"], got["c"]) == (2e12, None, -2.0) and got["d"] != got["d"]
