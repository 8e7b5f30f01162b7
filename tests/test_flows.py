import os

from pyspark.sql import functions as F

from airloom.functions import text as T
from airloom.plans import flows
from airloom.plans.source_queries import _sensed
from airloom.sources.tables import documents_as_pages, readings
from airloom.operators import timeseries as TS


def test_dashboard(spark, small):
    r = readings(spark, small)
    d = flows.dashboard(r, r.agg(F.max("date_utc")).scalar(), hours=72)
    assert d.city.first().aqi > 0 and d.hours.count() == 3 and 1 <= d.insights.count() <= 6
    keys = {x.key for x in d.snapshot.collect()}
    assert {"AQI", "AQI_category", "pm25", "pm25_unit", "cigarette_equivalent_per_day"} <= keys


def test_prompts_and_guard(spark, small):
    docs = documents_as_pages(spark, small).withColumns({
        "topic": T.topic(F.col("text")), "credibility_score": T.credibility(F.col("doc_name"), F.col("source_type"))})
    qs = spark.createDataFrame([(1, "explain the formula and the with ouen"), (2, "Sing a song")], "query_id bigint, text string")
    asked = flows.prompts(docs, qs)
    rows = {r.query_id: r for r in asked.collect()}
    assert len(rows[1].chunks) == 5 and "[Ref 5]" in rows[1].prompt and rows[2].intent == "general"
    answers = spark.createDataFrame([(1, "no citation"), (2, "[LLM down]")], "query_id bigint, answer string")
    out = {r.query_id: r for r in flows.guard(asked, answers).collect()}
    assert out[1].check.should_regenerate and out[1].retry_prompt.startswith("IMPORTANT") and out[2].is_error


def test_train(spark, tmp_path):
    hours = spark.range(24 * 60).select(
        F.lit("s").alias("station"), (F.lit("2022-11-20").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"),
        (100 + 40 * F.sin(F.col("id") / 4.0) + 10 * F.cos(F.col("id") / 37.0)).alias("aqi"))
    hours = hours.withColumn("pm25", F.col("aqi") / 2)
    out = flows.train(TS.densify(hours, ["station"]), ["station"], "2022-12-25", "2023-01-04", str(tmp_path / "m"),
                      recursive_points=20, depth=3, rounds=5)
    m = {r.model: r.mae for r in out["metrics"].collect()}
    assert set(m) == {"Persistence", "Trees_Global", "Trees_Regime"} and out["best"].first().model in m
    assert out["by_hour"].count() == 6 and os.path.isdir(tmp_path / "m" / "model")
    assert abs(out["importances"].agg(F.sum("percent")).first()[0] - 100) < 1e-6


def test_sensors_exist(spark, small):
    assert _sensed(spark, small).where("sensor_id IS NULL").count() == 0
