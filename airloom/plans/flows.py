"""End-to-end flows, composed from the operators."""
from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import prompts as PR, scoring as SC, text as T
from ..operators import forecast as FC, insights as INS, learning as L, readings as R, retrieval as RT
from ..operators import timeseries as TS
from ..operators.quantiles import winsorize
from ..session import cut_lineage


@dataclass
class Dashboard:
    concentrations: DataFrame
    city: DataFrame
    forecasts: DataFrame
    hours: DataFrame
    insights: DataFrame
    snapshot: DataFrame


def dashboard(readings: DataFrame, as_of: Column, hours: int = 24, max_insights: int = 6) -> Dashboard:
    """Refresh: recent readings to medians, index, forecast, insights and the chat snapshot."""
    recent = R.since(readings, as_of, hours)
    hourly, latest = R.hourly_rollup(recent), R.latest_per_key(readings)
    conc = R.city_concentrations(hourly, latest)
    city = R.index_of(conc, [])
    forecasts = FC.forecast_series(hourly)
    ahead = FC.forecast_index(forecasts)
    pm25 = conc.where("parameter = 'pm25'").select("value").scalar()
    moment = readings.sparkSession.range(1).select(as_of.alias("as_of"))
    insights = INS.ranked([
        INS.trend_alerts(hourly), INS.diurnal_notes(moment, []), INS.limit_comparison(conc),
        INS.emergency(city.withColumn("pm25", pm25)), INS.forecast_notes(ahead, city, forecasts),
        INS.station_spread(latest), INS.health_rules(city)], limit=max_insights)
    return Dashboard(conc, city, forecasts, ahead, insights, R.snapshot(conc, city))


def prompts(docs: DataFrame, questions: DataFrame, k: int = 5, cross_scores: DataFrame | None = None) -> DataFrame:
    """(query_id, intent, confidence, chunks, prompt) for a batch of questions.

    Questions that need no documents with a confidence over .5 skip retrieval; the others get up to their intent's
    ``top_k`` chunks (``k`` bounds what is fetched). ``docs``: doc_id, doc_name, text, topic, credibility_score.
    """
    q = questions.withColumn("i", T.intent(F.col("text")))
    q = q.select("*", T.intent_config(F.col("i.intent")).alias("cfg"))
    wanted = q.where(F.col("cfg.needs_rag") | (F.col("i.confidence") <= 0.5)).select("query_id", "text")
    found = RT.retrieve(docs, wanted, max(k, 7), cross_scores).join(q.select("query_id", "cfg.top_k"), "query_id").where(
        F.col("rank") <= F.col("top_k"))
    rows = found.join(docs.select("doc_id", "doc_name", "text"), "doc_id")
    chunk = F.struct("rank", "doc_id", "doc_name", "text", "topic", "final_score", "rerank_score", "credibility_score")
    chunks = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))  # at most seven each
    out = q.join(chunks, "query_id", "left")
    none = F.array().cast(chunks.schema["chunks"].dataType)
    out = out.withColumn("chunks", F.coalesce("chunks", none))
    prompt = PR.build_prompt(F.col("text"), F.col("chunks"), None, F.col("i.intent"), F.col("i.confidence"))
    return out.select("query_id", "text", F.col("i.intent").alias("intent"), F.col("i.confidence").alias("confidence"),
                      "chunks", prompt.alias("prompt"))


def guard(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Citation check and confidence of model answers (query_id, answer); adds the stricter prompt where the answer
    has to be made again. An answer that is an error text starts with ``[Groq``, ``[LLM`` or ``[API``."""
    rows = asked.join(answers, "query_id")
    n = F.size("chunks")
    rows = rows.withColumn("check", SC.answer_risk(F.col("answer"), n)).withColumns(
        SC.confidence_parts(F.col("answer"), F.col("text"), F.col("chunks")))
    score = SC.combine_confidence(F.col("source_quality"), F.col("citation_coverage"), F.col("relevance"),
                                  F.col("response_quality"), n, F.col("intent"))
    again = F.when(F.col("check.should_regenerate"), PR.regeneration_prompt(F.col("text"), F.col("chunks")))
    return rows.select("query_id", "answer", "check", score.alias("confidence_detail"), again.alias("retry_prompt"),
                       F.col("answer").rlike(r"^\[(Groq|LLM|API)").alias("is_error"))


def train(history: DataFrame, series: list[str], train_until: str = "2023-01-01", test_from: str = "2024-01-01",
          path: str | None = None, recursive_points: int = 150, **tree) -> dict[str, DataFrame]:
    """Gap-filled hourly history to fitted models: metrics per model, the best one, error by hour ahead, importances.

    ``history``: series, ts, aqi and any of the known columns, on a gap-free grid. With ``path`` the models and the
    tables are written there.
    """
    values = [c for c in history.columns if c not in [*series, "ts"]]
    filled = winsorize(TS.interpolate(history, series, values), series, "aqi")
    frame = TS.features(filled, series)
    names = TS.feature_columns(frame, series=series)
    # Every fit and every metric reads this table again, so it is written once.
    frame = cut_lineage(frame.dropna(subset=[*names, "aqi"]))
    parts = TS.split_by_year(frame, "ts", train_until, test_from)
    inputs = [c for c in L.PROFILE if c.rsplit("_", 1)[0] in frame.columns]
    means = tuple(c for c in ("pm25", "pm10", "temperature", "humidity", "wind_speed") if c in frame.columns)
    regimes = L.fit_regimes(TS.daily_profile(parts[0], series, means=means), inputs)
    tr, va, te = (
        cut_lineage(L.assign_regimes(
            p, L.daily_regimes(TS.daily_profile(p, series, means=means), regimes, series), series))
        for p in parts)
    whole = L.fit_trees(tr, va, names, **tree)
    by_regime = L.fit_by_regime(tr, va, names, whole, **tree)
    scored = {
        "Persistence": te.withColumn("prediction", F.col("aqi_lag1")), "Trees_Global": whole.transform(te),
        "Trees_Regime": L.predict_by_regime(te, by_regime, whole)}
    one = None
    for name, df in scored.items():
        m = L.regression_metrics(df, "aqi", "prediction").withColumn("model", F.lit(name))
        one = m if one is None else one.unionByName(m)
    spark = history.sparkSession
    importances = spark.createDataFrame(L.tree_importances(whole, names), "feature string, importance double")
    out = {
        "metrics": one, "best": L.best_model(one.where("model <> 'Persistence'")),
        "by_hour": L.evaluate_recursive(te, whole, names, series, points=recursive_points),
        "importances": L.importance_ranking(importances),
        "features": spark.createDataFrame([(n,) for n in names], "feature string")}
    if path:
        whole.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([asdict(regimes)]).write.mode("overwrite").json(f"{path}/regimes")
        for r, m in by_regime.items():
            m.write().overwrite().save(f"{path}/regime_models/{r}")
        for name, df in out.items():
            df.write.mode("overwrite").json(f"{path}/{name}")
    return out
