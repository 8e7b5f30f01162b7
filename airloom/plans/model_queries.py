"""Queries that fit models: regimes, boosted trees, attributions, recursive forecasts, ARIMA."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import arima, boosting, learning as L, shapley
from ..operators import timeseries as TS
from ..session import cut_lineage
from ..sources.tables import table
from .catalog import near, query
from .index_queries import hourly

SERIES = ["parameter"]
TRAIN_UNTIL, TEST_FROM = "2024-01-20", "2024-01-25"


# --- Regimes --------------------------------------------------------------------------------

def _order_profile(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderpriority", F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"))
    return TS.daily_profile(o, ["o_orderpriority"], "ts", "price", ())


PROFILE = ["price_mean", "price_std", "price_max", "price_min", "price_range"]


@query("ml_regimes")
def ml_regimes(spark, sf):
    """Daily price profiles in three regimes (the best of ten starts), numbered by rising mean."""
    p = _order_profile(spark, sf)
    model = L.fit_regimes(p, PROFILE)
    daily = L.daily_regimes(p, model, ["o_orderpriority"], "price_mean")
    return daily.join(p, ["o_orderpriority", "ts"]).groupBy("regime").agg(
        F.count(F.lit(1)).alias("days"), near(F.avg("price_mean"), 2).alias("mean"))


# --- Trees ----------------------------------------------------------------------------------

def _model_frame(spark, sf) -> DataFrame:
    g = hourly(spark, sf).select("parameter", F.col("date_utc").alias("ts"), F.col("value").alias("aqi"))
    g = TS.interpolate(TS.densify(g, SERIES), SERIES, ["aqi"])
    return cut_lineage(TS.features(g, SERIES, lagged_delta=True).dropna(subset=["aqi", "aqi_lag1"]))


def _features(frame: DataFrame) -> list[str]:
    return TS.feature_columns(frame, series=SERIES)


def _split(frame: DataFrame):
    return TS.split_by_year(frame, "ts", TRAIN_UNTIL, TEST_FROM)


#: Larger steps and fewer trees than the operator's defaults: a tree is a handful of jobs whatever the data's size.
BY_DEPTH = boosting.Settings(rounds=40, step=0.2, depth=4, stop=8)
BY_LEAVES = boosting.Settings(rounds=40, step=0.2, depth=6, leaves=12, every=5, min_rows=20, metric="mae", stop=8)


def _by_regime(spark, sf):
    """Frame with the regime of each hour: three regimes of daily profiles, fitted on the training days."""
    f = _model_frame(spark, sf)
    inputs = [f"aqi_{x}" for x in ("mean", "std", "max", "min", "range")]
    model = L.fit_regimes(TS.daily_profile(_split(f)[0], SERIES, means=()), inputs)
    return cut_lineage(L.assign_regimes(f, L.daily_regimes(TS.daily_profile(f, SERIES, means=()), model, SERIES), SERIES))


@query("ml_model_comparison")
def ml_model_comparison(spark, sf):
    """Persistence, trees limited by depth, trees limited by leaves, and ARIMA on the last days, per parameter."""
    f = _model_frame(spark, sf)
    names, (train, val, test) = _features(f), _split(f)
    scored = {"persistence": test.withColumn("prediction", F.col("aqi_lag1"))}
    for name, settings in (("by_depth", BY_DEPTH), ("by_leaves", BY_LEAVES)):
        scored[name] = boosting.fit(train, val, names, "aqi", settings).transform(test)
    out = None
    for name, df in scored.items():
        m = L.regression_metrics(df, "aqi", "prediction", SERIES).withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out.select("parameter", "model", *[near(c, 3).alias(c) for c in ("mae", "rmse", "r2", "spike_mae")], "rows")


@query("ml_regime_router")
def ml_regime_router(spark, sf):
    """One model per fitted regime with the global model behind it; metrics of the routed predictions."""
    f = _by_regime(spark, sf)
    names, (train, val, test) = _features(f), _split(f)
    fit = lambda tr, va, features, target: boosting.fit(tr, va, features, target, BY_DEPTH)
    whole = fit(train, val, names, "aqi")
    models = L.fit_by_regime(train, val, names, whole, fit=fit)
    routed = L.predict_by_regime(test, models, whole).withColumnRenamed("prediction", "p")
    out = L.regression_metrics(routed, "aqi", "p", ["regime"])
    return out.select("regime", near("mae", 3).alias("mae"), near("rmse", 3).alias("rmse"), "rows")


@query("fc_recursive_metrics")
def fc_recursive_metrics(spark, sf):
    """Error of the recursive forecast by hour ahead, from evenly spaced origins of every series."""
    f = _model_frame(spark, sf)
    names, (train, val, _) = _features(f), _split(f)
    model = boosting.fit(train, val, names, "aqi", BY_DEPTH)
    m = L.evaluate_recursive(f, model, names, SERIES, horizon=6)
    return m.select("hour_offset", near("mae", 3).alias("mae"), near("rmse", 3).alias("rmse"), "rows")


@query("ml_shap_importance")
def ml_shap_importance(spark, sf):
    """The fifteen features of greatest mean absolute Shapley value over 500 test rows, with their class."""
    f = _model_frame(spark, sf)
    names, (train, val, test) = _features(f), _split(f)
    model = boosting.fit(train, val, names, "aqi", BY_DEPTH)
    ranked = L.importance_ranking(shapley.shapley_importance(test, model))
    return ranked.where("rank <= 15").select("rank", "feature", near("importance", 4).alias("importance"), near("percent", 3).alias("percent"))


@query("ml_shap_rows")
def ml_shap_rows(spark, sf):
    """Of every test hour the prediction, what its Shapley values and the base add up to, and the strongest feature."""
    f = _model_frame(spark, sf)
    names, (train, val, test) = _features(f), _split(f)
    model = boosting.fit(train, val, names, "aqi", BY_DEPTH)
    rows = shapley.explain(model.transform(test), model)
    total = F.aggregate("contributions", F.lit(shapley.base_value(model)), lambda a, v: a + v)
    size = F.transform("contributions", lambda v: F.abs(v))
    top = F.array(*[F.lit(n) for n in names])[F.array_position(size, F.array_max(size)).cast("int") - 1]
    return rows.select("parameter", "ts", near("prediction", 4).alias("prediction"), near(total, 4).alias("explained"), top.alias("strongest"))


# --- ARIMA ----------------------------------------------------------------------------------

@query("ml_arima_metrics")
def ml_arima_metrics(spark, sf):
    """ARIMA(2,1,2) per parameter, fitted up to the test days, forecast over them (720 hours at most)."""
    g = hourly(spark, sf).select("parameter", F.col("date_utc").alias("ts"), F.col("value").alias("aqi"))
    before = F.lit(TEST_FROM).cast("timestamp")
    made = arima.forecast(arima.fit(g.where(F.col("ts") < before), SERIES, "aqi"), SERIES, 720)
    met = made.join(g.where(F.col("ts") >= before), [*SERIES, "ts"])
    m = L.regression_metrics(met, "aqi", "prediction", SERIES)
    return m.select("parameter", *[near(c, 3).alias(c) for c in ("mae", "rmse", "r2")], "rows")
