"""Regimes, boosted trees, metrics and the recursive forecast."""
from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions import numeric as N
from ..session import cut_lineage
from . import kmeans, timeseries as TS
from .kmeans import KMeansModel
from .bounds import broadcast_if_small
from .quantiles import exact_quantiles

PROFILE = ["aqi_mean", "aqi_std", "aqi_max", "aqi_min", "pm25_mean", "pm10_mean", "temperature_mean", "humidity_mean",
           "wind_speed_mean", "aqi_range"]


# --- Metrics ------------------------------------------------------------------------------

def regression_metrics(df: DataFrame, truth: str = "y", prediction: str = "p", keys: list[str] = (),
                       min_spikes: int = 10) -> DataFrame:
    """MAE, RMSE, R² and the MAE of the top tenth of true values (NULL unless it has more than ``min_spikes`` rows)."""
    keys = list(keys)
    rows = df.where(F.col(truth).isNotNull() & F.col(prediction).isNotNull())
    if not keys:
        return regression_metrics(rows.withColumn("_all", F.lit(1)), truth, prediction, ["_all"], min_spikes).drop("_all")
    limit = exact_quantiles(rows, keys, truth, {"_p90": 0.9})
    err = F.col(truth) - F.col(prediction)
    spike = F.col(truth) >= F.col("_p90")
    out = rows.join(broadcast_if_small(limit), keys).groupBy(*keys).agg(
        F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("_mse"), F.var_pop(truth).alias("_var"),
        F.count_if(spike).alias("_n"), F.avg(F.when(spike, F.abs(err))).alias("_spike"),
        F.count(F.lit(1)).alias("rows"))
    return out.select(
        *keys, "mae", F.sqrt("_mse").alias("rmse"), (1.0 - F.try_divide("_mse", "_var")).alias("r2"),
        F.when(F.col("_n") > min_spikes, F.col("_spike")).alias("spike_mae"), "rows")


def persistence_metrics(features: DataFrame, keys: list[str] = (), target: str = "aqi") -> DataFrame:
    """The naive forecast: the value of the hour before."""
    return regression_metrics(features, target, f"{target}_lag1", keys)


def best_model(results: DataFrame) -> DataFrame:
    """Name of the lowest error; the first by name wins a tie."""
    return results.agg(F.min(F.struct("mae", "model")).alias("b")).select("b.model", "b.mae")


def _percent() -> Column:
    return F.try_divide("importance", F.sum("importance").over(W.partitionBy())) * 100.0


def importance_ranking(importances: DataFrame) -> DataFrame:
    """(feature, importance, percent, rank) of a feature-sized table. No share is known (NULL) where all importances are 0,
    as of a model that stopped before its first tree."""
    return importances.select(
        "feature", "importance", _percent().alias("percent"),
        F.row_number().over(W.orderBy(F.col("importance").desc(), "feature")).alias("rank"))


def importance_classes(importances: DataFrame) -> DataFrame:
    """Importance by feature class with its share of the total."""
    name, chain = F.col("feature"), None
    for label, prefixes in K.IMPORTANCE_CLASSES:
        hit = reduce(lambda a, b: a | b, [name.startswith(p) for p in prefixes])
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    sums = importances.withColumn("class", chain.otherwise(K.IMPORTANCE_OTHER)).groupBy("class").agg(
        F.sum("importance").alias("importance"))
    return sums.withColumn("percent", _percent())


def mean_absolute(contributions: DataFrame, columns: list[str]) -> DataFrame:
    """Mean absolute contribution per feature column, as (feature, importance)."""
    one = contributions.agg(*[F.avg(F.abs(F.col(c))).alias(c) for c in columns])
    return one.unpivot([], columns, "feature", "importance")


# --- Regimes ------------------------------------------------------------------------------

def fit_regimes(profile: DataFrame, inputs: list[str] = PROFILE, k: int = 3, seed: int = 42, starts: int = 10) -> KMeansModel:
    """The best of ``starts`` clusterings of the daily profiles."""
    return kmeans.fit(profile, inputs, k, starts, seed)


def daily_regimes(profile: DataFrame, model: KMeansModel, series: list[str], level: str = "aqi_mean") -> DataFrame:
    """Regime of each day, numbered by rising level of the cluster centre (cluster numbers are arbitrary)."""
    ranks = F.array(*[F.lit(r) for r in model.by_level(level)])
    days = profile.withColumn("_cluster", model.nearest()).where(F.col("_cluster").isNotNull())
    return days.select(*series, "ts", ranks[F.col("_cluster")].alias("regime"))


def assign_regimes(hourly: DataFrame, daily: DataFrame, series: list[str]) -> DataFrame:
    """Regime of the last profiled day at or before each hour; 0 before the first."""
    return TS.as_of(hourly, daily, series, "regime", default=0)


# --- Trees --------------------------------------------------------------------------------

def fit_trees(train: DataFrame, val: DataFrame, features: list[str], target: str = "aqi", depth: int = 5,
              rounds: int = 50, step: float = 0.1, seed: int = 42) -> PipelineModel:
    """Boosted trees with early stopping on the validation rows."""
    from pyspark.ml import Pipeline

    both = train.withColumn("_val", F.lit(False)).unionByName(val.withColumn("_val", F.lit(True)))
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"),
        GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="prediction", maxDepth=depth, maxIter=rounds,
                     stepSize=step, subsamplingRate=0.8, seed=seed, validationIndicatorCol="_val"),
    ]).fit(both)


def tree_importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Impurity importance, highest first (Shapley values: ``shapley``)."""
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))


def fit_by_regime(train: DataFrame, val: DataFrame, features: list[str], fallback, regimes: int = 3,
                  target: str = "aqi", min_train: int = 100, min_val: int = 20, fit=None, **kw) -> dict:
    """One model per regime; too few rows fall back to the global model. ``fit`` is called as ``fit_trees`` is, which it
    is if none is given."""
    fit = fit or fit_trees
    sizes = {
        name: {r["regime"]: r["count"] for r in df.groupBy("regime").count().collect()}  # one row per regime
        for name, df in (("train", train), ("val", val))
    }
    out = {}
    for r in range(regimes):
        enough = sizes["train"].get(r, 0) >= min_train and sizes["val"].get(r, 0) >= min_val
        mine = F.col("regime") == r
        out[r] = fit(train.where(mine), val.where(mine), features, target, **kw) if enough else fallback
    return out


def predict_by_regime(df: DataFrame, models: dict[int, PipelineModel], fallback=None) -> DataFrame:
    """Every row with the prediction of its regime's model. Rows whose regime is NULL or has no model take the one of
    ``fallback`` (the global model), or NULL without one."""
    parts = [m.transform(df.where(F.col("regime") == r)).drop("_x") for r, m in models.items()]
    rest = df.where(F.col("regime").isNull() | ~F.col("regime").isin(list(models)))
    parts.append(fallback.transform(rest).drop("_x") if fallback is not None else rest.withColumn("prediction", F.lit(None).cast("double")))
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- Recursive forecast -------------------------------------------------------------------

def forecast_origins(features: DataFrame, series: list[str], target: str = "aqi", history: int = 168) -> DataFrame:
    """Adds ``_hist``: the target of the last ``history`` hours up to each row, newest last."""
    w = TS.by_time(series).rowsBetween(-(history - 1), 0)
    return features.withColumn("_hist", F.collect_list(F.coalesce(F.col(target), F.lit(float("nan")))).over(w))


def every_nth(df: DataFrame, series: list[str], points: int = 200, start: int = 168, horizon: int = 6) -> DataFrame:
    """Evenly spaced forecast origins per series (``step`` = range / points, so it may overshoot)."""
    w = TS.by_time(series)
    sized = df.withColumn("_rn", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*series)))
    wanted = F.when(F.col("_n") < horizon + start + points, F.greatest(F.lit(50), F.col("_n") - horizon - start)).otherwise(points)
    step = F.greatest(F.lit(1), F.floor((F.col("_n") - horizon - start) / wanted))
    keep = (F.col("_rn") >= start) & (F.col("_rn") < F.col("_n") - horizon) & (F.pmod(F.col("_rn") - start, step) == 0)
    return sized.where(keep).drop("_rn", "_n")


def recursive_forecast(origins: DataFrame, model: PipelineModel, features: list[str], series: list[str],
                       target: str = "aqi", horizon: int = 6, refresh: bool = False) -> DataFrame:
    """(series, ts, hour_offset, prediction) for all origins at once, one model pass (and checkpoint) per hour ahead.

    After each step the target, its lags, rolling statistics, the one-hour change and the calendar move on; the other
    changes, pollutant lags and weather stay as at the origin unless ``refresh`` recomputes the longer changes too.
    """
    row = origins.fillna(0.0, subset=[c for c in features if c in origins.columns])
    state = row.withColumn("_t0", F.col("ts")).withColumn("_cur", F.col(target))
    steps = []
    for h in range(1, horizon + 1):
        state = model.transform(state).drop("_x").withColumn("_p", F.greatest(F.col("prediction"), F.lit(0.0))).drop("prediction")
        steps.append(F.struct(F.lit(h).alias("hour_offset"), F.col(f"_p{h}").alias("prediction")))
        state = state.withColumn(f"_p{h}", F.col("_p"))
        if h < horizon:
            state = cut_lineage(_advance(state, target, h, refresh))  # else the plan of each hour holds those before it
    out = state.select(*series, F.col("_t0").alias("ts"), F.explode_outer(F.array(*steps)).alias("_step"))
    return out.select(*series, "ts", "_step.hour_offset", "_step.prediction")


def _advance(state: DataFrame, target: str, h: int, refresh: bool) -> DataFrame:
    hist, p = F.col("_hist"), F.col("_p")
    size = F.size(hist)
    known = lambda x: F.when(~F.isnan(x), x)
    cols = {}
    for lag in K.LAG_HOURS:
        name = f"{target}_lag{lag}"
        if name in state.columns:
            old = known(F.try_element_at(hist, F.lit(-lag)))
            cols[name] = F.when(size >= lag, F.coalesce(old, F.lit(0.0))).otherwise(F.col(name))
    for w in K.ROLL_HOURS:
        if f"{target}_rmean{w}" not in state.columns:
            continue
        recent = F.filter(F.slice(hist, F.greatest(size - w + 1, F.lit(1)), F.lit(w)), lambda x: ~F.isnan(x))
        n = F.size(recent)
        mean = F.try_divide(F.aggregate(recent, F.lit(0.0), lambda a, x: a + x), n)
        squares = F.aggregate(F.transform(recent, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
        cols[f"{target}_rmean{w}"] = F.coalesce(mean, F.lit(0.0))
        cols[f"{target}_rstd{w}"] = F.when(n > 1, F.sqrt(squares / (n - 1))).otherwise(0.0)
    if f"{target}_delta1" in state.columns:
        cols[f"{target}_delta1"] = p - F.coalesce(F.col("_cur"), F.lit(0.0))
    if refresh:
        for k in (3, 6):
            cols[f"{target}_delta{k}"] = p - F.coalesce(known(F.try_element_at(hist, F.lit(-k))), p)
    ts = F.timestamp_micros(F.unix_micros("_t0") + h * 3_600_000_000)
    cal = N.calendar(ts)
    cols.update({c: v for c, v in cal.items() if c in state.columns})
    cols["_hist"] = F.slice(F.concat(hist, F.array(p)), F.greatest(size + 1 - 168 + 1, F.lit(1)), F.lit(168))
    cols["_cur"] = p
    return state.withColumns(cols)


def evaluate_recursive(features_df: DataFrame, model: PipelineModel, features: list[str], series: list[str],
                       target: str = "aqi", horizon: int = 6, points: int = 200) -> DataFrame:
    """Metrics per hour ahead over evenly spaced origins."""
    origins = every_nth(forecast_origins(features_df, series, target), series, points, horizon=horizon)
    made = recursive_forecast(origins, model, features, series, target, horizon)
    made = made.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + F.col("hour_offset").cast("bigint") * 3_600_000_000))
    truth = features_df.select(*series, "ts", F.col(target).alias("y"))
    rows = made.join(truth, [*series, "ts"]).withColumnRenamed("prediction", "p")
    return regression_metrics(rows, "y", "p", ["hour_offset"])
