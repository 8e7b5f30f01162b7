"""Boosted trees, Shapley values, k-means and ARIMA against plain statements."""
import itertools
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from airloom.operators import arima as A, boosting as B, kmeans as KM, learning as L, shapley as S


def table(spark, rows, seed=1, missing=0.1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(rows, 4)), 2)
    x[:, 3] = rng.integers(0, 3, rows)
    y = np.round(np.where(x[:, 0] > 0, 3 * x[:, 1], -x[:, 2]) + x[:, 3] + 0.1 * rng.normal(size=rows), 3)
    x[rng.random(x.shape) < missing] = np.nan
    cells = [[None if np.isnan(v) else float(v) for v in r] + [float(t)] for r, t in zip(x, y)]
    return spark.createDataFrame(cells, "a double, b double, c double, d double, y double"), x, y


def plain_boost(x, y, edges, s: B.Settings):
    """Trees by recursion over row sets; best leaf first where leaves are limited."""
    codes = B.binned(x, [np.array(e) for e in edges])
    out = np.full(len(y), y.mean())
    shrink = lambda g: np.sign(g) * max(abs(g) - s.l1, 0)
    worth = lambda g, h: shrink(g) ** 2 / (h + s.l2)

    def split(rows, g):
        best = None
        for f in range(x.shape[1]):
            for cut in range(1, s.bins):
                for missing_left in (True, False):
                    left = np.array([(missing_left if codes[r, f] == 0 else codes[r, f] <= cut) for r in rows])
                    a, b = rows[left], rows[~left]
                    if min(len(a), len(b)) < max(s.min_rows, 1):
                        continue
                    gain = worth(g[a].sum(), len(a)) + worth(g[b].sum(), len(b)) - worth(g[rows].sum(), len(rows))
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, a, b
        return best

    for _ in range(s.rounds):
        g = out - y
        leaves = [(np.arange(len(y)), 0)]
        found = {0: split(leaves[0][0], g)}
        while s.leaves is None or len(leaves) < s.leaves:
            able = [(found[i][0], -i, i) for i, (rows, depth) in enumerate(leaves) if depth < s.depth and found[i]]
            if not able:
                break
            i = max(able)[2]
            depth = leaves[i][1] + 1
            _, a, b = found[i]
            leaves[i] = (a, depth)
            leaves.append((b, depth))
            found[i], found[len(leaves) - 1] = split(a, g), split(b, g)
        after = out.copy()
        for rows, _ in leaves:
            after[rows] += -shrink(g[rows].sum()) / (len(rows) + s.l2) * s.step
        out = after
    return out


@pytest.mark.parametrize("s", [
    B.Settings(rounds=3, step=0.5, depth=3, rows=1.0, columns=1.0, bins=8, stop=99),
    B.Settings(rounds=2, step=0.5, depth=9, leaves=6, rows=1.0, columns=1.0, bins=8, min_rows=7, l1=1.0, l2=2.0, stop=99)])
def test_trees_against_recursion(spark, s):
    df, x, y = table(spark, 200)
    model = B.fit(df, None, ["a", "b", "c", "d"], "y", s)
    assert np.allclose(model.predict_values(x), plain_boost(x, y, model.edges, s), atol=1e-5)
    assert all(sum(1 for f in t.feature if f < 0) <= (s.leaves or 2 ** s.depth) for t in model.trees)
    got = sorted(r.prediction for r in model.transform(df).collect())
    assert np.allclose(got, sorted(model.predict_values(x)))
    again = B.fit(df.repartition(7), None, ["a", "b", "c", "d"], "y", s)
    assert again.to_json() == model.to_json()  # however the rows are spread
    assert B.BoostedTrees.from_json(model.to_json()) == model


def test_boosting_stops_and_draws(spark):
    df, x, y = table(spark, 600, seed=3)
    val, xv, yv = table(spark, 200, seed=4)
    s = B.Settings(rounds=60, step=0.3, depth=3, bins=16, stop=5)
    model = B.fit(df, val, ["a", "b", "c", "d"], "y", s)
    assert 0 < len(model.trees) <= s.rounds and len(model.history) <= len(model.trees) + s.stop + 1
    rmse = lambda m: float(np.sqrt(np.mean((m.predict_values(xv) - yv) ** 2)))
    assert abs(min(model.history) - rmse(model)) < 1e-4 and rmse(model) < 0.7 * np.std(yv)
    assert B.fit(df.limit(0), None, ["a"], "y", s).predict_values(np.array([[1.0]])).tolist() == [0.0]
    constant = B.fit(df.withColumn("y", F.lit(2.0)), None, ["a"], "y", B.Settings(rounds=2))
    assert constant.predict_values(np.array([[1.0], [np.nan]])).tolist() == [2.0, 2.0]
    by_leaves = B.fit(df, val, ["a", "b", "c", "d"], "y", B.Settings(rounds=30, step=0.3, depth=12, leaves=8, every=5, min_rows=20, metric="mae", bins=16, stop=5))
    mae = float(np.mean(np.abs(by_leaves.predict_values(xv) - yv)))
    assert abs(min(by_leaves.history) - mae) < 1e-4


def subset_values(model, code):
    """Shapley values from every subset of the features."""
    n = len(model.features)

    def value(known):
        def walk(tree, node):
            f = tree.feature[node]
            if f < 0:
                return tree.value[node]
            if f in known:
                goes = tree.missing_left[node] if code[f] == 0 else code[f] <= tree.cut[node]
                return walk(tree, tree.left[node] if goes else tree.right[node])
            l, r = tree.left[node], tree.right[node]
            return (tree.cover[l] * walk(tree, l) + tree.cover[r] * walk(tree, r)) / tree.cover[node]
        return sum(walk(t, 0) for t in model.trees)

    out = np.zeros(n)
    for i in range(n):
        for k in range(n):
            for sub in itertools.combinations([j for j in range(n) if j != i], k):
                out[i] += factorial(k) * factorial(n - 1 - k) / factorial(n) * (value({*sub, i}) - value(set(sub)))
    return out


def test_shapley_values(spark):
    df, x, y = table(spark, 300, seed=5)
    model = B.fit(df, None, ["a", "b", "c", "d"], "y", B.Settings(rounds=4, step=0.5, depth=4, bins=8, rows=0.8, stop=99))
    codes = B.binned(x, [np.array(e) for e in model.edges])
    got = S.contributions(model, codes)
    assert np.allclose(got.sum(1) + S.base_value(model), model.predict(codes), atol=1e-9)
    for i in range(0, 300, 23):
        assert np.allclose(got[i], subset_values(model, codes[i]), atol=1e-9)
    rows = S.explain(df, model).withColumn("p", F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v))
    assert np.allclose(sorted(r.p + S.base_value(model) for r in rows.collect()), sorted(model.predict(codes)))


def test_seeded_sample(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("x"))
    one, two = S.seeded_sample(df, 100), S.seeded_sample(df.repartition(13), 100)
    ids = sorted(r.id for r in one.collect())
    assert len(ids) == 100 and ids == sorted(r.id for r in two.collect())
    assert ids != sorted(r.id for r in S.seeded_sample(df, 100, seed=7).collect()) and S.seeded_sample(df, 9999).count() == 5000
    assert 2000 < np.mean(ids) < 3000


def test_shapley_importance(spark):
    df, x, y = table(spark, 400, seed=6)
    model = B.fit(df, None, ["a", "b", "c", "d"], "y", B.Settings(rounds=5, step=0.5, depth=3, bins=8, stop=99))
    got = {r.feature: r.importance for r in S.shapley_importance(df, model, rows=1000).collect()}
    want = np.abs(S.contributions(model, B.binned(x, [np.array(e) for e in model.edges]))).mean(0)
    assert np.allclose([got[f] for f in "abcd"], want)


def test_best_of_ten_starts(spark):
    rng = np.random.default_rng(7)
    centres = np.array([[0, 0], [0, 5], [5, 0], [5, 5], [20, 20], [21, 26]])
    x = centres[rng.integers(0, 6, 600)] + rng.normal(size=(600, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(9999, None, 1.0)], "id int, a double, b double")
    model = KM.fit(df, ["a", "b"], k=6, starts=10)
    assert model.inertia == min(model.inertias) and len(set(np.round(model.inertias, 3))) > 1
    z = (x - x.mean(0)) / x.std(0)
    c = np.array(model.centres)
    d = ((z[:, None] - c[None]) ** 2).sum(2)
    assert abs(d.min(1).sum() - model.inertia) < 1e-6
    assert np.allclose(c, [z[d.argmin(1) == i].mean(0) for i in range(6)], atol=1e-3)  # Lloyd has come to rest
    got = {r.id: r.n for r in df.select("id", model.nearest().alias("n")).collect()}
    assert got.pop(9999) is None and got == dict(enumerate(d.argmin(1).tolist()))
    ranks = model.by_level("a")
    assert sorted(range(6), key=lambda i: c[i][0]) == [ranks.index(i) for i in range(6)]
    few = KM.fit(df.where("id < 2"), ["a", "b"], k=3)
    assert abs(few.inertia) < 1e-9


def plain_arima(y, p=2, q=2, long=12):
    d = np.diff(y)
    fit = lambda rows, target: np.linalg.lstsq(np.array(rows), np.array(target), rcond=None)[0]
    a = fit([[1, *d[t - long:t][::-1]] for t in range(long, len(d))], d[long:])
    e = {t: d[t] - np.dot(a, [1, *d[t - long:t][::-1]]) for t in range(long, len(d))}
    at = range(long + q, len(d))
    row = lambda t: [1, *d[t - p:t][::-1], *[e[t - i] for i in range(1, q + 1)]]
    b = fit([row(t) for t in at], [d[t] for t in at])
    u = {t: d[t] - np.dot(b, row(t)) for t in at}
    return b, list(d[-p:][::-1]), [u[len(d) - 1 - i] for i in range(q)], y[-1]


def test_arima(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for name in ("x", "y"):
        noise = rng.normal(size=400)
        d = np.zeros(400)
        for t in range(2, 400):
            d[t] = 0.1 + 0.5 * d[t - 1] - 0.2 * d[t - 2] + noise[t] + 0.4 * noise[t - 1]
        y = 100 + np.cumsum(d)
        rows += [(name, t, float(v)) for t, v in enumerate(y)]
        b, last, u, now = plain_arima(y)
        ahead = []
        for _ in range(5):
            step = b[0] + b[1] * last[0] + b[2] * last[1] + b[3] * u[0] + b[4] * u[1]
            last, u, now = [step, last[0]], [0.0, u[0]], now + step
            ahead.append(now)
        want[name] = b, ahead
    rows += [("short", 0, 1.0), ("short", 1, 2.0), ("short", 2, None)]
    df = spark.createDataFrame(rows, "s string, t int, v double").withColumn("ts", F.timestamp_seconds(F.col("t") * 3600))
    fitted = A.fit(df, ["s"], "v")
    got = {r.s: r for r in fitted.collect()}
    for name, (b, _) in want.items():
        assert np.allclose(got[name].coefficients, b, atol=1e-6)
    ahead = A.forecast(fitted, ["s"], 5).orderBy("ts").collect()
    for name, (_, values) in want.items():
        assert np.allclose([r.prediction for r in ahead if r.s == name], values, atol=1e-6)
    assert [r.prediction for r in ahead if r.s == "short"] == [2.0] * 5
    assert min(r.ts for r in ahead if r.s == "x").hour == 400 % 24
    windowed = {r.s: r for r in A.fit(df, ["s"], "v", last=100).collect()}
    y = np.array([v for n, t, v in rows if n == "x"])[-100:]
    assert np.allclose(windowed["x"].coefficients, plain_arima(y)[0], atol=1e-6)


def test_rows_without_a_model_stay(spark):
    df, x, y = table(spark, 60, seed=9)
    s = B.Settings(rounds=2, depth=2, bins=4, stop=99)
    one = B.fit(df, None, ["a", "b"], "y", s)
    two = B.fit(df.where("a > 0"), None, ["a", "b"], "y", s)
    rows = df.withColumn("regime", F.when(F.col("d") < 2, F.col("d").cast("int")))
    alone = L.predict_by_regime(rows, {0: two})
    assert alone.count() == 60 and alone.where("regime = 0 and prediction is null").count() == 0
    assert alone.where("(regime <> 0 or regime is null) and prediction is not null").count() == 0
    routed = L.predict_by_regime(rows, {0: two}, one)
    assert routed.count() == 60 and routed.where("prediction is null").count() == 0


def test_importance_of_a_model_without_trees(spark):
    none = spark.createDataFrame([("aqi_lag1", 0.0), ("hour_sin", 0.0)], "feature string, importance double")
    assert [(r["rank"], r.feature, r.percent) for r in L.importance_ranking(none).orderBy("rank").collect()] == [(1, "aqi_lag1", None), (2, "hour_sin", None)]
    assert {r.percent for r in L.importance_classes(none).collect()} == {None}
    some = none.withColumn("importance", F.when(F.col("feature") == "hour_sin", 3.0).otherwise(1.0))
    assert [r.percent for r in L.importance_ranking(some).orderBy("rank").collect()] == [75.0, 25.0]
