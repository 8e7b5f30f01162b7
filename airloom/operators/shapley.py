"""Shapley values of boosted trees, with the trees' own row counts for what is not known.

A leaf counts for a row with the product, over the features of its path, of 1 or 0 (the row's value leads there or not)
for known features and of the share of rows that go that way for the others. A feature's value is its mean marginal
contribution over all orders of the features, taken leaf by leaf; only the sizes of the sets matter, so that a polynomial
of the path's other features stands for all of them. The values of a row and the base add up to its prediction.
"""
from __future__ import annotations

from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .boosting import BoostedTrees, Tree, as_matrix, binned, feature_array


def leaf_paths(tree: Tree) -> list[tuple[float, dict[int, tuple[float, list[tuple[int, bool, bool]]]]]]:
    """Per leaf its value and, by feature, the share of rows that its splits let through and the splits (cut, missing goes
    left, the path goes left)."""
    out, stack = [], [(0, {})]
    while stack:
        node, path = stack.pop()
        f = tree.feature[node]
        if f < 0:
            out.append((tree.value[node], path))
            continue
        for child, left in ((tree.left[node], True), (tree.right[node], False)):
            share = tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.0
            before, rules = path.get(f, (1.0, []))
            stack.append((child, path | {f: (before * share, rules + [(tree.cut[node], tree.missing_left[node], left)])}))
    return out


def expected(tree: Tree) -> float:
    """The mean over the rows that the tree has seen."""
    return sum(value * np.prod([share for share, _ in path.values()]) for value, path in leaf_paths(tree))


def base_value(model: BoostedTrees) -> float:
    return model.base + sum(expected(t) for t in model.trees)


def contributions(model: BoostedTrees, codes: np.ndarray) -> np.ndarray:
    """rows x features Shapley values of binned rows."""
    out = np.zeros((len(codes), len(model.features)))
    for tree in model.trees:
        for value, path in leaf_paths(tree):
            if not path or value == 0.0:
                continue
            d = len(path)
            names = list(path)
            share = [path[f][0] for f in names]
            leads = []
            for f in names:
                ok = np.ones(len(codes))
                for cut, missing_left, left in path[f][1]:
                    goes = np.where(codes[:, f] == 0, missing_left, codes[:, f] <= cut)
                    ok *= goes == left
                leads.append(ok)
            weight = [factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)]
            for i, f in enumerate(names):
                # by[k]: sum over sets of k of the other features, each known, of what the leaf counts
                by = [np.ones(len(codes))]
                for j in range(d):
                    if j != i:
                        known, unknown = [leads[j] * b for b in by], [share[j] * b for b in by]
                        by = [unknown[0], *(known[k - 1] + unknown[k] for k in range(1, len(by))), known[-1]]
                out[:, f] += value * (leads[i] - share[i]) * sum(w * b for w, b in zip(weight, by))
    return out


def seeded_sample(df: DataFrame, rows: int = 500, seed: int = 42) -> DataFrame:
    """At most ``rows`` rows drawn by a hash of their columns and the seed, the same ones however the table is spread. Each
    task sends at most ``rows`` rows; nothing is sorted as a whole. Equal rows are drawn together."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*kept, F.xxhash64(F.lit(seed), F.struct(*kept)).alias("_draw")).orderBy("_draw", *kept).limit(rows).drop("_draw")


def explain(df: DataFrame, model: BoostedTrees, output: str = "contributions") -> DataFrame:
    """``df`` with the Shapley value of each of the model's features (an array in their order)."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def made(x: pa.Array) -> pa.Array:
        m = sent.value
        got = contributions(m, binned(as_matrix(x, len(m.features)), [np.array(e) for e in m.edges]))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, got.shape[1]), pa.int32()), pa.array(got.ravel()))

    return df.withColumn(output, made(feature_array(model.features)))


def shapley_importance(df: DataFrame, model: BoostedTrees, rows: int = 500, seed: int = 42) -> DataFrame:
    """(feature, importance): mean absolute Shapley value over a seeded sample."""
    names = F.array(*[F.lit(f) for f in model.features])
    each = explain(seeded_sample(df.select(*(F.col(f"`{f}`") for f in model.features)), rows, seed), model)
    flat = each.select(F.explode(F.arrays_zip(names.alias("feature"), F.col("contributions").alias("value"))).alias("c"))
    return flat.groupBy(F.col("c.feature").alias("feature")).agg(F.avg(F.abs("c.value")).alias("importance"))
