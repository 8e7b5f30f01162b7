"""K-means on standardised columns from several starts at once; the start of least inertia is kept.

All starts share one pass and one aggregate per iteration: a task assigns its rows for every start and sends sums per start
and cluster. The first centres are drawn by squared distance over all rows (the row of greatest log(u) / d² for a hash u of
the row is such a draw), again for all starts in one pass.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage


@dataclass
class KMeansModel:
    inputs: list[str]
    means: list[float]
    scales: list[float]
    centres: list[list[float]]      # standardised
    inertia: float
    inertias: list[float]           # of every start
    iterations: int

    def scaled(self) -> list[Column]:
        return [(F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(self.inputs, self.means, self.scales)]

    def nearest(self) -> Column:
        """Number of the nearest centre (ties: the lower number); NULL where an input is."""
        x = self.scaled()
        known = reduce(lambda a, b: a & b, [c.isNotNull() for c in x])
        far = [F.struct(_distance(x, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(self.centres)]
        return F.when(known, F.least(*far)["i"] if len(far) > 1 else F.lit(0))

    def by_level(self, column: str) -> list[int]:
        """Cluster number -> its rank by rising centre of ``column``."""
        i = self.inputs.index(column)
        order = sorted(range(len(self.centres)), key=lambda c: self.centres[c][i])
        return [order.index(c) for c in range(len(self.centres))]

    def plain_centres(self) -> list[list[float]]:
        return [[v * s + m for v, s, m in zip(c, self.scales, self.means)] for c in self.centres]


def _distance(x: list[Column], centre: list[float]) -> Column:
    return reduce(lambda a, b: a + b, [(c - F.lit(v)) * (c - F.lit(v)) for c, v in zip(x, centre)])


def fit(df: DataFrame, inputs: list[str], k: int = 3, starts: int = 10, seed: int = 42, most: int = 300, tolerance: float = 1e-4) -> KMeansModel:
    """Rows with a NULL or NaN input take no part. Fewer distinct rows than ``k`` give fewer different centres. A centre
    that loses all rows stays where it is. Stops when no start moves by more than ``tolerance`` (squared, summed), or after
    ``most`` iterations."""
    n = len(inputs)
    plain = df.select(*(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(inputs)))
    plain = plain.where(reduce(lambda a, b: a & b, [F.col(f"x{i}").isNotNull() & ~F.isnan(f"x{i}") for i in range(n)]))
    moments = plain.agg(*[f(f"x{i}").alias(f"{a}{i}") for i in range(n) for a, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if moments.m0 is None:
        raise ValueError("no complete row")
    means, scales = [moments[f"m{i}"] for i in range(n)], [moments[f"s{i}"] or 1.0 for i in range(n)]
    x = F.array(*[(F.col(f"x{i}") - F.lit(means[i])) / F.lit(scales[i]) for i in range(n)])
    rows = cut_lineage(plain.select(x.alias("x")).withColumn("h", F.xxhash64("x")))

    centres = _first_centres(rows, k, starts, seed)
    for iteration in range(1, most + 1):
        sums, after = _sums(rows, centres), centres.copy()
        full = sums[:, :, 0] > 0
        after[full] = sums[full][:, 2:] / sums[full][:, :1]
        moved = float(((after - centres) ** 2).sum(2).max())
        centres = after
        if moved <= tolerance ** 2:
            break
    inertia = _sums(rows, centres)[:, :, 1].sum(1).tolist()
    best = min(range(starts), key=lambda s: (round(inertia[s], 9), s))
    return KMeansModel(list(inputs), means, scales, centres[best].tolist(), inertia[best], inertia, iteration)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def _sums(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """starts x clusters x (rows, inertia, sum of each column), from one pass: a task adds up its rows, an aggregate the
    tasks."""
    starts, k, n = centres.shape
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        c = sent.value
        out = np.zeros((starts, k, 2 + n))
        for batch in batches:
            x = _matrix(batch, n)
            for s in range(starts):
                d = ((x[:, None, :] - c[s][None]) ** 2).sum(2)
                near = d.argmin(1)
                for i in range(k):
                    mine = near == i
                    out[s, i, 0] += mine.sum()
                    out[s, i, 1] += d[mine, i].sum()
                    out[s, i, 2:] += x[mine].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], ["place", "value"])

    made = rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(centres.shape[0] * k * (2 + n))
    out[made.column("place").to_numpy()] = made.column("value").to_numpy()
    sent.unpersist()
    return out.reshape(starts, k, 2 + n)


def _first_centres(rows: DataFrame, k: int, starts: int, seed: int) -> np.ndarray:
    n = len(rows.first().x)
    centres = np.zeros((starts, 0, n))
    for step in range(k):
        sent = rows.sparkSession.sparkContext.broadcast(centres)

        def run(batches):
            c, best = sent.value, {}
            for batch in batches:
                x, h = _matrix(batch, n), np.array(batch.column(1)).view(np.uint64)
                for s in range(starts):
                    order = np.log(_chance(h, seed, step, s))
                    if c.shape[1]:
                        near = ((x[:, None, :] - c[s][None]) ** 2).sum(2).min(1)
                        order = np.where(near > 0, order / np.maximum(near, 1e-300), -np.inf)  # never where a centre stands
                    at = int(order.argmax())
                    if order[at] > best.get(s, (-np.inf,))[0]:
                        best[s] = order[at], x[at]
            found = sorted(best)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int32()), pa.array([best[s][0] for s in found], pa.float64()), pa.array([best[s][1].tolist() for s in found], pa.list_(pa.float64()))],
                ["start", "order", "x"])

        drawn = rows.mapInArrow(run, "start int, order double, x array<double>").groupBy("start").agg(
            F.max_by("x", F.struct("order", "x")).alias("x")).collect()  # a row per start
        new = centres[:, :1].copy() if step else np.zeros((starts, 1, n))
        for r in drawn:
            new[r.start, 0] = r.x
        centres = np.concatenate([centres, new], 1)
    return centres


def _chance(h: np.ndarray, seed: int, step: int, start: int) -> np.ndarray:
    """A number in (0, 1) of each row's hash, another one for each step and start."""
    with np.errstate(over="ignore"):
        x = h ^ (np.uint64(seed * 1_000_003 + step * 1009 + start + 1) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53
