"""Second-order boosted regression trees on histograms.

Every feature is cut into at most ``bins`` quantile bins once. A level of a tree is one pass over the binned rows: each task
sums gradients and Hessians per node, feature and bin, and one aggregate adds the tasks up. The sums are whole numbers
(gradients are scaled and rounded), so a model does not depend on how rows are spread over tasks. What reaches the driver
is one number per node, feature and bin, whose count the parameters bound (``leaves`` or 2**depth nodes x features x bins),
never rows.

The loss is the squared error: a row's gradient is prediction - target, its Hessian 1. A split's gain and a leaf's weight
are regularised by ``l1`` and ``l2``. Rows (by a hash of the row) and columns (by a hash of the name) are drawn for each
tree. Missing values go to the side where they gain more. A tree grows level by level to ``depth``; with ``leaves`` it is
the tree that splitting the leaf of greatest gain first gives. Boosting ends when the error of the validation rows has not
fallen for ``stop`` trees, and the trees up to the least error are kept.
"""
from __future__ import annotations

import heapq
import json
import zlib
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

SCALE_BITS = 24       # gradients are whole multiples of the target's range / 2**SCALE_BITS
KEEP_EVERY = 10       # trees after which each row's prediction is written down


@dataclass(frozen=True)
class Settings:
    rounds: int = 2000
    step: float = 0.05
    depth: int = 8
    leaves: int | None = None   # None: all splits of positive gain down to depth
    l1: float = 0.1
    l2: float = 0.1
    rows: float = 0.8
    every: int = 1              # trees that share a draw of rows
    columns: float = 0.8
    min_rows: int = 1
    bins: int = 64
    stop: int = 50
    metric: str = "rmse"        # or "mae"
    seed: int = 42


#: Trees limited by depth, and trees limited by leaves that split the best leaf first.
BY_DEPTH = Settings()
BY_LEAVES = Settings(depth=24, leaves=127, every=5, min_rows=20, metric="mae")


@dataclass
class Tree:
    """Nodes by number; feature -1 marks a leaf. A row goes left if its bin is at most ``cut``; bin 0 is a missing value."""
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool) -> tuple[int, int]:
        new = len(self.feature)
        for name, blank in (("feature", -1), ("cut", 0), ("missing_left", True), ("left", 0), ("right", 0), ("value", 0.0), ("cover", 0)):
            getattr(self, name).extend([blank, blank])
        self.feature[node], self.cut[node], self.missing_left[node] = feature, cut, missing_left
        self.left[node], self.right[node] = new, new + 1
        return new, new + 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(getattr(self, n)) for n in ("feature", "cut", "missing_left", "left", "right"))


def place(tree: tuple[np.ndarray, ...], codes: np.ndarray) -> np.ndarray:
    """The leaf of each row of bins."""
    feature, cut, missing_left, left, right = tree
    node = np.zeros(len(codes), np.int64)
    row = np.arange(len(codes))
    open_ = row[feature[node] >= 0]
    while len(open_):
        at = node[open_]
        code = codes[open_, feature[at]]
        node[open_] = np.where(np.where(code == 0, missing_left[at], code <= cut[at]), left[at], right[at])
        open_ = open_[feature[node[open_]] >= 0]
    return node


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of a rows x features array: 0 for no value, else 1 + the number of edges below it."""
    out = np.empty(x.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.where(np.isnan(x[:, i]), 0, 1 + np.searchsorted(e, x[:, i], side="left"))
    return out


@dataclass
class BoostedTrees:
    """A fitted model. ``transform`` adds the prediction, as the models of the standard library do."""
    features: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Tree]
    history: list[float] = field(default_factory=list)

    def predict(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), self.base)
        for tree in self.trees:
            out += np.array(tree.value)[place(tree.arrays(), codes)]
        return out

    def predict_values(self, x: np.ndarray) -> np.ndarray:
        return self.predict(binned(x, [np.array(e) for e in self.edges]))

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(self)  # bounded by rounds and leaves

        @F.arrow_udf("double")
        def made(x: pa.Array) -> pa.Array:
            return pa.array(sent.value.predict_values(as_matrix(x, len(sent.value.features))))

        return df.withColumn(output, made(feature_array(self.features)))

    def importances(self) -> list[tuple[str, int]]:
        """How often each feature splits, highest first."""
        counts = [0] * len(self.features)
        for tree in self.trees:
            for f in tree.feature:
                if f >= 0:
                    counts[f] += 1
        return sorted(zip(self.features, counts), key=lambda x: (-x[1], x[0]))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "BoostedTrees":
        d = json.loads(text)
        return cls(d["features"], d["edges"], d["base"], [Tree(**t) for t in d["trees"]], d["history"])


def feature_array(features: list[str]) -> Column:
    return F.array(*[F.col(f"`{f}`").cast("double") for f in features])


def as_matrix(x, width: int) -> np.ndarray:
    flat = x.flatten() if isinstance(x, pa.Array) else pa.concat_arrays([c.flatten() for c in x.chunks])
    return np.asarray(flat.fill_null(float("nan")).to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def quantile_edges(df: DataFrame, features: list[str], bins: int, accuracy: int = 10_000) -> list[list[float]]:
    """At most bins - 1 edges per feature, from one pass of mergeable sketches (a sketch of few values is exact)."""
    shares = [i / bins for i in range(1, bins)]
    plain = lambda f: F.when(~F.isnan(F.col(f"`{f}`").cast("double")), F.col(f"`{f}`").cast("double"))
    row = df.agg(*[F.percentile_approx(plain(f), shares, accuracy).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [sorted(set(q or ())) for q in row]


def _coded(features: list[str], edges: list[list[float]]) -> Column:
    cuts = [np.array(e) for e in edges]

    @F.arrow_udf("binary")
    def made(x: pa.Array) -> pa.Array:
        return pa.array([r.tobytes() for r in binned(as_matrix(x, len(cuts)), cuts)], pa.binary())

    return made(feature_array(features))


def _chance(name: str, seed: int) -> float:
    return zlib.crc32(f"{seed}:{name}".encode()) / 2 ** 32


def fit(train: DataFrame, val: DataFrame | None, features: list[str], target: str = "aqi", settings: Settings = BY_DEPTH) -> BoostedTrees:
    """Rows without a target take no part. Without validation rows all ``rounds`` are kept. An empty table gives a model
    that predicts 0."""
    s = settings
    if s.bins > 255:
        raise ValueError("at most 255 bins")
    own = lambda df, valid: df.select(*(F.col(f"`{f}`").cast("double").alias(f) for f in features), F.col(f"`{target}`").cast("double").alias("_y"), F.lit(valid).alias("_valid"))
    rows = own(train, False)
    if val is not None:
        rows = rows.unionByName(own(val, True))
    rows = rows.where(F.col("_y").isNotNull() & ~F.isnan("_y"))
    edges = quantile_edges(rows.where(~F.col("_valid")), features, s.bins)
    hashed = F.xxhash64(*(F.col(f"`{f}`") for f in features), "_y")
    base_row = rows.where(~F.col("_valid")).agg(F.avg("_y").alias("m"), F.min("_y").alias("a"), F.max("_y").alias("b")).first()
    if base_row.m is None:
        return BoostedTrees(list(features), edges, 0.0, [])
    scale = 2.0 ** SCALE_BITS / max(base_row.b - base_row.a, 1e-300)
    base = round(base_row.m * scale) / scale
    table = cut_lineage(rows.select(_coded(features, edges).alias("codes"), F.col("_y").alias("y"), F.col("_valid").alias("valid"),
                                    hashed.alias("hash"), F.lit(base).alias("margin")))
    model = BoostedTrees(list(features), edges, base, [])
    best, best_round, pending = None, 0, []
    for number in range(s.rounds + 1):
        drawn = [i for i, f in enumerate(features) if _chance(f, s.seed * 1_000_003 + number) < s.columns] or [number % len(features)]
        tree, error = _grow(table, pending, drawn, len(features), number, scale, s, last=number == s.rounds)
        if error is not None:
            model.history.append(error)
            if best is None or error < best:
                best, best_round = error, number
            elif number - best_round >= s.stop:
                break
        if number == s.rounds or tree is None:
            break
        model.trees.append(tree)
        pending.append(tree)
        if len(pending) == KEEP_EVERY:
            table = cut_lineage(table.withColumn("margin", _added(pending, len(features))(F.col("codes"), F.col("margin"))))
            pending = []
    if best is not None:
        model.trees = model.trees[:best_round]
    return model


def _added(trees: list[Tree], width: int):
    sent = [(t.arrays(), np.array(t.value)) for t in trees]

    @F.arrow_udf("double")
    def made(codes: pa.Array, margin: pa.Array) -> pa.Array:
        x = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, width)
        out = np.array(margin)
        for arrays, value in sent:
            out = out + value[place(arrays, x)]
        return pa.array(out)

    return made


def _sums(sent, width: int, s: Settings):
    """Sums of a task: key (node number, drawn feature, bin) -> gradient, rows; key -1 and -2 are the validation error."""
    def run(batches):
        state = sent.value
        trees, partial, frontier, drawn, number, scale = (state[k] for k in ("trees", "partial", "frontier", "drawn", "number", "scale"))
        size = s.bins + 1
        grad = np.zeros((len(frontier), len(drawn), size), np.int64)
        count = np.zeros_like(grad)
        slot = np.full(max(len(partial[0]), 1), -1, np.int64)
        slot[frontier] = np.arange(len(frontier))
        error, seen = 0, 0
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width)
            y, valid, hashes, margin = (np.array(batch.column(i)) for i in range(1, 5))
            for arrays, value in trees:
                margin = margin + value[place(arrays, x)]
            gap = margin - y
            if state["measure"] and valid.any():
                e = np.abs(gap[valid])
                error += int(np.rint((e if s.metric == "mae" else e * e / state["spread"]) * scale).astype(np.int64).sum())
                seen += int(valid.sum())
            draw = (_mixed(hashes, number // s.every + s.seed) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53 < s.rows
            use = ~valid & draw
            where = slot[place(partial, x[use])]
            use_rows, where = np.flatnonzero(use)[where >= 0], where[where >= 0]
            g = np.rint(gap[use_rows] * scale).astype(np.int64)
            for j, f in enumerate(drawn):
                key = where * size + x[use_rows, f]
                n = np.bincount(key, minlength=len(frontier) * size)
                # bincount adds floats; halves of the whole numbers are added exactly
                high = np.bincount(key, g >> 20, len(frontier) * size).astype(np.int64)
                low = np.bincount(key, g & 0xFFFFF, len(frontier) * size).astype(np.int64)
                grad[:, j] += ((high << 20) + low).reshape(-1, size)
                count[:, j] += n.reshape(-1, size)
        key = np.flatnonzero(count.ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([key, [-1]])), pa.array(np.concatenate([grad.ravel()[key], [error]])), pa.array(np.concatenate([count.ravel()[key], [seen]]))],
            ["key", "g", "n"])
    return run


def _mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = hashes.view(np.uint64) ^ (np.uint64(salt & 0xFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _worth(g, h, s: Settings):
    return shrunk(g, s.l1) ** 2 / (h + s.l2 + 1e-300)


def best_split(grad: np.ndarray, rows: np.ndarray, s: Settings):
    """(gain, feature, cut, missing goes left) of one node from features x bins sums (bin 0: missing), or None. Ties go to
    the first feature, then the lowest cut, then missing to the left."""
    total_g, total_h = grad[0].sum(), rows[0].sum()
    g, h = np.cumsum(grad[:, 1:], 1)[:, :-1], np.cumsum(rows[:, 1:], 1)[:, :-1]
    options = []
    for g_left, h_left in ((g + grad[:, :1], h + rows[:, :1]), (g, h)):
        gain = _worth(g_left, h_left, s) + _worth(total_g - g_left, total_h - h_left, s) - _worth(total_g, total_h, s)
        fine = (h_left >= max(s.min_rows, 1)) & (total_h - h_left >= max(s.min_rows, 1))
        options.append(np.where(fine, gain, -np.inf))
    both = np.stack(options, 2)
    at = int(both.argmax()) if both.size else -1
    if at < 0 or not both.ravel()[at] > 1e-9:
        return None
    feature, cut, side = np.unravel_index(at, both.shape)
    return float(both.ravel()[at]), int(feature), int(cut) + 1, bool(side == 0)


def _grow(table: DataFrame, pending: list[Tree], drawn: list[int], width: int, number: int, scale: float, s: Settings, last: bool):
    """One tree, and the validation error of the model before it. The tree is None where nothing can be split."""
    spark = table.sparkSession
    tree, frontier, error, splits = Tree(), [0], None, {}
    for level in range(s.depth + 1):
        measure = level == 0
        state = {"trees": [(t.arrays(), np.array(t.value)) for t in pending], "partial": tree.arrays(), "frontier": frontier, "drawn": drawn,
                 "number": number, "scale": scale, "measure": measure, "spread": 2.0 ** SCALE_BITS / scale}
        sent = spark.sparkContext.broadcast(state)
        sums = table.mapInArrow(_sums(sent, width, s), "key long, g long, n long").groupBy("key").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toArrow()
        sent.unpersist()
        key, g, n = (sums.column(c).to_numpy() for c in ("key", "g", "n"))
        if measure:
            seen = n[key == -1].sum()
            if seen:
                error = float(g[key == -1].sum() / scale / seen)
                error = (error * state["spread"]) ** 0.5 if s.metric == "rmse" else error
            if last:
                return None, error
        size = s.bins + 1
        grad, rows = np.zeros(len(frontier) * len(drawn) * size), np.zeros(len(frontier) * len(drawn) * size)
        fine = key >= 0
        grad[key[fine]], rows[key[fine]] = g[fine] / scale, n[fine]
        grad, rows = grad.reshape(len(frontier), len(drawn), size), rows.reshape(len(frontier), len(drawn), size)
        for i, node in enumerate(frontier):
            total_g, total_h = grad[i, 0].sum(), rows[i, 0].sum()
            tree.cover[node] = int(total_h)
            tree.value[node] = float(-shrunk(total_g, s.l1) / (total_h + s.l2 + 1e-300) * s.step) if total_h else 0.0
            if level < s.depth and (found := best_split(grad[i], rows[i], s)):
                splits[node] = (found[0], drawn[found[1]], found[2], found[3])
        wanted = _first_splits(tree, splits, s.leaves)
        frontier = []
        for node in sorted(wanted):
            if tree.feature[node] < 0:
                frontier += tree.split(node, *splits[node][1:])
        if not frontier:
            break
    kept = _pruned(tree, _first_splits(tree, splits, s.leaves))
    return (kept if len(kept.feature) > 1 else None), error


def _first_splits(tree: Tree, splits: dict[int, tuple], leaves: int | None) -> set[int]:
    """The nodes that are split when the leaf of greatest gain is always split first, as far as their gains are known. More
    known gains can only take nodes out of it, so that a node outside is never needed."""
    heap, out = [], set()
    if 0 in splits:
        heap = [(-splits[0][0], 0)]
    while heap and (leaves is None or len(out) + 1 < leaves):
        _, node = heapq.heappop(heap)
        out.add(node)
        if tree.feature[node] >= 0:
            for child in (tree.left[node], tree.right[node]):
                if child in splits:
                    heapq.heappush(heap, (-splits[child][0], child))
    return out


def _pruned(tree: Tree, splits: set[int]) -> Tree:
    """The tree with those splits only."""
    out = Tree()
    stack = [(0, 0)]
    while stack:
        node, new = stack.pop()
        out.value[new], out.cover[new] = tree.value[node], tree.cover[node]
        if node in splits and tree.feature[node] >= 0:
            left, right = out.split(new, tree.feature[node], tree.cut[node], tree.missing_left[node])
            stack += [(tree.left[node], left), (tree.right[node], right)]
    return out
