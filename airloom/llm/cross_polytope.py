"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three times: random signs, then the fast Hadamard transform) turns a unit vector, and the signed axis
nearest to it is its code. The bits of a code grow with the table, so that a bucket holds about ``BUCKET_ROWS`` rows: as
many whole rotations as that takes, and a last one of which only the first axes count. ``TABLES`` tables have rotations of
their own. A query probes the buckets of each table in the order of its distance to their axes; rows of the probed buckets
are compared exactly, on the original vectors.

The measure is the inner product. Vectors of about one length (a power of two) form a region, in which each gets one more
component that makes all equally long, so that the largest inner product is the nearest direction; every query asks in
every region.

The number of probes is fitted: ``FIT_QUERIES`` queries are compared with every row, and as many probes are taken as find
``FIT_RECALL`` of their neighbours. Everything else covers every row and has no bound on candidates.
"""
from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.bounds import broadcast_if_small
from .common import store

TABLES = 2
BUCKET_ROWS = 256    # rows of a bucket that the bits of a code aim at
CELL_ROWS = 2048     # rows (of several buckets) that a task holds at a time; larger buckets are split
QUERY_ROWS = 1024    # queries that a task compares at a time
FIT_QUERIES = 64
FIT_RECALL = 0.96
CODE_BITS = 44

CLEAN = "id long, node binary, dim int, power int, norm double, vector array<double>"
FOUND = "query binary, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


@lru_cache(maxsize=256)
def _signs(width: int, table: int, turn: int) -> np.ndarray:
    return np.random.default_rng([width, table, turn]).choice([-1.0, 1.0], (3, width))


def rotated(x: np.ndarray, table: int, turn: int) -> np.ndarray:
    for signs in _signs(x.shape[1], table, turn):
        x = hadamard(x * signs)
    return x


def axes(dim: int, bits: int) -> list[int]:
    """Axes that count in each rotation of a code: all, and of the last as many as the bits left take. One bit is the
    side of one axis."""
    width = 1 << int(dim).bit_length()  # one more component fits in
    whole = width.bit_length()          # bits of a signed axis
    out = [width] * (bits // whole)
    if bits % whole:
        out.append(1 << (bits % whole - 1))
    return out


def penalties(x: np.ndarray, table: int, bits: int, dim: int) -> list[np.ndarray]:
    """For each rotation the distance of every row of x to every signed axis, as far as their order needs it."""
    out = []
    for turn, n in enumerate(axes(dim, bits)):
        r = rotated(x, table, turn)[:, :n]
        both = np.concatenate([r, -r], 1)
        out.append(both.max(1, keepdims=True) - both)
    return out


def codes(x: np.ndarray, table: int, bits: int, dim: int) -> np.ndarray:
    """The code of each row."""
    out = np.zeros(len(x), np.int64)
    for p in penalties(x, table, bits, dim):
        out = out * p.shape[1] + p.argmin(1)
    return out


def probes(line: list[np.ndarray], n: int) -> np.ndarray:
    """The n codes nearest to one row, nearest first. ``line`` has the row's penalties of each rotation."""
    cost, code = np.zeros(1), np.zeros(1, np.int64)
    for p in line:
        together = (cost[:, None] + (p * p)[None, :]).ravel()
        keep = np.argpartition(together, n - 1)[:n] if n < len(together) else np.arange(len(together))
        keep = keep[np.argsort(together[keep], kind="stable")]
        cost, code = together[keep], code[keep // len(p)] * len(p) + keep % len(p)
    return code


def widened(x: np.ndarray, power: int, most: float | None) -> np.ndarray:
    """Rows of one region as unit vectors with room for one more component: it fills up what a row lacks to ``most``, the
    greatest length of the region (both divided by 2**power). Queries (``most`` None) are only made unit vectors."""
    x = np.ldexp(x, -power)
    out = np.zeros((len(x), 1 << int(x.shape[1]).bit_length()))
    lengths = np.sqrt((x * x).sum(1))
    if most is None:
        out[:, :x.shape[1]] = x / lengths[:, None]
    else:
        out[:, :x.shape[1]] = x / most
        out[:, x.shape[1]] = np.sqrt(np.maximum(0.0, 1 - (lengths / most) ** 2))
    return out


def _matrix(vectors: pa.Array, rows: np.ndarray | None = None) -> np.ndarray:
    """Vectors of one length, none null, as an array."""
    if rows is not None:
        vectors = vectors.take(pa.array(rows))
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def _clean(batches):
    """Rows that take part, with a key of their vector, their length's power of two and what is left of the length."""
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        usable = np.array(ids.is_valid()) & np.array(vectors.is_valid())
        sizes = np.array(vectors.value_lengths().fill_null(0))
        for n in np.unique(sizes[usable & (sizes > 0)]).tolist():
            rows = np.flatnonzero(usable & (sizes == n))
            part = vectors.take(pa.array(rows))
            x = np.asarray(part.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False), np.float64).reshape(-1, n)
            fine = np.isfinite(x).all(1) & (x != 0).any(1)
            x, rows = x[fine] + 0.0, rows[fine]  # -0.0 is 0.0
            if not len(rows):
                continue
            scale = np.frexp(np.abs(x).max(1))[1]
            short = np.ldexp(x, -scale[:, None])
            length = np.sqrt((short * short).sum(1))
            power = np.floor(np.log2(length) + 0.5).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(rows)), pa.array([hashlib.md5(v.tobytes()).digest() for v in x], pa.binary()),
                pa.array(np.full(len(x), n), pa.int32()), pa.array(scale + power, pa.int32()),
                pa.array(np.ldexp(length, -power)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, n), pa.int32()), pa.array(x.ravel()))],
                ["id", "node", "dim", "power", "norm", "vector"])


def _clean_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).mapInArrow(_clean, CLEAN)


def _bits(rows: int) -> int:
    return min(CODE_BITS, max(0, round(np.log2(max(rows, 1) / BUCKET_ROWS))))


def _add_codes(regions: dict):
    """Adds each row's bucket in each table."""
    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            dims, powers = t.column("dim").to_numpy(), t.column("power").to_numpy()
            out = np.zeros((len(t), TABLES), np.int64)
            vectors = t.column("vector").combine_chunks()
            for dim, power in set(zip(dims.tolist(), powers.tolist())):
                number, bits, most = regions[dim, power]
                rows = np.flatnonzero((dims == dim) & (powers == power))
                x = widened(_matrix(vectors, rows), power, most)
                for table in range(TABLES):
                    out[rows, table] = codes(x, table, bits, dim) | (number * TABLES + table) << CODE_BITS
            made = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, TABLES), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("vector"), batch.column("ids"), made],
                                             ["node", "vector", "ids", "buckets"])
    return run


def _asked(x: np.ndarray, dim: int, regions: dict, n: int):
    """For each row of x the buckets that it probes: n of each table and region of its length."""
    unit = x / np.abs(x).max(1, keepdims=True)
    unit = widened(unit, 0, None)
    out = [[] for _ in x]
    for (size, _), (number, bits, _) in regions.items():
        if size != dim:
            continue
        for table in range(TABLES):
            parts = penalties(unit, table, bits, dim)
            for i in range(len(x)):
                out[i].append(probes([p[i] for p in parts], n) | (number * TABLES + table) << CODE_BITS)
    return [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]


def _add_probes(regions: dict, n: int):
    def run(batches):
        for batch in batches:
            sizes = np.array(batch.column("vector").value_lengths())
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                for a in range(0, len(rows), QUERY_ROWS):
                    some = pa.array(rows[a:a + QUERY_ROWS])
                    vectors = batch.column("vector").take(some)
                    found = _asked(_matrix(vectors), dim, regions, n)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("node").take(some), vectors, pa.array(found, pa.list_(pa.int64()))], ["node", "vector", "buckets"])
    return run


class Best:
    """The best rows of each query that a task has met so far, each row once."""

    def __init__(self, k: int):
        self.k, self.parts, self.size, self.limit = k, [], 0, 1 << 20

    def add(self, query: np.ndarray, vec_id: np.ndarray, score: np.ndarray):
        self.parts.append((query, vec_id, score))
        self.size += len(query)
        if self.size > self.limit:
            self.parts = [self.kept()]
            self.size = len(self.parts[0][0])
            self.limit = max(self.limit, 2 * self.size)

    def kept(self):
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, vec_id, score = (np.concatenate(p) for p in zip(*self.parts))
        order = np.lexsort((-score, vec_id, query))
        q, v = query[order], vec_id[order]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
        order = order[fresh]
        order = order[np.lexsort((vec_id[order], -score[order], query[order]))]
        q = query[order]
        first = np.searchsorted(q, q, "left")
        order = order[np.arange(len(q)) - first < self.k]
        return query[order], vec_id[order], score[order]


def nearest(asked: np.ndarray, rows: np.ndarray, ids: list[np.ndarray], k: int):
    """(query number, id, score) of the k best ids of each query: the matrix product selects, the score is summed for each
    pair alone, so that it does not depend on what else is compared."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough = np.nan_to_num(asked @ rows.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        n = rows.shape[0]
        least = np.partition(rough, n - k, axis=1)[:, n - k] if n > k else np.full(len(asked), -np.inf)
        slack = 1e-12 * np.sqrt((asked * asked).sum(1)) * np.sqrt((rows * rows).sum(1).max())
        least = np.where(np.isfinite(least) & np.isfinite(slack), least - slack, least)
        who, what = np.nonzero(rough >= least[:, None])
        score = np.concatenate([(asked[who[a:a + 65536]] * rows[what[a:a + 65536]]).sum(1) for a in range(0, max(len(who), 1), 65536)])
    score = np.where(np.isnan(score), -np.inf, score)
    head = np.array([i[0] for i in ids])
    order = np.lexsort((head[what], -score, who))
    first = np.searchsorted(who[order], who[order], "left")
    order = order[np.arange(len(order)) - first < k]
    who, what, score = who[order], what[order], score[order]
    many = np.array([len(ids[w]) for w in what], np.int64)
    flat = np.concatenate([ids[w] for w in what]) if len(what) else np.zeros(0, np.int64)
    return np.repeat(who, many), flat, np.repeat(score, many)


def _emit(best: Best, names: list[bytes]):
    query, vec_id, score = best.kept()
    for a in range(0, len(query), 50_000):
        part = slice(a, a + 50_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[q] for q in query[part]], pa.binary()), pa.array(vec_id[part]), pa.array(score[part])], ["query", "vec_id", "score"])


def _search(k: int):
    """Rows come by cell, the index rows of a cell before its queries: those are held, the queries stream."""
    def run(batches):
        best, names, numbers = Best(k), [], {}
        cell, held, ready = None, [], {}
        for batch in batches:
            at = np.array(batch.column("cell"))
            kind = np.array(batch.column("kind"))
            change = np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1])) + 1
            bounds = [0, *change.tolist(), len(at)]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                if at[a] != cell:
                    cell, held, ready = at[a], [], {}
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    held.append(part)
                    continue
                if held:
                    ready, held = _by_bucket(held), []
                for c in range(0, len(part), QUERY_ROWS):
                    some = part.slice(c, QUERY_ROWS)
                    who = some.column("node").to_pylist()
                    for x in who:
                        if x not in numbers:
                            numbers[x] = len(names)
                            names.append(x)
                    _compare(some, np.array([numbers[x] for x in who]), ready, best)
        yield from _emit(best, names)

    def _by_bucket(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        keys = t.column("bucket").to_numpy()
        vectors, ids = t.column("vector").combine_chunks(), t.column("longs").to_pylist()
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        return {int(keys[rows[0]]): (_matrix(vectors, rows), [np.array(ids[r], np.int64) for r in rows])
                for rows in np.split(order, cuts)}

    def _compare(some, who, ready, best):
        sizes = np.array(some.column("longs").value_lengths())
        wanted = np.asarray(some.column("longs").flatten())
        row = np.repeat(np.arange(len(some)), sizes)
        vectors = some.column("vector")
        for key in np.unique(wanted).tolist():
            if key not in ready:
                continue
            rows, ids = ready[key]
            mine = row[wanted == key]
            q, i, s = nearest(_matrix(vectors, mine), rows, ids, k)
            best.add(who[mine][q], i, s)
    return run


def _exact(sent, k: int):
    """The k best rows of every sample query, with their vectors."""
    def run(batches):
        best, vectors_of = Best(k), {}
        names, by_dim = sent.value
        for batch in batches:
            sizes = np.array(batch.column("vector").value_lengths())
            for dim in np.unique(sizes).tolist():
                if dim not in by_dim:
                    continue
                rows = np.flatnonzero(sizes == dim)
                x = _matrix(batch.column("vector"), rows)
                ids = [np.array(v[:1], np.int64) for v in batch.column("ids").take(pa.array(rows)).to_pylist()]
                who, asked = by_dim[dim]
                q, i, s = nearest(asked, x, ids, k)
                best.add(who[q], i, s)
                place = {int(v[0]): n for n, v in enumerate(ids)}
                vectors_of.update({v: x[place[v]] for v in set(i.tolist())})
                left = set(best.kept()[1].tolist())
                vectors_of = {v: x for v, x in vectors_of.items() if v in left}
        query, vec_id, score = best.kept()
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[q] for q in query], pa.binary()), pa.array(vec_id), pa.array(score),
             pa.array([vectors_of[v].tolist() for v in vec_id.tolist()], pa.list_(pa.float64()))], ["query", "vec_id", "score", "vector"])
    return run


def fit_probes(classes: DataFrame, asked: DataFrame, regions: dict, k: int, queries: int = FIT_QUERIES, recall: float = FIT_RECALL) -> int:
    """Probes of each table that find ``recall`` of the k nearest rows of at most ``queries`` queries."""
    spark = classes.sparkSession
    sample = asked.orderBy("node").limit(queries).select("node", "vector").toArrow()  # keys are digests: any order is random
    if not len(sample):
        return 1
    names = sample.column("node").to_pylist()
    vectors = sample.column("vector").combine_chunks()
    sizes = np.array(vectors.value_lengths())
    by_dim = {int(d): (np.flatnonzero(sizes == d), _matrix(vectors, np.flatnonzero(sizes == d))) for d in np.unique(sizes)}
    sent = spark.sparkContext.broadcast((names, by_dim))
    met = classes.mapInArrow(_exact(sent, k + 1), FOUND + ", vector array<double>")
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    met = met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("query", "score", "vector").toArrow()
    number = {x: i for i, x in enumerate(names)}
    parts = {}
    for dim, (who, x) in by_dim.items():
        unit = widened(x / np.abs(x).max(1, keepdims=True), 0, None)
        for i, q in enumerate(who.tolist()):
            parts[q] = dim, unit[i:i + 1], x[i]
    whom = [number[x] for x in met.column("query").to_pylist()]
    near = [np.array(v) for v in met.column("vector").to_pylist()]
    others = [j for j, q in enumerate(whom) if not np.array_equal(near[j], parts[q][2])]
    whom, near = [whom[j] for j in others], [near[j] for j in others]
    if not near:
        return 1
    most, rank = 1, np.zeros(len(near), np.int64)
    lines, wanted = {}, {}
    for j in range(len(near)):
        x = near[j][None]
        dim = parts[whom[j]][0]
        scale = int(np.frexp(np.abs(x).max())[1])
        short = np.ldexp(x, -scale)
        power = scale + int(np.floor(np.log2(np.sqrt((short * short).sum())) + 0.5))
        region, bits, greatest = regions[dim, power]
        most = max(most, 1 << bits)
        for table in range(TABLES):
            wanted[j, table] = (region, bits, codes(widened(x, power, greatest), table, bits, dim)[0])
    n = 1
    while True:  # more and more probes, until they reach enough
        rank[:] = 2 * n
        for j in range(len(near)):
            dim, unit, _ = parts[whom[j]]
            for table in range(TABLES):
                region, bits, code = wanted[j, table]
                if (whom[j], table, bits, n) not in lines:
                    lines[whom[j], table, bits, n] = {int(c): i for i, c in enumerate(
                        probes([p[0] for p in penalties(unit, table, bits, dim)], n))}
                rank[j] = min(rank[j], lines[whom[j], table, bits, n].get(int(code), 2 * n) + 1)
        if n >= most or np.mean(rank <= n) >= recall:
            return min(n, max(1, int(np.quantile(rank, recall, method="higher"))))
        lines.clear()
        n *= 2


def nearest_neighbours(queries: DataFrame, rows: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding",
                       recall: float = FIT_RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query the k rows of largest inner product that the tables find.

    Candidates are all rows but those with the query's own id; ties go to smaller ids. Scores are inner products of the
    original vectors in double precision. Rows with a null id or a vector that is null, empty, zero or holds null or
    non-finite components take no part, nor do pairs of different lengths. Rows that repeat an id count once, with their
    best score; of query rows that repeat an id one asks. Products too large for a double end as infinite ones, those
    that are no number as the least. Empty tables give an empty result.

    Equal vectors are one row of the index, with their k + 1 smallest ids: others cannot be among the k nearest. Equal
    queries ask once. So a vector that a third of the rows have is no hot bucket; buckets of many different vectors are
    split among tasks.
    """
    spark = rows.sparkSession
    kept = k + 1
    clean = _clean_rows(rows, key, vector)
    least = W.partitionBy("node").orderBy("id")
    firsts = clean.withColumn("place", F.row_number().over(least)).where(F.col("place") <= kept)
    classes = firsts.groupBy("node").agg(F.sort_array(F.collect_set("id")).alias("ids"), *(F.first(c).alias(c) for c in ("dim", "power", "norm", "vector")))
    classes = store(classes)
    stats = classes.groupBy("dim", "power").agg(F.count("*").alias("n"), F.max("norm").alias("most")).orderBy("dim", "power").collect()  # a row per length and power of two
    regions = {(r.dim, r.power): (i, _bits(r.n), r.most) for i, r in enumerate(stats)}
    members = store(_clean_rows(queries, key, vector).groupBy("id").agg(F.min_by(F.struct("node", "vector"), "node").alias("q")).select(
        F.col("id").alias("query_id"), "q.node", "q.vector"))
    asked = members.dropDuplicates(["node"]).select("node", "vector")
    n = fit_probes(classes, asked, regions, k, recall=recall)

    coded = store(classes.mapInArrow(_add_codes(regions), "node binary, vector array<double>, ids array<long>, buckets array<long>"))
    index = coded.select("node", "vector", F.col("ids").alias("longs"), F.explode("buckets").alias("bucket"))
    sizes = coded.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    heavy = broadcast_if_small(sizes.where(F.col("n") > CELL_ROWS).select("bucket", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("parts")))
    cells = max(1, -(-TABLES * sum(r.n for r in stats) // CELL_ROWS))
    cell = F.pmod(F.xxhash64("bucket", "part"), F.lit(cells)).cast("int").alias("cell")
    parts = F.coalesce("parts", F.lit(1))
    held = index.join(heavy, "bucket", "left").withColumn("part", F.pmod(F.xxhash64("node"), parts)).select(
        cell, F.lit(0).alias("kind"), "node", "bucket", "vector", "longs")
    sent = asked.mapInArrow(_add_probes(regions, n), "node binary, vector array<double>, buckets array<long>")
    probed = sent.select("node", "vector", F.explode("buckets").alias("bucket")).join(heavy, "bucket", "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
    probed = probed.select(cell, "node", "bucket", "vector").groupBy("cell", "node").agg(
        F.first("vector").alias("vector"), F.collect_set("bucket").alias("longs"))
    probed = probed.select("cell", F.lit(1).alias("kind"), "node", F.lit(None).cast("long").alias("bucket"), "vector", "longs")
    dealt = held.unionByName(probed).repartition("cell").sortWithinPartitions("cell", "kind")
    found = dealt.mapInArrow(_search(kept), FOUND)

    once = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    by_query = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = once.withColumn("n", F.row_number().over(by_query)).where(F.col("n") <= kept).drop("n")
    own = members.select("query_id", F.col("node").alias("query"))
    met = own.join(best, "query").where(F.col("vec_id") != F.col("query_id"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
