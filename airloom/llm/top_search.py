"""Exact top-k inner products, term at a time.

The candidates lie in posting lists: for each term (component) the rows of a block that have it, and their weights. The
terms of sparse query rows are taken one after the other; each scatters query weight x posting weight into a dense array
of scores. A partition selection keeps the best k of a block, and the blocks' lists merge.

Every query of the stated set meets every row, in blocks. A batch of queries is bounded and travels as a broadcast
variable; the number of batches grows with the query set. What a task sends on is k rows per query.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import store

QUERY_BATCH = 4096  # queries held by a task at a time
BLOCK_ROWS = 1024   # candidate rows scored at a time
TILE = 128          # queries that share one score array, so that it stays in the processor's cache
LONG = 2 ** 63 - 1

FOUND = "query_id long, vec_id long, score long"


def postings(block: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each term of a rows x terms array the positions of the rows that have it, ascending, and their weights."""
    out = {}
    for term in range(block.shape[1]):
        where = np.flatnonzero(block[:, term])
        if len(where):
            out[term] = where, block[where, term]
    return out


def accumulate(queries: dict, n_queries: int, lists: dict, n_rows: int, kind) -> np.ndarray:
    """Scores (queries x rows) of all terms that both sides have. ``queries`` are posting lists of the query side."""
    scores = np.zeros((n_queries, n_rows), kind)
    for term, (who, weights) in queries.items():
        if term in lists:
            where, others = lists[term]
            added = np.multiply.outer(weights, others)
            if len(who) == n_queries and len(where) == n_rows:
                scores += added
            else:
                scores[np.ix_(who, where)] += added
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores of one query, ties to smaller ids: partition, then order the few that are left."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _whole(vectors: pa.Array, scale: int):
    """Rows that take part, their floor(scale * x) as an array of rows of one length each, by length."""
    valid = np.array(vectors.is_valid())
    lengths = np.array(vectors.value_lengths().fill_null(0))
    flat = vectors.flatten()
    values = np.asarray(flat.fill_null(float("nan")).to_numpy(zero_copy_only=False), np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for n in np.unique(lengths[valid]):
        rows = np.flatnonzero(valid & (lengths == n))
        part = values[starts[rows][:, None] + np.arange(n)] if n else np.zeros((len(rows), 0))
        fine = np.isfinite(part).all(1)
        yield rows[fine], np.floor(scale * part[fine])


def _number_kind(a: np.ndarray, b: np.ndarray):
    """The narrowest number that holds every score exactly."""
    terms = max(a.shape[1], 1)
    bound = terms * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    return np.float32 if bound < 2 ** 24 else np.float64 if bound < 2 ** 53 else np.int64 if bound < 2 ** 62 else object


def _as(x: np.ndarray, kind) -> np.ndarray:
    if kind is object:
        return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    return x.astype(kind)


def _scorer(sent, k: int, scale: int):
    def run(batches):
        held = {}  # best k so far per query
        query_ids, query_rows = sent.value
        for batch in batches:
            ids_all = np.array(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            known = np.array(batch.column(0).is_valid())
            vectors = batch.column(1)
            for rows, part in _whole(vectors, scale):
                fine = known[rows]
                rows, part = rows[fine], part[fine]
                n = part.shape[1]
                if n not in query_rows:
                    continue
                who, asked = query_rows[n]
                for a in range(0, len(rows), BLOCK_ROWS):
                    ids, block = ids_all[rows[a:a + BLOCK_ROWS]], part[a:a + BLOCK_ROWS]
                    kind = _number_kind(asked, block)
                    lists = postings(_as(block, kind))
                    for b in range(0, len(who), TILE):
                        own = postings(_as(asked[b:b + TILE], kind))
                        scores = accumulate(own, len(who[b:b + TILE]), lists, len(ids), kind)
                        if kind is object:
                            scores = np.clip(scores, -LONG - 1, LONG)
                        _keep(held, query_ids, who[b:b + TILE], scores, ids, k)
        out = [(q, i, s) for q, found in held.items() for i, s in found]
        for a in range(0, len(out), 10_000):
            q, i, s = zip(*out[a:a + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())],
                                             ["query_id", "vec_id", "score"])
    return run


def _keep(held, query_ids, who, scores, ids, k):
    """Merges a block's best k of each query into those that the task holds; rows with the query's own id stay out."""
    n = scores.shape[1]
    lowest = -np.inf if scores.dtype.kind == "f" else -2 ** 63 if scores.dtype.kind == "i" else -10 ** 700
    order = np.argsort(ids, kind="stable")
    own_ids = query_ids[who]
    first, last = (np.searchsorted(ids, own_ids, side, sorter=order) for side in ("left", "right"))
    for row in np.flatnonzero(first < last):
        scores[row, order[first[row]:last[row]]] = lowest
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else [lowest] * len(who)
    for row, own in enumerate(own_ids.tolist()):
        line, before = scores[row], held.get(own, [])
        if len(before) == k and least[row] < before[-1][1]:
            at = np.flatnonzero(line >= before[-1][1])
        else:
            at = np.flatnonzero(line >= least[row])
        at = at[ids[at] != own]
        if len(at):
            met = at[best(line[at], ids[at], k)]
            found = before + [(int(i), int(x)) for i, x in zip(ids[met], line[met])]
            held[own] = sorted(found, key=lambda f: (-f[1], f[0]))[:k]


def top_k_products(queries: DataFrame, rows: DataFrame, k: int = 5, scale: int = 256, key: str = "vec_id",
                   vector: str = "embedding", batch: int = QUERY_BATCH) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query.

    Components are floor(scale * x). Candidates are all rows but those with the query's own id. Ties go to smaller ids.
    Vectors that are null or hold null or non-finite components, and rows with a null id, take no part; neither do pairs
    of different lengths. Rows that repeat an id count each as a candidate; of query rows with one id the smallest vector
    asks. Scores beyond a long end at its limits. Empty tables give an empty result.
    """
    spark = rows.sparkSession
    vectors = rows.select(F.col(f"`{key}`").cast("long").alias("vec_id"),
                          F.col(f"`{vector}`").cast("array<double>").alias("embedding"))
    plain = F.expr("embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    asked = queries.select(F.col(f"`{key}`").cast("long").alias("query_id"),
                           F.col(f"`{vector}`").cast("array<double>").alias("embedding"))
    asked = store(asked.where(plain & F.col("query_id").isNotNull())
                  .groupBy("query_id").agg(F.min("embedding").alias("embedding")))
    n_batches = -(-asked.count() // batch)
    found = None
    for b in range(n_batches):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_batches)) == b).toArrow()
        ids = part.column("query_id").to_numpy()
        by_length = {}
        for at, whole in _whole(part.column("embedding").combine_chunks(), scale):
            if len(at):
                by_length[whole.shape[1]] = (at, whole)
        sent = spark.sparkContext.broadcast((ids, by_length))
        got = vectors.mapInArrow(_scorer(sent, k, scale), FOUND)
        if n_batches > 1:
            got = store(got)
            sent.unpersist()
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
