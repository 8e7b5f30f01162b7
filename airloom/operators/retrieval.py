"""Keyword, dense and hybrid search, reranking.

Documents: (doc_id, text, ...). Queries: (query_id, text). All searches answer a batch of queries in one plan.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions import text as T
from ..functions.numeric import sigmoid
from ..session import cut_lineage
from . import scoring_block as SB
from .bounds import broadcast_if_small, is_small, top_k

SCORE_DIGITS = 9  # scores are rounded before ranking so that summation order cannot reorder equal documents


# --- Keyword index ------------------------------------------------------------------------

def words_of(pattern: Column | None = None) -> Column:
    """Words of the text; a NULL text has none, but counts as a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return T.tokens(text) if pattern is None else F.regexp_extract_all(F.lower(text), pattern, F.lit(0))


def term_counts(docs: DataFrame, pattern: Column | None = None) -> DataFrame:
    """(doc_id, token, tf, dl). Co-located by doc_id, so later aggregates by (doc_id, ...) need no further shuffle."""
    words = words_of(pattern)
    rows = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", words.alias("w"))
    # Outer generators throughout: the plain ones add a filter on the array, which would tokenize every text twice.
    rows = rows.select("doc_id", F.size("w").alias("dl"), F.explode_outer("w").alias("token")).where("token IS NOT NULL")
    return rows.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def term_stats(docs: DataFrame, pattern: Column | None = None) -> DataFrame:
    """(token, df, cf, dl_sum); the row with the empty token holds the corpus: df = documents, dl_sum = all tokens.

    A task counts block by block and sends one row per word of a block; the sums meet in one combinable aggregate.
    """
    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, STATS_BLOCK):
                words = batch.slice(at, STATS_BLOCK).column("w")
                known, word, row, n = SB.pair_counts(words)
                sizes = SB.list_sizes(words)

                def total(x=None):
                    return np.bincount(word, weights=x, minlength=len(known)).astype(np.int64)

                corpus = [len(words), len(words), sizes.sum()]
                columns = [np.append(c, x) for c, x in zip([total(), total(n), total(sizes[row])], corpus)]
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([known, pa.array([""], known.type)]), *map(pa.array, columns)], ["token", "df", "cf", "dl_sum"])

    rows = docs.select(words_of(pattern).alias("w")).mapInArrow(count, "token string, df bigint, cf bigint, dl_sum bigint")
    return rows.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("df", "cf", "dl_sum")])


STATS_BLOCK = 2048  # documents counted at a time


def document_frequency(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(token, df, dl_sum), distinct words only: the cheaper pass when term totals are not needed.

    ``wanted``: (token) to keep, the corpus row included; other words are dropped before the shuffle.
    """
    words = words_of()
    rows = docs.select(words.alias("w")).select(
        F.size("w").alias("dl"), F.explode_outer(F.concat(F.array(F.lit("")), F.array_distinct("w"))).alias("token"))
    if wanted is not None:
        rows = rows.join(wanted, "token", "left_semi")
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("dl_sum"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, token, qtf): a repeated query token counts repeatedly."""
    return queries.select("query_id", F.explode_outer(T.tokens(F.col("text"))).alias("token")).where(
        "token IS NOT NULL").groupBy(
        "query_id", "token").agg(F.count(F.lit(1)).alias("qtf"))


def _weighted_terms(terms: DataFrame, queries: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, token, weight, avg_dl). Terms absent from the corpus drop out."""
    marks = queries.select("query_id", F.lit("").alias("token"), F.lit(0).cast("bigint").alias("qtf"))
    joined = terms.unionByName(marks).join(stats, "token")
    corpus = W.partitionBy("query_id")  # rows of one query text
    mark = F.col("token") == ""
    n = F.max(F.when(mark, F.col("df"))).over(corpus)
    total = F.max(F.when(mark, F.col("dl_sum"))).over(corpus)
    out = joined.select("query_id", "token", "qtf", "df", n.alias("n"), (total / n).alias("avg_dl")).where("qtf > 0")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    return out.select("query_id", "token", (F.col("qtf") * idf).alias("weight"), "avg_dl")


def query_matrix(weights: DataFrame) -> tuple[dict[str, int], list[int], np.ndarray] | None:
    """(token -> row, query ids, term × query matrix) of (query_id, token, weight) rows already known to be few."""
    rows = weights.select("query_id", "token", "weight").collect()
    tokens = sorted({r["token"] for r in rows})
    ids = sorted({r["query_id"] for r in rows})
    if not SB.fits(len(tokens), len(ids)):
        return None
    at, col = {t: i for i, t in enumerate(tokens)}, {q: j for j, q in enumerate(ids)}
    matrix = np.zeros((len(tokens), len(ids)))
    for r in rows:
        matrix[at[r["token"]], col[r["query_id"]]] = r["weight"]
    return at, ids, matrix


def _token_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", words_of().alias("w"))


def _matrix_top_k(terms: DataFrame, at: dict[str, int], ids: list[int], matrix: np.ndarray, k: int) -> DataFrame:
    """Best ``k`` positive products per query, from stored postings. ``terms``: (doc_id, token, x, scale)."""
    table = terms.sparkSession.createDataFrame(list(at.items()), "token string, idx int")  # the terms of the batch
    rows = terms.join(F.broadcast(table), "token").groupBy("doc_id").agg(  # at most one element per query term
        F.collect_list("idx").alias("idx"), F.collect_list("x").alias("x"), F.first("scale").alias("scale"))
    best = SB.best_per_task(rows, lambda part: SB.sparse_block(part.to_pandas(), len(matrix)) @ matrix, ids, k, SCORE_DIGITS, 0.0,
                            len(matrix))
    return top_k(best, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)


def bm25_scores(hits: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) for every pair that shares a term; the way for query batches beyond the bounds."""
    return hits.join(weights, "token").groupBy("query_id", "doc_id").agg(
        F.round(F.sum(F.col("weight") * F.col("x")), SCORE_DIGITS).alias("score"))


def bm25_search(docs: DataFrame, queries: DataFrame, k: int = 5, postings: DataFrame | None = None,
                stats: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, bm25_score, rank): score relative to the best of the query, positive only.

    Two passes over the documents: document frequencies of the query terms (an aggregate over the words of the batch
    only, unless ``stats`` has them), then the scores. A batch of measured size is scored by matrix products where the
    documents lie (``scoring_block``): neither texts nor pairs are shuffled, and a word that occurs in every document
    is no hot key. A larger batch, or one beyond the matrix bound, runs as shuffled joins, where AQE splits hot words.
    """
    terms = query_terms(queries)
    small = is_small(terms)
    if stats is None:
        corpus = queries.sparkSession.range(1).select(F.lit("").alias("token"))
        wanted = terms.select("token").distinct().unionByName(corpus)
        stats = document_frequency(docs, F.broadcast(wanted) if small else wanted)
    weights = _weighted_terms(terms, queries, stats)
    if small:
        weights = cut_lineage(weights)
    made = query_matrix(weights) if small else None
    order = [F.col("score").desc(), F.col("doc_id")]
    k1, b = K.BM25_K1, K.BM25_B
    if made is not None and postings is None:
        at, ids, matrix = made
        avg = weights.agg(F.max("avg_dl").alias("a")).first()["a"] or 1.0
        known = pa.array(list(at), type=pa.string())

        def score(part):
            tf, length = SB.count_block(part, known)
            return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[:, None] / avg)) @ matrix

        found = SB.best_per_task(_token_rows(docs), score, ids, k, SCORE_DIGITS, 0.0, len(at))
        best = top_k(found, ["query_id"], order, k)
    else:
        avg_dl = weights.agg(F.max("avg_dl").alias("a")).scalar()
        tf = F.col("tf")
        x = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
        hits = (postings if postings is not None else term_counts(docs)).withColumn("avg_dl", avg_dl).select(
            "doc_id", "token", x.alias("x"), F.lit(1.0).alias("scale"))
        best = _matrix_top_k(hits, *made, k) if made is not None else top_k(
            bm25_scores(hits, weights).where("score > 0"), ["query_id"], order, k)
    top = F.max("score").over(W.partitionBy("query_id"))  # at most k rows
    return best.select("query_id", "doc_id", (F.col("score") / (top + 1e-9)).alias("bm25_score"), "rank")


# --- Dense vectors ------------------------------------------------------------------------
QUERY_TILE = 16  # queries whose differences to a block of vectors are held at a time


def flat_search(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """Exact nearest neighbours by squared L2: (query_id, vec_id, distance, dense_score, rank).

    ``vectors``: (vec_id, embedding); ``queries``: (query_id, embedding). Queries go in blocks of about ``block``; each
    block meets the vectors where they lie, and a task sends on its best ``k`` per query. Distances are sums of squared
    differences for every number of queries, so that the block size cannot change a digit.
    """
    queries = cut_lineage(queries)  # counted and then used, but computed once
    blocks = max(1, -(-queries.count() // block))
    found = None
    for b in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = own.orderBy("query_id").collect()
        if rows or found is None:
            part = _nearest_in_block(vectors, rows, k)
            found = part if found is None else found.unionByName(part)
    ranked = top_k(found, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)
    return ranked.select("query_id", F.col("doc_id").alias("vec_id"), F.abs("score").alias("distance"), "rank").withColumn(
        "dense_score", 1.0 / (1.0 + F.col("distance")))


def _nearest_in_block(vectors: DataFrame, rows: list, k: int) -> DataFrame:
    q = np.array([r["embedding"] for r in rows], dtype=float)

    def score(part):
        e = np.stack(part.to_pandas()["embedding"].to_numpy()).astype(float)
        out = np.empty((len(e), len(q)))
        for at in range(0, len(q), QUERY_TILE):
            gap = e[:, None, :] - q[None, at:at + QUERY_TILE, :]
            out[:, at:at + QUERY_TILE] = -np.einsum("ijk,ijk->ij", gap, gap)
        return out

    return SB.best_per_task(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), score,
                            [int(r["query_id"]) for r in rows], k, SCORE_DIGITS)


TFIDF_WORD = r"[\p{L}\p{N}_]{2,}"


def fit_vocabulary(docs: DataFrame, size: int = K.TFIDF_FEATURES, stats: DataFrame | None = None) -> DataFrame:
    """The ``size`` most frequent terms of at least two characters with their idf.

    As fitting a vectorizer does, this reads the corpus once (or its ``term_stats``) and keeps the result: at most
    ``size`` rows.
    """
    stats = stats if stats is not None else term_stats(docs)
    rows = stats.where((F.length("token") >= 2) | (F.col("token") == "")).withColumn("kind", F.col("token") == "")
    best = top_k(rows, ["kind"], [F.col("cf").desc(), F.col("token")], size).select("token", "df").collect()
    n = next((r["df"] for r in best if r["token"] == ""), 0)
    schema = "token string, df bigint"
    terms = docs.sparkSession.createDataFrame([tuple(r) for r in best if r["token"] != ""], schema)
    return terms.select("token", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def tfidf_terms(texts: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, token, x): tf·idf over the vocabulary, which has at most 768 rows."""
    counts = term_counts(texts.select(F.col(key).alias("doc_id"), "text"), F.lit(TFIDF_WORD))
    return counts.join(F.broadcast(vocabulary), "token").select(
        "doc_id", "token", (F.col("tf") * F.col("idf")).alias("x"))


def _unit(terms: DataFrame) -> DataFrame:
    """Adds ``scale``, the inverse length of the text's vector (at most one row per vocabulary term)."""
    square = F.sum(F.col("x") * F.col("x")).over(W.partitionBy("doc_id"))
    return terms.withColumn("scale", 1.0 / F.sqrt(square))


def tfidf_search(docs: DataFrame, queries: DataFrame, k: int = 5, vocabulary: DataFrame | None = None) -> DataFrame:
    """Dense search in the TF-IDF fallback space: (query_id, doc_id, distance, rank, dense_score).

    Unit vectors give squared L2 = 2 - 2·dot. A text without vocabulary terms is the zero vector: at distance 1 from
    every unit vector and 0 from another zero vector. A batch of measured size is one matrix of at most 768 rows, and
    one pass over the documents without any shuffle of texts.
    """
    vocab = vocabulary if vocabulary is not None else fit_vocabulary(docs)
    q = _unit(tfidf_terms(queries, "query_id", vocab))
    q = cut_lineage(q.select(F.col("doc_id").alias("query_id"), "token", (F.col("x") * F.col("scale")).alias("weight")))
    n_queries = queries.limit(MAX_BATCH + 1).count()
    if n_queries <= MAX_BATCH and SB.fits(K.TFIDF_FEATURES, n_queries):
        best = _tfidf_by_matrix(docs, queries, q, vocab, k)
    else:
        best = _tfidf_by_joins(docs, queries, q, vocab, k)
    return best.withColumn("dense_score", 1.0 / (1.0 + F.col("distance")))


MAX_BATCH = 20_000


def _tfidf_by_matrix(docs: DataFrame, queries: DataFrame, q: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    idf = {r["token"]: r["idf"] for r in vocab.collect()}  # at most 768
    at = {t: i for i, t in enumerate(sorted(idf))}
    ids = sorted(r["query_id"] for r in queries.select("query_id").collect())  # at most MAX_BATCH
    col = {i: j for j, i in enumerate(ids)}
    matrix = np.zeros((len(at), len(ids)))
    for r in q.collect():
        matrix[at[r["token"]], col[r["query_id"]]] = r["weight"]
    scale, unit_query = np.array([idf[t] for t in at]), matrix.any(axis=0)
    known = pa.array(list(at), type=pa.string())

    def score(part):
        x = SB.count_block(part, known)[0] * scale
        norm = np.sqrt((x * x).sum(axis=1))
        unit_doc = norm > 0
        x[unit_doc] /= norm[unit_doc, None]
        apart = np.where(unit_doc[:, None] & unit_query[None, :], 2.0,
                         np.where(unit_doc[:, None] | unit_query[None, :], 1.0, 0.0))
        return 2.0 * (x @ matrix) - apart

    best = SB.best_per_task(_token_rows(docs), score, ids, k, SCORE_DIGITS, width=len(at))
    ranked = top_k(best, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)
    return ranked.select("query_id", "doc_id", F.greatest(-F.col("score"), F.lit(0.0)).alias("distance"), "rank")


def _tfidf_by_joins(docs: DataFrame, queries: DataFrame, q: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """The way for batches beyond the bound.

    Documents that share no term with a query all tie at distance 2 (or 1), and only the first of them by id can reach
    the top k, so they come from a list of at most 2k per kind instead of being paired with every query. A query with
    fewer than k scored documents has all of them in ``near``; one with k needs no such document.
    """
    d = _unit(tfidf_terms(docs, "doc_id", vocab)).withColumn("x", F.col("x") * F.col("scale"))
    best = top_k(bm25_scores(d, q).where("score > 0"), ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)
    near = best.select("query_id", "doc_id", F.round(2.0 - 2.0 * F.col("score"), SCORE_DIGITS).alias("distance"))
    units = q.select("query_id").distinct().withColumn("unit", F.lit(True))
    kinds = queries.select("query_id").join(units, "query_id", "left")
    fill = kinds.withColumn("l", _first_documents(docs, vocab, k).scalar()).select(
        "query_id", F.coalesce("unit", F.lit(False)).alias("q_unit"), F.explode_outer("l").alias("f"))
    fill = fill.select("query_id", "f.doc_id", (
        F.when(F.col("q_unit") & F.col("f.doc_unit"), 2.0)
        .when(F.col("q_unit") | F.col("f.doc_unit"), 1.0).otherwise(0.0)).alias("distance"))
    # A filled document that does score is either in ``near`` and dropped here, or behind k nearer ones.
    fill = fill.join(near.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return top_k(near.unionByName(fill), ["query_id"], ["distance", "doc_id"], k)


def _first_documents(docs: DataFrame, vocabulary: DataFrame, k: int) -> DataFrame:
    """One row with the first 2k documents inside and outside the vocabulary space, by id."""
    known = vocabulary.agg(F.collect_list("token").alias("t")).scalar()  # at most 768 words
    inside = F.arrays_overlap(F.regexp_extract_all(F.lower("text"), F.lit(TFIDF_WORD), F.lit(0)), known)
    rows = docs.select("doc_id", inside.alias("doc_unit"))
    first = top_k(rows, ["doc_unit"], ["doc_id"], 2 * k)
    return first.agg(F.collect_list(F.struct("doc_id", "doc_unit")).alias("l"))


# --- Fusion and reranking -----------------------------------------------------------------

def fuse(dense: DataFrame, sparse: DataFrame, docs: DataFrame, k: int = 20, dense_weight: float = K.DENSE_WEIGHT,
         sparse_weight: float = K.SPARSE_WEIGHT) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lists (query_id, doc_id, rank).

    Documents of equal text count as one and add up; the first dense hit names the result.
    """
    lists = dense.select("query_id", "doc_id", "rank", F.lit(0).alias("src"), F.lit(dense_weight).alias("wt")).unionByName(
        sparse.select("query_id", "doc_id", "rank", F.lit(1).alias("src"), F.lit(sparse_weight).alias("wt")))
    lists = cut_lineage(lists)  # measured and then used, but searched once
    key = F.sha2("text", 256).alias("key")
    if is_small(lists):  # only found texts get a digest
        with_text = docs.select("doc_id", "text").join(F.broadcast(lists), "doc_id").select(*lists.columns, key)
    else:
        with_text = lists.join(docs.select("doc_id", key), "doc_id")
    fused = with_text.groupBy("query_id", "key").agg(
        F.sum(F.col("wt") / (K.RRF_K + F.col("rank"))).alias("s"),
        F.min_by("doc_id", F.struct("src", "rank")).alias("doc_id"))
    scored = fused.select("query_id", "doc_id", F.round("s", 6).alias("hybrid_score"))
    return top_k(scored, ["query_id"], [F.col("hybrid_score").desc(), F.col("doc_id")], k)


def candidate_count(top_k_wanted: int) -> int:
    return max(4 * top_k_wanted, 20)


def hybrid_search(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Both searches and their fusion, on one set of term statistics.

    The statistics have one row per distinct word; they are written once (``cut_lineage``) since both searches use them.
    """
    stats = cut_lineage(term_stats(docs))
    dense = tfidf_search(docs, queries, k, fit_vocabulary(docs, stats=stats))
    sparse = bm25_search(docs, queries, k, stats=stats)
    return fuse(dense, sparse, docs, k)


def with_marks(found: DataFrame, docs: DataFrame, *marks: Column | str) -> DataFrame:
    """``found`` with columns of its documents. Those are computed for found documents only: the semi join comes first."""
    found = cut_lineage(found)
    ids = broadcast_if_small(found.select("doc_id").distinct())
    rows = docs.join(ids, "doc_id", "left_semi").select("doc_id", *marks)
    return found.join(broadcast_if_small(rows), "doc_id")


def boost_topics(candidates: DataFrame, preferred: Column) -> DataFrame:
    """×1.3 for candidates of a preferred topic. The order of the list is left as it is."""
    hit = F.coalesce(F.array_contains(preferred, F.col("topic")), F.lit(False))
    return candidates.withColumn("hybrid_score", F.when(hit, F.col("hybrid_score") * K.TOPIC_BOOST).otherwise(
        F.col("hybrid_score")))


def rerank(candidates: DataFrame, k: int = 5, floor: float = K.RERANK_FLOOR,
           reliability: float = K.RELIABILITY_WEIGHT, has_model: bool = True) -> DataFrame:
    """Order by .85·sigmoid(cross_encoder_score) + .15·credibility; below the floor only the first row stays.

    Candidates: (query_id, doc_id, credibility_score, cross_encoder_score). Without a model the credibility decides and
    there is no floor.
    """
    cred = F.coalesce(F.col("credibility_score"), F.lit(K.CREDIBILITY_MISSING))
    if not has_model:
        scored = candidates.withColumns({
            "cross_encoder_score": F.lit(0.0), "rerank_score": cred, "final_score": cred})
        return top_k(scored, ["query_id"], [F.col("final_score").desc(), F.col("doc_id")], k)
    ce = F.coalesce(F.col("cross_encoder_score"), F.lit(0.0))
    norm = sigmoid(ce)
    scored = candidates.withColumns({
        "cross_encoder_score": F.bround(ce, 4), "rerank_score": F.bround(norm, 4),
        "final_score": F.bround((1 - reliability) * norm + reliability * cred, 4)})
    ranked = top_k(scored, ["query_id"], [F.col("final_score").desc(), F.col("doc_id")], k)
    return ranked.where((F.col("rank") == 1) | (F.col("final_score") >= floor))


def adaptive_k(scores: DataFrame, keys: list[str], score: str, order: list, max_k: int = 10, min_k: int = 2,
               gap: float = 0.3) -> DataFrame:
    """Cut-off per key at the first large drop (elbow): (keys, k). Only the best ``max_k`` scores are looked at."""
    sizes = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    best = top_k(scores, keys, [F.col(score).desc(), *order], max_k, "_r")
    w = W.partitionBy(*keys).orderBy("_r")
    drop = (F.lag(score).over(w) - F.col(score)) / (F.first(score).over(w) + 1e-9)
    cut = best.withColumn("_drop", drop).where((F.col("_r") - 1 >= min_k) & (F.col("_drop") > gap)).groupBy(*keys).agg(
        (F.min("_r") - 1).alias("cut"))
    n = F.col("n")
    return sizes.join(cut, keys, "left").select(
        *keys, F.when(n <= min_k, n).otherwise(F.coalesce("cut", F.least(n, F.lit(max_k)))).cast("int").alias("k"))


def retrieve(docs: DataFrame, queries: DataFrame, k: int = 5, cross_scores: DataFrame | None = None) -> DataFrame:
    """Hybrid candidates, topic boost by intent, rerank, best ``k`` per query.

    ``docs`` needs topic and credibility_score. ``cross_scores``: (query_id, doc_id, cross_encoder_score) from a model
    outside this engine; without it the credibility orders the candidates.
    """
    found = hybrid_search(docs, queries, candidate_count(k)).drop("rank")
    config = queries.select("query_id", T.intent_config(T.intent(F.col("text"))["intent"])["preferred_topics"].alias("pt"))
    rows = with_marks(found, docs, "topic", "credibility_score").join(config, "query_id")
    rows = boost_topics(rows, F.col("pt")).drop("pt")
    if cross_scores is None:
        return rerank(rows.withColumn("cross_encoder_score", F.lit(0.0)), k, has_model=False)
    return rerank(rows.join(cross_scores, ["query_id", "doc_id"], "left"), k)


# --- Embedding cache ----------------------------------------------------------------------

def cache_lookup(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts with their cached embedding or NULL. ``cache``: (key, embedding), unique by key."""
    return texts.withColumn("key", T.cache_key(F.col("text"))).join(cache, "key", "left")


def cache_stats(lookups: DataFrame) -> DataFrame:
    hit = F.count("embedding")
    n = F.count(F.lit(1))
    return lookups.agg(
        hit.alias("hits"), (n - hit).alias("misses"),
        F.coalesce(F.bround(F.try_divide(hit.cast("double"), n), 3), F.lit(0.0)).alias("hit_rate"))


def cache_merge(cache: DataFrame, fresh: DataFrame, max_size: int | None = None) -> DataFrame:
    """Newest embedding per key (rows without one only count as a use). Both: (key, embedding, used_at). With ``max_size``
    only the most recently used keys."""
    both = cache.unionByName(fresh).groupBy("key").agg(
        F.max_by(F.col("embedding"), F.when(F.col("embedding").isNotNull(), F.col("used_at"))).alias("embedding"), F.max("used_at").alias("used_at"))
    return both if max_size is None else keep_first_rows(both, max_size, [F.col("used_at").desc_nulls_last(), F.col("key")])


def keep_first_rows(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows in an order that ends in a unique column. Rows are dealt out by ranges of the order; the driver
    sees the ranges' sizes only, and the rows of the one range that ``n`` falls into are numbered."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = cut_lineage(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    left, whole = n, []
    for r in sorted(ranged.groupBy("_range").count().collect()):
        if r["count"] > left:
            number = F.row_number().over(W.partitionBy("_range").orderBy(*order))
            part = ranged.where(F.col("_range") == r["_range"]).withColumn("_n", number).where(F.col("_n") <= left).drop("_n")
            return ranged.where(F.col("_range").isin(whole)).unionByName(part).drop("_range") if whole else part.drop("_range")
        left -= r["count"]
        whole.append(r["_range"])
    return ranged.drop("_range")
