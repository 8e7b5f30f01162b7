"""Queries on stored tables that are written first: the keyword index and the embedding cache."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..session import cut_lineage
from ..sources import cache_store, term_index
from ..sources.tables import questions, table
from ..streaming.sink import work_folder
from .catalog import near, query
from .text_queries import BM25, docs

RANKED = """r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM bm WHERE score > 0)
SELECT query_id, doc_id, round(score / (top + 1e-9) + 1e-9, 5) AS bm25_score, rank FROM r WHERE rank <= 10"""


def _found(spark, sf, path) -> DataFrame:
    return term_index.search(spark, path, questions(spark, sf), 10).withColumn("bm25_score", near("bm25_score", 5))


@query("idx_search_stored", f"WITH {BM25}, {RANKED}")
def idx_search_stored(spark, sf):
    """All documents as one batch, searched by dictionary and blocks."""
    path = work_folder(spark)
    term_index.add(docs(spark, sf), path, "base")
    return _found(spark, sf, path)


@query("idx_append_search", f"WITH {BM25}, {RANKED}")
def idx_append_search(spark, sf):
    """Three batches, one of them written twice, merged after the second."""
    path = work_folder(spark)
    d = docs(spark, sf)
    part = lambda i: d.where(F.pmod("doc_id", F.lit(3)) == i)
    term_index.add(part(0), path, "a")
    term_index.add(part(1), path, "b")
    term_index.compact(spark, path)
    for _ in range(2):
        term_index.add(part(2), path, "c")
    return _found(spark, sf, path)


@query("idx_force_rebuild", f"WITH {BM25}, {RANKED}")
def idx_force_rebuild(spark, sf):
    """Every document is first stored with another text, and half of them then replaced twice over by a rebuild."""
    path = work_folder(spark)
    d = docs(spark, sf)
    odd = F.col("doc_id") % 2 == 1
    term_index.add(d.withColumn("text", F.when(odd, F.reverse("text")).otherwise(F.col("text"))), path, "base")
    term_index.rebuild(d.where(odd), path, "doc_id")
    return _found(spark, sf, path)


def _entries(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select(T.cache_key(F.col("text")).alias("key"), F.array(F.length("text").cast("double")).alias("embedding"),
                                             F.col("doc_id").alias("used_at"))
    return d.where("key IS NOT NULL")


CACHE = r"""e AS (SELECT substr(sha256(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))), 1, 24) AS key, length(text) AS size, doc_id AS used_at FROM documents WHERE text IS NOT NULL),
c AS (SELECT key, arg_max(size, used_at) AS size, max(used_at) AS used_at FROM e GROUP BY 1)"""


@query("cache_append", f"WITH {CACHE}, u AS (SELECT key, max(used_at + 1000000 * (used_at % 2)) AS last FROM e GROUP BY 1) SELECT key, size, last AS used_at FROM c JOIN u USING (key)")
def cache_append(spark, sf):
    """The texts' entries in ten appends (more than the folders that a generation lists), then a use of every odd one."""
    path = work_folder(spark)
    e = cut_lineage(_entries(spark, sf))
    for i in range(10):
        cache_store.append(e.where(F.pmod("used_at", F.lit(10)) == i), path)
    uses = e.where("used_at % 2 = 1").select("key", F.lit(None).cast("array<double>").alias("embedding"), (F.col("used_at") + 1_000_000).alias("used_at"))
    cache_store.append(uses, path)
    return cache_store.read(spark, path).select("key", F.col("embedding")[0].cast("bigint").alias("size"), "used_at")


@query("cache_evict", f"WITH {CACHE} SELECT key, size, used_at FROM (SELECT *, row_number() OVER (ORDER BY used_at DESC, key) AS n, count(*) OVER () AS rows FROM c) WHERE n <= rows // 3")
def cache_evict(spark, sf):
    """A third of the keys, the most recently used ones."""
    path = work_folder(spark)
    cache_store.append(_entries(spark, sf), path)
    cache_store.evict(spark, path, cache_store.read(spark, path).count() // 3)
    return cache_store.read(spark, path).select("key", F.col("embedding")[0].cast("bigint").alias("size"), "used_at")
