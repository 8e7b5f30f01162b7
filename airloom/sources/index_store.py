"""The retrieval index: chunks with their vectors, and keyword postings, as Parquet tables in one folder.

Vector and metadata share a row. Postings are written sorted by token within hash partitions of the token, so a search
that filters on its terms reads only matching row groups. Corpus figures come from aggregates, never from a refit.
"""
from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import ingest, retrieval
from ..operators.bounds import broadcast_if_small
from ..session import cut_lineage


def save(chunks: DataFrame, path: str, batch: str = "base", partitions: int | None = None) -> DataFrame:
    """Write one batch of chunks (doc_id, text, metadata and optionally embedding) and its postings.

    A batch is its own folder and is overwritten as a whole, so a repeated run of the same batch leaves one copy.
    """
    folder = f"batch={batch}"
    chunks.write.mode("overwrite").parquet(f"{path}/chunks/{folder}")
    stored = chunks.sparkSession.read.parquet(f"{path}/chunks/{folder}")
    postings = retrieval.term_counts(stored)
    # Token and document both enter the hash, so the posting list of a common word spreads over all files.
    spread = postings.repartition(*([partitions] if partitions else []), "token", F.pmod(F.xxhash64("doc_id"), F.lit(32)))
    spread.sortWithinPartitions("token", "doc_id").write.mode("overwrite").parquet(f"{path}/postings/{folder}")
    return stored


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, postings); postings are rebuilt from the chunks when they are missing."""
    chunks = spark.read.parquet(f"{path}/chunks").drop("batch")
    try:
        postings = spark.read.parquet(f"{path}/postings").drop("batch")
    except AnalysisException:
        postings = retrieval.term_counts(chunks)
    return chunks, postings


def append(pages: DataFrame, path: str, batch: str | None = None, force: bool = False) -> DataFrame:
    """Chunk the documents that the other batches do not know and add them as a batch. Returns its chunks.

    Give a repeatable ``batch`` name where the call may be repeated (streams do). The first batch may be appended to
    nothing. ``force`` chunks all pages and rebuilds: what other batches hold of these documents is replaced.
    """
    batch = batch or uuid.uuid4().hex
    spark = pages.sparkSession
    try:
        indexed = spark.read.parquet(f"{path}/chunks").where(F.col("batch").cast("string") != batch)
    except AnalysisException:  # nothing stored yet
        indexed = spark.createDataFrame([], "doc_name string, batch string")
    if force:
        _forget(pages.select("doc_name").distinct(), indexed, path)
    fresh = ingest.new_chunks(pages, indexed, force)
    keyed = fresh.withColumn("doc_id", F.xxhash64("doc_name", "page", "chunk"))
    return save(keyed, path, batch)


def _forget(names: DataFrame, indexed: DataFrame, path: str) -> None:
    """Writes the batches that hold any of the named documents again without them."""
    touched = [r.batch for r in indexed.join(names, "doc_name", "left_semi").select(
        F.col("batch").cast("string").alias("batch")).distinct().collect()]
    for batch in touched:
        rest = indexed.where(F.col("batch").cast("string") == batch).drop("batch").join(names, "doc_name", "left_anti")
        save(cut_lineage(rest), path, batch)


def stats(postings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Term statistics with the corpus row (shape of ``retrieval.document_frequency``). Documents without any token
    have no posting but count as documents."""
    terms = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("dl_sum"))
    # The terms of a document add up to its length.
    each = chunks.select(F.lit(1).alias("df"), F.lit(0).cast("long").alias("n")).unionByName(
        postings.select(F.lit(0).alias("df"), F.col("tf").alias("n")))
    corpus = each.agg(F.sum("df").alias("df"), F.sum("n").alias("dl_sum")).select(F.lit("").alias("token"), "df", "dl_sum")
    return terms.unionByName(corpus)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5) -> DataFrame:
    """Keyword search on the stored index."""
    chunks, postings = load(spark, path)
    wanted = broadcast_if_small(retrieval.query_terms(queries).select("token").distinct())
    figures = stats(postings, chunks)
    return retrieval.bm25_search(chunks, queries, k, postings=postings.join(wanted, "token", "left_semi"), stats=figures)


def save_cache(entries: DataFrame, path: str) -> None:
    """Append embeddings (key, embedding, used_at) whose key is not stored yet, of repeated keys the newest."""
    spark = entries.sparkSession
    entries = entries.groupBy("key").agg(F.max_by("embedding", "used_at").alias("embedding"), F.max("used_at").alias("used_at"))
    try:
        known = spark.read.parquet(path).select("key")
        entries = entries.join(known, "key", "left_anti")
    except AnalysisException:  # nothing stored yet
        pass
    entries.write.mode("append").parquet(path)
