"""Documents into the index."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .chunking import chunk_pages


def new_pages(pages: DataFrame, indexed: DataFrame, force: bool = False) -> DataFrame:
    """Pages whose document name is not in the index yet. The name is the only key."""
    if force:
        return pages
    return pages.join(indexed.select("doc_name").distinct(), "doc_name", "left_anti")


def new_chunks(pages: DataFrame, indexed: DataFrame, force: bool = False) -> DataFrame:
    """Annotated chunks of the new pages; topic, year and credibility are kept."""
    return chunk_pages(new_pages(pages, indexed, force))


def snippet_chunks(snippets: DataFrame) -> DataFrame:
    """Free texts (name, text) as chunks; names are not checked against the index."""
    return chunk_pages(snippets.select(
        F.col("name").alias("doc_name"), F.lit(1).alias("page"), "text", F.lit("text").alias("source_type")))


def topic_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("topic").agg(F.count(F.lit(1)).alias("chunks"))
