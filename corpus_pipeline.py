"""From raw documents to token ids: quality, near-duplicates, repeated spans, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; all but the
last return the columns of documents. ``run`` writes each stage to the shared folder and reads it again for the next.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from airloom.llm import byte_bpe, decontaminate, near_dedup, quality, substring_dedup
from airloom.llm.common import read, store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject. It learns from the labels of the training part only."""
    model = quality.train(docs, read(spark, sf_dir, "labels").where(~quality.held_out()))
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of least doc_id."""
    return near_dedup.keep_first(docs).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words that earlier windows of 20 words repeat; a text that loses none stays as it is."""
    done = substring_dedup.dedup_spans(docs, keep=("text", "lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return done.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover less than a twentieth."""
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"), keep=("text", "lang", "source", "n_chars"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of what they decode to."""
    done = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), extra="decoded")
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontaminate", decontaminate_stage),
    ("byte_bpe", encode_stage),
]

#: The classifier, the alignment and the merges cannot be stated in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
