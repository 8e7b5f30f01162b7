"""Scores of documents against a batch of queries as matrix products inside the tasks.

Spark lays out the documents (one row each, with the terms they share with the batch); a task multiplies blocks of
them with the query matrix and keeps only its best ``k`` per query. Query-document pairs are therefore never rows: a
shuffle carries at most k rows per task and query, however many documents match.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK = 1024
BLOCK_CELLS = 2_000_000  # a block of wide rows has fewer of them, so that its matrix stays below 16 MB
MAX_MATRIX_BYTES = 256 * 1024 * 1024


def fits(n_terms: int, n_queries: int) -> bool:
    return n_terms * n_queries * 8 <= MAX_MATRIX_BYTES


def sparse_block(batch: pd.DataFrame, width: int) -> np.ndarray:
    """Rows (idx, x, scale) as a dense block; ``idx`` are unique per row."""
    out = np.zeros((len(batch), width))
    sizes = batch["idx"].map(len).to_numpy()
    if sizes.sum():
        row = np.repeat(np.arange(len(batch)), sizes)
        out[row, np.concatenate(batch["idx"].to_numpy())] = np.concatenate(batch["x"].to_numpy())
    return out * batch["scale"].to_numpy()[:, None]


def list_sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def places(words: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """Place of each word in the vocabulary, -1 for others."""
    return pc.fill_null(pc.index_in(words, value_set=vocabulary.cast(words.type)), -1).to_numpy(zero_copy_only=False)


def count_block(part: pa.RecordBatch, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts (rows × vocabulary) and lengths of the token arrays in ``w``. The words stay in Arrow's buffers; no Python
    string is made of them."""
    words = part.column("w")
    sizes = list_sizes(words)
    at = places(words.flatten(), vocabulary)
    cell = (np.repeat(np.arange(len(words)), sizes) * len(vocabulary) + at)[at >= 0]
    out = np.bincount(cell, minlength=len(words) * len(vocabulary)).astype(float)
    return out.reshape(len(words), len(vocabulary)), sizes.astype(float)


def pair_counts(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, and for each pair of a word and a row that has it: place of the word, row, how often), ordered by
    word and row."""
    coded = words.flatten().dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, n = np.unique(at * len(words) + np.repeat(np.arange(len(words)), list_sizes(words)), return_counts=True)
    return coded.dictionary, pairs // max(len(words), 1), pairs % max(len(words), 1), n


class Best:
    """The ``k`` highest scores per query of what was added, the lower doc_id first on a tie."""

    def __init__(self, query_ids: list[int], k: int, digits: int = 9, floor: float | None = None):
        self.ids, self.k, self.digits, self.floor = np.asarray(query_ids, dtype=np.int64), k, digits, floor
        self.score = [np.empty(0) for _ in query_ids]
        self.doc = [np.empty(0, dtype=np.int64) for _ in query_ids]

    def add(self, docs: np.ndarray, block: np.ndarray) -> None:
        """``block``: (documents × queries)."""
        block = np.round(block, self.digits)
        for j in range(len(self.ids)):
            column = block[:, j]
            hit = column > self.floor if self.floor is not None else np.ones(len(column), dtype=bool)
            if len(self.score[j]) == self.k:
                hit &= column >= self.score[j][-1]
            if hit.any():
                s = np.concatenate([self.score[j], column[hit]])
                d = np.concatenate([self.doc[j], docs[hit]])
                order = np.lexsort((d, -s))[:self.k]
                self.score[j], self.doc[j] = s[order], d[order]

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(query_id, doc_id, score)"""
        sizes = [len(d) for d in self.doc]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(self.ids, sizes)), pa.array(np.concatenate(self.doc)), pa.array(np.concatenate(self.score))],
                ["query_id", "doc_id", "score"])


BEST = "query_id bigint, doc_id bigint, score double"


def best_per_task(rows: DataFrame, score: Callable[[pa.RecordBatch], np.ndarray], query_ids: list[int], k: int,
                  digits: int = 9, floor: float | None = None, width: int = 1) -> DataFrame:
    """(query_id, doc_id, score): each task's ``k`` highest scores per query, the lower doc_id first on a tie.

    ``rows`` has doc_id and what ``score`` needs; ``score`` gets a block of them, which it may spread to ``width`` columns,
    and returns a (rows × queries) array. Scores not above ``floor`` are left out.
    """
    block = max(1, min(BLOCK, BLOCK_CELLS // max(width, len(query_ids), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(query_ids, k, digits, floor)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                best.add(part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), score(part))
        yield from best.rows()

    return rows.mapInArrow(run, BEST)
