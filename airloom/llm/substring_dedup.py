"""Repeated spans of words over all documents, by de Bruijn compaction.

Windows of ``WINDOW`` words are the edges of a de Bruijn graph of token k-mers. Consecutive windows that share their
minimiser (the least hashed k-mer that they hold, leftmost) are one run: the start of a path that does not branch.
Equal windows have equal minimisers, so all that repeats meets under the same minimiser:

1. minimisers of two or more documents are counted; all other windows are unique and go no further;
2. runs of those minimisers compact to paths: equal runs are grouped, each with the first document that has it;
3. where paths of one minimiser differ (the graph branches there), the single edges of each path, from the one document
   that has it first, are grouped the same way;
4. joins take the first documents back to the places of runs and edges; a span that an earlier document has is removed,
   together with what the document itself repeats.

A set of hashes goes back to the scans as a bit table of a bounded size (``FILTER_BITS``) that may let more through, never
less; the exact joins decide. Keys are 128 bits wide (minimiser and window). A run stands for its windows in all
shuffles, and groups are combined before them, so that a passage in every document is one row a task.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import drop, store
from .token_hash import chunks, mix, run_hashes, sliding_least, word_hashes

WINDOW, KMER = 20, 8
KMER_BASE, WINDOW_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
FILTER_BITS = 1 << 29      # 64 MB at most
FILTER_PARTS = 64
ROWS_OUT = 50_000
FIRST_ID = -2 ** 63        # what a null doc_id counts as


class Windows:
    """Windows of the documents of a chunk: where they start, their hashes, and the runs that they form."""

    def __init__(self, texts: list, window: int = WINDOW, kmer: int = KMER):
        self.words = [(t or "").encode().split() for t in texts]
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(lengths)])
        hashes = word_hashes([w for words in self.words for w in words])
        kmers = run_hashes(hashes, kmer, KMER_BASE)
        every = run_hashes(hashes, window, WINDOW_BASE)
        doc = np.repeat(np.arange(len(texts)), np.maximum(lengths - window + 1, 0))
        first = np.repeat(np.cumsum(np.concatenate([[0], np.maximum(lengths - window + 1, 0)]))[:-1], np.maximum(lengths - window + 1, 0))
        self.doc, self.pos = doc, np.arange(len(doc)) - first  # of each window: its document, its first word
        at = self.begin[doc] + self.pos
        self.hash = every[at] if len(at) else np.zeros(0, np.uint64)
        if not len(at):
            self.run_start = self.run_size = np.zeros(0, np.int64)
            self.minimiser = np.zeros(0, np.uint64)
            return
        marked = (kmers >> np.uint64(32) << np.uint64(32)) | np.arange(len(kmers), dtype=np.uint64)
        least = (sliding_least(marked, window - kmer + 1)[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        self.run_start = np.flatnonzero(fresh)  # positions in the list of windows
        self.run_size = np.diff(np.append(self.run_start, len(at)))
        self.minimiser = kmers[least[self.run_start]]

    def path(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash of all words of runs: their first and last window, and how many windows."""
        return mix(self.hash[start] + mix(self.hash[start + size - 1] + size.astype(np.uint64)))


def _probes(hashes: np.ndarray, part_bits: int) -> list[np.ndarray]:
    low = hashes & np.uint64(0xFFFFFFFF)
    step = (hashes >> np.uint64(26)) | np.uint64(1)
    return [((low + np.uint64(i) * step) & np.uint64(part_bits - 1)).astype(np.int64) for i in range(4)]


def _part(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(58)).astype(np.int64)


def hash_filter(hashes: DataFrame) -> np.ndarray | None:
    """A bit table of the ``hash`` column, FILTER_PARTS x bytes; None if there are no hashes. Tasks fill its parts."""
    n = hashes.count()
    if not n:
        return None
    part_bits = min(FILTER_BITS, 1 << max(16, (16 * n - 1).bit_length())) // FILTER_PARTS

    def fill(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            h = np.asarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            part = _part(h)
            for p in np.unique(part).tolist():
                bits = held.setdefault(p, np.zeros(part_bits // 8, np.uint8))
                for at in _probes(h[part == p], part_bits):
                    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for p, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["part", "bits"])

    placed = hashes.select("hash").repartition(FILTER_PARTS, F.shiftrightunsigned("hash", 58))
    out = np.zeros((FILTER_PARTS, part_bits // 8), np.uint8)
    for row in placed.mapInArrow(fill, "part int, bits binary").toLocalIterator():
        out[row.part] = np.frombuffer(row.bits, np.uint8)
    return out


def _may_hold(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    part, found = _part(hashes), np.ones(len(hashes), bool)
    for at in _probes(hashes, table.shape[1] * 8):
        found &= (table[part, at >> 3] >> (at & 7)) & 1 == 1
    return found


def _scan(emit):
    """Runs ``emit(windows, ids, keys, marks)``, which gives arrays of columns, over chunks of (id, key, mark, text)."""
    def run(batches):
        for batch in batches:
            texts = batch.column(3).to_pylist()
            ids, keys, marks = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(3))
            for a, b in chunks(texts):
                columns = emit(Windows(texts[a:b]), ids[a:b], keys[a:b], marks[a:b])
                names = list(columns)
                for i in range(0, len(columns[names[0]]), ROWS_OUT):
                    yield pa.RecordBatch.from_arrays([pa.array(columns[c][i:i + ROWS_OUT]) for c in names], names)
    return run


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _emit_minimisers(w: Windows, ids, keys, marks) -> dict:
    doc = w.doc[w.run_start]
    order = np.lexsort((w.minimiser, doc))
    m, d = w.minimiser[order], doc[order]
    fresh = np.ones(len(m), bool)
    fresh[1:] = (m[1:] != m[:-1]) | (d[1:] != d[:-1])
    return {"hash": _signed(m[fresh])}


def _emit_runs(table):
    def emit(w: Windows, ids, keys, marks) -> dict:
        keep = _may_hold(table.value, w.minimiser)
        start, size = w.run_start[keep], w.run_size[keep]
        doc = w.doc[start]
        return {"m": _signed(w.minimiser[keep]), "path": _signed(w.path(start, size)), "id": ids[doc], "key": keys[doc],
                "span": w.pos[start] << 8 | size}
    return emit


def _emit_edges(table):
    def emit(w: Windows, ids, keys, marks) -> dict:
        keep = np.zeros(0, bool)
        if len(w.run_start):
            path = w.path(w.run_start, w.run_size)
            keep = _may_hold(table.value, path ^ marks[w.doc[w.run_start]].view(np.uint64))
        of_run = np.repeat(np.arange(len(w.run_start)), w.run_size)
        at = np.flatnonzero(keep[of_run])
        doc = w.doc[at]
        return {"m": _signed(w.minimiser[of_run[at]]), "path": _signed(w.hash[at]), "id": ids[doc], "key": keys[doc],
                "span": w.pos[at] << 8 | 1}
    return emit


FOUND = "m long, path long, id long, key long, span long"


def _finish(batches):
    """Removes the given spans and what a document repeats itself."""
    for batch in batches:
        texts, spans = batch.column(1).to_pylist(), batch.column(2)
        for first, last in chunks(texts):
            w = Windows(texts[first:last])
            out = []
            bounds = np.searchsorted(w.doc, np.arange(last - first + 1))
            for d, words in enumerate(w.words):
                n = len(words)
                own = w.hash[bounds[d]:bounds[d + 1]]
                edge = np.zeros(n + 1, np.int64)
                given = spans[first + d].values
                if given is not None and len(given):
                    packed = given.to_numpy()
                    np.add.at(edge, packed >> 8, 1)
                    np.add.at(edge, (packed >> 8) + (packed & 255) + WINDOW - 1, -1)
                if len(own) > 1:
                    again = np.ones(len(own), bool)
                    again[np.unique(own, return_index=True)[1]] = False
                    again = np.flatnonzero(again)
                    np.add.at(edge, again, 1)
                    np.add.at(edge, again + WINDOW, -1)
                gone = np.cumsum(edge)[:-1] > 0
                n_gone = int(gone.sum())
                if n_gone:
                    change = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    kept = b" ".join([words[i] for i in np.flatnonzero(~gone)])
                    removed = change.tolist()
                else:
                    kept, removed = b" ".join(words), []
                out.append((n, n_gone, kept.decode(), removed, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, last - first), *(pa.array(c, k) for c, k in zip(
                    zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string())))],
                ["key", "n_words", "n_removed", "kept", "removed", "kept_sha256"])


def _earlier(places: DataFrame, first: DataFrame) -> DataFrame:
    """id, key, span of the places whose (m, path) an earlier document has."""
    return places.join(first, ["m", "path"]).where("source < id").select("id", "key", "span")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """id, key, spans (array of packed long: first window << 8 | windows) that an earlier document has, from rows of
    (id, key, text)."""
    spark = rows.sparkSession
    rows = rows.select("id", "key", F.xxhash64("id").alias("mark"), "text")
    seen = rows.mapInArrow(_scan(_emit_minimisers), "hash long")
    repeated = store(seen.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    table = hash_filter(repeated)
    drop(repeated)
    if table is None:
        return spark.createDataFrame([], "id long, key long, spans array<long>")
    runs = store(rows.mapInArrow(_scan(_emit_runs(spark.sparkContext.broadcast(table))), FOUND))
    paths = store(runs.groupBy("m", "path").agg(F.min("id").alias("source"), F.count("*").alias("copies")))
    found = _earlier(runs, paths.where("copies > 1").drop("copies"))
    branching = paths.groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select("m")
    undecided = store(paths.join(branching, "m").select(F.col("path").bitwiseXOR(F.xxhash64("source")).alias("hash")))
    table = hash_filter(undecided)
    drop(undecided)
    if table is not None:
        edges = store(rows.mapInArrow(_scan(_emit_edges(spark.sparkContext.broadcast(table))), FOUND))
        first = edges.groupBy("m", "path").agg(F.min("id").alias("source"), F.count("*").alias("copies")).where("copies > 1")
        found = found.unionByName(_earlier(edges, first.drop("copies")))
    return found.groupBy("id", "key").agg(F.collect_list("span").alias("spans"))


def dedup_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``keep`` columns, n_words, n_removed, kept (the kept words joined by one space), removed (flat list of
    word positions from, to, from, to ...) and kept_sha256, a row per document.

    A word is removed if a window of 20 words that covers it starts earlier too: in a document of smaller id, or earlier
    in the same document; windows are those of the input. Words are split at ASCII white space. Null texts have no words.
    Documents of fewer than 20 words keep all. A null id counts as the smallest. Rows that repeat an id are no earlier
    than one another, so they keep what only they share. An empty table gives an empty result; columns that are not
    named do not appear.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    number = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(FIRST_ID))
    base = docs.select(number.alias("id"), F.xxhash64(body).alias("key"), body.alias("text"),
                       F.struct(F.col(f"`{key}`").alias("own"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep))).alias("kept_columns"))
    spans = repeated_spans(base.select("id", "key", "text"))
    joined = base.join(spans, ["id", "key"], "left").select("kept_columns", "text", "spans")
    kind = base.schema["kept_columns"].dataType.simpleString()
    done = joined.mapInArrow(_finish, f"key {kind}, n_words long, n_removed long, kept string, removed array<long>, kept_sha256 string")
    return done.select(F.col("key.own").alias(key), *(F.col(f"key.k{i}").alias(c) for i, c in enumerate(keep)),
                       "n_words", "n_removed", "kept", "removed", "kept_sha256")
