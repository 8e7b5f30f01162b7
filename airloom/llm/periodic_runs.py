"""Runs of repeated words by a dictionary of basic factors.

The factors of 1, 2, 4, ... words are named, each level from pairs of names of the one before; only factors that occur
again in their document are kept, so that the levels end where nothing repeats. The successor of an occurrence is the next
one of the same name. Successors within twice the length that follow each other at one distance form an arithmetic
progression, which proposes the distance as a period; the stretch is extended as far as the period holds, and what several
levels or progressions propose is kept once.

A factor of at least q words inside a run of smallest period q has its successor exactly q words on, and the level of the
least power of two that is q or more has three of them in a row in any run of four periods. So no such run is missed; and
a distance that proposes a stretch of two periods and more is its smallest period.

Documents are worked on side by side: a word is named with its document, so that no factor reaches over two.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import only
from .token_hash import chunks

LEAST_WORDS, LEAST_PERIODS = 6, 4
TOGETHER = 1 << 16  # words that one look ahead of an extension compares at most


def named(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Names of the words of all texts in a row (equal only within one text), the place where each text starts (and the
    end), and the words."""
    words = [t.split() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    numbers: dict[bytes, int] = {}
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for d in words for w in d), np.int64, int(starts[-1]))
    flat += np.repeat(np.arange(len(words), dtype=np.int64), np.diff(starts)) * (len(numbers) + 1)
    return flat, starts, words


def repeated(place: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of occurrences in the order of their places those whose name occurs again: (place, new dense name, and among all
    kept ones every occurrence that has a successor, with the distance to it)."""
    order = np.argsort(name, kind="stable")
    ordered = name[order]
    same = ordered[1:] == ordered[:-1]
    fresh = np.concatenate([[True], ~same])
    number = np.empty(len(name), np.int64)
    number[order] = np.cumsum(fresh)
    again = np.zeros(len(name), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    here, there = place[order[:-1][same]], place[order[1:][same]]
    return place[again], number[again], here, there - here


def progressions(here: np.ndarray, gap: np.ndarray, size: int, length: int, successor: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) where three successive occurrences stand at one distance: the stretch from the first to
    the end of the second, in which the period holds; neighbouring first ones of one distance are one stretch.
    ``successor`` is scratch space of zeros and comes back so."""
    near = gap <= 2 * length
    here, gap = here[near], gap[near]
    successor[here] = gap
    third = successor[np.minimum(here + gap, size - 1)] == gap
    first, period = here[third], gap[third]
    successor[here] = 0
    if not len(first):
        return np.zeros((0, 3), np.int64)
    order = np.argsort(first)
    first, period = first[order], period[order]
    cut = np.flatnonzero((np.diff(first) != 1) | (np.diff(period) != 0)) + 1
    a, b = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(first) - 1]])
    return np.stack([first[a], first[b] + period[a] + length, period[a]], 1)


def extend(found: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The stretches as far to both sides as their period holds."""
    start, end, period = (found[:, i].copy() for i in range(3))
    size = len(words)
    more = (end < size) & (words[np.minimum(end, size - 1)] == words[end - period])
    for i in np.flatnonzero(more).tolist():
        end[i] += _alike(words, int(end[i]), int(end[i] - period[i]), 1)
    more = (start > 0) & (words[start - 1] == words[np.minimum(start - 1 + period, size - 1)])
    for i in np.flatnonzero(more).tolist():
        start[i] -= _alike(words, int(start[i] - 1), int(start[i] - 1 + period[i]), -1)
    return np.stack([start, end, period], 1)


def _alike(words: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a on equal those from b on, in steps of ``step``."""
    done, look = 0, 16
    while True:
        n = min(look, len(words) - max(a, b)) if step > 0 else min(look, min(a, b) + 1)
        if n <= 0:
            return done
        if step > 0:
            differ = np.flatnonzero(words[a:a + n] != words[b:b + n])
        else:
            differ = np.flatnonzero(words[a - n + 1:a + 1][::-1] != words[b - n + 1:b + 1][::-1])
        if len(differ):
            return done + int(differ[0])
        done, a, b, look = done + n, a + step * n, b + step * n, min(2 * look, TOGETHER)


def runs(words: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, end, period) of all runs of ``least_periods`` (four at least) periods and ``least_words`` words, by
    start, then period. A run is not extended by a neighbouring word, and has no smaller period."""
    if least_periods < 4:
        raise ValueError("three successive occurrences of a factor are sure only in runs of four periods")
    size = len(words)
    place, name = np.arange(size), words
    successor = np.zeros(size, np.int64)
    at = np.full(size, -1, np.int64)
    found, length = [], 1
    while len(place):
        place, name, here, gap = repeated(place, name)
        met = progressions(here, gap, size, length, successor)
        if len(met):
            met = np.unique(extend(met, words), axis=0)
            found.append(met[met[:, 1] - met[:, 0] >= np.maximum(least_words, least_periods * met[:, 2])])
        # Factors of twice the length: pairs of names that stand side by side.
        at[place] = np.arange(len(place))
        second = at[np.minimum(place + length, size - 1)]
        second[place + length >= size] = -1
        at[place] = -1
        whole = second >= 0
        place, name = place[whole], name[whole] * (int(name.max(initial=0)) + 1) + name[second[whole]]
        length *= 2
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def dropped(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stand in a run behind its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def _runs(least_words: int, least_periods: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("_text")
            sizes = [(s.as_buffer().size if s.is_valid else 0) for s in texts]
            for a, b in chunks([range(n) for n in sizes]):
                raw = [s.as_buffer().to_pybytes() if s.is_valid else b"" for s in texts.slice(a, b - a)]
                words, starts, split = named(raw)
                found = runs(words, least_words, least_periods)
                doc = np.searchsorted(starts, found[:, 0], "right") - 1
                by_doc: list[list[tuple[int, int, int]]] = [[] for _ in raw]
                for d, (start, end, period) in zip(doc.tolist(), found.tolist()):
                    by_doc[d].append((start - int(starts[d]), end - start, period))
                kept = []
                for own, met in zip(split, by_doc):
                    gone = dropped(len(own), met) if met else None
                    kept.append(b" ".join(own if gone is None else [w for w, g in zip(own, gone.tolist()) if not g]))
                columns = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([len(w) for w in split], pa.int64()),
                     pa.array([[{"start": s, "length": n, "period": p} for s, n, p in met] for met in by_doc],
                              pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                     pa.array(kept, pa.binary()).cast(pa.string())],
                    [*batch.schema.names[:-1], "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (),
                  least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``key``, ``keep``, n_words, runs (array of start, length, period, by start, then period), collapsed (the words that
    are in no run, or in the first period of all runs that hold them, joined by a space) of every document.

    Words are split at ASCII white space. A null text is an empty one: no words, no runs, an empty collapsed text.
    Repeated rows and null keys are rows like any other; an empty table gives an empty result. Columns of ``keep`` must
    not have the names of the columns made; other columns of the input cannot clash. A text of any length is one row's
    work, in memory in proportion to its words.
    """
    clash = {c.lower() for c in (key, *keep)} & {"n_words", "runs", "collapsed", "_text"}
    if clash or len({c.lower() for c in (key, *keep)}) != 1 + len(keep):
        raise ValueError(f"names that are made or repeated: {sorted(clash) or keep}")
    rows = only(docs, *dict.fromkeys([key, *keep, text])).select(
        F.col(f"`{key}`"), *(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_runs(least_words, least_periods),
                           f"{kinds}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_repetition(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``text``, where one text in ten (by the CRC-32 of its key) goes over to a repetition: from word a on it
    repeats p words. Other texts stay as they are; so do those with a null key or no words."""
    h = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    body = F.col(f"`{text}`").cast("string")
    words = F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    drawn = docs.select(F.col(f"`{key}`").alias("_key"), body.alias("_body"), F.when(h % 10 == 0, words).alias("_words"), F.floor(h / 10).alias("_g"))
    n = F.size("_words")
    placed = drawn.select("_key", "_body", "_words", "_g", n.alias("_n"), F.when(n > 0, F.col("_g") % n).cast("int").alias("_a"))
    period = (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")
    placed = placed.withColumn("_p", period)
    repeats = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(
        F.get("_words", F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return placed.select(F.col("_key").alias(key), F.when(F.col("_n") > 0, F.array_join(repeats, " ")).otherwise(F.col("_body")).alias(text))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, n_runs, the longest run (ties: the smallest start, then period) and digests of all runs and of the
    collapsed text."""
    text = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    longest = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], (y["length"] > x["length"]).cast("int") * 2 - 1)
                           .when(x["start"] != y["start"], (x["start"] > y["start"]).cast("int") * 2 - 1)
                           .otherwise((x["period"] > y["period"]).cast("int") * 2 - 1))
    top = F.get(longest, F.lit(0))
    return found.select(
        F.col(f"`{key}`"), F.size("runs").cast("long").alias("n_runs"), *(top[c].alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * top["length"] / top["period"]).cast("long").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
