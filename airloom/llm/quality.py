"""Quality by compression: zstandard dictionaries from good and from bad labelled texts.

A text is compressed in chunks with either dictionary; the difference of the two compressed sizes, divided by their sum,
tells which kind it resembles. This is done twice, on the text and on its shape (letters folded to a or A, digits to 0),
since invented or rare words share no substrings while their layout does. A logistic curve over the two differences and
the compressed shares of the text, fitted on labelled texts that no dictionary has seen, makes them a probability.

Fitting takes a bounded sample of labelled rows (``SAMPLE_ROWS`` distinct texts a class, ``SAMPLE_CHUNKS`` chunks of
each); scoring takes every row, whole.
"""
from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SAMPLE_ROWS = 2000     # labelled texts per class that are fitted on
SAMPLE_CHUNKS = 8      # chunks of such a text
CHUNK = 1024           # bytes that are compressed together
WORDS, SHAPES = 1 << 15, 1 << 13  # bytes of a dictionary of texts, of shapes
LEVEL = 3

SHAPE = bytes(ord("A") if 65 <= b < 91 else ord("a") if 97 <= b < 123 or b >= 128 else ord("0") if 48 <= b < 58 else b
              for b in range(256))


@dataclass(frozen=True)
class Model:
    dictionaries: tuple[bytes, ...]  # good and bad texts, good and bad shapes; empty if there was nothing to learn from
    weights: tuple[float, ...]       # of the features, the constant last
    empty: float                     # log odds of label 1 among the labelled texts, for a text without features


@functools.lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[bytes, ...]):
    import zstandard

    made = []
    for content in dictionaries:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False,
                                             write_dict_id=False).compress)
    return made


def features(body: bytes, dictionaries: tuple[bytes, ...]) -> list[float]:
    """The normalised differences (bad less good, positive for good texts) of text and shape, then the share of its
    size that either compresses to, plain and squared; zeros for an empty text."""
    if not body or not all(dictionaries):
        return [0.0] * 6
    good, bad, good_shape, bad_shape = _compressors(dictionaries)
    a = b = c = d = 0
    for i in range(0, len(body), CHUNK):
        part = body[i:i + CHUNK]
        shape = part.translate(SHAPE)
        a += len(good(part))
        b += len(bad(part))
        c += len(good_shape(shape))
        d += len(bad_shape(shape))
    x, y = a / len(body), c / len(body)
    return [(b - a) / (a + b), (d - c) / (c + d), x, y, x * x, y * y]


def score_of(text: str, model: Model) -> float:
    z = model.empty
    if text:
        *weights, z = model.weights
        z += sum(w * x for w, x in zip(weights, features(text.encode(), model.dictionaries)))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def dictionary(chunks: list[bytes], size: int) -> bytes:
    """The substrings that stand for a class; the chunks themselves where there are too few to choose from."""
    import zstandard

    whole = b"".join(chunks)
    if len(whole) > 4 * size and len(chunks) >= 16:
        try:
            return zstandard.train_dictionary(size, chunks, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # the trainer finds nothing that repeats
            pass
    return whole[-size:]


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic curve by Newton steps, drawn a little to 0 so that separable data end; constant last."""
    width = x.shape[1]
    if not len(y) or y.min() == y.max():
        return (*[0.0] * width, log_odds(y))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, ridge = np.zeros(width + 1), np.array([0.1] * width + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return (*(w[:-1] / scale).tolist(), float(w[-1] - (w[:-1] * mean / scale).sum()))


def log_odds(y: np.ndarray) -> float:
    """Of label 1, one more of either label counted in."""
    return math.log((y.sum() + 1) / (len(y) - y.sum() + 1))


def fit(sample: list[tuple[list[str], int]]) -> Model:
    """From (chunks of a text, label): every other text of a class makes the dictionaries, the rest calibrate."""
    texts: dict[int, list[list[bytes]]] = {0: [], 1: []}
    for chunks, label in sample:
        texts[label].append([part for c in chunks for body in (c.encode(),)
                             for part in (body[i:i + CHUNK] for i in range(0, len(body), CHUNK))])
    own = {label: [c for body in bodies[::2] for c in body] for label, bodies in texts.items()}
    shapes = {label: [c.translate(SHAPE) for c in chunks] for label, chunks in own.items()}
    dictionaries = (*(dictionary(own[y], WORDS) for y in (1, 0)), *(dictionary(shapes[y], SHAPES) for y in (1, 0)))
    rest = [(b"".join(body), label) for label, bodies in texts.items() for body in bodies[1::2] if body]
    if {y for _, y in rest} != {0, 1}:
        rest = [(b"", label) for label, bodies in texts.items() for _ in bodies]
    x = np.array([features(body, dictionaries) for body, _ in rest]).reshape(-1, 6)
    y = np.array([label for _, label in rest], float)
    return Model(dictionaries, calibrate(x, y), log_odds(y))


def sample_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> list:
    """A bounded sample: of each class the ``rows`` labelled ids that come first in hash order, with chunks of their
    texts at evenly spread places; of equal texts one."""
    marked = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where(
        "id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    chosen = None
    for y in (0, 1):
        part = marked.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    n = F.greatest(F.ceil(F.length("body") / CHUNK).cast("int"), F.lit(1))
    taken = F.least(n, F.lit(SAMPLE_CHUNKS))
    chunks = F.transform(F.sequence(F.lit(0), taken - 1),
                         lambda i: F.substring("body", F.floor(i * n / taken).cast("int") * CHUNK + 1, F.lit(CHUNK)))
    bodies = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("body")).where("body is not null")
    # At most 2 x rows ids: a proven bound.
    found = bodies.join(F.broadcast(chosen), "id").groupBy(F.xxhash64("body").alias("same")).agg(
        F.min_by(F.struct(chunks.alias("chunks"), "y"), F.xxhash64("id")).alias("one"), F.min(F.xxhash64("id")).alias("at"))
    out = [(r.one.chunks, r.one.y) for r in found.orderBy("at", "same").collect()]
    return out


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          rows: int = SAMPLE_ROWS) -> Model:
    return fit(sample_rows(docs, labels, key, text, label, rows))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier) and predicted (1 from ``threshold`` on).

    A null or empty text gets the share of label 1 among the sampled texts; without labels of both classes every text
    does (a half without any). Columns of those names in the input are replaced. Rows are
    independent, so repeated rows and nulls need no care, and an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts):
        return texts.map(lambda t: score_of(t, sent.value)).astype("float64")

    value = scored(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    out = docs.drop("score", "predicted").withColumn("score", value)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2):
    """Rows that no label is learnt from."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % parts == part
