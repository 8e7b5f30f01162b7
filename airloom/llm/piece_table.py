"""Fill-in-middle as a piece table.

A document is a list of descriptors (buffer, start, length) over two immutable buffers: its text and the sentinels.
Cutting splits a descriptor, an arrangement permutes the parts and puts sentinel descriptors between them, and the inverse
permutation restores the text. Digests read the descriptors one after the other; a text is copied only where its rendered
form is asked for.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import only

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE  # the second buffer
TEXT, MARKS = 0, 1                    # numbers of the buffers

#: What stands in which order: a sentinel, then the part (0 prefix, 1 middle, 2 suffix) behind it.
ARRANGEMENTS = {
    "psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)),
    "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)),
}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_INNER = np.zeros(256, bool)  # bytes inside a code point
_INNER[0x80:0xC0] = True

Piece = tuple[int, int, int]


def token_starts(data: np.ndarray) -> np.ndarray:
    """Byte places where a token (a run of ASCII letters, or one other code point) starts."""
    letter = _LETTER[data]
    start = ~_INNER[data]
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start)


def cut(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The descriptors of what stands before byte ``at`` and from it on; the descriptor that holds it is split."""
    before, after = [], []
    for buffer, start, length in pieces:
        own = min(max(at, 0), length)
        if own:
            before.append((buffer, start, own))
        if own < length:
            after.append((buffer, start + own, length - own))
        at -= length
    return before, after


def arrange(parts: list[list[Piece]], form: str) -> list[Piece]:
    """The parts (prefix, middle, suffix) in the order of ``form``, each behind its sentinel."""
    out = []
    for mark, part in ARRANGEMENTS[form]:
        out.append((MARKS, SENTINELS.index(mark), len(mark)))
        out += parts[part]
    return out


def separate(data: bytes, form: str) -> list[Piece]:
    """Descriptors over a rendered text that restore the source: the inverse permutation of what lies between the
    sentinels. A text has none of its own, and none can arise where two pieces meet."""
    if form == "plain":
        return [(TEXT, 0, len(data))] if data else []
    order = ARRANGEMENTS[form]
    places = [data.index(mark) for mark, _ in order]
    ends = [*places[1:], len(data)]
    parts: dict[int, Piece] = {}
    for (mark, part), place, end in zip(order, places, ends):
        parts[part] = (TEXT, place + len(mark), end - place - len(mark))
    return [parts[p] for p in sorted(parts) if parts[p][2]]


def render(pieces: list[Piece], text: bytes) -> bytes:
    buffers = memoryview(text), memoryview(SENTINELS)
    return b"".join(buffers[b][s:s + n] for b, s, n in pieces)


def digest(pieces: list[Piece], text: bytes) -> str:
    """SHA-256 of the rendered text, without rendering it."""
    buffers = memoryview(text), memoryview(SENTINELS)
    out = hashlib.sha256()
    for b, s, n in pieces:
        out.update(buffers[b][s:s + n])
    return out.hexdigest()


def transform(text: bytes, h1: int, h2: int, h3: int, h4: int, plain_percent: int = 10, spm_percent: int = 20):
    """(tokens, form, code points of prefix and of middle, descriptors) of one text."""
    data = np.frombuffer(text, np.uint8)
    starts = token_starts(data)
    n = len(starts)
    whole = [(TEXT, 0, len(text))] if text else []
    if not n or h3 % 100 >= 100 - plain_percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, whole
    places = np.append(starts, len(text))
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    front, rest = cut(whole, int(places[first]))
    middle, back = cut(rest, int(places[last] - places[first]))
    form = "spm" if h4 % 100 < spm_percent else "psm"
    points = np.flatnonzero(~_INNER[data])
    a, b = np.searchsorted(points, [places[first], places[last]])
    return n, form, int(a), int(b - a), arrange([front, middle, back], form)


def _fim(plain_percent: int, spm_percent: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("_text")
            draws = list(zip(*(batch.column(f"_h{i}").to_pylist() for i in range(1, 5))))
            for a in range(0, len(texts), 256):  # what is rendered at a time
                rows = []
                for text, draw in zip(texts.slice(a, 256), draws[a:a + 256]):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    n, form, prefix, middle, pieces = transform(raw, *draw, plain_percent, spm_percent)
                    rows.append((n, form, prefix, middle, render(pieces, raw), digest(pieces, raw),
                                 [{"buffer": b, "start": s, "length": c} for b, s, c in pieces]))
                n, form, prefix, middle, output, sha, pieces = zip(*rows)
                kept = [batch.column(i).slice(a, 256) for i in range(batch.num_columns - 5)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                     pa.array(output, pa.binary()).cast(pa.string()), pa.array(sha),
                     pa.array(pieces, pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])))],
                    [*batch.schema.names[:-5], "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "pieces"])
    return run


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), seed: str = "1",
                   plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """``key``, ``keep``, n (tokens), form, prefix_chars, middle_chars, output, output_sha256, pieces of every document.

    The draws are the first four 8-digit groups of the SHA-256 of ``seed``:``key``; a null key counts as an empty one, so
    rows that repeat a key draw alike. Prefix and middle end after tokens; a text that is empty (or null) or holds a
    sentinel stays plain, and its counts of code points are null. ``pieces`` are places in bytes of the UTF-8 text (buffer
    0) and of ``SENTINELS`` (buffer 1). An empty table gives an empty result. Columns of ``keep`` must not have the names
    of the columns made; other columns of the input cannot clash. A text of any length is one row's work.
    """
    made = ["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "pieces"]
    clash = {c.lower() for c in (key, *keep)} & {*made, "_text", "_h1", "_h2", "_h3", "_h4"}
    if clash or len({c.lower() for c in (key, *keep)}) != 1 + len(keep):
        raise ValueError(f"names that are made or repeated: {sorted(clash) or keep}")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    rows = only(docs, *dict.fromkeys([key, *keep, text])).select(
        F.col(f"`{key}`"), *(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("_text"),
        *(F.conv(F.substring(drawn, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-5])
    return rows.mapInArrow(_fim(plain_percent, spm_percent),
                           f"{kinds}, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, pieces array<struct<buffer:int,start:long,length:long>>")


def _restore(batches):
    for batch in batches:
        outputs = batch.column("_output")
        forms = batch.column("_form").to_pylist()
        for a in range(0, len(outputs), 256):
            texts, digests = [], []
            for output, form in zip(outputs.slice(a, 256), forms[a:a + 256]):
                raw = output.as_buffer().to_pybytes() if output.is_valid else b""
                pieces = separate(raw, form or "plain")
                texts.append(render(pieces, raw))
                digests.append(digest(pieces, raw))
            kept = [batch.column(i).slice(a, 256) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digests)],
                                             [*batch.schema.names[:-2], "restored", "restored_sha256"])


def restore(formatted: DataFrame, keep: tuple[str, ...] = ("doc_id",), output: str = "output", form: str = "form") -> DataFrame:
    """``keep``, restored (the source text), restored_sha256, from a rendered text and its form alone. A null text is an
    empty one, a null form plain; a text that lacks a sentinel of its form fails. ``keep`` must not name the made columns."""
    if {c.lower() for c in keep} & {"restored", "restored_sha256", "_output", "_form"}:
        raise ValueError(f"names that are made: {keep}")
    rows = formatted.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{output}`").alias("_output"), F.col(f"`{form}`").alias("_form"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    return rows.mapInArrow(_restore, f"{kinds}{', ' if kinds else ''}restored string, restored_sha256 string")
