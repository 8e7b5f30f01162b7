"""Conversations as one text that a deterministic parser takes back into the same turns.

    ### role:
    text</turn>

Inside roles and texts a backslash before ``\\``, ``#``, ``<`` or ``:`` stands for that character. A turn is first
rendered as it is and parsed again; if what comes back differs from the source, its control strings are escaped, and if
that does not suffice, its backslashes too. The last form always comes back, so every turn ends identical.

A turn's text holds no control string that is not escaped and ends with one, so a conversation parses as its turns do.
"""
from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

HEAD, COLON, END = "### ", ":\n", "</turn>\n"
TURN_END = "</turn>"
_MARK = re.compile(r"\\[\\#<:]|### |</turn>|:\n")

FORMATTED = "conv_id long, turn long, n long, rendered string, start long, loss_start long, loss_end long"
READ_BACK = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long")
ROWS_OUT = 2048


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """The turns of a rendered text as (role, text, start and end of the escaped text); None if it breaks the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(HEAD, at):
            return None
        role, at = _field(rendered, at + len(HEAD), COLON)
        if role is None:
            return None
        start = at
        text, at = _field(rendered, at, TURN_END)
        if text is None or not rendered.startswith("\n", at):
            return None
        turns.append((role, text, start, at - len(TURN_END)))
        at += 1
    return turns


def _field(rendered: str, at: int, closing: str) -> tuple[str | None, int]:
    """The unescaped field up to its closing mark. A header inside a field breaks the grammar."""
    parts = []
    for m in _MARK.finditer(rendered, at):
        mark = m.group()
        if mark[0] == "\\":
            parts.append(rendered[at:m.start()] + mark[1])
            at = m.end()
        elif mark == closing:
            return "".join(parts) + rendered[at:m.start()], m.end()
        elif mark != COLON:
            return None, at
    return None, at


def escape(text: str, level: int) -> str:
    if level == 2:
        text = text.replace("\\", "\\\\")
    if level:
        for mark in (HEAD, TURN_END, COLON):
            text = text.replace(mark, "\\" + mark)
    return text


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn as text and where its escaped content lies, at the first level of escaping that reads back identical."""
    for level in range(3):
        out = f"{HEAD}{escape(role, level)}{COLON}{escape(text, level)}{END}"
        turns = parse(out)
        if turns and len(turns) == 1 and turns[0][:2] == (role, text):
            return out, turns[0][2], turns[0][3]
    raise ValueError("a turn does not read back")  # cannot be: level 2 escapes every mark and every backslash


def _format(batches):
    conv, n, at = (), 0, 0
    for batch in batches:
        out = []
        for conv_id, turn, role, text, trained in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != (conv_id,):
                conv, n, at = (conv_id,), 0, 0
            rendered, start, end = render(role, text)
            out.append((conv_id, turn, n, rendered, at, at + start if trained else None, at + end if trained else None))
            n, at = n + 1, at + len(rendered)
            if len(out) == ROWS_OUT:
                yield _batch(out, FORMATTED)
                out = []
        if out:
            yield _batch(out, FORMATTED)


def _read_back(batches):
    conv = None
    for batch in batches:
        out = []
        for conv_id, rendered, start, loss_start, loss_end in zip(*(c.to_pylist() for c in batch.columns)):
            if conv is None or conv[0] != conv_id:
                if conv is not None:
                    out.append(_digest(conv))
                conv = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(rendered):
                conv[1] += 1
                conv[2].update(f"{role}\n{text}\n".encode())
            conv[5] += len(rendered)
            if loss_start is not None:
                # What the mask covers is the escaped content of one field.
                masked, _ = _field(rendered[loss_start - start:loss_end - start] + TURN_END, 0, TURN_END)
                conv[3] += len(masked)
                conv[4].update(masked.encode())
        if out:
            yield _batch(out, READ_BACK)
    if conv is not None:
        yield _batch([_digest(conv)], READ_BACK)


def _digest(conv):
    conv_id, n, turns, chars, loss, formatted = conv
    return conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), formatted


def _batch(rows, schema: str):
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [name for name, _ in fields])


def format_turns(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, turn, n (from 0), rendered, start, loss_start, loss_end: a row per turn, in order within a partition.

    The rendered pieces of a conversation, joined in order of n, are its text; start is the offset of a piece in it, and
    the loss span (code points of that text) covers the escaped content of turns of ``trained_role``, else null.

    Order is by turn, then role, then text; a null turn comes first. Null roles and texts are empty; rows whose conv_id
    is null form one conversation. Repeated rows are turns each. An empty table gives an empty result; further columns
    do not matter. A conversation streams through one task, turn by turn, so its length does not take memory.
    """
    text = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text")}
    rows = turns.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"),
                        text["role"].alias("role"), text["text"].alias("text"),
                        (text["role"] == trained_role).alias("trained"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_format, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what the parser recovers from ``format_turns``: conv_id, n_turns, turns_sha256 (role, newline,
    text, newline of each turn), loss_chars and loss_sha256 of the unescaped text under the mask, formatted_chars."""
    return formatted.select("conv_id", "rendered", "start", "loss_start", "loss_end").mapInArrow(_read_back, READ_BACK)
