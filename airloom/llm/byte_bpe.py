"""Byte-level BPE encoding and decoding with a public vocabulary.

Pre-tokenisation works on arrays. Each code point gets a symbol (its class, and for white space and apostrophes what
follows); each symbol is a function from the state of a small automaton to its next state. Those functions form a finite
monoid, so composing two is one table look-up, and an associative scan over the symbols (within blocks, over the blocks,
then both together) gives the state before every code point, hence the boundaries. No regular expression is run.

The slices between boundaries are looked up in a cache of merged pieces, which holds their ids as little-endian unsigned
32-bit integers; a piece that is not in it is merged by rank.

The pattern that the automaton states:
    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space not before a non-space|white space
"""
from __future__ import annotations

import base64
import functools
import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CACHE_PIECES = 400_000      # merged pieces that a worker remembers
CHUNK_CHARS = 1 << 19       # code points that are scanned together
WIDEST = 64                 # bytes of the pieces that are merged side by side
TOGETHER = 8192             # pieces that are merged side by side
BLOCK = 256                 # symbols that one row of the scan composes in sequence

# Classes of code points.
LETTER, NUMBER, OTHER, SPACE, BLANK, CLOSE = range(6)  # SPACE is U+0020, BLANK other white space, CLOSE ends a text
# Symbols of the automaton.
S_LETTER, S_NUMBER, S_OTHER, S_APOS1, S_APOS2, S_WHITE, S_LAST_SPACE, S_LAST_BLANK, S_CLOSE, S_NONE = range(10)
# States: a token has just ended, or one is open.
ENDED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, PREFIX, ONE_LEFT, TWO_LEFT = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token starts with this symbol."""
    if symbol == S_NONE:
        return state, False
    if symbol == S_CLOSE:
        return ENDED, True
    if symbol == S_LETTER:
        if state == TWO_LEFT:
            return ONE_LEFT, False
        if state == ONE_LEFT:
            return ENDED, False
        return IN_LETTERS, state not in (IN_LETTERS, PREFIX)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, PREFIX)
    if symbol in (S_OTHER, S_APOS1, S_APOS2):
        if state in (IN_OTHERS, PREFIX):
            return IN_OTHERS, False
        return {S_OTHER: IN_OTHERS, S_APOS1: ONE_LEFT, S_APOS2: TWO_LEFT}[symbol], True
    if symbol == S_WHITE:
        return IN_WHITE, state != IN_WHITE
    return (PREFIX if symbol == S_LAST_SPACE else ENDED), True


@functools.cache
def _monoid():
    """(id of each symbol's function, products, state from state, identity): the closure of the symbols' functions."""
    of_symbol = [tuple(_step(s, x)[0] for s in range(8)) for x in range(10)]
    known = dict.fromkeys(of_symbol)
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in of_symbol:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = None
                todo.append(h)
    number = {f: i for i, f in enumerate(known)}
    kind = np.uint8 if len(number) <= 256 else np.uint16
    product = np.array([[number[tuple(g[s] for s in f)] for g in known] for f in known], kind)
    starts = np.array([[_step(s, x)[1] for x in range(10)] for s in range(8)])
    return (np.array([number[f] for f in of_symbol], kind), product, np.array(list(known), np.uint8), starts,
            number[of_symbol[S_NONE]])


def _scan(functions: np.ndarray, product: np.ndarray, identity: int) -> np.ndarray:
    """Inclusive prefix products."""
    n = len(functions)
    if n <= BLOCK:
        out = functions.copy()
        for i in range(1, n):
            out[i] = product[out[i - 1], out[i]]
        return out
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, identity, functions.dtype)
    padded[:n] = functions
    by_column = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    for i in range(1, BLOCK):
        by_column[i] = product[by_column[i - 1], by_column[i]]
    before = np.full(rows, identity, functions.dtype)
    before[1:] = _scan(by_column[-1], product, identity)[:-1]
    return product[before[None, :], by_column].T.reshape(-1)[:n]


def symbols(classes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The automaton's symbols of code points with their classes; ``CLOSE`` stands behind every text."""
    out = np.array([S_LETTER, S_NUMBER, S_OTHER, S_WHITE, S_WHITE, S_CLOSE], np.uint8)[classes]
    last = np.zeros(len(out), bool)  # white space right before something else
    last[:-1] = classes[1:] <= OTHER
    out[last & (classes == SPACE)] = S_LAST_SPACE
    out[last & (classes == BLANK)] = S_LAST_BLANK
    at = np.flatnonzero(points[:-1] == ord("'"))
    one = points[at + 1]
    two = points[np.minimum(at + 2, len(points) - 1)]
    out[at[np.isin(one, [ord(c) for c in "stmd"])]] = S_APOS1
    pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    out[at[pair]] = S_APOS2
    return out


def boundaries(classes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Where tokens start, each CLOSE being one of its own."""
    of_symbol, product, function, starts, identity = _monoid()
    s = symbols(classes, points)
    states = np.zeros(len(s), np.uint8)
    states[1:] = function[:, ENDED][_scan(of_symbol[s], product, identity)[:-1]]
    return np.flatnonzero(starts[states, s])


@functools.cache
def class_table() -> np.ndarray:
    """The class of every code point, as the tokenizer library's own Unicode tables have it (1.1 million bytes)."""
    import tiktoken

    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        probe = tiktoken.Encoding("classes", pat_str=pattern, special_tokens={}, explicit_n_vocab=256,
                                  mergeable_ranks={bytes([b]): b for b in range(256)})
        members = bytes(probe.encode_ordinary(every)).decode()
        table[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    table[ord(" ")] = SPACE
    return table


class Merger:
    """Merges of a vocabulary: which two ids join to which, and the pieces that a worker remembers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.none = max(ranks.values(), default=0) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for word, rank in ranks.items():
            for i in range(1, len(word)):
                left, right = ranks.get(word[:i]), ranks.get(word[i:])
                if left is not None and right is not None:
                    pairs[left * (self.none + 1) + right] = rank
        self._table(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))
        every = np.arange(256)
        self.byte_ranks = self.rank_of(np.repeat(self.byte_ids, 256), self.byte_ids[np.tile(every, 256)])
        self.known: dict[str, bytes] = {}

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Pairs in a hash table, each in the first free slot from its own on."""
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.joined = np.full(1 << bits, -1), np.full(1 << bits, self.none, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            at = slot[left]
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[left[free]]  # of several for one slot, the last stays
            left = left[self.keys[at] != keys[left]]
            slot[left] = (slot[left] + 1) & self.last
        at = self._slot(keys)
        while len(left := np.flatnonzero(self.keys[at] != keys)):
            at[left] = (at[left] + 1) & self.last
        self.joined[at] = values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id (which is the rank) that two neighbours join to, ``none`` if they do not."""
        wanted = left * (self.none + 1) + right
        at = self._slot(wanted)
        found = self.keys[at]
        on = np.flatnonzero((found != wanted) & (found >= 0))
        while len(on):
            at[on] = slot = (at[on] + 1) & self.last
            found = self.keys[slot]
            on = on[(found != wanted[on]) & (found >= 0)]
        return self.joined[at]  # that of a free slot is ``none``

    def ids_of(self, pieces: list[str]) -> bytes:
        """The ids of the pieces one after the other, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, pieces))

    def learn(self, pieces: set[str]) -> None:
        """Merges the pieces that are not yet remembered."""
        fresh = [p for p in pieces if p not in self.known]
        if len(self.known) + len(fresh) > CACHE_PIECES:
            self.known.clear()
            fresh = list(pieces)
        self.known.update(zip(fresh, self.split([p.encode() for p in fresh])))

    def split(self, bodies: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        ids, sizes = self.flat(bodies)
        raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def flat(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and how many each piece has."""
        whole = np.fromiter(map(self.ranks.get, bodies, itertools.repeat(-1)), np.int64, len(bodies))
        widths = np.fromiter(map(len, bodies), np.int64, len(bodies))
        sizes, parts = np.ones(len(bodies), np.int64), []
        widths = np.where(whole >= 0, 0, np.where(widths > WIDEST, -1, np.maximum(widths + 15, 16) // 16 * 16))
        for width in np.flatnonzero(np.bincount(widths + 1)) - 1:
            at = np.flatnonzero(widths == width)
            if width == 0:
                parts.append((at, whole[at]))
            elif width < 0:
                merged = [np.array(_merge_long(bodies[i], self.ranks), np.int64) for i in at.tolist()]
                sizes[at] = [len(x) for x in merged]
                parts.append((at, np.concatenate(merged)))
            else:
                for some in np.split(at, range(TOGETHER, len(at), TOGETHER)):
                    ids, sizes[some] = self.merge([bodies[i] for i in some.tolist()], int(width))
                    parts.append((some, ids))
        begin, out = np.cumsum(sizes) - sizes, np.empty(sizes.sum(), np.int64)
        for at, ids in parts:
            n = sizes[at]
            out[np.arange(len(ids)) + np.repeat(begin[at] - np.cumsum(n) + n, n)] = ids
        return out, sizes

    def merge(self, bodies: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of at most ``width`` bytes, and how many each has. They are merged side by side: in each round
        every piece joins the neighbours of lowest rank, of equal ranks the leftmost, until no neighbours join."""
        n = np.fromiter(map(len, bodies), np.int64, len(bodies))
        raw = np.array(bodies, f"S{width}").view(np.uint8).reshape(-1, width)
        # A piece stands between ids that join with nothing; what is merged away leaves its place to none.
        wide = width + 2
        there = np.arange(width) < n[:, None]
        ids = np.full((len(bodies), wide), self.none)
        ids[:, 1:-1][there] = self.byte_ids[raw[there]]
        rank = np.full((len(bodies), wide), self.none, np.int32)
        pair = there[:, 1:]
        rank[:, 1:-2][pair] = self.byte_ranks[raw[:, :-1][pair].astype(np.int64) * 256 + raw[:, 1:][pair]]
        alive = np.zeros((len(bodies), wide), bool)
        alive[:, 1:-1] = there
        one, alive_one = ids.reshape(-1), alive.reshape(-1)
        after, before = np.arange(1, ids.size + 1), np.arange(-1, ids.size - 1)
        rows = np.arange(len(bodies))
        while len(rows):
            best = rank.argmin(1)
            value = rank[np.arange(len(rows)), best]
            go = value < self.none
            if not go.all():
                rows, best, value, rank = rows[go], best[go], value[go], rank[go]
                if not len(rows):
                    break
            at = rows * wide + best
            gone = after[at]
            right, left = after[gone], before[at]
            one[at], alive_one[gone] = value, False
            after[at], before[right] = right, at
            new = self.rank_of(np.concatenate([one[left], one[at]]), np.concatenate([one[at], one[right]]))
            here, first = np.arange(len(rows)) * wide, rows * wide
            cells = rank.reshape(-1)
            cells[here + (gone - first)] = self.none
            cells[here + (left - first)] = new[:len(rows)]
            cells[here + best] = new[len(rows):]
        return ids[alive], alive.sum(1)


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One long piece in n log n, by a heap of pairs over linked parts."""
    n = len(piece)
    end = list(range(1, n + 1))   # of the part that starts at i; 0 once it has been merged away
    before = list(range(-1, n - 1))
    heap = []

    def offer(a: int):
        b = end[a]
        if b < n:
            rank = ranks.get(piece[a:end[b]])
            if rank is not None:
                heapq.heappush(heap, (rank, a, b, end[b]))

    for i in range(n):
        offer(i)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if end[a] != b or end[b] != c:
            continue
        end[a], end[b] = c, 0
        if c < n:
            before[c] = a
            offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at:end[at]]])
        at = end[at]
    return out


@functools.cache
def _vocabulary(path: str) -> tuple[Merger, list[bytes]]:
    """A worker's merges and the bytes of each id."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    words: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
    for word, rank in ranks.items():
        words[rank] = word
    return Merger(ranks), words


def split_texts(texts: list[str], table: np.ndarray) -> list[tuple[str, list[int]]]:
    """For each text the string that it lies in, with its boundaries there, its end last."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    classes = table[points]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    classes[ends] = CLOSE
    points = points.copy()
    points[ends] = 0
    at = boundaries(classes, points)
    closes = np.searchsorted(at, ends)
    at, out, first = at.tolist(), [], 0
    for close in closes.tolist():
        out.append((joined, at[first:close + 1]))
        first = close + 1
    return out


def encode_texts(texts: list[str], table: np.ndarray, path: str, offsets: bool = False) -> list[tuple[bytes, list[int]]]:
    """Ids (little-endian unsigned 32-bit) of each text, and where its pieces start if asked for."""
    merger, out = _vocabulary(path)[0], []
    for joined, at in split_texts(texts, table):
        out.append(([joined[i:j] for i, j in zip(at, at[1:])], [x - at[0] for x in at] if offsets else []))
    merger.learn(set(itertools.chain.from_iterable(pieces for pieces, _ in out)))
    return [(merger.ids_of(pieces), at) for pieces, at in out]


def decode_ids(ids: bytes, path: str) -> bytes:
    return b"".join(map(_vocabulary(path)[1].__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _chunks(texts: list[str]):
    """(from, to) of texts that are worked on together; a longer text stands alone, whole."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > CHUNK_CHARS:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def _run(path: str, table, extra: str):
    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                done = encode_texts(texts[a:b], table.value, path, extra == "offsets")
                columns = {
                    "key": keys.slice(a, b - a), "n_tokens": pa.array([len(ids) // 4 for ids, _ in done], pa.int64()),
                    "ids": pa.array([ids for ids, _ in done], pa.binary())}
                if extra == "decoded":
                    columns["decoded"] = pa.array([decode_ids(ids, path) for ids, _ in done], pa.binary())
                elif extra == "offsets":
                    columns["offsets"] = pa.array([at for _, at in done], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    return run


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", extra: str = "") -> DataFrame:
    """key, n_tokens, ids (binary: little-endian unsigned 32-bit integers), and ``extra``.

    ``vocabulary`` is the path, on every machine, of a rank file. ``extra``: "decoded" adds the bytes decoded from the
    ids, "offsets" the code-point offsets of the pieces (the end last), so that part of a text can be decoded. Each text
    is encoded whole, without special tokens. A null text is an empty one, which has no ids. Rows are independent:
    repeated rows, null keys and further columns need no care, and an empty table gives an empty result.
    """
    kind = docs.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    table = docs.sparkSession.sparkContext.broadcast(class_table())
    schema = f"key {kind}, n_tokens long, ids binary" + {
        "": "", "decoded": ", decoded binary", "offsets": ", offsets array<long>"}[extra]
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_run(vocabulary, table, extra), schema).withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the decoded bytes of ``encode``'s ids; null ids decode to nothing."""
    kind = encoded.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = [decode_ids(x or b"", vocabulary) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["key", "decoded"])

    rows = encoded.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").alias("ids"))
    return rows.mapInArrow(run, f"key {kind}, decoded binary").withColumnRenamed("key", key)
