"""Log probabilities of texts under a small causal self-attention model on subword ids.

Words are split into the subwords of a public vocabulary. One attention layer, written and trained in numpy, reads the
first subword ids of the words before and predicts the class of the next word's first subword; within a class a word has
its share of the training counts, to which comes a share by its subwords, each after the one before it, up to the end of
the word: (count + R q) / (total + R), where R is how often words of fewer than ``ONCE`` occurrences stand in the class and
q the word's chance by its subwords. So every text has a probability and those of all words sum to one at most.

Counts of words and subwords come from all training documents, and so do the classes: each occurrence of a first subword
tells which frequent ones stand in the same piece of its text. The most frequent words (``DICTIONARY``) travel with their
counts; the counts of all others are joined after a task has scored its texts, and enter the same formula, so that the
size of the dictionary does not change a score. The attention weights start on a bounded sample (``WARM_DOCS``) and are
then trained on by every task, on all words of its training documents, and averaged.

A text is scored in windows of ``WIDTH`` words that overlap by ``OVERLAP``; a word is scored once, in the first window
that holds it, so it has at least the overlap as context.
"""
from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .byte_bpe import _vocabulary
from .common import store
from .token_hash import chunks

DICTIONARY = 200_000   # words whose counts travel to every task, the most frequent ones; all others are joined
SEEN = 200_000         # further words that a worker remembers at a time
CLASSES = 128          # of first subwords; the last is the end of a text
OWN_ROWS = 2048        # first subwords with an embedding of their own; others share that of their class
WIDTH, OVERLAP, DIM = 32, 8, 16
ANCHORS = 32           # most frequent first subwords, by which the others are classed
PIECE = 256            # words of a text that stand beside one another; a longer text is cut into pieces
WARM_DOCS, WARM_WORDS, WARM_STEPS = 2000, 256, 400
BATCH = 64             # windows of a training step
SCORE_BATCH = 64       # windows scored at a time; their logits stay in a core's cache
RATE = 4e-3
SETTLE = 100           # steps of a task after which its rate falls with the root of their number
PAIRS = 400_000        # neighbouring subwords of rare words that are known by their own counts, the most frequent ones
DISCOUNT, PRIOR = 0.75, 0.5
ONCE = 3               # words of fewer occurrences tell what unseen words are like
TRAIN_EVERY = 1024     # words of a text for each window of a sample (``_training_windows``)
END = b"\n"            # stands for the end of a text; no word holds white space
GROUP_BYTES = 4 << 20  # text whose words are looked up together where the order of texts does not matter
HANDED = 20_000        # distinct words that a task hands on in one batch


def text_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def coded_words(texts: list) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of all texts, which of them stands at each place, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(pa.array(texts, pa.large_string()), "")))
    words, end = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
    there = pc.greater(pc.binary_length(words), 0)  # white space at either end of a text leaves empty ones
    sizes = np.diff(np.append(0, np.cumsum(there.to_numpy(zero_copy_only=False)))[np.append(0, end)])
    coded = words.filter(there).dictionary_encode()
    return coded.dictionary.cast(pa.large_binary()), coded.indices.to_numpy(), sizes


def distinct_words(texts: list) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    words, at, sizes = coded_words(texts)
    return words.to_numpy(zero_copy_only=False).tolist(), at, sizes


# The model.

def shapes() -> dict[str, tuple[int, ...]]:
    return {"embed": (OWN_ROWS + CLASSES + 1, DIM), "place": (WIDTH, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM),
            "o": (DIM, DIM), "u": (DIM, CLASSES), "c": (CLASSES,)}


def initial(class_counts: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    w = {n: (rng.standard_normal(s) * (0.3 if n == "embed" else 0.1 if n == "place" else DIM ** -0.5)).astype(np.float32)
         for n, s in shapes().items()}
    w["u"] *= 0.3
    share = (class_counts + 1) / (class_counts.sum() + CLASSES)
    w["c"] = np.log(share).astype(np.float32)
    return w


MASK = np.triu(np.full((WIDTH, WIDTH), -1e9, np.float32), 1)
BEFORE = np.tril(np.ones((WIDTH, WIDTH), np.float32))
SAFE = 60              # exponentials of numbers up to this need no shift in single precision


class Room:
    """Arrays that one batch after the other is worked out in; new ones would be asked of the system for each."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], kind) -> np.ndarray:
        size = math.prod(shape)
        got = self.held.get(name)
        if got is None or got.dtype != kind or len(got) < size:
            got = self.held[name] = np.empty(size, kind)
        return got[:size].reshape(shape)


def _safe(x: np.ndarray) -> bool:
    return x.size == 0 or -SAFE < x.min() and x.max() < SAFE


def _joint(w: dict) -> np.ndarray:
    return np.concatenate([w["q"] * DIM ** -0.5, w["k"], w["v"]], 1)


def hidden(w: dict, rows: np.ndarray, room: Room):
    """What each place (windows x places) knows of what stands before, behind it a 1, as rows of one matrix; and what led
    to it."""
    count, n = rows.shape
    kind = w["embed"].dtype
    x = np.take(w["embed"], rows, 0, out=room("x", (count, n, DIM), kind), mode="clip")
    x += w["place"][:n]
    flat = x.reshape(-1, DIM)
    every = np.matmul(flat, _joint(w), out=room("qkv", (count * n, 3 * DIM), kind)).reshape(count, n, 3 * DIM)
    q, k, v = every[..., :DIM], every[..., DIM:2 * DIM], every[..., 2 * DIM:]
    a = np.matmul(q, k.transpose(0, 2, 1), out=room("a", (count, n, n), kind))
    if _safe(a):
        np.exp(a, out=a)
        a *= BEFORE[:n, :n]
    else:
        a += MASK[:n, :n]
        a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
    a /= (a.reshape(-1, n) @ np.ones(n, kind)).reshape(count, n, 1)
    z = np.matmul(a, v, out=room("z", (count, n, DIM), kind))
    h = room("h", (count * n, DIM + 1), kind)
    np.add(np.matmul(z.reshape(-1, DIM), w["o"], out=room("zo", (count * n, DIM), kind)), flat, out=h[:, :DIM])
    h[:, DIM] = 1
    return h, (x, q, k, v, a, z)


def _out(w: dict) -> np.ndarray:
    return np.concatenate([w["u"], w["c"][None]])


def class_logits(w: dict, h: np.ndarray, room: Room) -> np.ndarray:
    """Of each row of ``h``, shifted where exponentials would not fit."""
    logits = np.matmul(h, _out(w), out=room("logits", (len(h), CLASSES), h.dtype))
    if not _safe(logits):
        logits -= logits.max(1, keepdims=True)
    return logits


def forward(w: dict, rows: np.ndarray):
    """Logits of the class at each place (windows x places x classes) from the embedding rows of what stands before, and
    what led to them."""
    room = Room()
    h, made = hidden(w, rows, room)
    return (h @ _out(w)).reshape(*rows.shape, CLASSES), (*made, h[:, :DIM].reshape(*rows.shape, DIM))


def class_log_probabilities(w: dict, rows: np.ndarray, classes: np.ndarray, counted: np.ndarray | None = None,
                            room: Room | None = None) -> np.ndarray:
    """Of the classes at all places (windows x places), or of those at the ``counted`` ones only, in their order."""
    room = room or Room()
    h = hidden(w, rows, room)[0]
    if counted is not None:
        at = np.flatnonzero(counted)
        h = np.take(h, at, 0, out=room("counted", (len(at), DIM + 1), h.dtype), mode="clip")
        classes = classes.reshape(-1)[at]
    logits = class_logits(w, h, room)
    target = logits[np.arange(len(logits)), classes.reshape(-1)]
    np.exp(logits, out=logits)
    return (target - np.log(logits @ np.ones(CLASSES, h.dtype))).reshape(classes.shape)


def gradients(w: dict, rows: np.ndarray, classes: np.ndarray, weight: np.ndarray, room: Room | None = None) -> dict:
    """Of the mean negative log probability over places of weight 1."""
    room = room or Room()
    h, (x, q, k, v, a, z) = hidden(w, rows, room)
    count, n = rows.shape
    kind = h.dtype
    flat = lambda t: t.reshape(count * n, t.shape[-1])
    share = (weight / max(weight.sum(), 1)).reshape(-1).astype(kind)
    p = class_logits(w, h, room)
    np.exp(p, out=p)
    p *= (share / (p @ np.ones(CLASSES, kind)))[:, None]
    p[np.arange(len(p)), classes.reshape(-1)] -= share
    of_out = (p.T @ h).T
    g = {"u": of_out[:DIM], "c": of_out[DIM]}
    dh = np.matmul(p, w["u"].T, out=room("dh", (count * n, DIM), kind))
    g["o"] = flat(z).T @ dh
    dz = np.matmul(dh, w["o"].T, out=room("dz", (count * n, DIM), kind)).reshape(count, n, DIM)
    every = room("dqkv", (count, n, 3 * DIM), kind)
    np.matmul(a.transpose(0, 2, 1), dz, out=every[..., 2 * DIM:])
    ds = np.matmul(dz, v.transpose(0, 2, 1), out=room("ds", (count, n, n), kind))
    # The sum of ds * a over what is looked at is the product of dz and z.
    ds -= (np.multiply(dz, z, out=room("dzz", (count, n, DIM), kind)) @ np.ones(DIM, kind))[:, :, None]
    ds *= a
    np.matmul(ds, k, out=every[..., :DIM])
    np.matmul(ds.transpose(0, 2, 1), q, out=every[..., DIM:2 * DIM])  # q holds the scale of the products already
    joint = flat(x).T @ flat(every)
    g["q"], g["k"], g["v"] = joint[:, :DIM] * DIM ** -0.5, joint[:, DIM:2 * DIM], joint[:, 2 * DIM:]
    dx = np.matmul(flat(every), _joint(w).T, out=room("dx", (count * n, DIM), kind))
    dx += dh
    g["place"] = np.zeros_like(w["place"])
    g["place"][:n] = dx.reshape(count, n, DIM).sum(0)
    at = np.add(rows.reshape(-1, 1) * DIM, np.arange(DIM), out=room("at", (count * n, DIM), np.int64))
    g["embed"] = np.bincount(at.reshape(-1), dx.reshape(-1), w["embed"].size).reshape(w["embed"].shape).astype(w["embed"].dtype)
    return g


class Trainer:
    """Adam steps on batches of windows; all weights are parts of one array."""

    def __init__(self, weights: dict, rate: float):
        self.flat = np.concatenate([x.reshape(-1) for x in weights.values()])
        ends = np.cumsum([x.size for x in weights.values()]).tolist()
        self.w = {n: self.flat[end - x.size:end].reshape(x.shape) for (n, x), end in zip(weights.items(), ends)}
        self.m, self.s, self.g, self.part = (np.zeros_like(self.flat) for _ in range(4))
        self.rate, self.steps = rate, 0
        self.room = Room()

    def step(self, rows, classes, weight):
        self.steps += 1
        found = gradients(self.w, rows, classes, weight, self.room)
        g, m, s, part = np.concatenate([found[n].reshape(-1) for n in self.w], out=self.g), self.m, self.s, self.part
        m *= 0.9
        m += np.multiply(g, 0.1, out=part)
        s *= 0.99
        part *= g
        part *= 0.1
        s += part
        below = np.sqrt(np.multiply(s, 1 / (1 - 0.99 ** self.steps), out=g), out=g)
        below += 1e-6
        np.multiply(m, self.rate / (1 - 0.9 ** self.steps), out=part)
        part /= below
        self.flat -= part


# Words as numbers.

class Lexicon:
    """For every word: embedding row, class, log10 of its probability within the class, log10(count + 1); of words outside
    the dictionary as if they had no count, and log10 of what their subwords count for (``log_spelled``)."""

    def __init__(self, path: str, words: list[bytes], counts: np.ndarray, ends: int, stats: dict, spelled: tuple | None = None):
        self.merger = _vocabulary(path)[0]
        self.first_row, self.first_class = stats["row"], stats["class"]
        self._subword_model(stats)
        # A class holds its words by their counts, and behind them a share for all words by their subwords.
        self.base = len(words) + 1
        self.known: dict[bytes, int] = {w: i for i, w in enumerate(words)}
        self.known[END] = len(words)
        self.names = [*words, END]
        # Of the dictionary: worked out once, where the model is made.
        self.spelled = first, log_q = self._subwords(words) if spelled is None else spelled
        classes = np.append(self.first_class[first], CLASSES - 1)
        rare = np.bincount(self.first_class, stats["rare"], CLASSES) + 1.0
        self.total, self.rare = np.bincount(self.first_class, stats["all"], CLASSES) + rare, rare
        shape = self.base + SEEN
        self.cls = np.zeros(shape, np.int64)
        self.row = np.zeros(shape, np.int64)
        self.log_word = np.zeros(shape)
        self.log_count = np.zeros(shape)
        self.log_spelled = np.zeros(shape)
        b = self.base - 1
        self.cls[:self.base] = classes
        self.row[:b], self.row[b] = self.first_row[first], OWN_ROWS + CLASSES - 1
        c = classes[:-1]
        self.log_word[:b] = np.log10((counts + self.rare[c] * 10.0 ** log_q) / self.total[c])
        self.log_count[:b], self.log_count[b] = np.log10(counts + 1), np.log10(ends + 1)

    def _subword_model(self, stats):
        """Of rare words: the first subword within its class, and each next one (or the end of the word, as one more
        id) after the one before it: discounted pair counts, the rest by how often it comes next."""
        n = len(self.first_class)
        first, later = stats["first"] + 0.1, stats["later"] + 0.1
        mass = np.bincount(self.first_class, first, CLASSES)
        self.log_first = np.log10(first / mass[self.first_class])
        self.next = later / later.sum()
        self.pairs, counts = stats["pairs"], stats["pair_counts"]
        before = self.pairs // (n + 1)
        after = stats["first"] + stats["later"][:n] + PRIOR
        self.own = np.maximum(counts - DISCOUNT, 0) / after[before]
        self.left = 1 - np.bincount(before, self.own, n)
        self.pairs = np.append(self.pairs, np.iinfo(np.int64).max)
        self.own = np.append(self.own, 0.0)

    def _subwords(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First subword of each word, and log10 of the word's probability by its subwords among all words of its class."""
        ids, begin, after = subwords_of(self.merger, words, len(self.first_class))
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0)
        code = ids * (len(self.first_class) + 1) + after
        at = np.searchsorted(self.pairs, code)
        p = np.where(self.pairs[at] == code, self.own[at], 0) + self.left[ids] * self.next[after]
        first = ids[begin]
        return first, self.log_first[first] + np.add.reduceat(np.log10(p), begin)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        numbers = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            fresh = list(dict.fromkeys(words[i] for i in new.tolist()))
            if len(self.names) > self.base and len(self.names) + len(fresh) > self.base + SEEN:
                for w in self.names[self.base:]:
                    del self.known[w]
                del self.names[self.base:]
                return self.numbers(words)
            a, b = len(self.names), len(self.names) + len(fresh)
            if b > len(self.cls):  # a long text with more words than are remembered
                for n in ("cls", "row", "log_word", "log_count", "log_spelled"):
                    old = getattr(self, n)
                    setattr(self, n, np.concatenate([old, np.zeros(b - len(old), old.dtype)]))
            first, log_q = self._subwords(fresh)
            c = self.first_class[first]
            self.cls[a:b], self.row[a:b] = c, self.first_row[first]
            self.log_spelled[a:b] = log_q + np.log10(self.rare[c])
            self.log_word[a:b] = self.log_spelled[a:b] - np.log10(self.total[c])
            self.known.update(zip(fresh, range(a, b)))
            self.names += fresh
            numbers[new] = [self.known[words[i]] for i in new.tolist()]
        return numbers


def text_numbers(lexicon: Lexicon, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts, an end behind those of each, and how many each text has."""
    words, at, sizes = distinct_words(texts)
    numbers = lexicon.numbers([*words, END])
    sizes = sizes + 1
    out = np.full(sizes.sum(), numbers[-1])
    inner = np.ones(len(out), bool)
    inner[np.cumsum(sizes) - 1] = False
    out[inner] = numbers[at]
    return out, sizes


def subwords_of(merger, words: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subword ids of all words, where each word begins, and what follows each id, ``end`` at the end of a word."""
    ids, sizes = merger.flat(words)
    ends = np.cumsum(sizes)
    after = np.append(ids[1:], end) if len(ids) else ids.copy()
    after[ends - 1] = end
    return ids, np.concatenate([[0], ends])[:-1].astype(np.int64), after


def windows_of(n: int):
    """Windows over a text of n places: (starts, first scored place of each)."""
    starts = np.arange(0, max(n - OVERLAP, 1), WIDTH - OVERLAP)
    return starts, np.where(starts == 0, 0, OVERLAP)


def score_texts(weights: dict, numbers: list[np.ndarray], lexicon: Lexicon) -> list[float]:
    """log10 probability of each text (word numbers, the end last)."""
    return score_numbers(weights, np.concatenate(numbers), np.array([len(x) for x in numbers]), lexicon).tolist()


def score_numbers(weights: dict, numbers: np.ndarray, sizes: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """log10 probability of each text; ``numbers`` are those of all texts, ``sizes`` how many each has, the end included."""
    end = np.cumsum(sizes)
    begin = end - sizes
    rows, classes = np.zeros(len(numbers) + WIDTH, np.int64), np.zeros(len(numbers) + WIDTH, np.int64)
    rows[1:len(numbers)] = lexicon.row[numbers[:-1]]
    rows[begin] = OWN_ROWS + CLASSES
    classes[:len(numbers)] = lexicon.cls[numbers]
    # A text has the first ones of the longest text's windows.
    starts, first = windows_of(int(sizes.max()))
    windows = np.searchsorted(starts, np.maximum(sizes - OVERLAP, 1))
    text = np.repeat(np.arange(len(sizes)), windows)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    where, skip, ends = begin[text] + starts[nth], first[nth], end[text]
    out = np.bincount(np.repeat(np.arange(len(sizes)), sizes), lexicon.log_word[numbers], len(sizes))
    places, room = np.arange(WIDTH), Room()
    for a in range(0, len(where), SCORE_BATCH):
        at = where[a:a + SCORE_BATCH, None] + places
        counted = (places >= skip[a:a + SCORE_BATCH, None]) & (at < ends[a:a + SCORE_BATCH, None])
        log_p = class_log_probabilities(weights, rows[at], classes[at], counted, room)
        out += np.bincount(np.repeat(text[a:a + SCORE_BATCH], counted.sum(1)), log_p, len(sizes)) / np.log(10)
    return out


# Spark.

def _count(batches):
    """word, n: the words of some texts at a time and their ends; Spark adds them up within the task and over all."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in chunks(texts, GROUP_BYTES):
            words, at, _ = coded_words(texts[a:b])
            n = pa.array(np.append(np.bincount(at, minlength=len(words)), b - a))
            words = pa.concat_arrays([words, pa.array([END], pa.large_binary())])
            for first in range(0, len(words), HANDED):
                some = words.slice(first, HANDED).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([some, n.slice(first, HANDED)], ["word", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """word (bytes), n: every word of all texts, and the end of each."""
    return texts.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


FIRST_ALL, RARE, FIRST, LATER, PAIR = range(5)


def _subword_counts(path: str, least: int):
    """kind, id, n: occurrences of words by their first subword (FIRST_ALL), of words of fewer occurrences than ``least``
    (RARE); of the latter, each counted once, first subwords, later ones (the end of a word is one more id) and pairs."""
    def run(batches):
        merger, names = _vocabulary(path)
        size = len(names)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), np.asarray(batch.column(1).to_numpy(), np.float64)
            ids, begin, after = subwords_of(merger, words, size)
            rare = n < least
            of_rare = np.repeat(rare, np.diff(np.append(begin, len(ids))))
            first = ids[begin]
            for kind, at, weight in (
                    (FIRST_ALL, first, n), (RARE, first[rare], n[rare]), (FIRST, first[rare], None),
                    (LATER, after[of_rare], None), (PAIR, (ids * (size + 1) + after)[of_rare], None)):
                found, where = np.unique(at, return_inverse=True)
                total = np.bincount(where, weight, len(found)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), kind, np.int32)), pa.array(found), pa.array(total)], ["kind", "id", "n"])
    return run


def dictionary_threshold(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` rows reach."""
    by_size = counts.groupBy(F.least(F.col("n").cast("long"), F.lit(1_000_000)).alias("n")).agg(F.count("*").alias("rows"))
    held, least = 0, 1_000_001
    for row in by_size.orderBy(F.desc("n")).toLocalIterator():
        if held + row.rows > most:
            break
        held, least = held + row.rows, row.n
    return least


FIELD = 17             # bits of a count; three counts fit into one whole number in double precision


def first_subwords(path: str, words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """First subword of each word, of some ``known`` already."""
    first = np.fromiter(map(known.get, words, itertools.repeat(-1)), np.int64, len(words))
    new = np.flatnonzero(first < 0)
    merger, names = _vocabulary(path)
    ids, begin, _ = subwords_of(merger, [words[i] for i in new.tolist()], len(names))
    first[new] = ids[begin]
    return first


def add_beside(of_word: np.ndarray, at: np.ndarray, sizes: np.ndarray, number: np.ndarray, out: np.ndarray) -> None:
    """Adds to ``out`` (subwords x anchors), for each place of the texts, which anchors its piece holds. ``of_word`` has the
    first subword of each word, ``at`` the word at each place, ``sizes`` the places of each text, ``number`` the anchor
    that a subword is, or -1."""
    pieces = -(-sizes // PIECE)
    within = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    piece = np.repeat(np.cumsum(pieces) - pieces, sizes) + within // PIECE
    anchor = number[of_word][at]
    held = np.flatnonzero(anchor >= 0)
    width = -(-ANCHORS // 3) * 3
    present = np.zeros((width, pieces.sum()))
    present[anchor[held], piece[held]] = 1
    packed = present[0::3] + present[1::3] * 2.0 ** FIELD + present[2::3] * 4.0 ** FIELD
    ids, own = np.unique(of_word, return_inverse=True)
    row, most = own[at], 2 ** FIELD - 1
    for a in range(0, len(at), most):
        part = slice(a, a + most)
        for k, x in enumerate(packed):
            sums = np.bincount(row[part], x[piece[part]], len(ids)).astype(np.int64)
            for j in range(3 * k, min(3 * k + 3, ANCHORS)):
                out[ids, j] += sums & most
                sums >>= FIELD


BESIDE = [f"a{i}" for i in range(ANCHORS)]


def _beside(sent):
    """id, a0, a1, ...: of the occurrences of a first subword, how many stand in a piece that holds each of the anchors."""
    def run(batches):
        path, anchors, known = sent.value
        size = len(_vocabulary(path)[1])
        number = np.full(size, -1)
        number[anchors] = np.arange(len(anchors))
        together = np.zeros((size, ANCHORS), np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts, GROUP_BYTES):
                words, at, sizes = distinct_words(texts[a:b])
                add_beside(first_subwords(path, words, known), at, sizes, number, together)
        ids = np.flatnonzero(together.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, together[ids].T)], ["id", *BESIDE])
    return run


def beside_anchors(texts: DataFrame, path: str, first: np.ndarray, words: list[bytes]) -> np.ndarray:
    """How often each first subword stands beside each of the most frequent ones (subwords x anchors), over every word of
    all texts; ``first`` has the occurrences of each. The first subwords of ``words`` are sent along."""
    known = dict(zip(words, first_subwords(path, words, {}).tolist()))
    sent = texts.sparkSession.sparkContext.broadcast((path, by_frequency(first)[:ANCHORS], known))
    counted = texts.mapInArrow(_beside(sent), ", ".join(f"{c} long" for c in ["id", *BESIDE]))
    found = counted.groupBy("id").agg(*(F.sum(c).alias(c) for c in BESIDE)).toArrow()  # at most the vocabulary
    sent.unpersist()
    out = np.zeros((len(first), ANCHORS))
    out[found.column("id").to_numpy()] = np.stack([found.column(c).to_numpy() for c in BESIDE], 1)
    return out


def by_frequency(first: np.ndarray) -> np.ndarray:
    return np.argsort(-first, kind="stable")


def class_tables(first: np.ndarray, together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(embedding row, class) of each first subword: the most frequent have their own; the others are classed by the
    frequent ones that they stand beside (``beside_anchors``) more than expected, so that a class keeps to a language or
    kind of text."""
    order = by_frequency(first)
    own = CLASSES - ANCHORS - 1
    classes = np.empty(len(first), np.int64)
    usual = together.sum(0) / max(together.sum(), 1)
    classes[:] = own + np.argmax(together / (together.sum(1, keepdims=True) + 1) - usual, 1)
    classes[order[:own]] = np.arange(own)
    row = OWN_ROWS + classes
    row[order[:OWN_ROWS]] = np.arange(OWN_ROWS)
    return row, classes


_MADE: dict[str, Lexicon] = {}


def _made(sent) -> tuple[Lexicon, dict]:
    """A worker's lexicon of a broadcast model, made once."""
    model = sent.value
    if model["name"] not in _MADE:
        _MADE.clear()
        _MADE[model["name"]] = Lexicon(model["path"], model["words"], model["counts"], model["ends"], model["stats"], model["spelled"])
    return _MADE[model["name"]], model["weights"]


def every_window(lexicon: Lexicon, texts: list):
    """Windows over all words of the texts and their ends, each word the target of one place, in an order drawn anew for
    each group of texts (the same one for the same number of windows)."""
    numbers, size = text_numbers(lexicon, texts)
    end = np.cumsum(size)
    windows = -(-size // WIDTH)
    text = np.repeat(np.arange(len(size)), windows)
    at = (end - size)[text] + (np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)) * WIDTH
    order = np.random.default_rng(len(at)).permutation(len(at))
    at, last = at[order], end[text[order]]
    before = np.empty(len(numbers), np.int64)
    before[1:] = lexicon.row[numbers[:-1]]
    before[end - size] = OWN_ROWS + CLASSES
    place = at[:, None] + np.arange(WIDTH)
    there = place < last[:, None]
    place[~there] = 0
    return np.where(there, before[place], 0), np.where(there, lexicon.cls[numbers][place], 0), there.astype(np.float32)


def _training_windows(lexicon: Lexicon, texts: list, ids: list):
    """A window of every ``TRAIN_EVERY`` words of each text (one at least), at a place that its id decides: a sample for
    trials. ``train`` learns from ``every_window``."""
    import zlib

    cut = []
    for text, i in zip(texts, ids):
        words = [*text_words(text), END]
        for part in range(0, len(words), TRAIN_EVERY):
            room = min(TRAIN_EVERY, len(words) - part) - WIDTH // 2
            at = part + zlib.crc32((str(i) if part == 0 else f"{i}:{part}").encode()) % max(1, room)
            cut.append((at, words[max(at - 1, 0):at + WIDTH]))
    rows = np.zeros((len(cut), WIDTH), np.int64)
    classes = np.zeros((len(cut), WIDTH), np.int64)
    weight = np.zeros((len(cut), WIDTH), np.float32)
    numbers = lexicon.numbers([w for _, words in cut for w in words])
    first = 0
    for t, (at, words) in enumerate(cut):
        x = numbers[first:first + len(words)]
        first += len(words)
        before, x = ([OWN_ROWS + CLASSES], x) if at == 0 else (lexicon.row[x[:1]], x[1:])
        n = min(WIDTH, len(x))
        rows[t, :n] = np.concatenate([before, lexicon.row[x[:n - 1]]])
        classes[t, :n], weight[t, :n] = lexicon.cls[x[:n]], 1
    return rows, classes, weight


def _train_task(sent):
    def run(batches):
        lexicon, weights = _made(sent)
        trainer, windows = Trainer(weights, RATE / 4), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for first, last in chunks(texts):
                made = every_window(lexicon, texts[first:last])
                for b in range(0, len(made[0]), BATCH):
                    # Smaller steps later on, so that the tasks' models stay close enough to be averaged.
                    trainer.rate = RATE / 4 / (1 + trainer.steps / SETTLE) ** 0.5
                    trainer.step(*(x[b:b + BATCH] for x in made))
                windows += len(made[0])
        if windows:
            flat = np.concatenate([trainer.w[n].reshape(-1) for n in shapes()]).astype(np.float64) * windows
            yield pa.RecordBatch.from_arrays([pa.array([windows]), pa.array([flat.tolist()], pa.list_(pa.float64()))], ["windows", "sums"])
    return run


def _add_up(batches):
    windows, sums = 0, None
    for batch in batches:
        for n, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = x.values.to_numpy()
            windows, sums = windows + n, x if sums is None else sums + x
    if windows:
        yield pa.RecordBatch.from_arrays([pa.array([windows]), pa.array([sums.tolist()], pa.list_(pa.float64()))], ["windows", "sums"])


def averaged(trained: DataFrame, weights: dict) -> dict:
    """The mean of the tasks' weights, by windows; added up in a tree, so that the driver gets a few sums only."""
    kind = "windows long, sums array<double>"
    trained = store(trained)
    n = trained.count()
    while n > 64:
        n = n // 32
        trained = store(trained.repartition(n).mapInArrow(_add_up, kind))
    parts = trained.collect()
    if not parts:
        return weights
    total = sum(np.array(p.sums) for p in parts) / sum(p.windows for p in parts)
    out, at = {}, 0
    for name, shape in shapes().items():
        size = int(np.prod(shape))
        out[name] = total[at:at + size].reshape(shape).astype(np.float32)
        at += size
    return out


def train(docs: DataFrame, vocabulary: str, key: str, text: str) -> tuple[dict, DataFrame]:
    """The model (a bounded dictionary) and the stored counts of all training words."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{key}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    counts = store(word_counts(texts.select("text")))
    n, v = counts.agg(F.sum("n"), F.count("*")).first()
    plain = counts.where(F.col("word") != F.lit(END))
    least = dictionary_threshold(plain, DICTIONARY)
    held = plain.where(F.col("n") >= least).toArrow()  # at most DICTIONARY rows
    words, own = held.column("word").to_pylist(), np.asarray(held.column("n").to_numpy(), np.float64)
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    names = _vocabulary(vocabulary)[1]
    subwords = store(plain.select("word", "n").mapInArrow(
        _subword_counts(vocabulary, ONCE), "kind int, id long, n double").groupBy("kind", "id").agg(F.sum("n").alias("n")))
    tables = np.zeros((PAIR, len(names) + 1))
    for r in subwords.where(F.col("kind") < PAIR).toLocalIterator():  # at most the vocabulary, once a kind
        tables[r.kind, r.id] = r.n
    pairs = subwords.where(F.col("kind") == PAIR)
    pairs = pairs.where(F.col("n") >= dictionary_threshold(pairs, PAIRS)).orderBy("id").toArrow()
    body = F.split(F.trim("text"), r"[\x20\x09-\x0D]+")
    start = F.pmod(F.xxhash64("text"), F.greatest(F.size(body) - WARM_WORDS, F.lit(1))).cast("int") + 1
    # A hash below this bound leaves about twice the sample, so that no task sends a sample of its own to the driver.
    bound = -2 ** 63 + min(2 ** 64 - 1, 2 ** 65 * WARM_DOCS // max(ends, 1))
    sample = [r.words for r in texts.withColumn("h", F.xxhash64("id", "text")).where(F.col("h") <= F.lit(bound)).select(
        "h", F.slice(body, start, WARM_WORDS).alias("words")).orderBy("h").limit(WARM_DOCS).collect()]
    sample = [[w for s in words_ for w in text_words(s)] for words_ in sample]
    row, classes = class_tables(tables[FIRST_ALL, :-1], beside_anchors(texts.select("text"), vocabulary, tables[FIRST_ALL, :-1], words))
    stats = {"row": row, "class": classes, "all": tables[FIRST_ALL, :-1], "rare": tables[RARE, :-1], "first": tables[FIRST, :-1], "later": tables[LATER],
             "pairs": np.asarray(pairs.column("id").to_numpy()), "pair_counts": np.asarray(pairs.column("n").to_numpy())}
    lexicon = Lexicon(vocabulary, words, own, ends, stats)
    class_counts = np.bincount(classes, tables[FIRST_ALL, :-1], CLASSES)
    class_counts[CLASSES - 1] = ends
    model = {"name": counts._stored_at, "path": vocabulary, "words": words, "counts": own, "ends": ends, "stats": stats,
             "spelled": lexicon.spelled, "N": n or 0, "V": v, "weights": warm_start(lexicon, sample, class_counts)}
    sent = spark.sparkContext.broadcast(model)
    model = model | {"weights": averaged(texts.select("text").mapInArrow(_train_task(sent), "windows long, sums array<double>"), model["weights"])}
    sent.unpersist()
    return model, counts


def warm_start(lexicon: Lexicon, sample: list[list[bytes]], class_counts: np.ndarray) -> dict:
    trainer = Trainer(initial(class_counts), RATE)
    rng = np.random.default_rng(11)
    texts = [lexicon.numbers([*s, END]) for s in sample if s]
    for _ in range(WARM_STEPS if texts else 0):
        rows = np.zeros((BATCH, WIDTH), np.int64)
        classes = np.zeros((BATCH, WIDTH), np.int64)
        weight = np.zeros((BATCH, WIDTH), np.float32)
        for b, t in enumerate(rng.integers(0, len(texts), BATCH)):
            x = texts[t]
            at = int(rng.integers(0, max(1, len(x) - WIDTH // 2)))
            part = x[at:at + WIDTH]
            rows[b, :len(part)] = np.concatenate([[OWN_ROWS + CLASSES] if at == 0 else lexicon.row[x[at - 1:at]], lexicon.row[part[:-1]]])
            classes[b, :len(part)], weight[b, :len(part)] = lexicon.cls[part], 1
        trainer.step(rows, classes, weight)
    return trainer.w


def _score_task(sent):
    def run(batches):
        lexicon, weights = _made(sent)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts, GROUP_BYTES):
                numbers, sizes = text_numbers(lexicon, texts[a:b])
                text = np.repeat(np.arange(b - a), sizes)
                held = np.bincount(text, numbers < lexicon.base, b - a).astype(np.int64)
                log_counts = np.bincount(text, lexicon.log_count[numbers], b - a)
                # Words outside the dictionary, each once a text.
                at, seen = np.flatnonzero(numbers >= lexicon.base), len(lexicon.names)
                found, n = np.unique(text[at] * seen + numbers[at], return_counts=True)
                rare, offsets = found % seen, np.searchsorted(found, np.arange(b - a + 1) * seen).astype(np.int32)
                lists = (pa.ListArray.from_arrays(offsets, x) for x in (
                    pa.array([lexicon.names[i] for i in rare.tolist()], pa.binary()), pa.array(n, pa.int64()), pa.array(lexicon.log_spelled[rare])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(held), pa.array(log_counts),
                     pa.array(score_numbers(weights, numbers, sizes, lexicon)), *lists],
                    ["row", "n_tokens", "held", "log_counts", "score", "rare", "rare_n", "spelled"])
    return run


def score(docs: DataFrame, training, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, training (whether the row was learnt from), n_tokens, n_known, train_tokens, base_score and score, a row
    per row of ``docs``.

    ``training`` is a condition on the rows of ``docs`` that are learnt from. Tokens are the words of the text, A-Z
    lower-cased, and one end. base_score is the add-one unigram log10 probability, score that of the model. Null texts
    are empty: one token. Repeated rows and null keys are rows like any other; without training rows nothing is known
    and base_score is 0; an empty table gives an empty result. Further columns do not matter.
    """
    spark = docs.sparkSession
    model, counts = train(docs.where(training), vocabulary, key, text)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.monotonically_increasing_id().alias("row_number"), F.col(f"`{key}`").alias("key"), training.alias("training"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kept = rows.select(F.struct("row_number", "key", "training").alias("row"), "text")
    kind = kept.schema["row"].dataType.simpleString()
    done = store(kept.mapInArrow(_score_task(sent), f"row {kind}, n_tokens long, held long, log_counts double, score double, rare array<binary>, rare_n array<long>, spelled array<double>"))
    rare = done.select(F.col("row.row_number").alias("row_number"), F.explode(F.arrays_zip("rare", "rare_n", "spelled")).alias("r")).select(
        "row_number", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("times"), F.col("r.spelled").alias("spelled"))
    # Scored as words without a count so far: what (count + R q) is more than R q.
    gain = F.log10(F.col("n") + F.pow(F.lit(10.0), F.col("spelled"))) - F.col("spelled")
    met = rare.join(counts, "word").groupBy("row_number").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum(F.col("times") * gain).alias("gained"), F.sum("times").alias("known"))
    total = float(np.log10(model["N"] + model["V"] + 1))
    out = done.withColumn("row_number", F.col("row.row_number")).join(met, "row_number", "left")
    base = F.col("log_counts") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(total)
    known = F.col("held") - (0 if model["ends"] else 1) + F.coalesce("known", F.lit(0))
    return out.select(F.col("row.key").alias(key), F.col("row.training").alias("training"), "n_tokens", known.cast("long").alias("n_known"),
                      F.lit(model["N"]).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("gained", F.lit(0.0))).alias("score"))
