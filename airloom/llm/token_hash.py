"""Words as 64-bit hashes, and hashes of runs of words, over many documents at a time."""
from __future__ import annotations

import functools

import numpy as np

CACHE_WORDS = 300_000
CHUNK_BYTES = 1 << 20  # text that is worked on together; a longer text stands alone, whole


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over one another, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    def table(b):
        out = np.full(n, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)
    return table(base), table(pow(base, -1, 1 << 64))


def run_hashes(hashes: np.ndarray, length: int, base: int) -> np.ndarray:
    """A hash of each ``length`` consecutive ones: a polynomial in an odd base modulo 2^64, mixed."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = (p[:n] for p in _powers(base, 1 << max(n - 1, 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * down[:n - length + 1])


def sliding_least(values: np.ndarray, length: int) -> np.ndarray:
    """The least of each ``length`` consecutive values."""
    out, width = values, 1
    while width * 2 <= length:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = length - width
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def chunks(texts: list, most: int = CHUNK_BYTES):
    """(from, to) of texts that are worked on together."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > first and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)
