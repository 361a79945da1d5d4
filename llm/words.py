"""Words of many texts at once: one flat byte buffer, numpy offsets and 64-bit hashes.

A word is a maximal run of characters other than space and ``\\t \\n \\v \\f \\r``. Those six are single
bytes in UTF-8, so texts are cut as bytes. Hashes depend on the bytes of a word alone; they are equal in
every task and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a single longer text is handled alone, whole.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    got = _POWERS.get(int(base))
    if got is None or len(got) < n:
        got = np.full(max(n, SLICE_BYTES + 2), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= SLICE_BYTES + 2:
            _POWERS[int(base)] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers so that any of their bits can serve as a bucket or an order."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every span, by one running sum."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=total[1:])
    return (total[end] - total[start]) * powers(_INVERSE, len(values) + 1)[start]


class Texts:
    """Words of a slice of texts.

    ``start`` and ``end`` are the byte span of every word, ``text`` the index of its text, ``first[i]`` the
    index of the first word of text i, ``first[-1]`` the number of all words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray = _SPACE):
        """data: bytes of the texts; offsets: their bounds, from 0; breaks: which byte values stand in no word."""
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        space = breaks[data]
        bounds = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = space[:-1]
        edge[bounds] = True
        self.start = np.flatnonzero(~space & edge[:-1])
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = space[1:]
        edge[bounds] = True
        self.end = np.flatnonzero(~space & edge[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.n = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.n)), self.n)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        return mix(spans(_VALUES[self.data], self.start, self.end) ^ (self.end - self.start).astype(np.uint64))

    def grams(self, hashes: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Start (as a word index) and hash of every run of k words of one text."""
        at = np.flatnonzero(np.arange(len(hashes)) + k <= self.first[1:][self.text]) if len(hashes) else np.zeros(0, np.int64)
        salted = mix(hashes + np.uint64(seed)) if seed else hashes
        return at, mix(spans(salted, at, at + k)) if len(at) else np.zeros(0, np.uint64)


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets from 0) of runs of texts of about SLICE_BYTES; a null text is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, bounds, data = texts.buffers()
    offsets = np.frombuffer(bounds, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        yield i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j
