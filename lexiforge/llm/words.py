"""Vectorised word scanning over Arrow string columns.

Word classes are sets of separator bytes.  All separators used here are ASCII, so working on UTF-8 bytes is exact.
Texts are handled in chunks of a few hundred KB (a longer text is a chunk of its own), which bounds a task's memory
by the longest text and not by the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 19

#: Separators of white-space words: space, tab, newline, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators of lower-cased alphanumeric words: every ASCII byte but digits and a-z.
PUNCT = np.zeros(256, bool)
PUNCT[:0x80] = True
PUNCT[0x30:0x3A] = False
PUNCT[0x61:0x7B] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_STEP = U64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_LETTER = mix(np.arange(1, 257, dtype=U64) * _STEP)
_LETTER_2 = mix(np.arange(1001, 1257, dtype=U64) * _STEP)


class _Powers:
    """Powers of the polynomial base and of its inverse, grown to the longest chunk seen so far."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up[:n], cls.down[:n]


@dataclass
class Words:
    """The words of a chunk of texts: byte spans in ``data``, the text each belongs to, and counts per text."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray  # for each text the number of its first word, and the total at the end
    offsets: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), self.counts)

    def hashes(self, letter: np.ndarray = _LETTER) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.begin):
            return np.zeros(0, U64)
        n = len(self.data)
        up, down = _Powers.of(n + 1)
        total = np.empty(n + 1, U64)
        total[0] = 0
        np.cumsum(letter[self.data] * up[:n], out=total[1:])
        value = (total[self.end] - total[self.begin]) * down[self.begin]
        return mix(value + (self.end - self.begin).astype(U64) * _STEP)

    def second_hashes(self) -> np.ndarray:
        """Another 64-bit hash of each word's bytes; both together identify a word."""
        return self.hashes(_LETTER_2)


def scan(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool = False) -> Words:
    """The words of the texts ``data[offsets[i]:offsets[i + 1]]``; offsets start at 0."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), offsets)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(separators[data], out=inside[1:-1])
    edge = inside[1:] != inside[:-1]
    begins = edge & inside[1:]
    ends = edge & inside[:-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[inside[cut] & inside[cut + 1]]  # texts that meet within a run of word bytes
    begins[cut] = ends[cut] = True
    begin = np.flatnonzero(begins)
    return Words(data, begin, np.flatnonzero(ends), np.searchsorted(begin, offsets), offsets)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams that start at each word; the last k - 1 words have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * U64(0xC2B2AE3D27D4EB4F) + h[i : i + n]
    return mix(out)


def grams_at(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The same hashes as ``grams``, of the k-grams that start at the words ``at``."""
    out = h[at]
    for i in range(1, k):
        out = out * U64(0xC2B2AE3D27D4EB4F) + h[at + i]
    return mix(out)


def is_in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` the sorted array ``known`` holds."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def string_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, offsets from 0) for runs of texts of about ``size`` bytes."""
    n = len(column)
    if not n:
        return
    data, offsets = string_views(column)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def gather(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many spans one after another, and their offsets."""
    size = end - begin
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    if not offsets[-1]:
        return np.zeros(0, np.uint8), offsets
    index = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
    return data[index], offsets
