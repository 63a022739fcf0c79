"""Words and n-gram hashes of Arrow text columns, a block of rows at a time in NumPy.

A word is a run of bytes other than the six ASCII white-space bytes.  Hashes are
64 bits: a polynomial over a word's bytes, mixed, and a polynomial over the
words of an n-gram, mixed again.  Work arrays cover about a megabyte of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BLOCK = 1 << 20
_BASE, _GRAM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64."""
    if "up" not in _tables or len(_tables["up"]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(max(n, 2 * BLOCK), base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps)
    return _tables["up"], _tables["down"]


@dataclass
class Words:
    """The words of some rows: byte places in ``data``, hashes, and each row's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the last k - 1 are missing, rows are not separated."""
        n = max(0, len(self.hash) - k + 1)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * _GRAM + self.hash[j : j + n]
        return mix(out)

    def gram_starts(self, k: int) -> np.ndarray:
        """Words from which k words of the same row follow."""
        last = np.repeat(self.first[1:], self.counts)
        return np.flatnonzero(np.arange(len(last)) + k <= last)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + BLOCK)))
        base, stop = int(start[lo]), int(end[hi - 1])
        up, down = _powers(stop - base + 1)
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum((data[base:stop].astype(np.uint64) + np.uint64(1)) * up[: stop - base], out=sums[1:])
        s, e = start[lo:hi] - base, end[lo:hi] - base
        out[lo:hi] = (sums[e] - sums[s]) * down[s]
        lo = hi
    return mix(out ^ ((end - start).astype(np.uint64) << np.uint64(48)))


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    space = SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = ~space[inner]
    ends = ~space
    ends[:-1] &= space[1:]
    ends[inner - 1] = ~space[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), _hashes(data, start, end))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the row offsets into them; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of blocks of whole rows, of about ``limit`` bytes."""
    data, offsets = text_bytes(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_blocks(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    for lo, hi, data, offsets in row_blocks(column):
        yield lo, hi, split_words(LOWER[data] if lower else data, offsets)


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of the byte ranges between ``offsets``."""
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )
