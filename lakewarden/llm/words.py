"""Words of many texts at once, over the UTF-8 bytes that Arrow hands over.

A word is told apart by byte classes, so a batch is cut and hashed with array operations and no
word ever becomes a Python object. Hashes are 64 bits, equal for equal bytes. Each byte is mixed with
its place in the word before the sum, so that words of a regular build do not collide by that build.
Operators that remove or link by hashes compare digests of the words or the words themselves after.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes handled at a time. A longer text is handled alone; memory follows the longest text.
BLOCK = 1 << 20
_GOLD = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x + _GOLD
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` odd constants that depend on ``salt`` alone."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(2 * salt + 1)) | U64(1)


#: White space as the contracts spell it: blank and the control characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = mix(np.arange(256, dtype=U64) + U64(0x51ED))
_FOLDED = _BYTES.copy()
_FOLDED[0x41:0x5B] = _BYTES[0x61:0x7B]
_PLACES = np.zeros(0, U64)


def _places(n: int) -> np.ndarray:
    """A key for each place in a word."""
    global _PLACES
    if len(_PLACES) < n:
        _PLACES = seeds(max(n, 4096), 0x5D1)
    return _PLACES


class Words:
    """Words of some consecutive texts: ``hash``, the ``doc`` each stands in (its index), and per text ``first`` and ``count``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool) -> None:
        n_docs = len(offsets) - 1
        is_word = ~SPACE[data]
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        begins[heads] = is_word[heads]
        self.start = np.flatnonzero(begins)
        self.data, self.offsets = data, offsets
        if len(self.start):
            spans = np.diff(np.append(self.start, len(data)))
            # From the first word on; what stands before it is white space.
            body = data[self.start[0] :]
            at = np.arange(len(body)) - np.repeat(self.start - self.start[0], spans)
            codes = mix((_FOLDED if fold else _BYTES)[body] ^ _places(int(spans.max()) + 1)[at])
            codes[SPACE[body]] = 0
            self.hash = mix(np.add.reduceat(codes, self.start - self.start[0]))
        else:
            self.hash = np.zeros(0, U64)
        self.first = np.searchsorted(self.start, offsets[:-1])
        self.count = np.searchsorted(self.start, offsets[1:]) - self.first
        self.doc = np.repeat(np.arange(n_docs), self.count)

    def grams(self, n: int, salt: int) -> np.ndarray:
        """Hash of the ``n`` words from each word on, across text borders too: see ``within``."""
        keys, size = seeds(n, salt), max(len(self.hash) - n + 1, 0)
        out = np.zeros(size, U64)
        for j in range(n):
            out += self.hash[j : j + size] * keys[j]
        return mix(out)

    def within(self, n: int) -> np.ndarray:
        """Whether the ``n`` words from each word on belong to one text."""
        size = max(len(self.hash) - n + 1, 0)
        return self.doc[:size] == self.doc[n - 1 : n - 1 + size]

    def digests(self, first: np.ndarray, count: np.ndarray) -> list[bytes]:
        """A 128-bit BLAKE2b digest of the words of each run of ``count`` words from word ``first`` on, joined by one blank."""
        ends, data, make = self.ends(), self.data.tobytes(), functools.partial(hashlib.blake2b, digest_size=16)
        spans = zip(self.start[first].tolist(), ends[first + count - 1].tolist(), strict=True)
        return [make(b" ".join(data[x:y].split())).digest() for x, y in spans]

    def ends(self) -> np.ndarray:
        """The byte after each word."""
        spans = ~SPACE[self.data]
        last = spans.copy()
        last[:-1] &= ~spans[1:]
        borders = self.offsets[1:][np.diff(self.offsets) > 0] - 1
        last[borders] = spans[borders]
        return np.flatnonzero(last) + 1


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of an Arrow string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def blocks(column, fold: bool, size: int = BLOCK) -> Iterator[tuple[int, int, Words]]:
    """``(from, to, words)`` for runs of rows of ``column`` with about ``size`` bytes each."""
    if not len(column):
        return
    data, offsets = text_bytes(column)
    at = 0
    while at < len(offsets) - 1:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), len(offsets) - 1)
        yield at, to, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], fold)
        at = to
