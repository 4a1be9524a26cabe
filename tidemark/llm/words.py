"""Words of whole texts by NumPy passes over the bytes of an Arrow column; all hashes are modulo 2**64.

Every separator used here is an ASCII byte, and bytes from 0x80 up belong to words, so working on UTF-8 bytes gives the
words that the patterns give on code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: `[^\x20\x09-\x0D]+`
BLANKS = np.ones(256, bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALNUM = np.ones(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    ALNUM[_a : _b + 1] = False

SAME = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, all else unchanged.
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 0x20

#: bytes of text split at a time; the arrays made of them take some 40 times as much
CHUNK = 1 << 18
_LONG = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd(n: int, seed: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_PLACE = odd(_LONG, 11)
_GRAM = odd(64, 97)


class Words(NamedTuple):
    data: np.ndarray  # bytes, case folded
    first: np.ndarray  # by document: index of its first word; one more entry at the end
    start: np.ndarray  # by word: first byte
    end: np.ndarray  # by word: byte after the last
    hash: np.ndarray  # by word

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def pieces(column: pa.Array | pa.ChunkedArray, chunk: int = CHUNK, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `chunk` bytes (a longer text stands alone) and `rows` rows at most: first row, row after the last, bytes, offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + chunk, "right")) - 1)
        j = min(j, n, i + rows)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def split(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, fold: np.ndarray = SAME) -> Words:
    """The words (runs of `member` bytes) of each text, hashed after `fold`."""
    data = fold[data]
    inside = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return Words(data, np.zeros(len(offsets), np.int64), start, end, np.zeros(0, np.uint64))
    length = end - start
    base = np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(data)]])))
    place = np.arange(len(data)) - base
    value = _PLACE[place & (_LONG - 1)] * (data.astype(np.uint64) + np.uint64(1))
    value[~inside] = 0
    h = np.add.reduceat(value, start)
    h = mix(h + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return Words(data, np.searchsorted(start, offsets), start, end, h)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _GRAM[0]
    for j in range(1, k):
        out += h[j : n + j] * _GRAM[j]
    return mix(out + np.uint64(k))


def minima(x: np.ndarray, w: int) -> np.ndarray:
    """Index of the least of each w neighbours, the rightmost of equal ones; len(x) - w + 1 of them."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = x[:n].copy(), np.arange(n)
    for j in range(1, w):
        later = x[j : n + j]
        less = later <= best
        best[less] = later[less]
        at[less] = np.flatnonzero(less) + j
    return at
