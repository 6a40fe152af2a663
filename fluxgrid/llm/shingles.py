"""Words and word shingles of whole texts as 64-bit hashes, computed over whole Arrow buffers at once.

Texts are UTF-8 bytes with A-Z lower-cased; words are the runs of bytes outside [\\x20\\x09-\\x0D].
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_R = np.random.Generator(np.random.PCG64(20240229))
#: A random word for each position in a word (of the first 64; later ones repeat with another factor) and byte.
_RAW = _R.integers(0, 1 << 64, (64, 256), "u8")
_TABLE = _RAW.copy()
_MULT = _R.integers(0, 1 << 63, 64, "u8") * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE[:, _SPACE] = 0
_TABLE[:, 65:91] = _TABLE[:, 97:123]

#: The same where ASCII punctuation separates words too.
_BARE, _GAPS = _TABLE.copy(), _SPACE.copy()
_GAPS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_BARE[:, _GAPS] = 0


class Bytes:
    """Random words for bytes, and which bytes separate words; fold: A-Z count as a-z."""

    def __init__(self, separators: str, fold: bool):
        self.table, self.gaps = _RAW.copy(), np.zeros(256, bool)
        self.gaps[list(separators.encode())] = True
        self.table[:, self.gaps] = 0
        if fold:
            self.table[:, 65:91] = self.table[:, 97:123]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_blocks(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about `most` bytes; at least one row each."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], "i8")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", "u1")
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def words(data: np.ndarray, offsets: np.ndarray, bare: bool = False, tables: Bytes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word, and for each text the index of its first word (one more at the end). bare: ASCII
    punctuation separates words too. tables: others than those."""
    table, gaps = (tables.table, tables.gaps) if tables else (_BARE, _GAPS) if bare else (_TABLE, _SPACE)
    n = len(data)
    if n == 0:
        return np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(len(offsets), "i8")
    gap = gaps[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(before & ~gap), np.flatnonzero(after & ~gap) + 1
    first = np.searchsorted(starts, offsets)
    if len(starts) == 0:
        return np.zeros(0, "u8"), starts, ends, first
    at = np.arange(starts[0], n) - np.repeat(starts, np.diff(np.append(starts, n)))
    values = table.ravel()[((at & 63) << 8) + data[starts[0] :]]
    if (far := np.flatnonzero(at > 63)).size:
        values[far] *= (at[far] >> 6).astype("u8") * np.uint64(2) + np.uint64(1)
    return mix(np.add.reduceat(values, starts - starts[0])), starts, ends, first


def combine(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of `size` hashes."""
    m = len(hashes) - size + 1
    out = np.full(max(0, m), np.uint64(size))
    for k in range(size if m > 0 else 0):
        out += hashes[k : k + m] * _MULT[k % 64]
    return mix(out)


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; of fewer words, their sequence as one; without words, none."""
    for _, data, offsets in text_blocks(column):
        w, _, _, first = words(data, offsets)
        grams = combine(w, size)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            else:
                yield combine(w[a:b], b - a) if b > a else np.zeros(0, "u8")
