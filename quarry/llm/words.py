"""Byte-level word kernels over Arrow string columns, used inside ``mapInArrow``.

The word classes of the contracts are unions of ASCII bytes and "everything else", so a text can be cut on its UTF-8
bytes with numpy: no Python loop runs over words or characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one numpy step handles at most (a longer single text is its own step).
CHUNK_BYTES = 1 << 19

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
GRAM = np.uint64(0xD6E8FEB86659FD93)
LENGTH = np.uint64(0xA0761D6478BD642F)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]``
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing: digits, a-z and all non-ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift-multiply), in place on a fresh array."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below ``n``, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:
            _powers[int(base)] = have
    return have[:n]


@dataclass
class Words:
    """The words of some texts. ``first[i]:first[i + 1]`` are the words of text i."""

    data: np.ndarray  # bytes of the texts, one after the other
    starts: np.ndarray  # byte offsets of the words
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def left(self) -> np.ndarray:
        """For each word, how many words of its text start there or later."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
        inverse = powers(BASE_INV, n + 1)
        length = (self.ends - self.starts).astype(np.uint64)
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + length * LENGTH)


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)), at


def steps(column, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of rows of at most ``most`` bytes: (row, row after, bytes, offsets from 0)."""
    data, at = texts_of(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        end = min(end, rows)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def split(data: np.ndarray, at: np.ndarray, kind: np.ndarray, lower: bool) -> Words:
    """Cut texts into maximal runs of the bytes that ``kind`` holds."""
    if lower:
        data = LOWER[data]
    n = len(data)
    if not n:
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64))
    inside = kind[data]
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    before[at[at < n]] = False
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    after[at[at > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on; those that run past the last word are missing."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    for j in range(n):
        out *= GRAM
        out += hashes[j : j + size]
    return mix(out + np.uint64(n * int(LENGTH) % (1 << 64)))


def run_grams(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of ``n`` words inside one text."""
    at = np.flatnonzero(words.left() >= n)
    return at, grams(hashes, n)[at]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def winnow(words: Words, hashes: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, fingerprint) of the kept runs; each ``span`` words of one text keep at least one."""
    left = words.left()
    if not len(left):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    runs = np.full(len(hashes), np.iinfo(np.uint64).max, dtype=np.uint64)
    full = grams(hashes, gram)
    runs[: len(full)] = full
    width = span - gram + 1
    least = sliding_min(runs, width)  # least[i]: over runs i .. i + width - 1
    ok = left[: len(least)] >= span
    kept = np.zeros(len(hashes), dtype=bool)
    for j in range(width):  # a run is kept if it is the least of a window that holds it; equal ones all are
        own = runs[j : j + len(least)]
        kept[j : j + len(least)] |= ok & (own == least)
    at = np.flatnonzero(kept)
    return at, runs[at]


def signed(a: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return np.ascontiguousarray(a).view(np.int64)
