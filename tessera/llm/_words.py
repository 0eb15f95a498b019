"""Words of whole batches of texts as 64-bit hashes, by array operations only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
#: Bytes hashed at once; a longer text is hashed alone.
SLICE = 1 << 16
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_LETTER_VALUE = np.random.default_rng(1).integers(1, 1 << 63, 257, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n-1 of the base and of its inverse."""
    if len(_POWERS[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for i, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.ones(size, np.uint64)
            np.multiply.accumulate(np.full(size - 1, x, np.uint64), out=p[1:])
            _POWERS[i] = p
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, ends: where each value begins, and the last one's end) of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


def slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of values of at most ``most`` in all, or of one value."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_spans(data: np.ndarray, ends: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, value of ``ends``) of each word: the longest runs of bytes that ``letters`` (0: none) marks within one value."""
    inside = letters[data] != 0
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[ends[ends <= n]] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return begin, end, np.searchsorted(ends, begin, "right") - 1


def hashes(data: np.ndarray, ends: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each value); ``letters`` maps bytes to what is hashed of them."""
    n_values = len(ends) - 1
    found, counts = [], np.zeros(n_values, np.int64)
    for i, j in slices(ends, SLICE):
        a = data[ends[i] : ends[j]]
        if not len(a):
            continue
        begin, end, value = word_spans(a, ends[i : j + 1] - ends[i], letters)
        counts[i:j] = np.bincount(value, minlength=j - i)
        power, inverse = _powers(len(a) + 1)
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_LETTER_VALUE[letters[a]] * inverse[:-1], out=total[1:])
        found.append(mix((total[end] - total[begin]) * power[begin]).view(np.int64))
    return (np.concatenate(found) if found else np.empty(0, np.int64)), counts
