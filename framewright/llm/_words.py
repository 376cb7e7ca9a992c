"""Words, k-grams and their 64-bit hashes for whole Arrow batches at once, straight from the UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words split at ASCII white space, and of words of ASCII digits, a-z and everything beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes (A-Z lower-cased, eight zero bytes appended) and the n + 1 offsets of its texts; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    out = np.zeros(len(raw) + 8, np.uint8)
    out[:-8] = _LOWER[raw] if lower else raw
    return out, at - at[0]


class Words:
    """Words of a batch: starts and ends in buf, first[i]:first[i + 1] are the words of text i."""

    def __init__(self, column: pa.Array, kind: np.ndarray):
        self.buf, self.at = utf8(column)
        n = len(self.buf) - 8
        inside = kind[self.buf[:n]]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        before[self.at[:-1][self.at[:-1] < n]] = False
        after[self.at[1:][self.at[1:] > 0] - 1] = False
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.at)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A hash for each word, by eight bytes at a time; words over 64 bytes by xxhash."""
        eight = np.ndarray((len(self.buf) - 7,), "<u8", self.buf, strides=(1,))
        size = self.ends - self.starts
        h = mix((eight[self.starts] & _MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * _MULT)
        more = np.flatnonzero((size > 8) & (size <= _LONG))
        for k in range(8, _LONG, 8):
            if not len(more):
                break
            part = eight[self.starts[more] + k] & _MASKS[np.minimum(size[more] - k, 8)]
            h[more] = mix(h[more] * _MULT + part)
            more = more[size[more] > k + 8]
        for i in np.flatnonzero(size > _LONG):
            h[i] = xxhash.xxh3_64_intdigest(self.buf[self.starts[i] : self.ends[i]])
        return h

    def strings(self, start: int, stop: int) -> list[str]:
        return [self.buf[self.starts[i] : self.ends[i]].tobytes().decode() for i in range(start, stop)]


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, at their first word; runs over text borders are the caller's to leave out."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _MULT + words[i : i + n]
    return mix(h + np.uint64(k))
