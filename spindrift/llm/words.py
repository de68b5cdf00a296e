"""Vectorised words, word hashes and n-gram hashes of whole record batches of texts.

Everything works on the bytes of an Arrow string column at once; no text becomes a
Python object.  Hashes are unsigned 64-bit and the same on every machine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Words of at most so many bytes in all are hashed at a time: the work stays in a core's cache.
_CHUNK = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers (the finaliser of the SplitMix generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _PRIME)
_POWERS = np.ones(1, np.uint64)

#: ``[\x20\x09-\x0D]``: what separates words.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _PRIME | np.uint64(1))]))
    return _POWERS


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each value begins (and the last one ends); null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of a batch: ``data[start:end]`` each; document ``d`` has words ``of[d]`` to ``of[d + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    of: np.ndarray
    hash: np.ndarray

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))


def words(column: pa.Array, blank: np.ndarray = BLANK, fold: np.ndarray = SAME) -> Words:
    """Split each text at ``blank`` bytes; ``fold`` maps bytes before hashing."""
    data, at = raw(column)
    n = len(data)
    is_blank = blank[data]
    before = np.ones(n, bool)
    before[1:] = is_blank[:-1]
    before[at[:-1][at[:-1] < n]] = True
    start = np.flatnonzero(~is_blank & before)
    after = np.ones(n, bool)
    after[:-1] = is_blank[1:]
    after[at[1:][at[1:] > 0] - 1] = True
    end = np.flatnonzero(~is_blank & after) + 1
    of = np.searchsorted(start, at)
    return Words(data, start, end, of, _hash(data, start, end, np.where(blank, np.uint64(0), _BYTE[fold])))


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    length = end - start
    table = _powers(int(length.max(initial=0)) + 1)
    w = 0
    while w < len(start):
        stop = max(w + 1, int(np.searchsorted(end, start[w] + _CHUNK)))
        lo, hi = start[w], end[stop - 1]
        begin = start[w:stop] - lo
        width = np.diff(np.append(begin, hi - lo))
        place = np.arange(hi - lo) - np.repeat(begin, width)
        np.minimum(place, len(table) - 1, out=place)
        out[w:stop] = np.add.reduceat(value[data[lo:hi]] * table[place], begin)
        w = stop
    return mix(out ^ (length.astype(np.uint64) * _PRIME))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each ``n`` neighbours; the last ``n - 1`` places wrap round and mean nothing."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(n):
        out = out * (_PRIME | np.uint64(1)) + np.roll(hashes, -k)
    return mix(out + np.uint64(n))


def whole(hashes: np.ndarray) -> np.uint64:
    """One hash of a whole (short) sequence."""
    out = np.zeros(1, np.uint64)
    for h in hashes:
        out = out * (_PRIME | np.uint64(1)) + h
    return mix(out + np.uint64(len(hashes)))[0]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64)
