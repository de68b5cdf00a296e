"""A filter of bounded size for 64-bit keys: says no only for keys that are not in it.

It spares shuffles: rows whose key is surely absent stay where they are, and the rest
is decided exactly afterwards.  Its size follows the keys but never passes
``MOST_BITS`` (16 MB); beyond that it lets more rows through and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm import common
from spindrift.llm.words import mix

MOST_BITS = 1 << 27
_PROBES = 4


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    a, b = mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)), mix(keys + np.uint64(0x1234567)) | np.uint64(1)
    for k in range(_PROBES):
        yield ((a + np.uint64(k) * b) & np.uint64(bits - 1)).astype(np.int64)


class Bloom:
    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        self.bits = len(data) * 8

    def might_hold(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in _places(keys.view(np.uint64), self.bits):
            out &= (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def build(keys: DataFrame, count: int) -> Broadcast:
    """A broadcast of the bits for the only column (long) of ``keys``; wrap its value in :class:`Bloom`."""
    bits = min(MOST_BITS, max(1 << 12, 1 << int(16 * max(count, 1) - 1).bit_length()))
    name = keys.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits):
                np.bitwise_or.at(mine, at >> 3, (1 << (at & 7)).astype(np.uint8))
        used = np.flatnonzero(mine.reshape(-1, 512).any(1))
        for k in np.array_split(used, len(used) // 256 + 1):
            yield pa.record_batch([pa.array(k), pa.array([mine[512 * i : 512 * (i + 1)].tobytes() for i in k], pa.binary())], ["page", "bits"])

    pages = keys.select(name).mapInArrow(common.frugal(run), "page long, bits binary")

    def merge(rows):
        seen: dict[int, np.ndarray] = {}
        for page, data in rows:
            seen[page] = seen[page] | np.frombuffer(data, np.uint8) if page in seen else np.frombuffer(data, np.uint8)
        return [(k, v.tobytes()) for k, v in seen.items()]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = merge((p.as_py(), d.as_py()) for b in batches for p, d in zip(b.column(0), b.column(1), strict=True))
        if rows:
            yield pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], ["page", "bits"])

    # each page of bits meets its like in one task; what reaches the driver is the filter once
    full = bytearray(bits >> 3)
    for r in pages.repartition("page").mapInArrow(common.frugal(merged), "page long, bits binary").collect():  # the filter's size
        full[512 * r.page : 512 * (r.page + 1)] = r.bits
    return common.ship(keys.sparkSession, bytes(full))


def test(keys: DataFrame, count: int | None = None) -> Callable[[Column | str], Column]:
    """A function of a column (long): false only if the value is surely not in the only column of ``keys``."""
    shipped = build(keys, keys.count() if count is None else count)

    @F.arrow_udf("boolean")
    def might(values: pa.Array) -> pa.Array:
        return pa.array(Bloom(shipped.value).might_hold(values.to_numpy(zero_copy_only=False).astype(np.int64)))

    return might
