"""Delta coding of sorted integer lists, as Column functions (storage compression itself is Parquet's)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def delta_encode(values: Column) -> Column:
    """Each number less the one before it; the first stays."""
    return F.transform(values, lambda x, i: x - F.when(i > 0, F.get(values, i - 1)).otherwise(F.lit(0)))


def delta_decode(deltas: Column) -> Column:
    """Running sums: the inverse of :func:`delta_encode`, over whole record batches and in linear time."""

    @F.arrow_udf("array<bigint>")
    def decode(lists: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        sums = np.concatenate([[0], np.cumsum(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))])
        values = sums[1:] - np.repeat(sums[ends[:-1]], size)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values), mask=lists.is_null())

    return decode(deltas)
