"""Operations over one total order of all rows, without a single-task window.

Rows are dealt into ranges of the order; each range is ranked by itself, and one summary
row a range carries what the ranges before (or behind) it add.  Results are written to the shared
folder, and the dealt rows are given up again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.session import cut

_PART = "__part"


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    # both uses below read one persisted dealing; its bounds are fixed once they are sampled
    return df.repartitionByRange(*order).withColumn(_PART, F.spark_partition_id()).persist()


def _kept(out: DataFrame, rows: DataFrame) -> DataFrame:
    try:
        return cut(out)
    finally:
        rows.unpersist()


def with_running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before this one (0 for the first)."""
    rows = _ranged(df, order)
    total = rows.groupBy(_PART).agg(F.sum(value).alias("__sum"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = total.select(_PART, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    mine = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn(name, F.coalesce(F.sum(value).over(mine), F.lit(0)))
    out = out.join(F.broadcast(base), _PART)
    return _kept(out.withColumn(name, F.col(name) + F.col("__base")).drop(_PART, "__base"), rows)


def with_number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds each row's place, from 0 on."""
    return with_running(df, order, F.lit(1).cast("long"), name)


def with_next(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``value`` of the next row (null for the last)."""
    rows = _ranged(df, order)
    first = rows.groupBy(_PART).agg(F.min_by(F.col(value), F.struct(*order)).alias("__first"))
    after = first.select(_PART, F.lead("__first").over(Window.orderBy(_PART)).alias("__then"))  # one row a range
    mine = Window.partitionBy(_PART).orderBy(*order)
    out = rows.withColumn(name, F.lead(value).over(mine)).withColumn("__last", F.row_number().over(Window.partitionBy(_PART).orderBy(*[F.col(c).desc() for c in order])) == 1)
    out = out.join(F.broadcast(after), _PART)
    return _kept(out.withColumn(name, F.when(F.col("__last"), F.col("__then")).otherwise(F.col(name))).drop(_PART, "__last", "__then"), rows)
