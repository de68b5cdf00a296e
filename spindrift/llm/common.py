"""Shared plumbing: the cluster's shared folder, stored intermediates, column safety."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spindrift.session import delete_path, settings, shared_dir

#: Of a record batch handed to Python; they bound what the JVM and a worker hold at once.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
_BATCHES = {"spark__sql__execution__arrow__maxRecordsPerBatch": str(BATCH_ROWS), "spark__sql__execution__arrow__maxBytesPerBatch": str(BATCH_BYTES)}


def prepare(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers, unless the session already does.

    For operators whose result is a plan that runs later; the setting has to stay for it.  Others have :func:`workspace`.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key)
        if not now.isdigit() or int(now) > most:
            spark.conf.set(key, str(most))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spindrift/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, **watched: Column) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    ``watched`` aggregates are taken in the same job; the result has them as ``watched``, a dict.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if inner := _WORKSPACES.get():
        inner[-1].paths.append(path)
    seen = Observation() if watched else None
    source = df.observe(seen, *[c.alias(k) for k, c in watched.items()]) if watched else df
    # nobody reads this query's shuffles again: their files go at its end
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        source.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at, out.watched = path, seen.get if seen else {}  # noqa: SLF001
    return out


def ship(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast; in a workspace it ends with that."""
    out = spark.sparkContext.broadcast(value)
    if inner := _WORKSPACES.get():
        inner[-1].shipped.append(out)
    return out


@dataclass
class _Workspace:
    paths: list[str] = field(default_factory=list)
    kept: list[str] = field(default_factory=list)
    shipped: list[Broadcast] = field(default_factory=list)


#: The workspaces that this thread has open, the innermost last.
_WORKSPACES: ContextVar[tuple[_Workspace, ...]] = ContextVar("workspaces", default=())


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes on leaving all that was stored or shipped within, but for what the function it gives has stored."""
    mine, outer = _Workspace(), _WORKSPACES.get()
    token = _WORKSPACES.set((*outer, mine))

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = store(df, name)
        mine.kept.append(out._stored_at)  # noqa: SLF001
        return out

    try:
        with settings(spark, **_BATCHES):
            yield keep
    finally:
        _WORKSPACES.reset(token)
        for path in mine.paths:
            if path not in mine.kept:
                delete_path(spark, path)
        for value in mine.shipped:
            value.destroy()
        if outer:
            outer[-1].paths.extend(mine.kept)


def drop_stored(df: DataFrame) -> None:
    """Delete what :func:`store` wrote for ``df``; only for tables nobody reads again."""
    path = getattr(df, "_stored_at", None)
    if path:
        delete_path(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, in a worker that gives memory back to the system when a task ends.

    Workers wait for further tasks; what their allocators keep would count against the executor for as long.
    """

    def wrapped(batches: Iterator) -> Iterator:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: int = 0, rows: int = 256, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and about ``most`` bytes of the text in ``column``; one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        end, at = np.cumsum(size, dtype=np.int64), 0
        while at < n:
            fits = int(np.searchsorted(end, (end[at - 1] if at else 0) + most, "right"))
            stop = min(n, at + rows, max(at + 1, fits))
            yield batch.slice(at, stop - at)
            at = stop
