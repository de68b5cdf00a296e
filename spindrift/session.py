"""Sessions, the shared folder where long lineages are cut, and settings that hold for a while only."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: int | None = None, **settings: str) -> SparkSession:
    """A session for one machine: as many shuffle partitions as cores, UTC, adaptive plans."""
    n = cores or os.cpu_count() or 1
    builder = SparkSession.builder.master(f"local[{n}]").appName("spindrift")
    defaults = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    return builder.config(map=defaults | settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing, a local master gets a temporary folder of its
    own (tests); a real cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, **watched: Column) -> DataFrame:
    """``df`` written to the shared folder and read again, so that its lineage, and what the optimiser knows of it, end there.

    ``watched`` aggregates are taken in the same job; the result has them as ``watched``, a dict.
    """
    path = f"{shared_dir(df.sparkSession)}/spindrift/cut-{uuid.uuid4().hex}"
    seen = Observation() if watched else None
    source = df.observe(seen, *[c.alias(k) for k, c in watched.items()]) if watched else df
    source.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at, out.watched = path, seen.get if seen else {}  # noqa: SLF001
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete what :func:`cut` wrote for these; only for tables that nobody reads again."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm  # noqa: SLF001
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)  # noqa: SLF001


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """SQL settings (dots as ``__``) that go back to what they were; for queries that run inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
