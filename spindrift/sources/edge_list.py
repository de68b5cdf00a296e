"""Edge lists as text: readers and sinks.

``line`` mode: one edge a line, the first two columns; blank lines and lines that begin with
``#`` are skipped, and anything else that isn't two non-negative integers is an error.
``token`` mode: all white-space separated tokens of a file pair up across lines; a token counts as the
integer that it begins with, or 0; an odd last token is dropped; negative ids are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.session import cut, drop

#: Characters between tokens: carriage return, tab, line feed, NUL and space.
BLANKS = r"[\r\t\n\x00 ]+"
#: Neighbouring tokens of a split: from where on, how many, the first, the lowest, those at even and odd places, the next in the split.
RUN = "file long, block long, at long, n long, first long, lowest long, even array<long>, odd array<long>, behind long"
#: Tokens of a run, an even number; a reader's batch of 4096 runs is 16 MB.
RUN_TOKENS = 512


def read_edges(spark: SparkSession, path: str, mode: str = "line") -> DataFrame:
    """``src, dst`` (long); a missing or empty file is an error."""
    if mode not in ("line", "token"):
        raise ValueError(f"mode is line or token, not {mode}")
    try:
        edges = _lines(spark, path) if mode == "line" else _tokens(spark, path)
        empty = edges.isEmpty()
    except PySparkException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "USER_RAISED_EXCEPTION"):
            raise
        raise ValueError(f"{path} is no edge list: {str(e).splitlines()[0][:300]}") from e
    if empty:
        raise ValueError(f"{path} holds no edge")
    return edges


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path).select(F.regexp_replace("value", "^" + BLANKS, "").alias("line"))
    parts = text.where("line <> '' and not startswith(line, '#')").select("line", F.split("line", BLANKS).alias("c"))
    good = F.get("c", F.lit(0)).rlike("^[0-9]{1,18}$") & F.coalesce(F.get("c", F.lit(1)), F.lit("")).rlike("^[0-9]{1,18}$")
    bad = F.raise_error(F.concat(F.lit("not an edge: "), F.substring("line", 1, 80))).cast("long")
    number = lambda k: F.when(good, F.get("c", F.lit(k)).try_cast("long")).otherwise(bad)
    return parts.select(number(0).alias("src"), number(1).alias("dst"))


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of neighbouring tokens, without a shuffle of tokens.

    The text is read once, and its tokens are written to the shared folder in short runs that know the token behind them.
    Whether a run's pairs begin at its first or second token hangs on the tokens of its file before it, of which one row a
    split is enough.  Files are told apart by 64-bit hashes of their paths.
    """
    text = spark.read.text(path).select(F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.explode(F.split("value", BLANKS)).alias("token"))
    number = F.coalesce(F.regexp_extract("token", "^[+-]?[0-9]{1,18}", 0).try_cast("long"), F.lit(0))
    tokens = text.where("token <> ''").select("file", "block", number.alias("number"))
    runs = cut(tokens.mapInArrow(_runs, RUN), lowest=F.min("lowest"))
    if (runs.watched["lowest"] or 0) < 0:
        drop(runs)
        raise ValueError(f"{path} is no edge list: negative id")
    in_file = Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("n").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = runs.groupBy("file", "block").agg(F.sum("n").alias("n"), F.min_by("first", "at").alias("first"))
    splits = cut(splits.select("file", "block", (before % 2 == 1).alias("shifted"), F.lead("first").over(in_file).alias("after")))
    placed = runs.join(F.broadcast(splits), ["file", "block"])
    behind = F.coalesce("behind", "after")  # the last run of a split is followed by the next split with tokens
    left = F.when(F.col("shifted"), F.col("odd")).otherwise(F.col("even"))
    right = F.when(F.col("shifted"), F.expr("slice(even, 2, size(even))")).otherwise(F.col("odd"))
    pairs = placed.select(F.inline(F.arrays_zip(left.alias("src"), F.array_append(right, behind).alias("dst"))).alias("src", "dst"))
    return pairs.where("src is not null and dst is not null")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``RUN`` from rows of one token; a task reads splits one behind the other, each in the order of its text."""
    split, at, held = None, 0, np.empty(0, np.int64)
    for batch in batches:
        file, block, number = (c.to_numpy() for c in batch.columns)
        bounds = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for begin, end in pairwise([0, *bounds.tolist(), len(number)]):
            if begin == end:
                continue
            if split != (now := (int(file[begin]), int(block[begin]))):
                if len(held):
                    yield _cut_runs(split, at, held, len(held))
                split, at, held = now, 0, held[:0]
            held = np.concatenate([held, number[begin:end]])
            if whole := (len(held) - 1) // RUN_TOKENS * RUN_TOKENS:
                yield _cut_runs(split, at, held, whole)
                at, held = at + whole, held[whole:]
    if len(held):
        yield _cut_runs(split, at, held, len(held))


def _cut_runs(split: tuple[int, int], at: int, held: np.ndarray, upto: int) -> pa.RecordBatch:
    begins = np.arange(0, upto, RUN_TOKENS)
    ends = np.minimum(begins + RUN_TOKENS, upto)
    bounds = np.append(begins, upto)
    lists = lambda odd: pa.ListArray.from_arrays(pa.array((bounds + 1 - odd) // 2, pa.int32()), pa.array(held[odd:upto:2]))
    behind = pa.array(held[np.minimum(ends, len(held) - 1)], mask=ends >= len(held))
    same = lambda x: pa.array(np.full(len(begins), x))
    columns = [same(split[0]), same(split[1]), pa.array(at + begins), pa.array(ends - begins), pa.array(held[begins]), pa.array(np.minimum.reduceat(held[:upto], begins)), lists(0), lists(1), behind]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RUN.split(", ")])


def write_edges(edges: DataFrame, path: str) -> None:
    """One ``src dst`` a line."""
    edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(path)


def write_values(values: DataFrame, path: str, name: str) -> None:
    """The column ``name`` a line, in the order of ``id``."""
    values.orderBy("id").select(F.col(name).cast("string").alias("value")).write.text(path)
