"""Exact removal of long repeated word sequences by De Bruijn compaction.

A *window* is ``window`` consecutive words of one document.  A window is repeated if the
same words also start anywhere else, in the same document or another; every word that
a repeated window covers goes.

Token k-mers (``kmer`` words) are the edges of a De Bruijn graph.  Every window holds
``window - kmer + 1`` of them and is filed under the one with the smallest hash, so
equal windows are filed alike.

1. Each document gives the k-mers that some window is filed under (about one in ten).
   Those that occur twice or more are kept, in a filter of bounded size.
2. Documents are read again.  Windows filed under a repeated k-mer, and only they, form
   runs of neighbours under one k-mer: nonbranching paths that a task compacts by
   itself.  A run is a node with its hash, its place and the run that follows.
3. Nodes that occur at least twice hold repeated windows only.  Where all occurrences of a
   node are followed by one and the same node that occurs as often, the two are one
   path; pointer jumping by Spark joins compacts such paths.  (No cycle can arise: each
   step moves on in a finite document.)  Occurrences of a path's head, with the path's length,
   are repeated spans.
4. Where unlike nodes share a k-mer, as at the ends of passages, their windows are
   compared one by one.
5. Spans go back to their documents by source coordinates; documents without any stay
   where they are.

Defined cases: null and empty texts have no words; repeated rows are documents of their own, so
all their long sequences are repeated; documents shorter than a window stay as
they are; texts of any length are read whole; an empty table gives no rows; other columns, whatever their names,
play no part and stay as they are.  Equality is that of two 64-bit hashes of the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm import bloom, common
from spindrift.llm.words import Words, mix, ngrams, words

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class SubstringConfig:
    window: int = 35
    kmer: int = 16

    @property
    def width(self) -> int:
        """K-mers of a window."""
        return self.window - self.kmer + 1


def _slide(x: np.ndarray, width: int, pick, fill: np.uint64) -> np.ndarray:
    """``pick`` of ``x[i : i + width]`` for every i, with ``fill`` behind the end."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        later = np.full(len(out), fill)
        later[: max(len(out) - step, 0)] = out[step:]
        out, have = pick(out, later), have + step
    return out


def _filed(w: Words, config: SubstringConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k-mers, the k-mer that each window is filed under, and which windows exist."""
    ends, at = np.repeat(w.of[1:], np.diff(w.of)), np.arange(len(w.hash))
    grams = np.where(at + config.kmer <= ends, ngrams(w.hash, config.kmer), _NONE)
    return grams, _slide(grams, config.width, np.minimum, _NONE), at + config.window <= ends


def _texts(documents: DataFrame) -> DataFrame:
    return common.pick(documents, "doc_id", "text").select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), "text")


def repeated_kmers(documents: DataFrame, config: SubstringConfig) -> DataFrame:
    """``kmer``: those that windows are filed under and that occur at two places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            w = words(batch.column(0))
            if not len(w.hash):
                continue
            grams, filed, exists = _filed(w, config)
            # a k-mer serves if a window that holds it is filed under it
            above = _slide(np.where(exists, filed, np.uint64(0))[::-1], config.width, np.maximum, np.uint64(0))[::-1]
            yield pa.record_batch([pa.array(grams[(above == grams) & (grams != _NONE)].view(np.int64))], ["kmer"])

    kmers = common.pick(documents, "text").mapInArrow(common.frugal(run), "kmer long")
    return kmers.groupBy("kmer").agg(F.count("*").alias("n")).where("n > 1").select("kmer")


_RUNS = "kmer long, doc_id long, doc_key long, first long, n_windows long, node long, next long, hashes array<long>"


def runs(documents: DataFrame, kmers: DataFrame, count: int, config: SubstringConfig) -> DataFrame:
    """Runs of neighbouring windows under one repeated k-mer, with the hash of each window."""
    shipped = bloom.build(kmers, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bloom.Bloom(shipped.value)
        for batch in common.slices(batches, 2):
            w = words(batch.column(2))
            if len(w.hash) < config.window:
                continue
            _, filed, exists = _filed(w, config)
            at = np.flatnonzero(exists)
            at = at[known.might_hold(filed[at])]
            if not len(at):
                continue
            under, window = filed[at], np.zeros(len(at), np.uint64)
            for k in range(config.window):
                window = window * np.uint64(0xD1342543DE82EF95) + w.hash[at + k]
            window = mix(window)
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (under[1:] != under[:-1])
            # only text that repeats itself has longer runs; two windows' ends must cover a run
            begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            new |= (np.arange(len(at)) - begin) % config.width == 0
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(at)))
            last = first + size - 1
            node = mix(window[first] * np.uint64(3) + window[last] * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64) + under[first])
            follows = np.zeros(len(first), bool)
            follows[:-1] = at[first[1:]] == at[last[:-1]] + 1
            doc = np.searchsorted(w.of, at[first], "right") - 1
            after = pa.array(np.append(node[1:], node[:1]).view(np.int64), mask=~follows)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(window.view(np.int64)))
            columns = [under[first].view(np.int64), None, None, at[first] - w.of[doc], size, node.view(np.int64), None, None]
            columns = [pa.array(c) if c is not None else None for c in columns]
            columns[1], columns[2], columns[6], columns[7] = batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), after, lists
            yield pa.record_batch(columns, [f.split()[0] for f in _RUNS.split(", ")])

    return _texts(documents).mapInArrow(common.frugal(run), _RUNS)


def compact(nodes: DataFrame) -> DataFrame:
    """``kmer, node, total``: heads of nonbranching paths and the windows of the whole path.

    ``nodes``: kmer, node, n (occurrences), n_windows, and ``next``, the node that follows
    all occurrences (null if there is no such one).
    """
    # node numbers stand for (kmer, node): both are hashes, and a path's nodes occur equally often
    then = nodes.select(F.col("node").alias("next"), F.col("n").alias("then_n"))
    ahead = nodes.where("next is not null").join(then, "next").where("n = then_n").select(F.col("next").alias("node"), F.col("node").alias("up"), F.col("n_windows").alias("behind"))
    ahead = ahead.groupBy("node").agg(F.min("up").alias("up"), F.min("behind").alias("behind"), F.count("*").alias("ways")).where("ways = 1").drop("ways")
    state = common.store(ahead, "paths", going=F.count(F.lit(1)))  # node -> a node further up its path, and the windows between
    going = state.watched["going"]
    for _ in range(64):
        if not going:
            break
        further = state.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("behind").alias("more"))
        moved = state.join(further, "up", "left")
        moved = moved.select("node", F.coalesce("top", "up").alias("up"), (F.col("behind") + F.coalesce("more", F.lit(0))).alias("behind"), F.col("top").isNotNull().alias("went"))
        new = common.store(moved, "paths", going=F.count_if("went"))
        common.drop_stored(state)
        state, going = new, new.watched["going"]
    else:
        if going:
            raise RuntimeError("paths are not at their heads after 64 rounds")
    tails = nodes.join(state.select("node", "up", "behind"), "node", "left")
    totals = tails.groupBy(F.coalesce("up", "node").alias("node")).agg(F.max(F.coalesce("behind", F.lit(0)) + F.col("n_windows")).alias("total"))
    return totals.join(state.select("node"), "node", "left_anti")


def repeated_spans(documents: DataFrame, config: SubstringConfig = SubstringConfig()) -> DataFrame:
    """``doc_id, doc_key, begin, end``: word ranges of repeated text; together they are all of it."""
    common.prepare(documents.sparkSession)
    kmers = common.store(repeated_kmers(documents, config), "kmers", number=F.count(F.lit(1)))
    found = common.store(runs(documents, kmers, kmers.watched["number"], config), "runs")
    same = F.min("next") == F.max("next")
    nodes = found.groupBy("kmer", "node").agg(
        F.count("*").alias("n"),
        F.min("n_windows").alias("n_windows"),
        F.when(same & (F.count("next") == F.count("*")), F.min("next")).alias("next"),
    )
    nodes = common.store(nodes, "nodes")
    heads = common.store(compact(nodes.where("n > 1")), "heads")  # written, so Spark can split a node with very many occurrences
    whole = found.select("node", "doc_id", "doc_key", "first").join(heads, "node").select("doc_id", "doc_key", F.col("first").alias("begin"), (F.col("first") + F.col("total") + config.window - 1).alias("end"))
    # unlike nodes under one k-mer, one of them met only once: its windows may be in the others
    mixed = nodes.groupBy("kmer").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("kmer")
    # text that repeats itself may hold a window twice in one node
    single = nodes.groupBy("kmer").agg(F.count("*").alias("kinds"), F.max("n").alias("most")).where("kinds = 1 and most = 1").select("kmer")
    both = mixed.unionByName(single)
    both = common.store(both, "mixed")
    might = bloom.test(both)
    seen = common.store(nodes.join(both, "kmer").select("kmer", "node", "n"), "seen")
    # most runs lie inside passages, under k-mers with one node: their hashes needn't move; of a node met often, one
    # occurrence stands for all, and all others are gone before the shuffle
    alike = found.where(might("kmer")).groupBy("kmer", "node").agg(*[F.first(c).alias(c) for c in ("hashes", "doc_id", "doc_key", "first")])
    alone = F.col("n") == 1
    once = alike.join(seen, ["kmer", "node"]).select("kmer", "n", "hashes", *[F.when(alone, F.col(c)).alias(c) for c in ("doc_id", "doc_key", "first")])
    once = common.store(once.select("kmer", "n", "doc_id", "doc_key", F.posexplode("hashes").alias("place", "hash"), "first"), "windows")
    twice = once.groupBy("kmer", "hash").agg(F.sum("n").alias("times")).where("times > 1").select("kmer", "hash")
    part = once.where("n = 1").join(twice, ["kmer", "hash"]).select("doc_id", "doc_key", (F.col("first") + F.col("place")).alias("begin"))
    return whole.unionByName(part.select("doc_id", "doc_key", "begin", (F.col("begin") + config.window).alias("end")))


def _cut(column: pa.Array, spans: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words, words removed and what is left (joined by one space) of each text."""
    w = words(column)
    gone = np.zeros(len(w.start) + 1, np.int64)
    for d, ranges in enumerate(spans.to_pylist()):
        for s in ranges or ():
            gone[w.of[d] + s["begin"]] += 1
            gone[w.of[d] + s["end"]] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    lost = np.concatenate([[0], np.cumsum(gone)])
    # the kept words and a space behind each are copied byte by byte, all documents at once
    start, end = w.start[~gone], w.end[~gone]
    size = end - start + 1
    total = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(total[-1]) - np.repeat(total[:-1], size) + np.repeat(start, size)
    out = w.data[np.minimum(source, len(w.data) - 1)] if len(w.data) else np.zeros(0, np.uint8)
    out[total[1:] - 1] = 32
    bounds, data = total[w.of - lost[w.of]].tolist(), out.tobytes()
    kept = [data[a : b - 1].decode("utf-8") if b > a else "" for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return np.diff(w.of), np.diff(lost[w.of]), kept


def _with_spans(documents: DataFrame, config: SubstringConfig) -> DataFrame:
    """``row`` (all columns as one struct), ``text`` and ``spans`` (null: none) of every row."""
    common.prepare(documents.sparkSession)  # for the rows that are read later, too
    with common.workspace(documents.sparkSession) as keep:
        spans = repeated_spans(documents, config).distinct()
        # bounded by a document
        spans = keep(spans.groupBy("doc_id", "doc_key").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "spans")
    might = bloom.test(spans.select("doc_key"))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    rows = rows.withColumn("text", F.col("row.text")).withColumn("doc_id", F.col("row.doc_id"))
    rows = rows.withColumn("doc_key", F.xxhash64("doc_id", "text")).withColumn("maybe", might("doc_key"))
    same = (F.col("rows.doc_key") == F.col("found.doc_key")) & F.col("rows.doc_id").eqNullSafe(F.col("found.doc_id"))
    met = rows.where("maybe").alias("rows").join(spans.alias("found"), same, "left").select("row", "text", "spans")
    clean = rows.where("not maybe").select("row", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return met.unionByName(clean)


def deduplicate(documents: DataFrame, config: SubstringConfig = SubstringConfig()) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the words left, joined by one space) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            n_words, n_removed, kept = _cut(batch.column(1), batch.column(2))
            yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    rows = _with_spans(common.pick(documents, "doc_id", "text"), config).select("row.doc_id", "text", "spans")
    return rows.mapInArrow(common.frugal(run), "doc_id long, n_words long, n_removed long, kept string")


def without_repeats(documents: DataFrame, config: SubstringConfig = SubstringConfig()) -> DataFrame:
    """All rows and columns of ``documents``; texts that hold repeated words become what is left of them."""
    rows = _with_spans(documents, config)
    schema = T.StructType([rows.schema["row"], T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            _, n_removed, kept = _cut(batch.column(1), batch.column(2))
            yield pa.record_batch([batch.column(0), pa.array([k if n else None for k, n in zip(kept, n_removed, strict=True)], pa.string())], ["row", "kept"])

    out = rows.select("row", "text", "spans").mapInArrow(common.frugal(run), schema)
    text = F.coalesce("kept", "row.text")
    new = {"text": text} | ({"n_chars": F.when(F.col("kept").isNotNull(), F.length("kept")).otherwise(F.col("row.n_chars")).cast("long")} if "n_chars" in documents.columns else {})
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns])
