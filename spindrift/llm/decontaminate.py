"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of words: runs of ASCII letters and digits and
of all non-ASCII characters, A-Z lower-cased.  Seeds are the benchmark's n-grams of
``least_match`` words by their running (Karp-Rabin) hashes; documents are joined with
them as they are read.  For each document and item with seeds for enough of the item, greedy string tiling
repeatedly marks the longest match of words that aren't marked yet, in either, until
none of ``least_match`` words is left.  The marked share of the item is its coverage; order
plays no part, so passages in another order count in full.  From ``threshold`` on the
document leaks the item.  An item shorter than ``least_match`` words is a seed as a whole.

Longest matches are found from their two ends (equal seeds with unlike words before, or
behind, them), so texts that repeat themselves cost what they have matches, not pairs of seeds.

The benchmark goes to the tasks in blocks of at most ``block_words`` words (a longer item
is a block of its own).  If there are several, one pass over the documents keeps those that hold
any seed, by a filter of bounded size, and only they meet the blocks one after the other.
Documents aren't shuffled.

Defined cases: a null or empty text leaks nothing; items that are null or have no words match
nothing; of equally long matches the one that begins first in the item, then in the text, is marked;
of repeated rows each counts; texts of any length are read whole; an empty table on either side
gives no leaks; other columns, whatever their names, play no part and stay as they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spindrift.llm import bloom, common
from spindrift.llm.words import LOWER, NOT_ALNUM, Words, ngrams, words

#: Stand for the missing word at a text's, or an item's, end.
_TEXT_END, _ITEM_END = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0xFFFFFFFFFFFFFFFE)


@dataclass(frozen=True)
class TilingConfig:
    least_match: int = 5
    threshold: float = 0.5
    block_words: int = 1 << 20


def _split(column: pa.Array) -> Words:
    return words(column, NOT_ALNUM, LOWER)


def _grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams within one text each, and the words they begin at."""
    if len(w.hash) < n:
        return w.hash[:0], np.zeros(0, np.int64)
    at = np.flatnonzero(np.arange(len(w.hash)) + n <= np.repeat(w.of[1:], np.diff(w.of)))
    return ngrams(w.hash, n)[at], at


class Table:
    """Seeds of ``n`` words, sorted by hash: ``gram``, the item and the word in it."""

    def __init__(self, w: Words, n: int, chosen: np.ndarray):
        gram, at = _grams(w, n)
        item = np.searchsorted(w.of, at, "right") - 1
        ok = chosen[item]
        order = np.argsort(gram[ok], kind="stable")
        self.n, self.gram, self.item = n, gram[ok][order], item[ok][order]
        self.at = (at[ok] - w.of[item[ok]])[order]
        self.quick = np.zeros(1 << 22, bool)
        self.quick[(self.gram >> np.uint64(42)).astype(np.int64)] = True


class Seeds:
    """A block of items: their words' hashes, and tables of seeds by length."""

    def __init__(self, ids: list, texts: list[str], n: int):
        w = _split(pa.array(texts, pa.string()))
        self.ids, self.of, self.hash = ids, w.of, w.hash
        size = np.diff(w.of)
        lengths = sorted({int(k) for k in np.minimum(size, n)} - {0})
        self.tables = [Table(w, k, size >= n if k == n else size == k) for k in lengths]

    def item(self, k: int) -> np.ndarray:
        return self.hash[self.of[k] : self.of[k + 1]]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range that each is of."""
    size = hi - lo
    owner = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size), owner


def _ends(text: np.ndarray, beside: np.ndarray, item: np.ndarray, item_beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in text, in item) of equal seeds with unlike words beside them, by diagonal and then by place."""
    kinds, kind = np.unique(item, return_inverse=True)
    sides, side = np.unique(item_beside, return_inverse=True)
    key = kind * len(sides) + side
    order = np.argsort(key, kind="stable")
    key = key[order]
    k, s = np.minimum(np.searchsorted(kinds, text), len(kinds) - 1), np.minimum(np.searchsorted(sides, beside), len(sides) - 1)
    place = np.flatnonzero(kinds[k] == text)
    k, s, alike = k[place], s[place], sides[s[place]] == beside[place]
    lo, hi = np.searchsorted(key, k * len(sides)), np.searchsorted(key, (k + 1) * len(sides))
    same_lo = np.where(alike, np.searchsorted(key, k * len(sides) + s), hi)
    same_hi = np.where(alike, np.searchsorted(key, k * len(sides) + s, "right"), hi)
    j, i = _ranges(np.concatenate([lo, same_hi]), np.concatenate([same_lo, hi]))
    i, j = place[i % len(place)] if len(place) else i, order[j]
    by = np.lexsort((i, i - j))
    return i[by], j[by]


def matches(text: np.ndarray, item: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the text, place in the item, length) of all matches of ``n`` words or more that can't be made longer."""
    a, b = ngrams(text, n)[: len(text) - n + 1], ngrams(item, n)[: len(item) - n + 1]
    before = lambda x, none: np.append(none, x[: len(x) - n])
    behind = lambda x, none: np.append(x[n:], none)
    i, j = _ends(a, before(text, _TEXT_END), b, before(item, _ITEM_END))
    last, _ = _ends(a, behind(text, _TEXT_END), b, behind(item, _ITEM_END))
    return i, j, last - i + n


def tile(text: np.ndarray, item: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of word hashes: (text place, item place, length) of each tile."""
    if min(len(text), len(item)) < n:
        return []
    return _tile(matches(text, item, n), len(text), len(item), n)


def _tile(found: tuple[np.ndarray, np.ndarray, np.ndarray], text_words: int, item_words: int, n: int) -> list[tuple[int, int, int]]:
    heap = [(-k, j, i) for i, j, k in zip(*[x.tolist() for x in found], strict=True)]
    heapq.heapify(heap)
    text, item, tiles, left = np.zeros(text_words, bool), np.zeros(item_words, bool), [], item_words
    while heap and left >= n:
        k, j, i = heapq.heappop(heap)
        k = -k
        taken = text[i : i + k] | item[j : j + k]
        if not taken.any():
            tiles.append((i, j, k))
            text[i : i + k] = item[j : j + k] = True
            left -= k
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= n:
                heapq.heappush(heap, (a - b, j + a, i + a))
    return tiles


def _find(column: pa.Array, seeds: Seeds, config: TilingConfig) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(row, item, tiles) of every leak."""
    w = _split(column)
    for table in seeds.tables:
        n = table.n
        gram, at = _grams(w, n)
        hit = np.flatnonzero(table.quick[(gram >> np.uint64(42)).astype(np.int64)])
        lo, hi = np.searchsorted(table.gram, gram[hit]), np.searchsorted(table.gram, gram[hit], "right")
        doc = np.searchsorted(w.of, at[hit], "right") - 1
        keep = hi > lo
        lo, hi, doc = lo[keep], hi[keep], doc[keep]
        for a, b in zip(*_groups(doc), strict=True):
            d = int(doc[a])
            first, once = np.unique(lo[a:b], return_index=True)
            seed, _ = _ranges(first, hi[a:b][once])  # every seed of the block once at most
            item, place = table.item[seed], table.at[seed]
            by = np.lexsort((place, item))
            item, place = item[by], place[by]
            for c, e in zip(*_groups(item), strict=True):
                k = int(item[c])
                size = int(seeds.of[k + 1] - seeds.of[k])
                most = n + np.minimum(np.diff(place[c:e]), n).sum()  # words of the item that seeds cover
                if most >= config.threshold * size:
                    tiles = tile(w.hash[w.of[d] : w.of[d + 1]], seeds.item(k), n)
                    if sum(t[2] for t in tiles) >= config.threshold * size:
                        yield d, k, tiles


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    edge = np.flatnonzero(np.diff(x)) + 1
    return (np.concatenate([[0], edge]), np.concatenate([edge, [len(x)]])) if len(x) else (edge, edge)


def _blocks(benchmark: DataFrame, config: TilingConfig) -> Iterator[Seeds]:
    ids, texts, size = [], [], 0
    for r in common.pick(benchmark, "item_id", "text").where("text is not null").toLocalIterator():
        more = len(r.text) // 4 + 1
        if ids and size + more > config.block_words:
            yield Seeds(ids, texts, config.least_match)
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += more
    if ids:
        yield Seeds(ids, texts, config.least_match)


def _seeded(benchmark: DataFrame, config: TilingConfig):
    """A function of batches and the text's place: whether each row holds any seed of any item (or, rarely, none)."""
    n = config.least_match

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            for table in Seeds([None] * batch.num_rows, batch.column(0).to_pylist(), n).tables:
                yield pa.record_batch([pa.array(table.gram.view(np.int64)), pa.array([table.n] * len(table.gram), pa.int64())], ["gram", "n"])

    grams = common.store(common.pick(benchmark, "text").where("text is not null").mapInArrow(common.frugal(run), "gram long, n long").distinct(), "seeds")
    lengths = [r.n for r in grams.select("n").distinct().collect()]  # least_match at most
    shipped = bloom.build(grams.select("gram"), grams.count())

    def might(column: pa.Array) -> np.ndarray:
        known, w, out = bloom.Bloom(shipped.value), _split(column), np.zeros(len(column), bool)
        for k in lengths:
            gram, at = _grams(w, k)
            out[np.searchsorted(w.of, at[known.might_hold(gram)], "right") - 1] = True
        return out

    return might


def _holding(documents: DataFrame, might, holds: bool) -> DataFrame:
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, at):
            yield batch.filter(pa.array(might(batch.column(at)) == holds))

    return documents.mapInArrow(common.frugal(run), documents.schema)


def _met(documents: DataFrame, benchmark: DataFrame, config: TilingConfig) -> tuple[list[Seeds], DataFrame, DataFrame | None]:
    """Blocks of the benchmark, the rows that they have to meet, and the rows without any seed if those were set apart."""
    blocks = _blocks(benchmark, config)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return [first] if first else [], documents, None
    might = _seeded(benchmark, config)
    some = common.store(_holding(documents, might, True), "seeded")
    return _chain(first, second, blocks), some, _holding(documents, might, False)


def _chain(first, second, rest):
    yield first
    yield second
    yield from rest


_LEAKS = "doc_id long, item_id long, coverage double, item_words long, marked_words long, tiles array<struct<doc_start:long,item_start:long,length:long>>"
_TILES = pa.list_(pa.struct([("doc_start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())]))
_KINDS = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), _TILES]
_NAMES = ["doc_id", "item_id", "coverage", "item_words", "marked_words", "tiles"]


def leaks(documents: DataFrame, benchmark: DataFrame, config: TilingConfig = TilingConfig()) -> DataFrame:
    """One row per document and item that it leaks, with the tiles in words of each."""
    spark = documents.sparkSession
    common.prepare(spark)
    blocks, texts, apart = _met(common.pick(documents, "doc_id", "text"), benchmark, config)
    out = None
    for seeds in blocks:
        shipped = common.ship(spark, seeds) if apart is None else spark.sparkContext.broadcast(seeds)  # at most a block

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            seeds = shipped.value
            for batch in common.slices(batches, 1):
                rows = []
                for d, k, tiles in _find(batch.column(1), seeds, config):
                    size, marked = int(seeds.of[k + 1] - seeds.of[k]), sum(t[2] for t in tiles)
                    spans = [{"doc_start": int(i), "item_start": int(j), "length": int(n)} for i, j, n in sorted(tiles)]
                    rows.append((batch.column(0)[d].as_py(), seeds.ids[k], marked / size, size, marked, spans))
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)

        part = texts.mapInArrow(common.frugal(run), _LEAKS)
        if apart is not None:  # one of many blocks: it goes before the next one comes
            part = common.store(part, "leaks")
            shipped.destroy()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], _LEAKS) if out is None else out


def without_leaks(documents: DataFrame, benchmark: DataFrame, config: TilingConfig = TilingConfig()) -> DataFrame:
    """The rows of ``documents``, all columns, that leak no item; each row is judged where it lies."""
    spark = documents.sparkSession
    common.prepare(spark)
    at = documents.columns.index("text")
    blocks, out, apart = _met(documents, benchmark, config)
    for seeds in blocks:
        shipped = common.ship(spark, seeds) if apart is None else spark.sparkContext.broadcast(seeds)  # at most a block

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches, at):
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, _, _ in _find(batch.column(at), shipped.value, config)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(common.frugal(run), documents.schema)
        if apart is not None:  # one of many blocks: it goes before the next one comes
            out = common.store(out, "left")
            shipped.destroy()
    return out if apart is None else out.unionByName(apart)
