"""Language identification by prediction by partial matching (PPM) over bytes.

For each language a context tree of orders 0 to ``order`` is counted from training
texts: how often each byte followed each context.  A byte ``b`` after context ``c`` with
counts ``n`` (sum N, D distinct) has, with escape method C,

    P(b | c) = n(b) / (N + D)              if b was seen after c
    P(b | c) = D / (N + D) * P(b | c')     otherwise, c' being c without its first byte
    P(b | c) = P(b | c')                   if c itself was never seen

ending in the uniform distribution over 256 bytes.  Counts are frozen before scoring,
so the exact code length of every byte is a fixed number; the tables hold it for every
gram of the trees, all languages side by side, and for every context what leaving it costs.  A text's
language is the one with the shortest code for the whole text.

Training reads at most about ``max_documents`` documents of each language (a hash of
the id decides, with a share set from each language's count); they are used whole.
The context counts are summed in Spark.  Scoring is one pass without a shuffle; what
is broadcast has a row of one number a language for each unlike gram of the training sample.

Defined cases: a null text or one without any letter is ``und`` with score 0; letters are
those of Unicode; texts of any length are read whole, long ones piece by piece with their context;
equal code lengths go to the smaller language name; repeated rows each count in training and
get equal results; without any training text everything is ``und``; an empty table gives no rows;
other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm import common
from spindrift.llm.words import LOWER, raw

UNKNOWN = "und"


@dataclass(frozen=True)
class LangConfig:
    order: int = 3
    max_documents: int = 600


class _Index:
    """Number -> its place among ``keys`` (distinct), or -1: an open hash table of twice their number or more."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.key, self.place = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        at, left = self._first(keys), np.arange(len(keys))
        while len(left):  # each cell takes one of those that want it; the others go on to the next cell
            free = self.place[at[left]] < 0
            self.place[at[left[free]]] = left[free]
            settled = self.place[at[left]] == left
            self.key[at[left[settled]]] = keys[left[settled]]
            left = left[~settled]
            at[left] = (at[left] + 1) & (size - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._first(keys)
        out = self.place[at]
        left = np.flatnonzero((out >= 0) & (self.key[at] != keys))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.key) - 1)
            out[left] = self.place[at[left]]
            left = left[(out[left] >= 0) & (self.key[at[left]] != keys[left])]
        return out


@dataclass
class Order:
    """What a context tree has seen at one order, all languages side by side.

    ``bits[gram]``: code lengths of a gram (a context and the byte behind it, packed, last byte lowest) that
    some language has seen.  ``escape[context]``: what it costs to leave a context for the next shorter one.
    """

    grams: _Index
    bits: np.ndarray
    contexts: _Index
    escape: np.ndarray


@dataclass
class LangModel:
    """``orders[o]`` for every order from 0 on: as many rows as the training texts have unlike grams."""

    languages: list[str]
    orders: list[Order]

    @property
    def order(self) -> int:
        return len(self.orders) - 1

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Code lengths in bits: documents x languages."""
        data, at = raw(column)
        out = np.zeros((len(at) - 1, len(self.languages)))
        size = np.diff(at)
        for lo, hi, a, b in _pieces(size, at):
            skip = min(self.order, a - at[lo])  # bytes before the piece that are its context
            if b == a:
                continue
            first = np.maximum(at[lo:hi], a - skip) - (a - skip)
            cost = self._costs(_grams(LOWER[data[a - skip : b]], first, self.order)[skip:])
            full = size[lo:hi] > 0
            sums = np.add.reduceat(cost.astype(np.float64), (np.maximum(at[lo:hi], a) - a)[full], axis=0)
            out[np.arange(lo, hi)[full]] += sums
        return out

    def _costs(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths of the last byte of each gram of the highest order, a column for each language."""
        out = np.zeros((len(grams), len(self.languages)), np.float32)
        left = np.arange(len(grams))
        for o in range(self.order, -1, -1):
            table, part = self.orders[o], grams[left] & _mask(o + 1)
            found = table.grams.find(part)
            known = found >= 0
            out[left[known]] += table.bits[found[known]]
            left, part = left[~known], part[~known]
            if not len(left):
                return out
            context = table.contexts.find(part >> 8)
            out[left[context >= 0]] += table.escape[context[context >= 0]]
        out[left] += 8  # bytes that no language has seen: one of 256
        return out


def _mask(n: int) -> np.int64:
    return np.int64((1 << (8 * n)) - 1)


def _grams(b: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it, packed; 0 stands before ``starts``."""
    gram, begins = b.astype(np.int64), np.zeros(len(b), np.int64)
    starts = starts[starts < len(b)]
    begins[starts] = starts
    place = np.arange(len(b)) - np.maximum.accumulate(begins)
    for k in range(1, order + 1):
        before = np.zeros(len(b), np.int64)
        before[k:] = b[:-k]
        before[place < k] = 0
        gram |= before << (8 * k)
    return gram


def _pieces(size: np.ndarray, at: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, int, int]]:
    """(first document, last + 1, first byte, last + 1): runs of whole documents, or parts of a longer one."""
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        if hi > lo + 1 or size[lo] <= most:
            yield lo, hi, at[lo], at[hi]
        else:
            for a in range(at[lo], at[hi], most):
                yield lo, hi, a, min(a + most, at[hi])
        lo = hi


def build(languages: list[str], grams: np.ndarray, lang: np.ndarray, count: np.ndarray, order: int) -> LangModel:
    """From counts of (order + 1)-grams, each packed with its last byte lowest; byte 0 stands before a text's start."""
    n_lang, orders = len(languages), []
    below = lambda g: np.full((len(g), n_lang), 8.0)  # noqa: E731  bits of g's last byte at the next shorter order
    for o in range(order + 1):
        known, at = np.unique(grams & _mask(o + 1), return_inverse=True)
        n = np.bincount(at * n_lang + lang, weights=count, minlength=len(known) * n_lang).reshape(-1, n_lang)
        contexts, of = np.unique(known >> 8, return_inverse=True)
        total, distinct = np.zeros((len(contexts), n_lang)), np.zeros((len(contexts), n_lang))
        np.add.at(total, of, n)
        np.add.at(distinct, of, n > 0)
        escape = np.where(total > 0, -np.log2(np.maximum(distinct, 1) / np.maximum(total + distinct, 1)), 0.0)
        seen = np.log2(np.maximum(total + distinct, 1))[of] - np.log2(np.maximum(n, 1))
        bits = np.where(n > 0, seen, escape[of] + below(known & _mask(o)))
        table = Order(_Index(known), bits.astype(np.float32), _Index(contexts), escape.astype(np.float32))
        orders.append(table)
        below = (lambda t, b: lambda g: b[t.grams.find(g)])(table, bits)
    return LangModel(languages, orders)


def train(documents: DataFrame, config: LangConfig, keep: Column | None = None) -> LangModel | None:
    """Fit on documents with a language and a text; ``keep`` says which may be learnt from."""
    common.prepare(documents.sparkSession)
    order = config.order
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.where(keep) if keep is not None else known
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(config.max_documents / sizes[k]))])
    unit = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(unit < share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist())
            data, at = raw(batch.column(1))
            b = LOWER[data]
            gram = _grams(b, at[:-1], order)
            owner = np.repeat(lang, np.diff(at)) if len(b) else lang[:0]
            for one in np.unique(owner):
                g, n = np.unique(gram[owner == one], return_counts=True)
                yield pa.record_batch([pa.array([str(one)] * len(g)), pa.array(g), pa.array(n)], ["lang", "gram", "n"])

    grams = sample.select("lang", "text").mapInArrow(common.frugal(run), "lang string, gram long, n long")
    counts = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # bounded by the sample
    counts = counts.sort_values(["lang", "gram"])
    if not len(counts):
        return None
    place = {k: i for i, k in enumerate(languages)}
    return build(languages, counts["gram"].to_numpy(), counts["lang"].map(place).to_numpy(np.int64), counts["n"].to_numpy(np.float64), order)


def has_letter(column: pa.Array) -> np.ndarray:
    data, at = raw(column)
    seen = np.concatenate([[0], np.cumsum((LOWER[data] >= 97) & (LOWER[data] <= 122))])
    out = seen[at[1:]] > seen[at[:-1]]
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    for k in np.flatnonzero(~out & (high[at[1:]] > high[at[:-1]])):
        out[k] = any(c.isalpha() for c in column[int(k)].as_py())
    return out


def predict(documents: DataFrame, model: LangModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, bits_per_byte`` for every row: one pass over the texts."""
    spark = documents.sparkSession
    common.prepare(spark)
    shipped = common.ship(spark, model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for part in common.slices(batches, 1):
            ids, texts = part.column(0), part.column(1)
            ok = has_letter(texts) & (m is not None)
            bits = m.lengths(texts) if m is not None else np.zeros((len(texts), 1))
            best = bits.argmin(1)
            low = bits.min(1, keepdims=True)
            score = np.where(ok, 1 / np.exp2(np.maximum(low - bits, -1000)).sum(1), 0.0)
            size = np.maximum(np.diff(raw(texts)[1]), 1)
            names = [m.languages[b] if k else UNKNOWN for b, k in zip(best, ok, strict=True)]
            yield pa.record_batch([ids, pa.array(names, pa.string()), pa.array(score), pa.array(low[:, 0] / size)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return common.pick(documents, id_col, text_col).mapInArrow(common.frugal(run), "doc_id long, lang_pred string, score double, bits_per_byte double")
