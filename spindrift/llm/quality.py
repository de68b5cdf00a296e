"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage of the whole text is encoded: its
bytes are reduced to a few character classes, and the frequencies of the classes'
pairs go through a learnt layer.  Learnt gated attention weights the encoded
passages, and the weighted sum is scored by a logistic unit:

    h_k = tanh(W x_k + b)
    a_k = softmax_k(w . (tanh(V h_k) * sigmoid(U h_k)))
    p   = sigmoid(c . sum_k a_k h_k + d)

Only document labels train it.  Training is on the driver, over at most
``max_documents`` labelled documents (those with the smallest hashes of their ids)
and at most ``max_passages`` passages of each, drawn evenly; scoring covers every
passage of every document, task by task, without a shuffle.

Defined cases: a null or empty text is a bag with one empty passage; texts of any length are scored
whole; labels that are null or belong to no document are ignored, and of several labels of one document the
smallest counts; of several rows of one labelled id one text is learnt from; a score is a function of the text
alone, so repeated rows get equal ones; without any labels (or with only one kind) every score is the share of
label 1, or 1.0 if there are none; an empty table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm import common
from spindrift.llm.words import raw


@dataclass(frozen=True)
class QualityConfig:
    max_documents: int = 4000
    max_passages: int = 24
    passage_bytes: int = 256
    hidden: int = 24
    gate: int = 12
    epochs: int = 24
    batch: int = 128
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7


def _classes() -> np.ndarray:
    """Byte -> one of 16 classes."""
    out = np.full(256, 15, np.int64)
    for b in range(128):
        c = chr(b)
        out[b] = 14 if not c.isprintable() else 13
    for k, group in enumerate(("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", " ", "\n", ".,;:", "!?", "|", "#$%&*", "\"'()[]-_/")):
        for c in group:
            out[ord(c)] = k
    out[128:192] = 12
    return out


_CLASS = _classes()
FEATURES = 257


def encode(column: pa.Array, passage_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and how many passages each document has (1 at least)."""
    data, at = raw(column)
    count = np.maximum(1, -(-np.diff(at) // passage_bytes))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros((first[-1], FEATURES), np.float32)
    if len(data):
        size = np.diff(at)
        for lo, hi in _runs(size):
            base = at[lo]
            part = _CLASS[data[base : at[hi]]]
            doc = np.repeat(np.arange(lo, hi), size[lo:hi])
            place = np.arange(len(part)) - np.repeat(at[lo:hi] - base, size[lo:hi])
            passage = first[doc] + place // passage_bytes
            pair = part * 16
            pair[1:] += np.where(place[1:] > 0, part[:-1], 0)  # a document's first byte has none before it
            n = first[hi] - first[lo]
            seen = np.bincount((passage - first[lo]) * 256 + pair, minlength=n * 256).reshape(n, 256)
            out[first[lo] : first[hi], :256] = seen
    total = out[:, :256].sum(1, keepdims=True)
    out[:, :256] = np.sqrt(out[:, :256] / np.maximum(total, 1)) * 4
    out[:, 256] = np.log1p(total[:, 0]) / 4
    return out, count


def _runs(size: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of documents of together about ``most`` bytes."""
    total, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most)))
        yield lo, hi
        lo = hi


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class QualityModel:
    config: QualityConfig
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    mean: np.ndarray | None = None
    constant: float | None = None

    def bags(self, x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        w, first = self.weights, np.concatenate([[0], np.cumsum(count)[:-1]])
        h = np.tanh((x - self.mean) @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        s = (t * g) @ w["w"]
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, first), count))
        a = e / np.repeat(np.add.reduceat(e, first), count)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(count), self.constant)
        return self.bags(x, count)["p"].astype(np.float64)

    def fit(self, bags: list[np.ndarray], y: np.ndarray) -> QualityModel:
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 1.0
            return self
        c, rng = self.config, np.random.default_rng(self.config.seed)
        self.mean = np.concatenate(bags).mean(0)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        w = self.weights = {
            "W": init(FEATURES, c.hidden), "b": np.zeros(c.hidden, np.float32), "V": init(c.hidden, c.gate), "U": init(c.hidden, c.gate),
            "w": init(c.gate), "c": init(c.hidden), "d": np.zeros(1, np.float32),
        }
        m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
        share = y.mean()
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))  # both labels count alike
        for epoch in range(c.epochs):
            for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // c.batch)):
                x, count = np.concatenate([bags[i] for i in at]), np.array([len(bags[i]) for i in at])
                f = self.bags(x, count)
                g = self._gradients(x - self.mean, count, f, weight[at] * (f["p"] - y[at]) / len(at))
                step += 1
                for k in w:
                    d = g[k] + c.decay * w[k]
                    m1[k] = 0.9 * m1[k] + 0.1 * d
                    m2[k] = 0.999 * m2[k] + 0.001 * d * d
                    rate = c.rate * (1 - epoch / c.epochs)
                    w[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def _gradients(self, x: np.ndarray, count: np.ndarray, f: dict[str, np.ndarray], dlogit: np.ndarray) -> dict[str, np.ndarray]:
        w, first = self.weights, np.concatenate([[0], np.cumsum(count)[:-1]])
        h, t, g, a = f["h"], f["t"], f["g"], f["a"]
        dz = dlogit[:, None] * w["c"]
        dz_k = np.repeat(dz, count, axis=0)
        da = (dz_k * h).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, first), count))
        dt, dg = ds[:, None] * w["w"] * g * (1 - t * t), ds[:, None] * w["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz_k + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        return {
            "c": f["z"].T @ dlogit, "d": dlogit.sum(keepdims=True), "w": (t * g).T @ ds, "V": h.T @ dt, "U": h.T @ dg, "W": x.T @ dh, "b": dh.sum(0),
        }


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, config: QualityConfig, keep: Column | None = None) -> QualityModel:
    """Fit on labelled documents; ``keep``, on doc_id, says which labels may be learnt from."""
    common.prepare(documents.sparkSession)
    known = common.pick(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(keep) if keep is not None else known
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.max_documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, _ = encode(batch.column(2).slice(k, 1), config.passage_bytes)
                chosen = np.unique(np.linspace(0, len(x) - 1, config.max_passages).astype(int))
                yield pa.record_batch([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([x[chosen].astype(np.float16).tobytes()])], ["doc_id", "quality", "x"])

    # at most max_documents rows of an id and a label are broadcast
    texts = common.pick(documents, "doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text")
    rows = texts.mapInArrow(common.frugal(run), "doc_id long, quality int, x binary").collect()
    rows = sorted({r.doc_id: r for r in sorted(rows, key=lambda r: bytes(r.x))}.values(), key=lambda r: r.doc_id)
    bags = [np.frombuffer(r.x, np.float16).astype(np.float32).reshape(-1, FEATURES) for r in rows]
    return QualityModel(config).fit(bags, np.array([r.quality for r in rows], np.float32))


def score(documents: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row: one pass over the texts."""
    spark = documents.sparkSession
    common.prepare(spark)
    shipped = common.ship(spark, model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, 1):
            p = shipped.value.score(*encode(part.column(1), shipped.value.config.passage_bytes))
            yield pa.record_batch([part.column(0), pa.array(np.clip(p, 0, 1))], ["doc_id", "score"])

    return common.pick(documents, id_col, text_col).mapInArrow(common.frugal(run), "doc_id long, score double")


def keep_good(documents: DataFrame, model: QualityModel, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``documents``, all columns, with a score of at least ``threshold``; each is judged where it lies."""
    spark = documents.sparkSession
    common.prepare(spark)
    shipped, at = common.ship(spark, model), documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, at):
            p = shipped.value.score(*encode(part.column(at), shipped.value.config.passage_bytes))
            yield part.filter(pa.array(p >= threshold))

    return documents.mapInArrow(common.frugal(run), documents.schema)
