"""Embedding near-duplicates by epsilon grid order join.

Vectors are scaled to length 1, where a cosine of ``threshold`` is a Euclidean
distance ``eps``.  Equal vectors of a label become one *class* with a count.  A fixed-size second-moment
matrix, summed over all vectors, gives the leading principal dimensions; along
them the vectors lie in a grid of width ``eps``, and every label's vectors are sorted by
their cells (the epsilon grid order).  That sequence is cut into blocks of at most
``block`` vectors and ``block_bytes`` bytes, each with its bounding box on the principal dimensions.  Two
blocks of a label are joined unless their boxes are provably more than ``eps`` apart.  Within a pair
of blocks the join is recursive: sequence intervals are halved, intervals whose boxes
are too far apart are skipped, and small ones are compared by exact cosines in double
precision.  Blocks travel as the vectors came; all else is made from them where it is needed.

A task gives counts of links and a spanning forest of what it found, never all
pairs; sums of counts and connected components of the forests are the result.

Defined cases: vectors that are null, zero or hold null or non-finite parts link with
nothing, and so do those of a null label or without an id; vectors of different lengths link with nothing; a
cosine of exactly the threshold, as doubles compute it, is a link.  Every row is a vector of its own
with its own number of links, to all other rows; rows that share an id are one vertex of the
components.  An empty table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import common
from spindrift.llm.components import components
from spindrift.llm.words import mix


@dataclass(frozen=True)
class VectorConfig:
    threshold: float = 0.98
    dimensions: int = 12
    grid_dimensions: int = 4
    block: int = 4096
    block_bytes: int = 1 << 20
    leaf: int = 128

    @property
    def eps(self) -> float:
        """Distance of unit vectors at the threshold, and a little for rounding."""
        return float(np.sqrt(2 - 2 * self.threshold) * (1 + 1e-9) + 1e-9)

    def rows(self, row_bytes: int) -> int:
        """Vectors of a block."""
        return max(1, min(self.block, self.block_bytes // row_bytes))


#: Equal vectors that a task holds back to send them once, at most.
_HELD = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _usable(batch: pa.RecordBatch, kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a batch (vec_id, embedding, label), by length: rows of usable vectors, these, and their classes' hashes."""
    column = batch.column(1)
    at = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
    size = np.diff(at)
    ok = column.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(2).is_valid().to_numpy(zero_copy_only=False) & (size > 0)
    labels = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    for n in np.unique(size[ok]).tolist():
        rows = np.flatnonzero(ok & (size == n))
        x = values[at[rows][:, None] + np.arange(n)]
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        rows, x = rows[good], np.ascontiguousarray(x[good])
        if len(rows):
            bits = x.view(f"u{kind.itemsize}").astype(np.uint64)
            place = mix(np.arange(n, dtype=np.uint64) + np.uint64(n << 32))
            yield rows, x, mix(mix(bits ^ place).sum(1, dtype=np.uint64) ^ mix(labels[rows] + np.uint64(7)))


def _kind(vectors: DataFrame) -> np.dtype:
    """How parts of vectors travel: as floats if that is what they are."""
    return np.dtype(np.float32 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64)


def principal(vectors: DataFrame, kind: np.dtype, dimensions: int) -> dict[int, np.ndarray]:
    """Length of vectors -> its leading eigenvectors of the second moments of all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x, _ in _usable(batch, kind):
                u, n = _unit(x), x.shape[1]
                total[n] = total.get(n, 0) + u.T @ u
        for n, m in total.items():
            yield pa.record_batch([pa.array([n]), pa.array([TaskContext.get().partitionId() % 4]), pa.array([m.tobytes()], pa.binary())], ["size", "part", "m"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, m in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                total[n] = total.get(n, 0) + np.frombuffer(m).reshape(n, n)
        for n, m in total.items():
            yield pa.record_batch([pa.array([n]), pa.array([m.tobytes()], pa.binary())], ["size", "m"])

    total: dict[int, np.ndarray] = {}
    parts = vectors.mapInArrow(common.frugal(run), "size long, part long, m binary").repartition("size", "part")
    for r in parts.mapInArrow(common.frugal(merge), "size long, m binary").collect():  # 4 matrices a length
        total[r.size] = total.get(r.size, 0) + np.frombuffer(r.m).reshape(r.size, r.size)
    return {n: np.linalg.eigh(m)[1][:, ::-1][:, : min(dimensions, n)].copy() for n, m in total.items()}


def _join(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, config: VectorConfig, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of pairs with a cosine of at least the threshold; of one block with itself each once."""
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, n = stack.pop()
        if same and n <= i:
            continue
        gap = np.maximum(0, np.maximum(pa_[i:j].min(0) - pb[k:n].max(0), pb[k:n].min(0) - pa_[i:j].max(0)))
        if (gap * gap).sum() > config.eps**2:
            continue
        if max(j - i, n - k) <= config.leaf:
            x, y = np.nonzero(a[i:j] @ b[k:n].T >= config.threshold)
            x, y = x + i, y + k
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y
        elif j - i >= n - k:
            h = (i + j) // 2
            stack += [(i, h, k, n), (h, j, k, n)]
        else:
            h = (k + n) // 2
            stack += [(i, j, k, h), (i, j, h, n)]


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def links(vectors: DataFrame, config: VectorConfig = VectorConfig()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``."""
    with common.workspace(vectors.sparkSession) as keep:
        return keep(_links(vectors, config), "vectors")


def _links(vectors: DataFrame, config: VectorConfig) -> DataFrame:
    kind = _kind(vectors)
    vectors = common.pick(vectors, "vec_id", "embedding", "label").withColumn("label", F.col("label").cast("long"))

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, known = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for rows, _, key in _usable(batch, kind):
                cls[rows], known[rows] = key.view(np.int64), True
            yield pa.record_batch([batch.column(0), pa.array(cls, mask=~known)], ["vec_id", "cls"])

    rows = common.store(vectors.mapInArrow(common.frugal(classed), "vec_id long, cls long"), "rows")
    found = _found(vectors, kind, config)
    counts = found.where("other is null").groupBy("cls").agg(F.sum("links").alias("links"))
    classes = rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id"))
    classes = classes.join(counts, "cls", "left").select("cls", "least_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    classes = common.store(classes, "classes")
    arcs = found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b"))
    # rows of one id that are of several classes, or some of none
    mixed = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("cls").alias("first"), F.max("cls").alias("last"), F.count("cls").alias("classed"), F.count("*").alias("all"))
    mixed = mixed.where("first <> last or (classed > 0 and classed < all)").select("vec_id", "first")
    mixed = common.store(mixed, "mixed", number=F.count(F.lit(1)))
    placed = rows.withColumn("meets", F.col("cls"))
    if mixed.watched["number"]:
        met = rows.join(mixed, "vec_id", "left")
        arcs = arcs.unionByName(met.where("cls <> first").select(F.col("cls").alias("a"), F.col("first").alias("b")))
        placed = common.store(met.select("vec_id", "cls", F.coalesce("cls", "first").alias("meets")), "placed")
    joined = components(arcs)
    rooted = classes.join(joined.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("component_id", "cls")).drop("component_id")
    rooted = common.store(rooted, "rooted")
    least = common.store(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    final = common.store(rooted.join(least, "root").select(F.col("cls").alias("meets"), "n_links", "component_id"), "final")
    # a copied vector may be a third of all rows: a join of two written tables, which Spark can split
    out = placed.join(final, "meets", "left")
    component = F.coalesce("component_id", "vec_id")
    n_links = F.when(F.col("cls").isNotNull(), F.col("n_links")).otherwise(0).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _found(vectors: DataFrame, kind: np.dtype, config: VectorConfig) -> DataFrame:
    """``cls, links, other``: numbers of links of classes to others (``other`` null), and links of spanning forests."""
    axes = common.ship(vectors.sparkSession, principal(vectors, kind, config.dimensions))  # length x dimensions each
    names = ["label", "size", "cell", "cls", "n", "raw"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # vectors that a batch had several times; they may be a third of all
        for batch in batches:
            labels = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for rows, x, key in _usable(batch, kind):
                cls, first, n = np.unique(key.view(np.int64), return_index=True, return_counts=True)
                x = x[first]
                grid = min(config.grid_dimensions, x.shape[1])
                cell = np.floor(_unit(x) @ axes.value[x.shape[1]][:, :grid] / config.eps).astype(np.int32)
                out = [labels[rows[first]].tolist(), [x.shape[1]] * len(cls), cell.tolist(), cls.tolist(), n.tolist(), [v.tobytes() for v in x]]
                now = []
                for row in zip(*out, strict=True):
                    if row[3] in held:
                        held[row[3]][4] += row[4]
                    elif row[4] > 1 and len(held) < _HELD:
                        held[row[3]] = list(row)
                    else:
                        now.append(row)
                if now:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*now, strict=True), types, strict=True)], names)
        if held:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held.values(), strict=True), types, strict=True)], names)

    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary()]
    placed = vectors.mapInArrow(common.frugal(project), "label long, size long, cell array<int>, cls long, n long, raw binary")
    # the epsilon grid order of each label, in ranges; a range is cut into blocks where it lies
    order = ["label", "size", "cell", "cls"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number, rows = TaskContext.get().partitionId() << 32, 0, []

        def out() -> pa.RecordBatch:
            size, raw = rows[0][1], b"".join(r[5] for r in rows)
            places = _unit(np.frombuffer(raw, kind).reshape(-1, size)) @ axes.value[size]
            columns = [[base + number], [rows[0][0]], [size], [places.min(0).tolist()], [places.max(0).tolist()], [raw], [[r[3] for r in rows]], [[r[4] for r in rows]]]
            return pa.record_batch([pa.array(c) for c in columns], ["block", "label", "size", "low", "high", "raw", "classes", "counts"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rows and row[3] == rows[-1][3]:
                    rows[-1] = (*row[:4], rows[-1][4] + row[4], row[5])
                    continue
                if rows and (row[:2] != rows[0][:2] or len(rows) >= config.rows(len(row[5]))):
                    yield out()
                    number, rows = number + 1, []
                rows.append(row)
        if rows:
            yield out()

    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "block long, label long, size long, low array<double>, high array<double>, raw binary, classes array<long>, counts array<long>"
    blocks = common.store(ranged.mapInArrow(common.frugal(cut), schema), "blocks")
    # pairs of blocks: of one label and length, and near in the first dimension's cells, then in all
    box = blocks.select("block", "label", "size", "low", "high")
    cells = F.sequence(F.floor(F.col("low")[0] / config.eps), F.floor(F.col("high")[0] / config.eps) + 1)
    left = box.select("label", "size", F.explode(cells).alias("at"), F.col("block").alias("x"), F.col("low").alias("xl"), F.col("high").alias("xh"))
    right = left.select("label", "size", "at", F.col("x").alias("y"), F.col("xl").alias("yl"), F.col("xh").alias("yh"))
    gap = F.aggregate(F.zip_with(F.zip_with("xl", "yh", lambda a, b: a - b), F.zip_with("yl", "xh", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0))), F.lit(0.0), lambda s, g: s + g * g)
    pairs = left.join(right, ["label", "size", "at"]).where("x <= y").where(gap <= config.eps**2).select("x", "y").distinct()
    pairs = common.store(pairs, "pairs")
    # each block once for each pair that it is in
    ends = pairs.select("x", "y", F.col("x").alias("block")).unionByName(pairs.where("x < y").select("x", "y", F.col("y").alias("block")))
    met = common.store(ends, "ends").join(blocks.select("block", "size", "raw", "classes", "counts"), "block")

    def compare(pair: pa.Table) -> pa.Table:
        pair = pair.sort_by("block")
        size, same = pair["size"][0].as_py(), pair.num_rows == 1
        units = [_unit(np.frombuffer(r.as_py(), kind).reshape(-1, size)) for r in pair["raw"]]
        places = [u @ axes.value[size] for u in units]
        cls, weight = (np.concatenate([np.array(r.as_py()) for r in pair[c]]) for c in ("classes", "counts"))
        shift = 0 if same else len(units[0])
        found, parent, forest = np.zeros(len(cls), np.int64), np.arange(len(cls)), []
        for i, j in _join(units[0], units[-1], places[0], places[-1], config, same):
            j = j + shift
            np.add.at(found, i, weight[j])
            np.add.at(found, j, weight[i])
            for u, v in zip(i.tolist(), j.tolist(), strict=True):
                u, v = _find(parent, u), _find(parent, v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    forest.append((u, v))
        hit = np.flatnonzero(found)
        columns = [cls[hit].tolist() + [int(cls[u]) for u, _ in forest], found[hit].tolist() + [0] * len(forest), [None] * len(hit) + [int(cls[v]) for _, v in forest]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["cls", "links", "other"])

    return common.store(met.groupBy("x", "y").applyInArrow(compare, "cls long, links long, other long"), "found")
