"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct shingles of ``shingle`` words.  Documents with equal
sets form a *class*; classes are joined.  Shingles have one global order, rare ones first,
by counts over all documents in a table of fixed size (a count may be too high where
shingles share a cell; any order gives the right result, a good one is faster).

If two sets of sizes n and m are similar, they share at least ``l`` shingles among the first
``n - ceil(t n) + l`` and ``m - ceil(t m) + l`` of their orders, for any ``l``.  Each class picks
its own ``l``: a longer prefix costs more entries, and requires more shared ones before a pair is
verified; the cheapest ``l`` by the estimated numbers of entries and candidates is taken.  A
pair is a candidate if it shares at least the smaller of its two ``l``.

1. One pass: the sets' sizes and fingerprints, and the counts.
2. One pass: the prefixes' shingles; those of two classes or more go into a filter of
   bounded size.  One pass more gives the entries that pass it.
3. Shingles of at most ``light`` classes: pairs that share enough of them are verified
   by exact intersection, unless their sizes or parity bits already rule them out.  Each class's best candidate comes first; of the other pairs, only
   those remain whose components are still apart.
4. Shingles of more classes: each names the most central of its classes (its hub; the one
   whose shingles are the most common).  Classes that share a heavy shingle are in one hub's cluster.  Every
   member is a candidate with the hub, so groups of near copies collapse without their
   pairs.  The members that still are in other components than the hub's are compared with all
   members of similar size, block by block inside tasks, which return spanning forests.

Similar pairs sharing a heavy shingle are found in 4, all others in 3; so components are exact.

Defined cases: null texts and texts without words have the empty set and link with nothing;
with fewer words than a shingle the whole sequence is the only one; a similarity of exactly ``num / den`` is a
link; texts of any length are read whole; repeated rows are in one class; rows without an id link with
nothing and have no component; an empty table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import bloom, common
from spindrift.llm.components import components
from spindrift.llm.words import LOWER, mix, ngrams, whole, words

_PAGE = 4096


@dataclass(frozen=True)
class JaccardConfig:
    """Similar: ``den * |A & B| >= num * |A | B|``."""

    shingle: int = 5
    num: int = 80
    den: int = 100
    cells: int = 1 << 21
    most_matches: int = 8
    light: int = 32
    block_rows: int = 256
    block_shingles: int = 1 << 18

    def least_shared(self, n):
        """ceil(t n)"""
        return -(-n * self.num // self.den)


def shingle_sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    w = words(column, fold=LOWER)
    grams = ngrams(w.hash, shingle) if len(w.hash) else w.hash
    out = []
    for a, b in zip(w.of[:-1].tolist(), w.of[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        else:
            out.append(np.array([whole(w.hash[a:b])], np.uint64) if b > a else w.hash[:0])
    return out


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, bits that every member flips one of: the xor of two differs in at most |A ^ B| bits."""
    place = np.concatenate([s >> np.uint64(54) for s in sets] or [np.zeros(0, np.uint64)]).astype(np.int64)
    at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * (_PARITY * 64) + place
    out = (np.bincount(at, minlength=len(sets) * _PARITY * 64) & 1).astype(np.uint8).reshape(-1, 64)
    return np.packbits(out, axis=1).view(np.int64).reshape(len(sets), _PARITY)


def _fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    for k, s in enumerate(sets):
        if len(s):
            one[k] = mix(s * np.uint64(0xD1342543DE82EF95)).sum()
            two[k] = np.bitwise_xor.reduce(mix(s + np.uint64(len(s))))
    return mix(one ^ two), mix(two + one)


_FIRST = "doc_id long, doc_key long, n long, cls long, check long, parity array<long>, page long, counts binary"
#: 64-bit words of a set's parity bits.
_PARITY = 16


def _survey(documents: DataFrame, config: JaccardConfig) -> tuple[DataFrame, Broadcast, int]:
    """Each document's size and class; the counts of shingles by cell; the number of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(config.cells, np.uint32)
        names = [f.split()[0] for f in _FIRST.split(", ")]
        for batch in common.slices(batches, 2):
            sets = shingle_sets(batch.column(2), config.shingle)
            if sets:
                every = np.concatenate(sets)
                counts += np.bincount((every & np.uint64(config.cells - 1)).astype(np.int64), minlength=config.cells).astype(np.uint32) if len(every) > config.cells else 0
                if len(every) <= config.cells:
                    np.add.at(counts, (every & np.uint64(config.cells - 1)).astype(np.int64), 1)
            one, two = _fingerprints(sets)
            size = len(sets)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(_parities(sets).tolist(), pa.list_(pa.int64())), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary())], names)
        pages = counts.reshape(-1, _PAGE)
        for k in np.array_split(np.flatnonzero(pages.any(1)), 16):
            none = pa.nulls(len(k), pa.int64())
            yield pa.record_batch([none, none, none, none, none, pa.nulls(len(k), pa.list_(pa.int64())), pa.array(k, pa.int64()), pa.array([pages[i].tobytes() for i in k], pa.binary())], names)

    seen = common.store(_texts(documents).mapInArrow(common.frugal(run), _FIRST), "survey")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data, np.uint32)
                total[page] = total[page] + part.astype(np.uint64) if page in total else part.astype(np.uint64)
        if total:
            data = [np.minimum(v, 0xFFFFFFFF).astype(np.uint32).tobytes() for v in total.values()]
            yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(data, pa.binary())], ["page", "counts"])

    counts = np.zeros((config.cells // _PAGE, _PAGE), np.uint32)
    pages = seen.where("page is not null").select("page", "counts").repartition("page")
    for r in pages.mapInArrow(common.frugal(merge), "page long, counts binary").collect():  # a fixed number of cells
        counts[r.page] = np.frombuffer(r.counts, np.uint32)
    docs = seen.where("page is null").select("doc_id", "doc_key", "n", "cls", "check", "parity")
    return docs, common.ship(documents.sparkSession, counts.reshape(-1)), int(counts.sum(dtype=np.uint64))


def _texts(documents: DataFrame) -> DataFrame:
    return common.pick(documents, "doc_id", "text").select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), "text")


def prefix(s: np.ndarray, counts: np.ndarray, mean: float, config: JaccardConfig) -> tuple[np.ndarray, int, float]:
    """The prefix of a sorted set, its number of required matches, and how central the set is."""
    n = len(s)
    count = counts[(s & np.uint64(len(counts) - 1)).astype(np.int64)]
    order = np.argsort(count, kind="stable")  # rare first, then by hash
    excess = np.maximum(0.0, count[order] - 1.0 - mean - 3 * np.sqrt(mean))
    least = config.least_shared(n)
    ways = np.arange(1, min(config.most_matches, least) + 1)
    length = n - least + ways
    entries = np.cumsum(excess)[length - 1]
    best = int(np.argmin(length + entries + entries / ways * (n / 16)))
    return s[order[: length[best]]], int(ways[best]), float(np.log2(1 + excess).mean())


def _entries(documents: DataFrame, counts: Broadcast, total: int, config: JaccardConfig, known: Broadcast | None) -> DataFrame:
    """``token, cls`` of all prefixes, or ``token, cls, n, need, central`` of tokens that the filter lets through."""
    mean = total / config.cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pass_ = bloom.Bloom(known.value) if known is not None else None
        for batch in common.slices(batches):
            sets = shingle_sets(batch.column(0), config.shingle)
            cls, _ = _fingerprints(sets)
            found = [(prefix(s, counts.value, mean, config), k) for k, s in enumerate(sets) if len(s)]
            if not found:
                continue
            token = np.concatenate([p for (p, _, _), _ in found])
            owner = np.repeat(np.arange(len(found)), [len(p) for (p, _, _), _ in found])
            row = np.array([k for _, k in found])
            names = ["token", "cls", "n", "need", "central"]
            if pass_ is None:
                yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(cls[row[owner]].view(np.int64))], names[:2])
                continue
            ok = pass_.might_hold(token)
            token, owner = token[ok], owner[ok]
            need, central = np.array([m for (_, m, _), _ in found]), np.array([c for (_, _, c), _ in found])
            size = np.array([len(sets[k]) for k in row])
            yield pa.record_batch([pa.array(x) for x in (token.view(np.int64), cls[row[owner]].view(np.int64), size[owner], need[owner], central[owner])], names)

    schema = "token long, cls long" + ("" if known is None else ", n long, need long, central double")
    return common.pick(documents, "text").mapInArrow(common.frugal(run), schema)


def _sets(documents: DataFrame, classes: DataFrame, needed: DataFrame, config: JaccardConfig) -> DataFrame:
    """``cls, shingles``: one row of each class in ``needed`` (cls), and perhaps a few others.

    They are made from the texts where they are used, which costs less than to keep them.
    """
    wanted = common.store(classes.join(needed.distinct(), "cls").select("doc_key"), "wanted", number=F.count(F.lit(1)))
    shipped = bloom.build(wanted, wanted.watched["number"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bloom.Bloom(shipped.value)
        for batch in batches:
            keep = known.might_hold(batch.column(0).to_numpy().astype(np.int64))
            for part in common.slices(iter([batch.filter(pa.array(keep))]), 1):
                if part.num_rows:
                    sets = shingle_sets(part.column(1), config.shingle)
                    # a document that the filter let through by chance only adds a class that nobody asks for
                    cls, _ = _fingerprints(sets)
                    yield pa.record_batch([pa.array(cls.view(np.int64)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["cls", "shingles"])

    found = _texts(documents).select("doc_key", "text").mapInArrow(common.frugal(run), "cls long, shingles array<long>")
    # a document may stand in several rows
    return found.groupBy("cls").agg(F.first("shingles").alias("shingles"))


def _plausible(pairs: DataFrame, classes: DataFrame, config: JaccardConfig) -> DataFrame:
    """The pairs (a, b) whose sizes and parity bits leave them a chance; no similar pair is lost."""
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    unlike = F.aggregate(F.zip_with("p_a", "p_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    # |A ^ B| <= (1 - t) / (1 + t) * (|A| + |B|)
    near = (config.den + config.num) * unlike <= (config.den - config.num) * (F.col("n_a") + F.col("n_b"))
    return met.where(near & (config.den * F.least("n_a", "n_b") >= config.num * F.greatest("n_a", "n_b"))).select(*pairs.columns)


def _verify(pairs: DataFrame, documents: DataFrame, classes: DataFrame, config: JaccardConfig) -> DataFrame:
    """The pairs (a, b) of classes that are similar."""
    sets = _sets(documents, classes, pairs.select(F.explode(F.array("a", "b")).alias("cls")), config)
    side = lambda c: sets.select(F.col("cls").alias(c), F.col("shingles").alias(f"of_{c}"))
    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("of_a", "of_b"))
    met = met.select("a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b") - both).alias("either"))
    return common.store(met.where(config.den * F.col("both") >= config.num * F.col("either")).select("a", "b"), "links")


def _merge(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """``id, component_id`` after these links too; only the components that they join are worked on."""
    if found is None:
        return common.store(components(links), "found")
    mark = lambda c: found.select(F.col("id").alias(c), F.col("component_id").alias(f"in_{c}"))
    ends = links.join(mark("a"), "a", "left").join(mark("b"), "b", "left").select(F.coalesce("in_a", "a").alias("a"), F.coalesce("in_b", "b").alias("b"))
    ends = common.store(ends.where("a <> b").distinct(), "joins", number=F.count(F.lit(1)))
    if not ends.watched["number"]:
        return found
    more = common.store(components(ends), "more")
    into = more.select(F.col("id").alias("component_id"), F.col("component_id").alias("into"))
    moved = found.join(into, "component_id", "left").select("id", F.coalesce("into", "component_id").alias("component_id"))
    new = more.join(found.select("id"), "id", "left_anti")
    return common.store(moved.unionByName(new), "found")


def _compare(group: pa.Table, config: JaccardConfig) -> pa.Table:
    """A spanning forest of the similar pairs between the block's two sides."""
    left, cls = (group.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("left", "cls"))
    lists, out = group.column("shingles").combine_chunks(), []
    at = [np.flatnonzero(left), np.flatnonzero(~left)]
    if len(at[0]) and len(at[1]):
        sides = [lists.take(pa.array(k)) for k in at]
        flat = [x.flatten().to_numpy() for x in sides]
        size = [x.value_lengths().to_numpy() for x in sides]
        rows = [np.repeat(np.arange(len(n)), n) for n in size]
        shared = np.intersect1d(flat[0], flat[1])
        both = np.zeros((len(at[0]), len(at[1])), np.float32)
        where = [np.searchsorted(shared, f) for f in flat]
        ok = [(a < len(shared)) & (shared[np.minimum(a, len(shared) - 1)] == f) if len(shared) else np.zeros(len(f), bool) for a, f in zip(where, flat, strict=True)]
        for lo in range(0, len(shared), _PAGE):
            m = []
            for k in (0, 1):
                here = ok[k] & (where[k] >= lo) & (where[k] < lo + _PAGE)
                dense = np.zeros((len(at[k]), _PAGE), np.float32)
                dense[rows[k][here], where[k][here] - lo] = 1
                m.append(dense)
            both += m[0] @ m[1].T
        either = size[0][:, None].astype(np.float64) + size[1][None, :] - both
        parent: dict[int, int] = {}

        def find(k: int) -> int:
            while parent.setdefault(k, k) != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for i, j in zip(*np.nonzero(config.den * both.astype(np.float64) >= config.num * either), strict=True):
            a, b = int(cls[at[0][i]]), int(cls[at[1][j]])
            u, v = find(a), find(b)
            if u != v:
                parent[max(u, v)] = min(u, v)
                out.append((a, b))
    return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def _clusters(members: DataFrame, sets: DataFrame, config: JaccardConfig) -> DataFrame:
    """Links (a, b) between members (hub, cls, n, left) of one cluster; one side of each is ``left``."""
    bucket = F.floor(F.log("n") / F.log(F.lit(config.den / config.num))).cast("long")
    # rows of a block: few if their sets are large
    limit = F.greatest(F.lit(1), F.least(F.lit(config.block_rows), F.floor(config.block_shingles / F.pow(F.lit(config.den / config.num), F.col("bucket") + 1)))).cast("long")
    rows = members.withColumn("bucket", bucket)
    sizes = rows.groupBy("hub", "bucket").agg(F.count("*").alias("all"), F.count_if("left").alias("lefts"))
    sizes = common.store(sizes.withColumn("all_parts", F.ceil(F.col("all") / limit)).withColumn("left_parts", F.ceil(F.col("lefts") / limit)).drop("all", "lefts"), "sizes")
    rows = rows.join(sizes, ["hub", "bucket"])
    number = lambda parts: F.pmod(F.xxhash64("cls"), F.greatest(F.col(parts), F.lit(1)))
    near = F.explode(F.array(*[F.col("bucket") + k for k in (-1, 0, 1)]))
    base = rows.select("hub", "cls", "left", "bucket", number("left_parts").alias("left_part"), number("all_parts").alias("all_part"), near.alias("other"))
    other = sizes.select("hub", F.col("bucket").alias("other"), F.col("left_parts").alias("their_lefts"), F.col("all_parts").alias("their_all"))
    base = base.join(other, ["hub", "other"])
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    xs = base.where("left").select("hub", "cls", F.lit(True).alias("left"), F.col("bucket").alias("xb"), F.col("other").alias("yb"), F.col("left_part").alias("xp"), upto("their_all").alias("yp"))
    ys = base.where("their_lefts > 0").select("hub", "cls", F.lit(False).alias("left"), F.col("other").alias("xb"), F.col("bucket").alias("yb"), upto("their_lefts").alias("xp"), F.col("all_part").alias("yp"))
    met = xs.unionByName(ys).join(sets, "cls")
    return met.groupBy("hub", "xb", "yb", "xp", "yp").applyInArrow(lambda group: _compare(group, config), "a long, b long")


def similar_components(documents: DataFrame, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    return _rows(documents, config).select("doc_id", "n_shingles", "component_id")


def _rows(documents: DataFrame, config: JaccardConfig) -> DataFrame:
    """... and ``doc_key``, which rows of one id and text share, and ``root``, one number for each component."""
    with common.workspace(documents.sparkSession) as keep:
        return keep(_components(documents, config), "components")


def _components(documents: DataFrame, config: JaccardConfig) -> DataFrame:
    docs, counts, total = _survey(documents, config)
    classes = docs.where("n > 0 and doc_id is not null").groupBy("cls", "check").agg(F.min("doc_id").alias("least_id"), F.min("doc_key").alias("doc_key"), F.min("n").alias("n"), F.first("parity").alias("parity"))
    classes = common.store(classes, "classes")
    tokens = _entries(documents, counts, total, config, None).groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("token")
    tokens = common.store(tokens, "tokens", number=F.count(F.lit(1)))
    known = bloom.build(tokens, tokens.watched["number"])
    entries = _entries(documents, counts, total, config, known).groupBy("token", "cls").agg(F.min("n").alias("n"), F.min("need").alias("need"), F.min("central").alias("central"))
    entries = common.store(entries, "entries")
    kinds = entries.groupBy("token").agg(F.count("*").alias("df"), F.max(F.struct("central", "cls"))["cls"].alias("hub")).where("df > 1")
    entries = common.store(entries.join(kinds, "token").drop("central"), "entries")
    light = entries.where(F.col("df") <= config.light)
    one, two = (light.select("token", F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("need").alias(f"need_{c}")) for c in "ab")
    pairs = one.join(two, "token").where("a < b").where(config.den * F.least("n_a", "n_b") >= config.num * F.greatest("n_a", "n_b"))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min(F.least("need_a", "need_b")).alias("need")).where("shared >= need").select("a", "b", "shared")
    heavy = entries.where(F.col("df") > config.light).groupBy("hub", "cls").agg(F.min("n").alias("n"), F.count("*").alias("shared"))
    heavy = common.store(heavy, "heavy")
    star = heavy.where("hub <> cls").select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b"), "shared")
    pairs = common.store(pairs.unionByName(star).groupBy("a", "b").agg(F.sum("shared").alias("shared")), "pairs")
    pairs = common.store(_plausible(pairs, classes, config), "pairs")
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    best = ends.groupBy("a").agg(F.max(F.struct("shared", "b"))["b"].alias("b"))
    best = common.store(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "best")
    # everyone's best candidate first; then, of all others, only pairs that are still apart
    found = _merge(None, _verify(best, documents, classes, config))
    mark = lambda c: found.select(F.col("id").alias(c), F.col("component_id").alias(f"in_{c}"))
    apart = pairs.select("a", "b").join(best, ["a", "b"], "left_anti").join(mark("a"), "a", "left").join(mark("b"), "b", "left")
    apart = common.store(apart.where(F.coalesce("in_a", "a") != F.coalesce("in_b", "b")).select("a", "b"), "apart")
    found = _merge(found, _verify(apart, documents, classes, config))
    # members of heavy clusters that their hub didn't bring together
    label = lambda c, out: found.select(F.col("id").alias(c), F.col("component_id").alias(out))
    placed = heavy.join(label("cls", "own"), "cls", "left").join(label("hub", "main"), "hub", "left")
    placed = placed.withColumn("left", F.coalesce("own", "cls") != F.coalesce("main", "hub"))
    odd = placed.where("left").select("hub").distinct()
    members = common.store(placed.join(odd, "hub").select("hub", "cls", "n", "left"), "members", number=F.count(F.lit(1)))
    if members.watched["number"]:
        some = _sets(documents, classes, members.select("cls"), config)
        found = _merge(found, common.store(_clusters(members, some, config), "links"))
    # a component's number is the smallest id of its classes
    rooted = classes.join(found.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("component_id", "cls"))
    rooted = common.store(rooted.select("cls", "check", "least_id", "root"), "rooted")
    least = common.store(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    # all copies of a text, and all texts of a component, meet in joins of written tables, which Spark can split
    final = common.store(rooted.join(least, "root").select("cls", "check", "root", "component_id"), "final")
    rows = docs.drop("parity").join(final, ["cls", "check"], "left")
    has = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "doc_key", F.when(has, F.col("root")).alias("root"))


def one_of_each(documents: DataFrame, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """The rows of ``documents``, all columns, with one row of each component: that of the smallest id.

    Where rows of that id have several texts of one component, the one with the smallest hash stays, and of equal
    rows one. Rows without an id or without words stay.
    """
    common.prepare(documents.sparkSession)  # for the rows that are read later, too
    with common.workspace(documents.sparkSession) as keep:
        found = _rows(documents, config).where("root is not null")
        best = common.store(found.groupBy("root").agg(F.min(F.struct("doc_id", "doc_key")).alias("best")), "best")
        judged = found.join(best, "root").select("doc_key", (F.struct("doc_id", "doc_key") != F.col("best")).alias("goes"))
        per_key = judged.groupBy("doc_key").agg(F.bool_or("goes").alias("goes"), F.count("*").alias("times"))
        # who goes, and which rows occur several times; all others stay where they are
        touched = keep(per_key.where("goes or times > 1").select("doc_key", "goes"), "touched")
    might = bloom.test(touched.select("doc_key"))
    # the rows travel as one struct, whatever their other columns are called
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    rows = rows.withColumn("doc_key", F.xxhash64("row.doc_id", "row.text")).withColumn("maybe", F.col("row.doc_id").isNotNull() & might("doc_key"))
    met = rows.where("maybe").join(touched, "doc_key", "left").where("goes is null or not goes")
    several = met.where("goes is not null").groupBy("doc_key").agg(F.first("row").alias("row"))
    kept = rows.where("not maybe").select("row").unionByName(met.where("goes is null").select("row")).unionByName(several.select("row"))
    return kept.select("row.*")
