"""Greedy modularity clustering.

One level: every vertex looks at the vertices with an edge to it and takes the one with the
largest modularity gain above ``threshold`` (the smallest id of equals); if that id is smaller than its own it
becomes its parent.  Trees of parents are clusters, numbered by ascending root.

Further levels run on the compacted graph, with summed weights, until no label changes or
``num_clusters_hint`` is reached.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.graph import Graph
from spindrift.operators.sequence import with_number
from spindrift.session import cut, drop


@dataclass
class Level:
    """A weighted graph of distinct arcs (src, dst, w).

    ``vertices``: id and weight, the ends of edges at a vertex; ``total``: edges of the original graph.
    """

    vertices: DataFrame
    arcs: DataFrame
    total: int


def first_level(graph: Graph) -> Level:
    """Parallel edges count once in an arc's weight and fully in strengths."""
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id"))
    weight = ends.groupBy("id").agg(F.count("*").alias("weight"))
    vertices = graph.vertices().join(weight, "id", "left").select("id", F.coalesce("weight", F.lit(0)).alias("weight"))
    return Level(vertices, graph.edges.distinct().withColumn("w", F.lit(1).cast("long")), graph.num_edges)


def strengths(level: Level) -> DataFrame:
    """``id, q``"""
    return level.vertices.select("id", (F.col("weight") / F.lit(2.0 * level.total)).alias("q"))


def gains(level: Level) -> DataFrame:
    """``src, dst, gain`` of every arc."""
    # all sides, and the vertices that best_moves joins, are one shuffle of id and weight
    side = lambda c: level.vertices.select(F.col("id").alias(c), F.col("weight").alias(f"weight_{c}"))
    met = level.arcs.join(side("src"), "src").join(side("dst"), "dst")
    share = lambda c: F.col(c) / F.lit(2.0 * level.total)
    return met.select("src", "dst", (F.lit(2.0) * (share("w") - share("weight_src") * share("weight_dst"))).alias("gain"))


def best_moves(level: Level, threshold: float) -> DataFrame:
    """``id, parent, gain, weight`` of every vertex; without a gain above the threshold it is its own parent."""
    best = gains(level).where(F.col("gain") > threshold).groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((-F.col("gain")).alias("loss"), "src")).alias("best"))
    met = level.vertices.where("id is not null").join(best, "id", "left")  # the filter that the joins of gains have, for the same shuffle
    return met.select("id", F.coalesce(F.least("id", "best.src"), "id").alias("parent"), F.coalesce(-F.col("best.loss"), F.lit(threshold)).alias("gain"), "weight")


def roots(parents: DataFrame) -> DataFrame:
    """``id, root`` by pointer jumping; a parent's id is never larger than its child's, so paths end."""
    pieces, _ = _merged(cut(parents))
    return _union([*pieces, parents.where("parent = id").select("id", F.col("parent").alias("root"))])


def _union(pieces: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, pieces)


def _merged(parents: DataFrame, *carried: str, most_rounds: int = 64) -> tuple[list[DataFrame], list[DataFrame]]:
    """``id, root`` and the carried columns of the vertices that have a parent other than themselves, in pieces; the tables of these.

    ``parents`` is a written table.  A round joins and writes only the vertices that aren't known to be at their root.
    """
    active, pieces, tables = parents.where("parent <> id").select("id", F.col("parent").alias("root"), *carried), [], []
    for _ in range(most_rounds):
        up = _union([active.select("id", "root", F.lit(False).alias("top_ended")), *[x.select("id", "root", F.lit(True).alias("top_ended")) for x in pieces]])
        up = up.select(F.col("id").alias("root"), F.col("root").alias("top"), "top_ended")
        # what has no parent is a root
        moved = active.join(up, "root", "left").select("id", F.coalesce("top", "root").alias("root"), *carried, F.coalesce("top_ended", F.lit(True)).alias("ended"))
        new = cut(moved, going=F.count_if(~F.col("ended")))
        tables.append(new)
        pieces.append(new.where("ended").drop("ended"))
        active = new.where("not ended").drop("ended")
        if not new.watched["going"]:
            return pieces, tables
    raise RuntimeError(f"paths are not at their ends after {most_rounds} rounds")


def packed(labels: DataFrame) -> DataFrame:
    """``id, cluster``: roots, each a row of its own, numbered from 0 on in ascending order."""
    numbers = with_number(labels.where("id = root").select("root"), ["root"], "cluster")
    others = labels.where("id <> root").join(numbers, "root").select("id", "cluster")
    return others.unionByName(numbers.select(F.col("root").alias("id"), "cluster"))


def compact(level: Level, moves: DataFrame, merged: DataFrame) -> Level:
    """The graph of clusters, which keep the ids of their roots; ``merged``: ``id, root, weight`` of all other vertices."""
    arcs = level.arcs
    for end in ("src", "dst"):
        arcs = arcs.join(merged.select(F.col("id").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    both = arcs.where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    parts = moves.where("parent = id").select("id", "weight").unionByName(merged.select(F.col("root").alias("id"), "weight"))
    return Level(parts.groupBy("id").agg(F.sum("weight").alias("weight")), both, level.total)


def compact_counts(graph: Graph, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between clusters (``src, dst, weight``) and within them (``id, weight``), every edge of the bag once."""
    side = lambda c: clusters.select(F.col("id").alias(c), F.col("cluster").alias(f"c_{c}"))
    met = graph.edges.join(side("src"), "src").join(side("dst"), "dst").groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.count("*").alias("weight"))
    return met.where("src <> dst"), met.where("src = dst").select(F.col("src").alias("id"), "weight")


def clustering(graph: Graph, num_clusters_hint: int = 100, threshold: float = 3e-5, max_levels: int = 20, on_no_gain: str = "zero") -> DataFrame:
    """``id, cluster`` of every vertex.

    Where no gain exceeds the threshold at the first level, every label is 0
    (``on_no_gain="identity"``: its own id).
    """
    edges = cut(graph.edges)
    graph = Graph(edges, graph.given)
    level = _kept(first_level(graph))
    moves = _moves(level, threshold)
    if not moves.watched["gaining"]:
        zero = graph.vertices().withColumn("cluster", F.lit(0).cast("long"))
        drop(edges, level.vertices, level.arcs, moves)
        return zero if on_no_gain == "zero" else zero.withColumn("cluster", F.col("id"))
    # numbers of clusters ascend with their roots, so levels can do with roots, and clusters are numbered once at the end
    merged, tables = _merged(moves, "weight")
    levels, written = [merged], tables
    for _ in range(max_levels - 1):
        if moves.watched["clusters"] <= num_clusters_hint:
            break
        finer, level = level, _kept(compact(level, moves, _union(merged)))
        drop(finer.vertices, finer.arcs, moves)
        moves = _moves(level, threshold)
        if not moves.watched["moving"]:
            break
        merged, tables = _merged(moves, "weight")
        levels.append(merged)
        written += tables
    # a vertex is merged at one level at most; from the last level on, its root has its own last root already
    last = []
    for pieces in reversed(levels):
        ends = _union(pieces).select("id", "root")
        if last:
            then = _union(last).select(F.col("id").alias("root"), F.col("root").alias("then"))
            ends = ends.join(then, "root", "left").select("id", F.coalesce("then", "root").alias("root"))
        last.append(cut(ends))
    labels = cut(packed(_union([*last, moves.where("parent = id").select("id", F.col("parent").alias("root"))])))
    drop(edges, level.vertices, level.arcs, moves, *written, *last)
    return labels


def _moves(level: Level, threshold: float) -> DataFrame:
    """``id, parent, weight``, written, and counts of vertices that have a gain, that move, and that stay."""
    best = best_moves(level, threshold).select("id", "parent", "weight", (F.col("gain") > threshold).alias("gained"))
    return cut(best, gaining=F.count_if("gained"), moving=F.count_if(F.col("parent") != F.col("id")), clusters=F.count_if(F.col("parent") == F.col("id")))


def _kept(level: Level) -> Level:
    return Level(cut(level.vertices), cut(level.arcs), level.total)
