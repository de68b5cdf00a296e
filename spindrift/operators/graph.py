"""Directed property graphs as DataFrames: a bag of edges and the vertices 0 to max(id).

Parallel edges and self-loops are kept; every id up to the largest is a vertex,
also those that no edge names.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.sequence import with_number, with_running


class Graph:
    """``edges``: src, dst (long).  Everything else is a lazy DataFrame derived from it."""

    def __init__(self, edges: DataFrame, num_vertices: int | None = None):
        self.edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        self.given = num_vertices

    @classmethod
    def from_adjacency(cls, adjacency: DataFrame) -> Graph:
        """From ``src, dsts`` with distinct numbers in each list; rows with empty lists are vertices too."""
        n = adjacency.agg(F.max("src"), F.max(F.array_max("dsts")), F.count_if(F.size(F.array_distinct("dsts")) < F.size("dsts"))).first()
        if n[0] is None:
            raise ValueError("an adjacency list needs at least one vertex")
        if n[2]:
            raise ValueError("an adjacency list holds no repeated neighbours")
        return cls(adjacency.select("src", F.explode("dsts").alias("dst")), max(n[0], n[1] if n[1] is not None else 0) + 1)

    @property
    def spark(self):
        return self.edges.sparkSession

    @cached_property
    def _counts(self) -> tuple[int, int]:
        r = self.edges.agg(F.max(F.greatest("src", "dst")), F.count("*"), F.min(F.least("src", "dst"))).first()
        if r[0] is None and self.given is None:
            raise ValueError("a graph needs at least one edge")
        if r[2] is not None and r[2] < 0:
            raise ValueError("vertex ids can't be negative")
        return self.given or r[0] + 1, r[1]

    @property
    def num_vertices(self) -> int:
        return self._counts[0]

    @property
    def num_edges(self) -> int:
        return self._counts[1]

    def vertices(self) -> DataFrame:
        return self.spark.range(self.num_vertices)

    def counts(self) -> DataFrame:
        """One row: num_vertices, num_edges."""
        return self.edges.agg((F.max(F.greatest("src", "dst")) + 1).alias("num_vertices"), F.count("*").alias("num_edges"))

    def reverse(self) -> Graph:
        return Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), self.given)

    def sorted_edges(self) -> DataFrame:
        return self.edges.orderBy("src", "dst")

    def _degrees(self, by: str) -> DataFrame:
        seen = self.edges.groupBy(F.col(by).alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices().join(seen, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def out_degrees(self) -> DataFrame:
        return self._degrees("src")

    def in_degrees(self) -> DataFrame:
        return self._degrees("dst")

    def _offsets(self, degrees: DataFrame) -> DataFrame:
        """Where each vertex's edges begin in the sorted edges, and one row more for the end."""
        closed = degrees.unionByName(self.spark.range(self.num_vertices, self.num_vertices + 1).select("id", F.lit(0).cast("long").alias("degree")))
        return with_running(closed, ["id"], F.col("degree"), "offset").select("id", "offset")

    def out_offsets(self) -> DataFrame:
        return self._offsets(self.out_degrees())

    def in_offsets(self) -> DataFrame:
        return self._offsets(self.in_degrees())

    def out_neighbors(self) -> DataFrame:
        """``id, neighbors``: sorted, repeated as often as the edge; vertices without any are left out."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbors"))

    def in_neighbors(self) -> DataFrame:
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("src")).alias("neighbors"))

    def out_neighbors_of(self, v: int) -> DataFrame:
        return self.edges.where(F.col("src") == v).select("dst")

    def in_neighbors_of(self, v: int) -> DataFrame:
        return self.edges.where(F.col("dst") == v).select("src")

    def adjacency(self) -> DataFrame:
        """``src, dsts`` of every vertex, each neighbour once."""
        lists = self.edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("dsts"))
        return self.vertices().withColumnRenamed("id", "src").join(lists, "src", "left").select("src", F.coalesce("dsts", F.array().cast("array<bigint>")).alias("dsts"))

    def inverse_adjacency(self) -> DataFrame:
        return self.reverse().adjacency()

    def forward_index(self) -> DataFrame:
        """``src, dst, out_position, in_position``: where each edge of the order (src, dst) is in the order (dst, src)."""
        out = with_number(self.edges, ["src", "dst"], "out_position")
        return with_number(out, ["dst", "src", "out_position"], "in_position")

    def partition_bounds(self, parts: int, direction: str = "out") -> DataFrame:
        """``part, bound``: the first vertex of each of ``parts`` ranges with about as many edges."""
        offsets = (self.out_offsets() if direction == "out" else self.in_offsets()).where(F.col("id") < self.num_vertices)
        chunk = self.num_edges // parts
        inner = offsets.agg(*[F.count_if(F.col("offset") < chunk * t).alias(str(t)) for t in range(1, parts)]) if parts > 1 else None
        ends = self.spark.createDataFrame([(0, 0), (parts, self.num_vertices)], "part long, bound long")
        if inner is None:
            return ends
        stacked = inner.unpivot([], [F.col(f"`{t}`") for t in range(1, parts)], "part", "bound")
        return ends.unionByName(stacked.select(F.col("part").cast("long").alias("part"), "bound"))

    def dangling(self) -> DataFrame:
        """Vertices without edges out."""
        return self.vertices().join(self.edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")

    def isolated(self) -> DataFrame:
        """Vertices that no edge names."""
        named = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return self.vertices().join(named, "id", "left_anti")

    def compact_ids(self) -> tuple[Graph, DataFrame]:
        """The same graph over 0 to k - 1, and the mapping ``id, original``, for sparse or huge ids."""
        named = self.edges.select(F.col("src").alias("original")).unionByName(self.edges.select(F.col("dst").alias("original"))).distinct()
        mapping = with_number(named, ["original"], "id").select("id", "original")
        side = lambda c: mapping.select(F.col("original").alias(c), F.col("id").alias(f"{c}_id"))
        edges = self.edges.join(side("src"), "src").join(side("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
        return Graph(edges), mapping
