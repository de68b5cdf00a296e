"""PageRank with a fixed number of iterations.

Every rank starts at 1; ``rank = 0.85 * sum(rank(u) / outdeg(u)) + 0.15 / N`` over the
edges in, with multiplicity.  The mass of vertices without edges out is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators import gas
from spindrift.operators.graph import Graph
from spindrift.session import cut, drop, settings

JUMP = 0.15


class PageRankKernel(gas.Kernel):
    """``single``: every message and sum is a 32-bit float, added in ascending order of src."""

    def __init__(self, num_vertices: int, single: bool = False):
        self.n, self.single = num_vertices, single

    def prepare(self, graph: Graph, vertices: DataFrame) -> DataFrame:
        return vertices.join(graph.out_degrees(), "id")

    def init(self, vertex: str) -> Column:
        return F.lit(1.0).cast("float" if self.single else "double")

    def scatter(self, src: Column, dst: Column, value: Column, vertex: str) -> Column:
        degree = F.col(f"{vertex}.degree")
        # Spark divides as doubles; rounding that quotient to a float equals dividing floats
        return (value / degree.cast("float")).cast("float") if self.single else value / degree

    def zero(self, vertex: str) -> Column:
        return F.lit(0.0).cast("float" if self.single else "double")

    def combine(self, message: Column, src: Column) -> Column | None:
        return None if self.single else F.sum(message)

    def merge(self, acc: Column, message: Column, src: Column) -> Column:
        return (acc + message).cast("float")

    def apply(self, previous: Column, folded: Column, vertex: str) -> Column:
        out = F.lit(1 - JUMP) * folded.cast("double") + F.lit(JUMP / self.n)
        return out.cast("float") if self.single else out

    def result(self, state: DataFrame) -> DataFrame:
        return state.select("id", F.col("value").alias("rank"))


#: A vertex with more distinct arcs than this, and than an equal share of all, is a hub.
HUB_ARCS = 1 << 20
#: Arcs that one part of the dealt arcs holds, about.
PART_ARCS = 1 << 22


def pagerank(graph: Graph, num_iters: int = 50, precision: str = "double", cut_every: int = 10, hub_arcs: int = HUB_ARCS) -> DataFrame:
    """``id, rank`` of every vertex, written to the shared folder.

    With doubles, parallel edges are summed first, and an arc of weight 0 from each vertex to
    itself keeps all vertices in play.  The arcs are dealt by src once, into parts that grow in number with
    the arcs, and an iteration shuffles one partial sum a vertex and task and nothing else.  Arcs of
    hubs stay where they are, spread over all tasks, and get their ranks by broadcast: a
    hub has more than an equal share of the arcs, so there are fewer hubs than parts.
    """
    if precision == "f32":
        return gas.run(graph, PageRankKernel(graph.num_vertices, single=True), num_iters)
    if num_iters == 0:
        return graph.vertices().withColumn("rank", F.lit(1.0))
    spark = graph.spark
    pairs = cut(graph.edges.groupBy("src", "dst").agg(F.count("*").alias("k")))
    distinct = Graph(pairs, graph.given)
    n, m = distinct.num_vertices, distinct.num_edges
    # the larger a part, the fewer partial sums: no more parts than tasks run at once, unless they'd be too large
    parts = max(spark.sparkContext.defaultParallelism, -(-m // PART_ARCS))
    degrees = cut(pairs.groupBy("src").agg(F.sum("k").alias("degree"), F.count("*").alias("arcs")))
    arcs = pairs.join(degrees.drop("arcs"), "src").select("src", "dst", (F.col("k") / F.col("degree")).alias("w"))
    hubs = degrees.where(F.col("arcs") > max(hub_arcs, m // parts)).select("src")  # fewer than parts
    spread = None
    if not hubs.isEmpty():
        spread = cut(arcs.join(F.broadcast(hubs), "src"))
        arcs = arcs.join(F.broadcast(hubs), "src", "left_anti")
    stay = spark.range(n).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w"))
    # the loop's plans are the same again and again, and nothing in them is left to adapt; executors compile equal steps once
    with settings(spark, spark__sql__shuffle__partitions=str(parts), spark__sql__adaptive__enabled="false", spark__sql__codegen__useIdInClassName="false"):
        dealt = arcs.unionByName(stay).repartition(parts, "src").persist()
        try:
            ranks = last = None  # all are 1 at first
            for k in range(num_iters):
                if ranks is None:
                    every = dealt if spread is None else dealt.unionByName(spread)
                    sent = every.select("dst", F.col("w").alias("m"))
                else:
                    # a part's ranks become a hash table: the arcs needn't be sorted
                    sent = dealt.join(ranks.hint("shuffle_hash"), dealt["src"] == ranks["id"])
                    if spread is not None:
                        theirs = ranks.join(F.broadcast(hubs), ranks["id"] == hubs["src"]).select("id", "rank")
                        sent = sent.unionByName(spread.join(F.broadcast(theirs), F.col("src") == F.col("id")))
                    sent = sent.select("dst", (F.col("rank") * F.col("w")).alias("m"))
                new = sent.groupBy(F.col("dst").alias("id")).agg((F.lit(1 - JUMP) * F.sum("m") + F.lit(JUMP / n)).alias("rank"))
                if (k + 1) % (cut_every if spread is None else 1) == 0 or k + 1 == num_iters:
                    new = cut(new)
                    drop(last)
                    last = new
                ranks = new
        finally:
            dealt.unpersist()
    drop(pairs, degrees, spread)
    return ranks


def as_text(ranks: DataFrame) -> DataFrame:
    """``id, rank`` with the rank as text of six decimals."""
    return ranks.select("id", F.format_string("%.6f", F.col("rank").cast("double")).alias("rank"))
