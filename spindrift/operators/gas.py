"""Gather-apply-scatter supersteps.

A kernel builds Column expressions; one superstep is

    messages   = edges join state on src            -> scatter, gather
    folded     = messages grouped by dst            -> combine, or an ordered fold from zero
    next state = state left join folded             -> apply

All vertices see the state of the superstep before (bulk-synchronous).
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.graph import Graph
from spindrift.session import cut, drop


class Kernel(ABC):
    """Either ``combine`` (an aggregate, order doesn't matter) or ``merge`` (a left fold, src ascending)."""

    #: Whether ``gather`` reads the state of the receiving vertex.
    reads_dst = False

    def prepare(self, graph: Graph, vertices: DataFrame) -> DataFrame:
        """Columns of the vertices that stay the same in all supersteps."""
        return vertices

    @abstractmethod
    def init(self, vertex: str) -> Column:
        """First state of a vertex; columns of ``prepare`` are ``vertex.name``."""

    @abstractmethod
    def scatter(self, src: Column, dst: Column, value: Column, vertex: str) -> Column: ...

    def gather(self, src: Column, dst: Column, message: Column, dst_value: Column | None, dst_vertex: str) -> Column:
        return message

    @abstractmethod
    def zero(self, vertex: str) -> Column: ...

    def combine(self, message: Column, src: Column) -> Column | None:
        return None

    def merge(self, acc: Column, message: Column, src: Column) -> Column:
        raise NotImplementedError

    def apply(self, previous: Column, folded: Column, vertex: str) -> Column:
        return folded

    def result(self, state: DataFrame) -> DataFrame:
        return state


def _fold(kernel: Kernel, messages: DataFrame) -> DataFrame:
    combined = kernel.combine(F.col("message"), F.col("src"))
    if combined is not None:
        return messages.groupBy("dst").agg(combined.alias("folded"))
    return messages.groupBy("dst").agg(F.array_sort(F.collect_list(F.struct("src", "message"))).alias("in"))


def messages(graph: Graph, kernel: Kernel, state: DataFrame) -> DataFrame:
    """``src, dst, message`` of every edge for this state (id, value and the prepared columns)."""
    fixed = [c for c in state.columns if c not in ("id", "value")]
    side = lambda end: state.select(F.col("id").alias(end), F.struct("value", *fixed).alias(f"{end}_vertex"))
    met = graph.edges.join(side("src"), "src")
    sent = kernel.scatter(F.col("src"), F.col("dst"), F.col("src_vertex.value"), "src_vertex")
    met = met.withColumn("message", sent)
    if kernel.reads_dst:
        met = met.join(side("dst"), "dst")
        met = met.withColumn("message", kernel.gather(F.col("src"), F.col("dst"), F.col("message"), F.col("dst_vertex.value"), "dst_vertex"))
    else:
        met = met.withColumn("message", kernel.gather(F.col("src"), F.col("dst"), F.col("message"), None, ""))
    return met.select("src", "dst", "message")


def superstep(graph: Graph, kernel: Kernel, state: DataFrame) -> DataFrame:
    folded = _fold(kernel, messages(graph, kernel, state))
    met = state.join(folded.withColumnRenamed("dst", "id"), "id", "left")
    met = met.withColumn("vertex", F.struct(*[c for c in state.columns if c != "value"]))
    zero = kernel.zero("vertex")
    if "folded" in met.columns:
        result = F.coalesce("folded", zero)
    else:
        result = F.aggregate(F.coalesce("in", F.array()), zero, lambda acc, x: kernel.merge(acc, x["message"], x["src"]))
    new = met.withColumn("next", kernel.apply(F.col("value"), result, "vertex"))
    return new.select("id", F.col("next").alias("value"), *[c for c in state.columns if c not in ("id", "value")])


def initial(graph: Graph, kernel: Kernel) -> DataFrame:
    ready = kernel.prepare(graph, graph.vertices())
    return ready.withColumn("vertex", F.struct(*ready.columns)).withColumn("value", kernel.init("vertex")).select("id", "value", *[c for c in ready.columns if c != "id"])


def run(graph: Graph, kernel: Kernel, num_iters: int, cut_every: int = 8) -> DataFrame:
    """The kernel's result after ``num_iters`` supersteps; 0 gives the first state."""
    state, last = initial(graph, kernel), None
    for k in range(num_iters):
        state = superstep(graph, kernel, state)
        if (k + 1) % cut_every == 0 and k + 1 < num_iters:
            state = cut(state)
            drop(last)
            last = state
    return kernel.result(state)
