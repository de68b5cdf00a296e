"""The library's front: queries over an edge-list file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.operators.graph import Graph
from spindrift.plans import clustering as _clustering
from spindrift.plans import pagerank as _pagerank
from spindrift.session import local_session
from spindrift.sources.edge_list import read_edges


def load(file_name: str, mode: str = "line", spark: SparkSession | None = None) -> Graph:
    return Graph(read_edges(spark or SparkSession.getActiveSession() or local_session(), file_name, mode))


def pagerank(file_name: str, num_iters: int = 50, precision: str = "double", mode: str = "line") -> DataFrame:
    """``id, rank``"""
    return _pagerank.pagerank(load(file_name, mode), num_iters, precision)


def pagerank_text(file_name: str, num_iters: int = 50, precision: str = "double", mode: str = "line") -> DataFrame:
    """``id, rank`` with ranks as text of six decimals."""
    return _pagerank.as_text(pagerank(file_name, num_iters, precision, mode))


def clustering(file_name: str, num_clusters_hint: int = 100, threshold: float = 3e-5, mode: str = "line") -> DataFrame:
    """``id, cluster``"""
    return _clustering.clustering(load(file_name, mode), num_clusters_hint, threshold)


def to_list(values: DataFrame, name: str) -> list:
    """A small result as a list in the order of ids."""
    return [r[0] for r in values.orderBy("id").select(name).collect()]
