"""Graphs derived from the tables, as DataFrames and as the SQL of the same edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.operators.graph import Graph
from spindrift.operators.sequence import with_next

SQL = {
    "D1": "select src, dst from (select user_id src, lead(user_id) over (order by ts, event_id) dst from events) where dst is not null",
    "D2": "select distinct l_suppkey src, l_partkey + (select count(*) from supplier) dst from lineitem",
    "D2m": "select l_suppkey src, l_partkey + (select count(*) from supplier) dst from lineitem",
    "D3": "select src, dst from (select o_orderkey src, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) dst from orders) where dst is not null",
}
SQL["D4"] = f"select src, dst from ({SQL['D2m']}) union all select dst, src from ({SQL['D2m']})"


#: Rows of a part whose distinct pairs a task holds in memory.
PART_ROWS = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str, graph: str) -> DataFrame:
    if graph == "D1":
        events = table(spark, sf_dir, "events").select("ts", "event_id", F.col("user_id").alias("src"))
        return with_next(events, ["ts", "event_id"], "src", "dst").where("dst is not null").select("src", "dst")
    if graph == "D3":
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst"))
        return orders.where("dst is not null")
    suppliers = table(spark, sf_dir, "supplier").count()
    lines = table(spark, sf_dir, "lineitem")
    pairs = lines.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + suppliers).alias("dst"))
    if graph == "D2":
        # hardly a pair repeats: summing them before the shuffle would hold a split's pairs in memory for nothing
        parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // PART_ROWS))
        return pairs.repartition(parts, "src", "dst").distinct()
    if graph == "D2m":
        return pairs
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def graph(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    return Graph(edges(spark, sf_dir, name))
