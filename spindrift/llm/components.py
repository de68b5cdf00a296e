"""Connected components of links between numbers, by large-star and small-star rounds.

Every round joins each node with the smallest of its neighbours (a partial sum, so a
node with very many links is no burden to one task) and writes the shrunken links to
the shared folder.  About log(n) rounds, and always as many as it takes until one changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm import common


def _star(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``u, m`` (the smallest number around u, itself included), and the arcs (u, v) with that m.

    The first is written, so the join has a shuffle of its own on both sides and Spark can split
    a node with very many arcs among tasks.
    """
    least = common.store(arcs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return least, arcs.join(least, "u")


def _falling(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _state() -> dict[str, Column]:
    """What tells one set of links from another."""
    return {"links": F.count(F.lit(1)), "mark": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}


def components(links: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """``id, component_id`` of every number in ``links`` (a, b): the smallest number reachable.

    With ``most_rounds``, an error if labels are not stable by then.
    """
    down = common.store(links.select(*_falling("a", "b")).where("u <> v").distinct(), "links", **_state())
    rounds = 0
    while down.watched["links"]:
        if rounds == most_rounds:
            raise RuntimeError(f"components are not stable after {rounds} rounds")
        rounds += 1
        # large star: every larger neighbour of u hangs on the smallest number around u
        least, met = _star(down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = common.store(met.where("v > u").select(*_falling("v", "m")).where("u <> v").distinct(), "links")
        common.drop_stored(least)
        # small star: u and its smaller neighbours hang on the smallest of them
        least, met = _star(large)
        small = met.select(*_falling("v", "m")).unionByName(least.select(*_falling("u", "m")))
        new = common.store(small.where("u <> v").distinct(), "links", **_state())
        for old in (least, large, down):
            common.drop_stored(old)
        stable = new.watched == down.watched
        down = new
        if stable:
            break
    out = down.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return out.unionByName(out.select(F.col("component_id").alias("id"), "component_id").distinct())
