"""Connected components of a graph held as a table of links.

Large-star and small-star steps alternate until the links are stars around the smallest node
of each component.  A step is an aggregate and a join on the node; no node's links are ever
gathered, and the graph never comes to the driver.  The links after each round are a
written table, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.operators.joins import inner_join_unique
from keyweave.session import materialize


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _linked_to_least(links: DataFrame, *, larger_only: bool) -> DataFrame:
    """Each end of a link to the smallest node around its start; start > end in the result."""
    least = links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    met = inner_join_unique(links, least, ["a"])
    if larger_only:  # large star: the larger neighbours move
        moved = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:  # small star: the smaller neighbours move, and the node itself
        moved = met.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select("a", F.col("least").alias("b"))
        )
    return moved.where("a <> b").distinct()


def connected(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node.

    Links may repeat, point either way or join a node to itself; NULL ends are ignored.
    A node whose only link is to itself has no row.
    """
    now = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    mark = None
    for _ in range(most_rounds):
        large = _linked_to_least(_both_ways(now), larger_only=True)
        now = materialize(_linked_to_least(large, larger_only=False), "links")
        seen = now.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"),
        ).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.union(roots)
