"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm import common

MAX_ROUNDS = 60


def _settled(e: DataFrame) -> bool:
    """Whether every node is either a root or linked to exactly one root."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0] == 0


def _large_star(e: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest neighbour (itself included)."""
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return common.joined_salted(both, least, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = common.joined_salted(down, least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node with an edge.

    ``edges`` has long columns u, v; loops and repeated edges do not matter. Each round is written
    to the shared folder, and nodes with very many edges are dealt over many tasks. The number of rounds grows with the logarithm of the longest path.
    """
    e = common.written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    for _ in range(MAX_ROUNDS):
        if _settled(e):
            break
        e = common.written(_small_star(_large_star(e)).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
