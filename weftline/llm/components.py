"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Every step is a ``min`` per node (combined before the shuffle, so that a node with a third of all edges is no hot task)
and a join of edges with those minima (which adaptive execution can split). Edges and components never leave the
executors; each round is cut off by ``checkpoint()``, so that a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import shared_dir

MAX_ROUNDS = 64


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to the least of those."""
    down = edges.where("v < u").select("u", "v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v; longs); the component is its least node.

    Self links, repeated and reversed links do no harm; links with a null end are ignored; no links give no rows.
    """
    shared_dir(edges.sparkSession)
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    digest = None
    for _ in range(MAX_ROUNDS):
        now = _small_star(_large_star(now)).distinct().checkpoint()
        seen = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if seen == digest:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        digest = seen
    raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")
