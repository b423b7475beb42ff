"""Connected components of a graph given as a table of edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash, unstash


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one parent at most, and none if it is a parent itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up > 1 or up = 1 and down = 1").count() == 0


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, root for every node of an edge: root is the least node reachable.

    A large-star round hangs each node's larger neighbours on its least
    neighbour, a small-star round does so with the smaller ones; both only take
    minima per node (combined before the shuffle) and join them back, so no
    neighbour list is ever gathered. Rounds are written to the shared folder
    and end when all hang on roots, which may be so at the start.
    """
    now = stash(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "v")
        large = now.join(least, "v").select("u", F.col("m").alias("v"))  # repeats go with those of the small stars
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        then = stash(small, "edges")
        unstash(now)
        now = then
    raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
