"""Lineage graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """node, ancestor, depth (the least) by an iterated frontier; what was reached is never walked again, so diamonds don't multiply.

    Each round joins only what is new, and is written; rounds end when nothing is, at any depth.
    """
    step = written(edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).filter("node != ancestor").distinct())
    hop = step.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("__next"))
    new = known = step.withColumn("depth", F.lit(1))
    depth = 1
    while not new.isEmpty():
        depth += 1
        new = new.join(hop, "ancestor").select("node", F.col("__next").alias("ancestor")).filter("node != ancestor").distinct()
        new = written(new.join(known, ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        known = known.unionByName(new)
    return known


def on_cycles(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """Edges left when every node without parents, then without unresolved ones, is peeled off: those on or above a cycle."""
    left = written(edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).distinct())
    n, now = -1, left.count()
    while now not in (0, n):
        left = written(left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("child", "parent"))
        n, now = now, left.count()
    return left


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (the least node reachable) for every node of an edge: each takes the least root of its neighbours and then its root's own, until nothing changes.

    Rounds join by merging: tables just below the limit of a broadcast would go through the driver three times a round.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = written(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).filter("node != other").distinct())
    roots = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")))
    while True:
        offered = both.join(roots.withColumnRenamed("node", "other").hint("merge"), "other").groupBy("node").agg(F.min("root").alias("least"))
        nearer = roots.join(offered.hint("merge"), "node").select("node", F.least("root", "least").alias("hop"), F.col("root").alias("was"))
        jump = roots.select(F.col("node").alias("hop"), F.col("root").alias("far"))
        after = written(nearer.join(jump.hint("merge"), "hop", "left").select("node", F.least("hop", F.coalesce("far", "hop")).alias("root"), "was"))
        done = after.filter("root != was").isEmpty()
        roots = after.select("node", "root")
        if done:
            return roots


def guarded(edges: DataFrame, proposals: DataFrame, child: str, parent: str) -> DataFrame:
    """proposals with `verdict`: self (an edge to itself), cycle (its parent already descends from its child in edges) or ok; each is judged against the edges alone, not against other proposals."""
    above = closure(edges, child, parent).select(F.col("node").alias("__node"), F.col("ancestor").alias("__ancestor"))
    met = proposals.join(above, (F.col(parent) == F.col("__node")) & (F.col(child) == F.col("__ancestor")), "left")
    verdict = F.when(F.col(child) == F.col(parent), "self").when(F.col("__node").isNotNull(), "cycle").otherwise("ok")
    return met.withColumn("verdict", verdict).drop("__node", "__ancestor")


def dangling(rows: DataFrame, key: str, targets: DataFrame, target: str, law: str) -> DataFrame:
    """Offenders of a reference law: keys that name nothing."""
    named = targets.select(F.col(target).alias(key)).distinct()
    return rows.filter(F.col(key).isNotNull()).join(named, key, "left_anti").select(F.lit(law).alias("law"), F.col(key).cast("string").alias("offender")).distinct()
