"""Interval algebra: union, complement, and what is active at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOUCH = 1e-9


def merged(df: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """Intervals of a key united where they touch or overlap; n is how many."""
    order = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(lo) <= reach + TOUCH, 0).otherwise(1)
    df = df.withColumn("__new", new).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "__island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("n")).drop("__island")


def complement(df: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """The gaps between merged intervals of a key."""
    after = F.lead(lo).over(Window.partitionBy(*keys).orderBy(lo))
    return df.select(*keys, F.col(hi).alias(lo), after.alias(hi)).filter(F.col(hi).isNotNull())


def clipped(df: DataFrame, lo: str, hi: str, least: float, most: float) -> DataFrame:
    """Intervals cut to a range, those of positive length."""
    cut = df.withColumns({lo: F.greatest(F.col(lo), F.lit(least)), hi: F.least(F.col(hi), F.lit(most))})
    return cut.filter(F.col(hi) > F.col(lo))


def active_at(points: DataFrame, spans: DataFrame, at: str, lo: str, hi: str, width: float) -> DataFrame:
    """points with `active`, the number of spans with lo <= at < hi: through cells, so that no point meets all spans.

    Counted once for each different place, so repeated points count alike; a point at no place (null) has 0.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    dealt = spans.filter(F.col(lo) < F.col(hi)).select(F.col(lo).alias("__lo"), F.col(hi).alias("__hi"), F.explode(F.sequence(cell(lo), cell(hi))).alias("__cell"))
    places = points.select(F.col(at).alias("__at")).distinct().withColumn("__cell", cell("__at"))
    hits = places.join(dealt, "__cell").filter((F.col("__lo") <= F.col("__at")) & (F.col("__at") < F.col("__hi")))
    counts = hits.groupBy("__at").agg(F.count(F.lit(1)).alias("active"))
    return points.join(counts, F.col(at) == F.col("__at"), "left").drop("__at").withColumn("active", F.coalesce("active", F.lit(0)))
