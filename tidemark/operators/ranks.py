"""Ranks within few large groups, without sorting a group in one task: its values are cut into bins at approximate quantiles, rows are ordered within bins, and counts before each bin do the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written

BINS = 256


def same(left: DataFrame, right: DataFrame, keys: list[str], prefix: str = "__of_") -> Column:
    """Equality of keys, nulls being equal, where right has them with a prefix."""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"{prefix}{k}"])
    return on


def binned(df: DataFrame, keys: list[str], value: str, bins: int = BINS) -> DataFrame:
    """df with `__bin`: in which bin of its key each value lies; equal values lie in one, bins rise with the values. Rows with a null value are left out."""
    df = df.filter(F.col(value).isNotNull())
    cuts = df.groupBy(*(F.col(k).alias(f"__of_{k}") for k in keys)).agg(F.percentile_approx(value, [i / bins for i in range(1, bins)], 10_000).alias("__cuts"))
    both = df.join(cuts, same(df, cuts, keys)).drop(*(f"__of_{k}" for k in keys))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range((bins - 1).bit_length()))))
    # The number of cuts below the value, by binary search.
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("__cuts", at + step - 1) < F.col(value), at + step).otherwise(at))
    return both.withColumn("__bin", place).drop("__cuts")


def ranked(df: DataFrame, keys: list[str], value: str, order: list[str], bins: int = BINS) -> DataFrame:
    """df with `place` (from 1, by value, then order), `rank` (that of the first of equals), `ties` (how many are equal) and `of` (rows of the key); rows with a null value are left out."""
    rows = written(binned(df, keys, value, bins))
    counts = rows.groupBy(*(F.col(k).alias(f"__of_{k}") for k in keys), F.col("__bin").alias("__of___bin")).agg(F.count(F.lit(1)).alias("__n"))
    key = [f"__of_{k}" for k in keys]
    before = F.sum("__n").over(Window.partitionBy(*key).orderBy("__of___bin").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*key, "__of___bin", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(*key)).alias("of"))
    within = Window.partitionBy(*keys, "__bin")
    rows = rows.join(counts, same(rows, counts, [*keys, "__bin"])).drop(*key, "__of___bin")
    rows = rows.withColumns({"place": F.col("__before") + F.row_number().over(within.orderBy(value, *order)), "rank": F.col("__before") + F.rank().over(within.orderBy(value)), "ties": F.count(F.lit(1)).over(Window.partitionBy(*keys, "__bin", value))})
    return rows.drop("__before")


def least_from(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """ranked rows with `name`: the least of `value` over a row and all of its key with a higher place."""
    key = [f"__of_{k}" for k in keys]
    bins = rows.groupBy(*(F.col(k).alias(f"__of_{k}") for k in keys), F.col("__bin").alias("__of___bin")).agg(F.min(value).alias("__least"))
    later = F.min("__least").over(Window.partitionBy(*key).orderBy(F.desc("__of___bin")).rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select(*key, "__of___bin", later.alias("__later"))
    own = F.min(value).over(Window.partitionBy(*keys, "__bin").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(bins, same(rows, bins, [*keys, "__bin"])).drop(*key, "__of___bin")
    return rows.withColumn(name, F.least(own, F.coalesce("__later", own))).drop("__later")
