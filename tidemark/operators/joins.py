"""Joins that plain equality does not express, each turned into equi-joins so that they scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_flag(left: DataFrame, right: DataFrame, on: list[str], name: str) -> DataFrame:
    """left with 1 where right has the key, else 0."""
    keys = right.select(*on).distinct().withColumn("__there", F.lit(1))
    return left.join(keys, on, "left").withColumn(name, F.coalesce("__there", F.lit(0))).drop("__there")


def either_key(left: DataFrame, right: DataFrame, left_key: str, right_keys: tuple[str, str]) -> DataFrame:
    """Inner join on left_key = one OR the other key of right, each pair once: two equi-joins instead of a nested loop."""
    a, b = right_keys
    one = left.join(right, left[left_key] == right[a])
    other = left.join(right, (left[left_key] == right[b]) & ~right[a].eqNullSafe(right[b]) & ~left[left_key].eqNullSafe(right[a]))
    return one.unionByName(other)


def interval_join(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], width: float, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Pairs whose intervals overlap (touching ends don't), and whose keys are equal.

    Each side is dealt to the cells of `width` that it covers, and a pair is
    taken only in the cell where the later of both starts lies, so it comes once.
    Intervals that end before they begin overlap nothing. width should be near the usual length: it trades copies for candidates.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    dealt = lambda df, lo, hi: df.filter(F.col(lo) <= F.col(hi)).withColumn("__cell", F.explode(F.sequence(cell(lo), cell(hi))))
    right = dealt(right, *b).select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys], F.col("__cell").alias("__cell2"))
    on = F.col("__cell") == F.col("__cell2")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    start = F.greatest(cell(a[0]), cell(b[0]))
    pairs = dealt(left, *a).join(right, on).filter((F.col("__cell") == start) & (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])))
    return pairs.drop("__cell", "__cell2", *(f"__{k}" for k in keys))


def asof(left: DataFrame, right: DataFrame, at: str, right_at: str, keys: list[str], take: list[str]) -> DataFrame:
    """left with the columns `take` of the last row of right at or before it; one shuffle of both sides together."""
    some = F.struct(F.col(right_at).alias("__at"), *take)
    a = left.withColumns({"__when": F.col(at), "__side": F.lit(1), "__row": F.lit(None).cast(right.select(some).dtypes[0][1])})
    b = right.select(*keys, F.col(right_at).alias("__when"), F.lit(0).alias("__side"), some.alias("__row"))
    both = a.unionByName(b, allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy("__when", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__last", F.last("__row", ignorenulls=True).over(upto)).filter("__side = 1")
    return found.select(*left.columns, *(F.col(f"__last.{c}").alias(c) for c in take), F.col("__last.__at").alias(f"{right_at}_before"))


def nearest(left: DataFrame, right: DataFrame, at: str, right_at: str, keys: list[str]) -> DataFrame:
    """left with `before` and `after` (neighbours of its place in right) and `near`, the closer; a tie goes to the later."""
    a = left.withColumns({"__when": F.col(at), "__side": F.lit(1)})
    b = right.select(*keys, F.col(right_at).alias("__when"), F.lit(0).alias("__side"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__mark", F.when(F.col("__side") == 0, F.col("__when")))
    up = Window.partitionBy(*keys).orderBy("__when", "__side").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy("__when", F.desc("__side")).rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumns({"before": F.last("__mark", ignorenulls=True).over(up), "after": F.first("__mark", ignorenulls=True).over(down)})
    closer = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull(), F.col("before")).when(F.col(at) - F.col("before") < F.col("after") - F.col(at), F.col("before")).otherwise(F.col("after"))
    return both.filter("__side = 1").withColumn("near", closer).select(*left.columns, "before", "after", "near")


def capped_matches(left: DataFrame, right: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The m:n join on keys without those whose product of counts is above `most` (what the weighting rule leaves out anyway).

    Counting first keeps a hot key from multiplying; `freq` is the product.
    """
    n = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__l")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__r")), keys)
    n = n.withColumn("freq", F.col("__l") * F.col("__r")).filter(F.col("freq") <= most).drop("__l", "__r")
    return left.join(n, keys).join(right, keys)


def overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo))


def local_maxima(cells: DataFrame, group: list[str], at: tuple[str, str], weight: str) -> DataFrame:
    """The cells (one row each, at whole-numbered places) whose weight none of the eight around them exceeds.

    Each cell sends its weight to its neighbours, and a maximum per place, combined before the shuffle, does the rest.
    """
    i, j = at
    around = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1))))
    sent = cells.select(*group, i, j, weight, around.alias("__to"))
    own = F.when((F.col("__to.x") == 0) & (F.col("__to.y") == 0), F.col(weight))
    sent = sent.select(*group, (F.col(i) + F.col("__to.x")).alias(i), (F.col(j) + F.col("__to.y")).alias(j), F.col(weight).alias("__any"), own.alias(weight))
    top = sent.groupBy(*group, i, j).agg(F.max("__any").alias("__any"), F.max(weight).alias(weight))
    return top.filter(F.col(weight) >= F.col("__any")).drop("__any")


def same_subject(a: DataFrame, b: DataFrame, key: str) -> None:
    """Raises unless all rows of both tables have one and the same value in `key`: what is about different subjects must not be joined."""
    found = [r[0] for r in a.select(key).unionByName(b.select(key)).distinct().limit(3).collect()]
    if len(found) > 1 or None in found:
        raise ValueError(f"the tables are about different subjects: {key} is {', '.join(map(str, found))}")
