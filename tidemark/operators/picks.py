"""Deterministic picks: one row or the first few of each key, under a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_of(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key; rank: a name to keep the place under. Spark limits groups before the shuffle."""
    placed = df.withColumn(rank or "__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = placed.filter(F.col(rank or "__rank") <= n)
    return out if rank else out.drop("__rank")


def least_per_key(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The least value of each key, one row a key: what a correlated MIN subquery picks, as an aggregate."""
    return df.groupBy(*keys).agg(F.min(value).alias(name))


def first_known(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> list[Column]:
    """Aggregates that take each column's first value that isn't null, by order."""
    return [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns]
