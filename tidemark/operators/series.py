"""Ordered series within a key: gaps, fills, sessions, label state, rolling statistics, peaks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .ranks import least_from, ranked
from .streams import folded


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def with_gap(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "gap") -> DataFrame:
    """The difference to the row before; null for the first."""
    return df.withColumn(name, value - F.lag(value).over(ordered(keys, order)))


def filled(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """The last value known up to each row."""
    return df.withColumn(name, F.last(column, ignorenulls=True).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def sessions(df: DataFrame, keys: list[str], order: list[str], at: Column, most: float, name: str = "session") -> DataFrame:
    """Numbers from 0: a gap above `most` starts a new one."""
    w = ordered(keys, order)
    starts = F.coalesce((at - F.lag(at).over(w) > most).cast("int"), F.lit(0))
    return df.withColumn("__starts", starts).withColumn(name, F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")


def label_state(df: DataFrame, keys: list[str], order: list[str], primary: Column, name: str = "label") -> DataFrame:
    """Primary rows are numbered (three digits) and reset a counter; the others are <primary>w<count>, null before the first."""
    upto = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__p", primary.cast("int")).withColumn("__n", F.sum("__p").over(upto))
    within = Window.partitionBy(*keys, "__n").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__w", F.sum(1 - F.col("__p")).over(within))
    base = F.lpad(F.col("__n").cast("string"), 3, "0")
    return df.withColumn(name, F.when(F.col("__n") == 0, None).when(F.col("__p") == 1, base).otherwise(F.concat(base, F.lit("w"), F.col("__w")))).drop("__p", "__n", "__w")


def centred(keys: list[str], order: list[str], k: int) -> WindowSpec:
    return ordered(keys, order).rowsBetween(-k, k)


def rolling_median(value: str, frame: WindowSpec) -> Column:
    """The median of a frame of a few rows (Spark's own takes no frame)."""
    own = F.sort_array(F.collect_list(value).over(frame))
    n = F.size(own)
    return F.when(n > 0, (F.get(own, F.floor((n - 1) / 2).cast("int")) + F.get(own, F.floor(n / 2).cast("int"))) / 2)


def forward_mean(df: DataFrame, keys: list[str], order: list[str], value: str, k: int, name: str) -> DataFrame:
    """The mean of a row and the k - 1 after it; null where the window runs past the end."""
    w = ordered(keys, order).rowsBetween(0, k - 1)
    return df.withColumn(name, F.when(F.count(F.lit(1)).over(w) == k, F.avg(value).over(w)))


def local_peaks(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows above both neighbours."""
    w = ordered(keys, order)
    return df.withColumns({"__b": F.lag(value).over(w), "__a": F.lead(value).over(w)}).filter((F.col(value) > F.col("__b")) & (F.col(value) > F.col("__a"))).drop("__a", "__b")


def spaced(df: DataFrame, keys: list[str], at: str, value: str, least: float, most: int | None = None) -> DataFrame:
    """Greedy non-maximum suppression: highest first (then earliest), dropping what is within `least` of one kept; at most `most` a key."""

    def keep(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values([value, at], ascending=[False, True])
        kept: list[int] = []
        places = own[at].to_numpy()
        for i, place in enumerate(places):
            if (most is None or len(kept) < most) and all(abs(place - places[j]) > least for j in kept):
                kept.append(i)
        return own.iloc[kept]

    return df.groupBy(*keys).applyInPandas(keep, df.schema)


def merged_within(df: DataFrame, keys: list[str], at: str, tolerance: float) -> DataFrame:
    """Entries in order, dropping those within tolerance of the last one kept."""
    return folded(df, keys, [at], [at], at, lambda last, x: x if last is None or x - last > tolerance else None)


def snapped(df: DataFrame, keys: list[str], at: str, near: str) -> DataFrame:
    """Times in order, each moved to `near` if that is after the last one kept; else left where it is if that is; else dropped."""
    move = lambda last, x, to: to if last is None or to > last else x if x > last else None
    return folded(df, keys, [at], [at, near], at, move)


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str, name: str = "q") -> DataFrame:
    """q: the least of p * n / place over this and all later places by p, at most 1; null p-values are left out."""
    rows = ranked(df, keys, p, []).withColumn("__raw", F.col(p) * F.col("of") / F.col("place"))
    told = least_from(rows, keys, "__raw", "__q")
    return told.withColumn(name, F.least(F.lit(1.0), F.min("__q").over(Window.partitionBy(*keys, "__bin", p)))).select(*df.columns, name)


def grid_repaired(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """A beat grid without stray early beats and with missing ones filled in.

    A beat nearer to the last kept than two thirds of the median gap goes; a gap
    of about k medians (k rounded half to even, at least 2, within 0.25) gets
    k - 1 beats spaced evenly. Grids of fewer than four beats stay.
    """

    def repair(own: pd.DataFrame) -> pd.DataFrame:
        times = sorted(own[at].tolist())
        head = {k: own[k].iloc[0] for k in keys}
        if len(times) >= 4:
            median = pd.Series(times).diff().dropna().median()
            kept = [times[0]]
            for t in times[1:]:
                if t - kept[-1] >= median / 1.5:
                    kept.append(t)
            times = kept[:1]
            for a, b in zip(kept, kept[1:], strict=False):
                k = round((b - a) / median) if median else 1
                if k >= 2 and abs((b - a) / median - k) <= 0.25:
                    times += [a + (b - a) * i / k for i in range(1, k)]
                times.append(b)
        return pd.DataFrame({**head, at: times})

    return df.select(*keys, F.col(at).cast("double").alias(at)).groupBy(*keys).applyInPandas(repair, df.select(*keys, F.col(at).cast("double").alias(at)).schema)
