"""What several of the operators need: written intermediate tables, prefix sums, word counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
"""A word: a run of anything but ASCII white space."""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; where that is unset, a folder of our own in local mode and an error on a cluster."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        told = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", told)
    return told


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again.

    This cuts the lineage, so a lost executor costs no more than a reread, and
    what is used more than once is computed once.
    """
    path = f"{shared_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def unstash(df: DataFrame) -> None:
    """Delete what stash() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stash_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken: list[str], name: str) -> str:
    """A column name like `name` that isn't taken."""
    name = f"__{name}"
    while name in taken:
        name = f"_{name}"
    return name


HOT_KEYS = 5000


def is_hot(keys: DataFrame, name: Column, rows: str, total: int) -> Column:
    """Whether `name` is that of a key with more than a HOT_KEYS-th of all rows.

    keys: distinct keys and, in the column `rows`, how many of the `total` rows each has, so that at most HOT_KEYS names
    come to the driver. Rows of hot keys can be told by this with no shuffle that brings them together.
    """
    hot = [r[0] for r in keys.filter(F.col(rows) > max(100, total // HOT_KEYS)).select(name).collect()]
    return name.isin(hot) if hot else F.lit(False)


def word_count(text: Column) -> Column:
    """The number of words, counted in the JVM: each word, with the space after it, becomes one character."""
    bare = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    return F.coalesce(F.length(F.regexp_replace(bare, WORD + r"[\x20\x09-\x0D]*", "x")), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column) -> Column:
    """A stable order that has nothing to do with the ids: their MD5 in hex (null: that of nothing)."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def running_total(df: DataFrame, group: list[str], key: str, order: list[str], value: Column, name: str, digits: int = 3) -> DataFrame:
    """Add `name`: the running total of value within group, by key (hex digits), then order; this row included.

    A plain window over the group would sort a hot group in one task. Here the
    first hex digits of the key cut each group into 16**digits bins, whose sums
    are few; a window over those gives what lies before each bin, and the rows
    are only sorted within their bin. Nulls in group are a group of their own.
    """
    at, own, before, of = (fresh(df.columns, c) for c in ("bin", "value", "before", "group"))
    binned = df.withColumns({at: F.substring(key, 1, digits), own: value})
    sums = binned.groupBy(*group, at).agg(F.sum(own).alias(before))
    earlier = Window.partitionBy(*group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(c).alias(f"{of}{i}") for i, c in enumerate(group)), F.col(at).alias(f"{of}at"), F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    on = binned[at] == sums[f"{of}at"]
    for i, c in enumerate(group):
        on = on & binned[c].eqNullSafe(sums[f"{of}{i}"])
    within = Window.partitionBy(*group, at).orderBy(key, *order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.col(before) + F.sum(own).over(within)
    return binned.join(sums, on).withColumn(name, total.cast("long")).drop(at, f"{of}at", own, before, *(f"{of}{i}" for i in range(len(group))))
