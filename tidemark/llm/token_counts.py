"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums, so they are kept by
adding signed changes and never by counting again: an insert adds a document
and its tokens, a delete takes them off, a revision takes the old count off
(under the old version) and adds the new one. A batch of changes is first summed
per key, in the map tasks too, so a hot source costs one row a task.

A batch is committed under its id, as one folder of the rollup; the folder
counts once its _SUCCESS file is there. Committing an id again changes nothing,
so a batch may be replayed after any failure. compact() folds what is committed
into a snapshot that remembers the ids in it.

Defined results: a null text has no tokens; null sources and languages are keys
of their own; repeated rows count each; very long texts are counted whole; keys
whose sums are all zero are left out; an empty rollup or batch has no rows.
Columns of rows besides the named ones, whatever their names, play no part.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import word_count

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["documents", "tokens"]
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"


def word_tokens(text: Column) -> Column:
    """Tokenizer words-1: runs of anything but ASCII white space."""
    return word_count(text)


def piece_tokens(text: Column) -> Column:
    """Tokenizer words-2: runs of letters and digits, and every other visible character by itself."""
    visible = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(visible, r"[\p{L}\p{N}]+", "x"), " ", "")), F.lit(0)).cast("long")


def _encoding(path: str, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def bpe_tokens(text: Column, path: str, pattern: str) -> Column:
    """Tokens under a byte-pair vocabulary file of ranks, which must be at `path` on every executor; pattern is its pre-split."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path, pattern)
        for batch in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in batch], dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def inserted(rows: DataFrame) -> DataFrame:
    """Changes for new documents; rows: source, lang, tokenizer, tokens."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("documents"), F.col("tokens").cast("long").alias("tokens"))


def deleted(rows: DataFrame) -> DataFrame:
    """Changes for documents that go, with the tokens they were counted with."""
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("documents"), (-F.col("tokens")).cast("long").alias("tokens"))


def revised(rows: DataFrame) -> DataFrame:
    """Changes for documents counted anew; rows also have old_tokenizer and old_tokens."""
    old = rows.select("source", "lang", F.col("old_tokenizer").alias("tokenizer"), F.col("old_tokens").alias("tokens"))
    return deleted(old).unionByName(inserted(rows))


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _done(self, at: str) -> bool:
        path, fs = self._fs(f"{at}/_SUCCESS")
        return fs.exists(path)

    def _folders(self, kind: str) -> list[str]:
        path, fs = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if n.startswith(f"{kind}-") and self._done(f"{self.path}/{n}"))

    def _snapshot(self) -> tuple[str | None, set[str]]:
        known = self._folders("snapshot")
        if not known:
            return None, set()
        ids = self.spark.read.schema("batch string").parquet(f"{self.path}/ids-{known[-1].removeprefix('snapshot-')}")
        return known[-1], {r["batch"] for r in ids.collect()}

    def committed(self) -> set[str]:
        return {n.removeprefix("batch-") for n in self._folders("batch")} | self._snapshot()[1]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the changes of this batch; False if it was committed before."""
        if batch in self.committed():
            return False
        sums = changes.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens."""
        snapshot, folded = self._snapshot()
        return self._sums(snapshot, [n for n in self._folders("batch") if n.removeprefix("batch-") not in folded])

    def _sums(self, snapshot: str | None, batches: list[str]) -> DataFrame:
        paths = [f"{self.path}/{n}" for n in ([snapshot] if snapshot else []) + batches]
        every = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        sums = every.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        return sums.filter(" OR ".join(f"{c} != 0" for c in SUMS))

    def compact(self) -> None:
        """Fold everything that is committed into a new snapshot; readers change over when it is complete."""
        snapshot, folded = self._snapshot()
        batches = [n for n in self._folders("batch") if n.removeprefix("batch-") not in folded]  # one listing for both ids and totals
        ids, totals = {n.removeprefix("batch-") for n in batches} | folded, self._sums(snapshot, batches)
        n = f"{len(self._folders('snapshot')):09d}"
        self.spark.createDataFrame([(i,) for i in sorted(ids)], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ids-{n}")
        totals.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/snapshot-{n}")
        for i in folded:  # in the snapshot before already, so no reader needs these any more
            path, fs = self._fs(f"{self.path}/batch-{i}")
            fs.delete(path, True)
