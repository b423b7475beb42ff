"""Sorted rows read as a stream, run by run or row by row, whatever Arrow batches they come in: no group has to fit a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


ROWS = 250_000
"""Rows of a table that a task is dealt on average at most, so that its memory doesn't grow with the table."""


def tasks_of(df: DataFrame) -> int:
    """How many tasks rows are dealt to that make more work than their bytes tell: as many as a shuffle has, or cores, not fewer."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as a shuffle has: windows and sums by these keys and more follow without moving rows again, and adaptive execution doesn't put many parts into a task of much memory."""
    return df.repartition(tasks_of(df), *keys)


def dealt_by_rows(df: DataFrame, *keys: str) -> DataFrame:
    """As dealt, to more tasks where these would have more than ROWS rows each; for columns of a Parquet table, counting takes the footers of its files only."""
    return df.repartition(max(tasks_of(df), -(-df.count() // ROWS)), *keys)


def runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows in sorted batches by the values of their first n columns, a run at a time, whatever batches it lies in."""
    name, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        new[0] = True
        for c in batch.columns[:n]:
            code = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        first = np.flatnonzero(new)
        for at, rows in zip(first.tolist(), np.diff(np.r_[first, batch.num_rows]).tolist(), strict=True):
            of = tuple(batch.column(i)[at].as_py() for i in range(n))
            if of != name and parts:
                yield name, pa.Table.from_batches(parts)
                parts = []
            name = of
            parts.append(batch.slice(at, rows))
    if parts:
        yield name, pa.Table.from_batches(parts)


def folded(df: DataFrame, keys: list[str], order: list[str], values: list[str], name: str, keep: Callable[..., float | None]) -> DataFrame:
    """keys and `name`: what keep(last kept or None, *values of the row) gives for each row of a key in order, where that isn't None.

    The only state is the last one kept, so a key of any length streams through its task. Values are doubles; rows with a null among them are passed over.
    """
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for of, table in runs(batches, len(keys)):
            for batch in table.to_batches():
                at, out = [], []
                if of != key:
                    key, last = of, None
                for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[len(keys) :]), strict=True)):
                    got = keep(last, *row)
                    if got is not None:
                        last = got
                        at.append(i)
                        out.append(got)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns[: len(keys)]), pa.array(out, pa.float64())], [*keys, name])

    rows = df.dropna(subset=values).repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *(F.col(v).cast("double") for v in values))
    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{name}` double")
