"""Blocks of rows that meet other blocks, and the best of what they find, for searches over vectors.

A unit is a block that a task holds and rows that stream past it, in Arrow batches. What is
held is bounded by whoever deals out the units; what streams by is not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

MAX_TASKS = 10_000


class Work(Protocol):
    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]: ...
    def end(self) -> Iterator[pa.RecordBatch]: ...


def met(held: DataFrame, streamed: DataFrame, work: Callable[[pa.RecordBatch], Work], schema: str, units: int) -> DataFrame:
    """work(rows of held) meets the rows of streamed with the same `unit`, a long; both have the same columns.

    As many tasks as units, up to MAX_TASKS: rows are few beside the work that they make, so their bytes say nothing about how many tasks it takes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts, now = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            of, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (kind[1:] != kind[:-1])])
            for at, n in zip(first.tolist(), np.diff(np.r_[first, len(of)]).tolist(), strict=True):
                rows = batch.slice(at, n)
                if of[at] != unit:
                    if now is not None:
                        yield from now.end()
                    unit, parts, now = of[at], [], None
                if kind[at] == 0:
                    parts.append(rows)
                elif parts or now is not None:
                    if now is None:
                        now, parts = work(pa.Table.from_batches(parts).combine_chunks().to_batches()[0]), []
                    yield from now.add(rows)
        if now is not None:
            yield from now.end()

    columns = [c for c in held.columns if c != "unit"]
    both = held.select("unit", F.lit(0).alias("kind"), *columns).unionByName(streamed.select("unit", F.lit(1).alias("kind"), *columns))
    return both.repartition(max(1, min(units, MAX_TASKS)), "unit").sortWithinPartitions("unit", "kind").mapInArrow(run, schema)


def floats(rows: DataFrame, vector: str) -> str:
    """The numpy type of a vector column's components as bytes: as narrow as the column's own."""
    return "<f4" if isinstance(rows.schema[vector].dataType.elementType, FloatType) else "<f8"


def lists(column: pa.Array) -> list[np.ndarray | None]:
    """The vectors of a list column as doubles; None for those that are null, empty or hold null or non-finite components."""
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    at = column.offsets.to_numpy()
    out: list[np.ndarray | None] = []
    for i, there in enumerate(column.is_valid().to_pylist()):
        v = flat[at[i] : at[i + 1]] if there else None
        out.append(v if v is not None and len(v) and np.isfinite(v).all() else None)
    return out


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors of equal length, written as bytes, as the rows of a matrix of that type."""
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=kind)
    return flat.reshape(len(column), -1)


class Best:
    """The k best (value descending, id ascending) of each slot among what is added, in memory bounded by slots and k."""

    def __init__(self, slots: int, k: int, room: int = 1 << 20) -> None:
        self.k, self.room, self.n = k, max(room, 2 * slots * k), 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.least = np.full(slots, np.iinfo(np.int64).min)
        """A value below this can't be among the best any more."""

    def add(self, slot: np.ndarray, value: np.ndarray, of: np.ndarray) -> None:
        may = value >= self.least[slot]
        self.parts.append((slot[may], value[may], of[may]))
        self.n += int(may.sum())
        if self.n > self.room:
            self.all()

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """slot, value and id of the best so far, slot by slot."""
        if not self.parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        slot, value, of = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((of, -value, slot))
        slot, value, of = slot[order], value[order], of[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        best = place < self.k
        last = place == self.k - 1
        self.least[slot[last]] = value[last]
        self.parts, self.n = [(slot[best], value[best], of[best])], int(best.sum())
        return self.parts[0]
