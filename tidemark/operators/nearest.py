"""Vectors against vectors by cosine: a task holds a block of queries, rows stream past it and meet it as matrices, so memory is bounded and no pair leaves a task but what is asked for.

Vectors must have one length; those that are null, empty, zero or hold null or non-finite components have no cosine (null).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import picks

BLOCK = 8_192
"""Queries that a task holds at once."""
SLICE = 512
"""Rows that meet them at once."""
PAIRS = 1 << 27
"""Pairs that a task is meant to compare."""
NONE = -(1 << 40)
"""Stands for no cosine, which comes after all others."""


class Work(Protocol):
    def add(self, ids: np.ndarray, mark: object, vectors: np.ndarray) -> Iterator[pa.RecordBatch]: ...
    def end(self) -> Iterator[pa.RecordBatch]: ...


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors as the rows of a matrix of doubles; those that are null or empty as NaN."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if ((sizes != width) & (sizes > 0)).any():
        raise ValueError("vectors differ in length")
    out = np.full((len(sizes), width), np.nan)
    out[sizes > 0] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) if width else 0.0
    return out


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Lengths, summed from the first component on as Spark does; NaN for those without a direction."""
    if not vectors.shape[1]:
        return np.full(len(vectors), np.nan)
    own = np.sqrt(np.add.accumulate(vectors * vectors, axis=1)[:, -1])
    return np.where(np.isfinite(own) & (own > 0), own, np.nan)


def units(vectors: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Unit vectors; zero for those without a direction."""
    return np.where(np.isfinite(own)[:, None], vectors / own[:, None], 0.0)


def thousandths(x: np.ndarray) -> np.ndarray:
    """Doubles in whole 1/100,000, halves away from zero by their decimal digits as Spark's round does; NONE for NaN."""
    known = np.isfinite(x)
    far = np.where(known, np.abs(x) * 1e5, 0.0)
    out = np.floor(far + 0.5)
    for i in np.flatnonzero(np.abs(far - np.floor(far) - 0.5) < 1e-4):
        out[i] = int(Decimal(repr(abs(float(x[i])))).scaleb(5).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(known, np.where(x < 0, -out, out), NONE).astype(np.int64)


class Held:
    """A block of queries and how alike they are to rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors, self.lengths = ids, vectors, lengths(vectors)
        self.units, self.known = units(vectors, self.lengths), np.isfinite(self.lengths)

    def slices(self, vectors: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Places, lengths and cosines (a line a query; -inf for none) of rows, some at a time."""
        own = lengths(vectors)
        for at in range(0, len(vectors), SLICE):
            part = slice(at, at + SLICE)
            if vectors.shape[1] != self.vectors.shape[1]:
                if vectors.shape[1] and self.vectors.shape[1]:
                    raise ValueError("vectors differ in length")
                yield part, own[part], np.full((len(self.ids), len(own[part])), -np.inf)
                continue
            cosine = self.units @ units(vectors[part], own[part]).T
            cosine[:, ~np.isfinite(own[part])] = -np.inf
            cosine[~self.known] = -np.inf
            yield part, own[part], cosine


class Top(Held):
    """The k rows of the highest cosine to five digits, then of the least id, of each query, itself left out."""

    def __init__(self, ids: np.ndarray, marks: pa.Array, vectors: np.ndarray, k: int) -> None:
        super().__init__(ids, vectors)
        self.k, self.n = k, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.least = np.full(len(ids), -np.inf)
        """Below it, a cosine can't be among the best any more."""

    def add(self, ids: np.ndarray, mark: object, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part, own, cosine in self.slices(vectors):
            if self.k + 1 < cosine.shape[1] and np.isneginf(self.least).any():  # one more: the query may be among them
                self.least = np.maximum(self.least, np.partition(cosine, -self.k - 1, axis=1)[:, -self.k - 1] - 2e-5)
            q, e = np.nonzero(cosine >= self.least[:, None])
            other = self.ids[q] != ids[part][e]
            q, e = q[other], e[other]
            value = np.full(len(q), NONE)
            told = np.flatnonzero(np.isfinite(cosine[q, e]))
            for some in np.split(told, range(1 << 16, len(told), 1 << 16)):
                dots = np.add.accumulate(self.vectors[q[some]] * vectors[part][e[some]], axis=1)[:, -1] if len(some) else np.zeros(0)
                value[some] = thousandths(dots / (self.lengths[q[some]] * own[e[some]]))
            self.parts.append((q, value, ids[part][e]))
            self.n += len(q)
            if self.n > 4 * self.k * len(self.ids):
                self.best()
        yield from ()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, value, of = (np.concatenate(c) for c in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, dtype=np.int64),) * 3
        order = np.lexsort((of, -value, q))
        q, value, of = q[order], value[order], of[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        last = (place == self.k - 1) & (value != NONE)
        self.least[q[last]] = np.maximum(self.least[q[last]], value[last] / 1e5 - 1e-5)
        keep = place < self.k
        self.parts, self.n = [(q[keep], value[keep], of[keep])], int(keep.sum())
        return self.parts[0]

    def end(self) -> Iterator[pa.RecordBatch]:
        q, value, of = self.best()
        yield pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(of), pa.array(value / 1e5, mask=value == NONE)], ["q", "id", "cosine"])


class Highest(Held):
    """The highest cosine of each query among the rows of each other mark, a mark at a time."""

    def __init__(self, ids: np.ndarray, marks: pa.Array, vectors: np.ndarray) -> None:
        super().__init__(ids, vectors)
        self.marks, self.mark = marks, None
        self.own = np.array(marks.to_pylist(), dtype=object)
        self.best = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, mark: object, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        if mark != self.mark:
            yield from self.end()
            self.mark, self.best = mark, np.full(len(self.ids), -np.inf)
        for _, _, cosine in self.slices(vectors):
            self.best = np.maximum(self.best, cosine.max(axis=1))

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.mark is not None:
            other = np.flatnonzero(self.own != self.mark)
            best = self.best[other]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[other]), self.marks.take(pa.array(other)), pa.array([self.mark] * len(other), self.marks.type), pa.array(best, mask=np.isneginf(best))], ["q", "own", "mark", "best"])


def met(queries: DataFrame, rows: DataFrame, work: Callable[[np.ndarray, pa.Array, np.ndarray], Work], schema: str) -> DataFrame:
    """work(ids, marks, vectors of some queries) meets all rows; both have the columns id (long), mark and vector.

    Every block of queries meets every part of the rows once: a unit, which rows enter by its mark.
    """
    n, m = queries.count(), rows.count()
    blocks = max(1, -(-n // BLOCK))
    parts = max(1, -(-n * m // (blocks * PAIRS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, now = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            of, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            mark = batch.column(3).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (kind[1:] != kind[:-1]) | ((mark[1:] != mark[:-1]) & (kind[1:] == 1))])
            for at, size in zip(first.tolist(), np.diff(np.r_[first, len(of)]).tolist(), strict=True):
                some = batch.slice(at, size)
                if of[at] != unit:
                    if now is not None:
                        yield from now.end()
                    unit, held, now = of[at], [], None
                if kind[at] == 0:
                    held.append(some)
                elif held or now is not None:
                    if now is None:
                        block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        now, held = work(block.column(2).to_numpy(), block.column(3), matrix(block.column(4))), []
                    yield from now.add(some.column(2).to_numpy(), some.column(3)[0].as_py(), matrix(some.column(4)))
        if now is not None:
            yield from now.end()

    def dealt(df: DataFrame, kind: int, own: Column, every: Column) -> DataFrame:
        return df.select("id", "mark", "vector", own.alias("__own"), F.explode(every).alias("__of")).select(((F.col("__own") + F.col("__of")).cast("long")).alias("unit"), F.lit(kind).alias("kind"), "id", "mark", "vector")

    numbers = lambda n, by: F.array(*(F.lit(i * by) for i in range(n))) if n <= 1_000 else F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * by)
    held = dealt(queries, 0, F.pmod(F.xxhash64("id"), F.lit(blocks)), numbers(parts, blocks))
    streamed = dealt(rows, 1, F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(parts)) * blocks, numbers(blocks, 1))
    return held.unionByName(streamed).repartition(min(blocks * parts, 10_000), "unit").sortWithinPartitions("unit", "kind", "mark").mapInArrow(run, schema)


def top_cosines(queries: DataFrame, rows: DataFrame, k: int, place: str = "place") -> DataFrame:
    """q, id, cosine (five digits), place: the k rows of the highest cosine of each query, of equals the least id; a query is no row of its own."""
    some = met(queries.withColumn("mark", F.lit(0)), rows.withColumn("mark", F.lit(0)), lambda ids, marks, vectors: Top(ids, marks, vectors, k), "q long, id long, cosine double")
    return picks.first_of(some, ["q"], [F.desc("cosine"), F.asc("id")], k, place)


def highest_cosines(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """q, own, mark, best: the highest cosine of each query among the rows of each mark that isn't its own; null marks take no part."""
    kind = dict(rows.dtypes)["mark"]
    some = met(queries.filter("mark IS NOT NULL"), rows.filter("mark IS NOT NULL"), Highest, f"q long, own {kind}, mark {kind}, best double")
    return some.groupBy("q", "own", "mark").agg(F.max("best").alias("best"))
