"""Observers of long sequences: an adaptive Markov chain with all its readouts, checkerboard novelty, and matched filters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.special import DIGAMMA_SERIES, SHIFT
from .streams import dealt, runs

READOUTS = ("surprisal", "uncertainty", "model_information", "predictive_information", "expected_information", "information_rate", "uncertainty_drop")


def digamma(x: float) -> float:
    y = x + SHIFT
    return math.log(y) - 0.5 / y - sum(c / y ** (2 * k + 2) for k, c in enumerate(DIGAMMA_SERIES)) - sum(1 / (x + i) for i in range(SHIFT))


class AdaptiveChain:
    """A first-order chain with Dirichlet counts that decay: column j of `counts` is what came after symbol j."""

    def __init__(self, n: int, alpha: float, decay: float) -> None:
        self.counts, self.decay = np.full((n, n), alpha), decay
        self.last: int | None = None
        self.doubt: float | None = None
        self.settled = np.full(n, 1 / n)

    def _rate(self, a: np.ndarray, log_a: np.ndarray) -> float:
        """Entropy rate of two steps less that of one, at the equilibrium, which is looked for from the last one."""
        for _ in range(200):
            after = a @ self.settled
            after /= after.sum()
            near = np.abs(after - self.settled).max() < 1e-10
            self.settled = after
            if near:
                break
        two = a @ a
        entropy = lambda x, log_x: float(-(x * log_x).sum(axis=0) @ self.settled)
        return max(entropy(two, np.log(np.maximum(two, 1e-12))) - entropy(a, log_a), 0.0)

    def observe(self, symbol: int) -> tuple[float, ...]:
        j, out, doubt = self.last, (0.0,) * len(READOUTS), None
        if j is not None:
            a = self.counts / self.counts.sum(axis=0)
            log_a = np.log(np.maximum(a, 1e-12))
            p = a[:, j]
            doubt = float(-(p * log_a[:, j]).sum())
            gain = np.maximum((a * log_a).sum(axis=0) - a.T @ np.log(np.maximum(a @ p, 1e-12)), 0.0)  # of each symbol about the one after
            c, whole = float(self.counts[symbol, j]), float(self.counts[:, j].sum())
            # Divergence of the column with one more from the column before: only that count and the sum differ.
            learned = math.log(whole / c) + digamma(c + 1) - digamma(whole + 1)
            out = (-math.log(max(float(p[symbol]), 1e-12)), doubt, learned, float(gain[symbol]), float(p @ gain), self._rate(a, log_a), 0.0 if self.doubt is None else self.doubt - doubt)
            self.counts[symbol, j] += 1
            if self.decay > 0:
                self.counts /= 1 + self.decay * self.counts
        self.last, self.doubt = symbol, doubt
        return out


def adaptive_markov(df: DataFrame, keys: list[str], order: list[str], symbol: str, row: str, n: int, alpha: float = 0.5, decay: float = 0.01) -> DataFrame:
    """keys, row and READOUTS for each row of a key in order: symbols are numbers from 0 to n - 1.

    The first of a key has zeros. A symbol that is null or out of range is passed over. The state is a matrix of n by n numbers, so a key of any length streams through its task.
    """
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chain = None, None
        for of, table in runs(batches, len(keys)):
            for batch in table.to_batches():
                if of != key or chain is None:
                    key, chain = of, AdaptiveChain(n, alpha, decay)
                told = np.array([chain.observe(s) for s in batch.column(len(keys) + 1).to_pylist()]).reshape(-1, len(READOUTS))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], *(pa.array(np.ascontiguousarray(c)) for c in told.T)], [*keys, row, *READOUTS])

    rows = df.filter(F.col(symbol).between(0, n - 1)).repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, row, F.col(symbol).cast("int"))
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, row]) + "".join(f", {c} double" for c in READOUTS))


def checkerboard(n: int) -> np.ndarray:
    """The weights of 2n places about a boundary: a Gaussian of half of n, negative before it."""
    u = np.arange(-n, n) + 0.5
    return np.sign(u) * np.exp(-(u**2) / (2 * (n / 2) ** 2))


def novelty(df: DataFrame, keys: list[str], order: list[str], row: str, vector: str, width: int) -> DataFrame:
    """keys, row, novelty: how much the `width` rows before each differ from those from it on, by the checkerboard kernel over their self-similarity.

    The kernel is a product of one function of either place, so its sum over the similarity matrix is the squared length of one
    weighted sum of 2 * width unit vectors; the matrix and its mean, which the odd weights cancel, are never made. Rows nearer than width to either end of
    a key have 0; a vector that is null or zero or holds null or non-finite components counts as zero. Only the last rows are held; all vectors have one length.
    """
    kinds = dict(df.dtypes)
    weights = checkerboard(width)

    def units(column: pa.Array) -> np.ndarray:
        rows = [np.array(v if v is not None else [], dtype=np.float64) for v in column.to_pylist()]
        size = max(map(len, rows), default=0)
        out = np.zeros((len(rows), size))
        for i, v in enumerate(rows):
            if len(v) == size and np.isfinite(v).all() and v.any():
                out[i] = v / np.linalg.norm(v)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, waiting, seen = None, np.zeros((0, 0)), [], 0

        def out(of: tuple, ids: list, values: list[float], like: pa.Schema) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k] * len(ids), like.field(i).type) for i, k in enumerate(of)), pa.array(ids, like.field(len(keys)).type), pa.array(values, pa.float64())], [*keys, row, "novelty"])

        schema = None
        for of, table in runs(batches, len(keys)):
            for batch in table.to_batches():
                schema = batch.schema
                if of != key:
                    if waiting:
                        yield out(key, waiting, [0.0] * len(waiting), schema)
                    key, held, waiting, seen = of, np.zeros((0, 0)), [], 0
                new = units(batch.column(len(keys) + 1))
                if held.shape[1] != new.shape[1]:
                    held = np.zeros((len(held), new.shape[1])) if not held.any() else held
                    new = np.zeros((len(new), held.shape[1])) if held.shape[1] != new.shape[1] else new
                rows, waiting = np.concatenate([held, new]), waiting + batch.column(len(keys)).to_pylist()
                # `waiting` are the last rows that have no value yet; the first of all rows held is that many and `width` before the end, or the key's first.
                first = len(rows) - len(waiting)
                n = max(0, len(waiting) - width + 1)
                values = [float((s := weights @ rows[first + i - width : first + i + width]) @ s) if first + i >= width else 0.0 for i in range(n)]
                if n:
                    yield out(of, waiting[:n], values, schema)
                waiting = waiting[n:]
                held = rows[max(0, len(rows) - len(waiting) - width) :]
        if waiting:
            yield out(key, waiting, [0.0] * len(waiting), schema)

    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, row, vector)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, row]) + ", novelty double")


def resampled(window: Column, stretch: Column) -> Column:
    """A window of numbers read at a stretch: round(n * stretch) of them, the one at place i from floor(i / stretch)."""
    n = F.size(window)
    return F.transform(F.sequence(F.lit(0), F.bround(n * stretch).cast("int") - 1), lambda i: F.get(window, F.least(F.floor(i / stretch).cast("int"), n - 1)))


def matched_filter(windows: DataFrame, series: DataFrame, on: list[str], keys: list[str], window: str, gain: str | None, order: list[str], at: str, value: str, stretches: tuple[float, ...], longest: int) -> DataFrame:
    """on, keys, at, stretch, score: the place in the series where each window fits best, under the best stretch.

    A window is an array of numbers, with an array `gain` of the same length that weighs them; at a stretch it is resampled, weighed and scaled to length 1. Its score at a
    place is its inner product with as many numbers of the series from there, over the length of those (1e-9 at least, squared). `on` names
    the series that a window is held against, keys the window. Sums of squares are running sums; windows of the series
    are made once a length. Of equal scores (to nine digits) the least stretch wins, then the first place. A series not longer than a window, or a window resampled to fewer than two, gives nothing; `longest` bounds a resampled window.
    """
    weighed = F.col(window) if gain is None else F.zip_with(window, gain, lambda x, g: x * g)
    # Both sides are dealt by the series before anything multiplies; windows, the join and the best of each follow there.
    tried = dealt(windows.select(*on, *keys, weighed.alias("w")), *on).select(*on, *keys, F.explode(F.array(*map(F.lit, stretches))).alias("stretch"), "w")
    tried = tried.withColumn("w", resampled(F.col("w"), F.col("stretch"))).withColumn("m", F.size("w")).filter(F.col("m").between(2, longest))
    length = F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x)) + 1e-9
    tried = tried.withColumn("w", F.transform("w", lambda x: x / length))
    whole = Window.partitionBy(*on)
    ahead = whole.orderBy(*order)
    own = dealt(series.select(*on, *dict.fromkeys([*order, at]), F.col(value).cast("double").alias("__x")), *on)
    own = own.withColumns({"__n": F.count(F.lit(1)).over(whole), "__i": F.row_number().over(ahead), "__upto": F.sum(F.col("__x") * F.col("__x")).over(ahead.rowsBetween(Window.unboundedPreceding, 0))})
    following = ahead.rowsBetween(0, longest - 1)
    own = own.withColumns({"__next": F.collect_list("__x").over(following), "__ends": F.collect_list("__upto").over(following)})
    met = tried.join(own.select(*on, at, "__i", "__n", "__x", "__upto", "__next", "__ends"), on).filter((F.col("__n") > F.col("m")) & (F.col("__i") + F.col("m") - 1 <= F.col("__n")))
    product = F.aggregate(F.zip_with("w", F.slice("__next", F.lit(1), F.col("m")), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    energy = F.element_at("__ends", F.col("m")) - F.col("__upto") + F.col("__x") * F.col("__x")
    scored = met.withColumn("score", product / F.sqrt(F.greatest(energy, F.lit(1e-9))))
    best = scored.groupBy(*on, *keys).agg(F.min_by(F.struct(at, "stretch", "score"), F.struct(-F.round("score", 9), "stretch", "__i")).alias("b"))
    return best.select(*on, *keys, f"b.{at}", "b.stretch", "b.score")
