"""Hard negatives for anchors: windows of scores below each positive's, answered by slot-decomposed selection.

Components become whole numbers, floor(SCALE * x), so scores are exact inner products.
An anchor's positives are its best rows of the same label; for each of them the
negatives are the best rows of other labels whose score lies between two parts of the
positive's. These windows overlap. The positives' upper limits, in descending order,
cut the scores into disjoint slots: slot s holds what is at most the s-th limit and
above the next. Every task keeps the best k of each slot it has met, tasks are merged
slot by slot, and merging the slots from the lowest up gives, at each limit, the best k
at or below it: a suffix that answers the window of every positive with that limit,
less what lies below the window's lower end.

Anchors are dealt into blocks of ANCHORS, rows into tiles of TILE; each block meets
each tile in a unit of its own: the block is held with its slots, the tile streams by. A
frequent label or vector is spread over all tiles.

Defined results: rows with a null id, label or vector, an empty vector or one with null or
non-finite components take no part; of rows that share an id, that with the least
label and vector does, so repeated rows count once; vectors of unlike lengths don't meet; equal
scores go by the smaller id; a positive of negative score has no negatives (its window is empty); an
anchor without positives gives no rows; nor does an empty table. Components of 2^52 and
more in SCALE's units, or scores beyond 64 bits, raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import Best, lists, matrix, met
from .shared import stash

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
"""A window in hundredths of the positive's score."""

ANCHORS, TILE = 8_192, 32_768
CHUNK = 1 << 22
"""So many scores are held at once."""

_NONE = np.iinfo(np.int64).min


def _whole(rows: DataFrame, scale: int) -> DataFrame:
    """id, label, anchor, vector: whole numbers as bytes, of the rows that take part, one an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [None if v is None else np.floor(scale * v) for v in lists(batch.column(3))]
            if any(v is not None and np.abs(v).max() >= 2**52 for v in vectors):
                raise ValueError("a component is too large for exact scores")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([None if v is None else v.astype("<i8").tobytes() for v in vectors], pa.binary())], ["id", "label", "anchor", "vector"])

    kinds = dict(rows.dtypes)
    whole = rows.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, anchor boolean, vector binary")
    one = whole.filter("vector IS NOT NULL").groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("row"))
    return stash(one.select("id", "row.*"), "whole")


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, rows by anchors."""
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(anchors).max(initial=0)) * rows.shape[1]
    if most < 2**53:
        return (rows.astype(np.float64) @ anchors.T.astype(np.float64)).astype(np.int64)
    exact = rows.astype(object) @ anchors.T.astype(object)
    if max(map(abs, exact.ravel()), default=0) >= 2**63:
        raise ValueError("a score is beyond 64 bits")
    return exact.astype(np.int64)


class _Search:
    """A block of anchors that rows stream past; `choose` gives the slots of pairs that count."""

    def __init__(self, block: pa.RecordBatch, slots: int, k: int) -> None:
        names = block.schema.names
        self.ids, self.labels = (block.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("id", "label"))
        sizes = np.array([len(v) for v in block.column(names.index("vector")).to_pylist()])
        self.of = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
        self.vectors = {n: matrix(block.column(names.index("vector")).take(pa.array(at)), "<i8") for n, at in self.of.items()}
        self.slots, self.best = slots, Best(slots * len(self.ids), k)

    def choose(self, anchors: np.ndarray, labels: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raise NotImplementedError

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = rows.schema.names
        ids, labels = (rows.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("id", "label"))
        column = rows.column(names.index("vector"))
        sizes = np.array([len(v) for v in column.to_pylist()])
        for n, anchors in self.of.items():
            own = np.flatnonzero(sizes == n)
            step = max(1, CHUNK // max(1, len(anchors)))
            for lo in range(0, len(own), step):
                at = own[lo : lo + step]
                scores = products(matrix(column.take(pa.array(at)), "<i8"), self.vectors[n])
                row, a, slot = self.choose(anchors, labels[at], ids[at], scores)
                self.best.add(anchors[a] * self.slots + slot, scores[row, a], ids[at][row])
        return iter(())

    def end(self) -> Iterator[pa.RecordBatch]:
        slot, value, of = self.best.all()
        if len(slot):
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[slot // self.slots]), pa.array((slot % self.slots).astype(np.int32)), pa.array(of), pa.array(value)], ["anchor_id", "slot", "of", "score"])


class _Positives(_Search):
    def __init__(self, block: pa.RecordBatch, k: int) -> None:
        super().__init__(block, 1, k)

    def choose(self, anchors: np.ndarray, labels: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        alike = (labels[:, None] == self.labels[anchors][None, :]) & (ids[:, None] != self.ids[anchors][None, :]) & (scores >= self.best.least[anchors][None, :])
        row, a = np.nonzero(alike)
        return row, a, np.zeros(len(row), dtype=np.int64)


class _Negatives(_Search):
    def __init__(self, block: pa.RecordBatch, slots: int, k: int) -> None:
        super().__init__(block, slots, k)
        names = block.schema.names
        limits = block.column(names.index("limits")).to_pylist()
        self.limits = np.array([(u + [_NONE] * slots)[:slots] for u in limits], dtype=np.int64).reshape(-1, slots)
        self.lowest = block.column(names.index("lowest")).to_numpy(zero_copy_only=False).astype(np.int64)

    def choose(self, anchors: np.ndarray, labels: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        within = (scores <= self.limits[anchors, 0][None, :]) & (scores >= self.lowest[anchors][None, :])
        row, a = np.nonzero(within & (labels[:, None] != self.labels[anchors][None, :]))
        slot = (self.limits[anchors[a]] >= scores[row, a][:, None]).sum(axis=1) - 1
        return row, a, slot


def _searched(anchors: DataFrame, rows: DataFrame, n_rows: int, n_anchors: int, work, kinds: dict[str, str]) -> DataFrame:
    """anchor_id, slot, of, score from each unit; columns of rows that only anchors have are null."""
    blocks, tiles = -(-n_anchors // ANCHORS), -(-n_rows // TILE)
    number = lambda of, n: F.pmod(F.xxhash64(F.lit(7), of), F.lit(n))
    only = [c for c in anchors.columns if c not in rows.columns]
    held = anchors.withColumns({"block": number("id", blocks), "tile": F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))})
    rows = rows.withColumns({c: F.lit(None).cast(anchors.schema[c].dataType) for c in only} | {"tile": number("id", tiles)}).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    unit = (F.col("block") * tiles + F.col("tile")).cast("long").alias("unit")
    return met(held.select(unit, *anchors.columns), rows.select(unit, *anchors.columns), work, f"anchor_id {kinds['id']}, slot int, of {kinds['id']}, score long", blocks * tiles)


def hard_negatives(
    rows: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (where the condition holds) and each of its positives the best negatives in its window."""
    named = rows.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{label}`").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(f"`{vector}`").alias("vector"))
    whole = _whole(named, scale)
    kinds = dict(whole.dtypes)
    n_rows, n_anchors = whole.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    anchors, rows = whole.filter("anchor").drop("anchor"), whole.drop("anchor")
    best_first = [F.desc("score"), "of"]
    found = _searched(anchors, rows, max(1, n_rows), max(1, n_anchors), lambda block: _Positives(block, positives), kinds)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id").orderBy(*best_first))).filter(F.col("rank") <= positives)
    upper = F.floor(F.col("score").cast("decimal(20,0)") * high / 100).cast("long")
    lower = F.ceil(F.col("score").cast("decimal(20,0)") * low / 100).cast("long")
    places = Window.partitionBy("anchor_id").orderBy(F.desc("upper"))
    found = found.filter("score >= 0").select("anchor_id", F.col("of").alias("positive_id"), F.col("score").alias("positive_score"), upper.alias("upper"), lower.alias("lower"))
    found = stash(found.withColumn("slot", F.dense_rank().over(places) - 1), "positives")
    limits = found.groupBy("anchor_id").agg(F.reverse(F.array_sort(F.collect_set("upper"))).alias("limits"), F.min("lower").alias("lowest"))
    asking = stash(anchors.join(limits.withColumnRenamed("anchor_id", "id"), "id"), "asking")
    met_slots = _searched(asking, rows, max(1, n_rows), max(1, n_anchors), lambda block: _Negatives(block, positives, negatives), kinds)
    order = Window.partitionBy("anchor_id", "slot").orderBy(*best_first)
    kept = met_slots.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= negatives)
    kept = kept.groupBy("anchor_id", "slot").agg(F.array_sort(F.collect_list(F.struct("place", F.col("of").alias("negative_id"), F.col("score").alias("negative_score")))).alias("best"))
    slots = kept.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "best"))).alias("slots"))
    return _windows(found, slots, positives, negatives)


def _windows(found: DataFrame, slots: DataFrame, positives: int, negatives: int) -> DataFrame:
    """The negatives of each positive: slots merged from the lowest up, then what lies within the window."""
    kind = slots.schema["slots"].dataType.valueType.simpleString()
    none = F.array().cast(kind)
    upwards = F.sequence(F.lit(positives - 1), F.lit(0), F.lit(-1))
    merged = lambda done, s: F.slice(F.concat(F.coalesce(F.try_element_at(F.col("slots"), s), none), F.try_element_at(done, F.lit(1))), 1, negatives)
    suffixes = F.aggregate(upwards, F.array(none), lambda done, s: F.concat(F.array(merged(done, s)), done))
    each = found.join(slots.select("anchor_id", suffixes.alias("suffixes")), "anchor_id")
    own = F.filter(F.try_element_at("suffixes", F.col("slot") + 1), lambda x: x["negative_score"] >= F.col("lower"))
    each = each.select("anchor_id", "positive_id", "positive_score", F.posexplode(own).alias("at", "found"))
    return each.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), "found.negative_id", "positive_score", "found.negative_score")
