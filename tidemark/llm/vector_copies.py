"""Near-duplicate groups of embeddings by product quantisation: cosine of at least a limit, within equal labels.

Vectors of unit length whose cosine is at least `limit` are at most
r = sqrt(2 - 2 limit) apart. A coarse quantiser deals vectors into inverted lists, and
the residual from a list's centre is coded by the nearest of 256 words in each of
some subspaces. Both are fitted on a bounded sample (SAMPLE vectors) and only decide what
is compared, never what is a link: every vector is coded and kept, whole, with its
own coding error e, the distance to what its code stands for.

Probes are sufficient by geometry, not by a number. List j of centre c_j and radius R_j
may hold a vector within r of u only if |u - c_j| <= r + R_j, and if u lies within r of the plane
halfway between its own centre and c_j, since each vector is in its nearest list. The same bounds over
whole lists tell which blocks of lists need not meet. In a probed list the
asymmetric distance d of u to a code comes from tables of u and the words, and a vector
further than r + e by d is no link by the triangle inequality. What is left is decided by exact
cosines in double precision. So no link is lost, whatever the fit; a bad one costs time.

Equal vectors of a label are one, with a weight, before any comparison. Lists are put
together to blocks of about BLOCK vectors, a large list is cut, and each block meets
each other block of its label that it may have links with once: no group is gathered in one task, and a
hot label has more blocks. No pair leaves a task: links leave as
counts and as one edge a vector and unit, to a vector of its component.

Where vectors lie all over the space, as random ones do, no bound excludes lists, and the
comparisons grow with the square of a label's vectors, spread evenly over tasks.

Defined results: a null label, vectors that are null, empty, zero or hold null or
non-finite components have no links and are their own component; vectors of unlike
lengths are not compared; rows with equal vectors and labels are linked, repeated rows among them; a null
id counts as a vector, and names a component only if it has no other; an empty table
gives no rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import floats, lists, matrix, met
from .components import components
from .shared import stash

LIMIT = 0.93
SAMPLE = 16_384
SAMPLE_BYTES = 64 << 20
LISTS, WORDS, PARTS = 256, 256, 8
BLOCK = 2_048
CHUNK = 1_024
SLACK = 1e-3
"""Above what single precision may add to a distance."""

SEED = 7


class Model(NamedTuple):
    centres: np.ndarray  # lists x dimensions
    words: list[np.ndarray]  # of each subspace: words x its dimensions
    cuts: list[tuple[int, int]]
    """First and last dimension of each subspace."""


def normal(vectors: np.ndarray) -> np.ndarray:
    """Rows of unit length, in double precision; divided by the largest component first, so that squares don't overflow."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a to those of b."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def clustered(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means centres, at most as many as there are points; an empty cluster takes up the farthest point."""
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        d = squares(points, centres)
        own = d.argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))
        far = np.argsort(-d[np.arange(len(points)), own], kind="stable")[: int((n == 0).sum())]
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        centres[n == 0] = points[far]
    return centres


def fit(sample: np.ndarray, n_lists: int, n_words: int = WORDS, parts: int = PARTS, rounds: int = 8) -> Model:
    """The quantiser of a sample of unit vectors; the same sample gives the same model."""
    rng = np.random.default_rng(SEED)
    centres = clustered(sample, n_lists, rounds, rng)
    rest = sample - centres[squares(sample, centres).argmin(axis=1)]
    edges = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).round().astype(int).tolist()
    cuts = list(zip(edges[:-1], edges[1:], strict=True))
    return Model(centres, [clustered(rest[:, a:b], n_words, rounds, rng) for a, b in cuts], cuts)


def coded(units: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """list, distance to its centre, code, the part of the squared distance to a query that only the code decides, coding error."""
    d = squares(units, model.centres)
    own = d.argmin(axis=1)
    rest = units - model.centres[own]
    codes = np.zeros((len(units), len(model.cuts)), dtype=np.uint8)
    stands = np.zeros_like(rest)
    for m, (a, b) in enumerate(model.cuts):
        codes[:, m] = squares(rest[:, a:b], model.words[m]).argmin(axis=1)
        stands[:, a:b] = model.words[m][codes[:, m]]
    of_code = (stands * stands).sum(axis=1) + 2 * (stands * model.centres[own]).sum(axis=1)
    return own, np.linalg.norm(rest, axis=1), codes, of_code, np.linalg.norm(rest - stands, axis=1)


def _prepared(rows: DataFrame, vec_id: str, label: str, vector: str) -> DataFrame:
    """id, label, vector (as bytes) and its digest, null where the row has no part in links."""
    kind = floats(rows, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [v.astype(kind).tobytes() if there and v is not None and v.any() else None for v, there in zip(lists(batch.column(2)), batch.column(1).is_valid().to_pylist(), strict=True)]
            digests = [None if v is None else xxhash.xxh3_128_digest(v) for v in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary()), pa.array(digests, pa.binary())], ["id", "label", "vector", "digest"])

    kinds = dict(rows.dtypes)
    named = rows.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector"))
    return named.mapInArrow(run, f"id {kinds[vec_id]}, label {kinds[label]}, vector binary, digest binary")


def _encoded(distinct: DataFrame, model: Model, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, rho, codes, of_code, error = coded(normal(matrix(batch.column(3), kind)), model)
                more = [pa.array(own.astype(np.int32)), pa.array(rho), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(of_code), pa.array(error)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "list", "rho", "code", "of_code", "error"])

    return distinct.select("node", "label", "weight", "vector").mapInArrow(run, f"node long, label {dict(distinct.dtypes)['label']}, weight long, vector binary, list int, rho double, code binary, of_code double, error double")


def _near_lists(encoded: DataFrame, model: Model, kind: str, r: float) -> DataFrame:
    """label, list, other: lists of a label (also a list and itself) that may hold vectors within r of each other."""
    between = np.sqrt(squares(model.centres, model.centres))
    none = np.finfo(np.float64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units, own, rho = normal(matrix(batch.column(1), kind)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            d2 = squares(units, model.centres)
            plane = np.where(between[own] > 0, (d2 - (rho**2)[:, None]) / np.maximum(2 * between[own], 1e-300), 0)
            labels = batch.column(0).dictionary_encode()
            n = len(model.centres)
            pairs, of = np.unique(labels.indices.to_numpy() * n + own, return_inverse=True)
            for k, pair in enumerate(pairs.tolist()):
                mine = np.flatnonzero(of == k)
                columns = [labels.dictionary.take(pa.array([pair // n] * n)), pa.array(np.full(n, pair % n, dtype=np.int32)), pa.array(np.arange(n, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.sqrt(d2[mine].min(axis=0))), pa.array(plane[mine].min(axis=0))], ["label", "list", "other", "nearest", "plane"])

    least = encoded.select("label", "vector", "list", "rho").mapInArrow(run, f"label {dict(encoded.dtypes)['label']}, list int, other int, nearest double, plane double")
    least = least.groupBy("label", "list", "other").agg(F.min("nearest").alias("nearest"), F.min("plane").alias("plane"))
    radius = encoded.groupBy("label", "list").agg(F.max("rho").alias("radius"))
    one = least.join(radius.withColumnRenamed("list", "other").withColumnRenamed("radius", "other_radius"), ["label", "other"]).join(radius, ["label", "list"])
    back = least.select("label", F.col("list").alias("other"), F.col("other").alias("list"), F.col("nearest").alias("back"), F.col("plane").alias("back_plane"))
    both = one.join(back, ["label", "list", "other"], "left").na.fill(none, ["back", "back_plane"])
    far = (F.col("nearest") - F.col("other_radius") > r + SLACK) | (F.col("back") - F.col("radius") > r + SLACK) | (F.col("plane") + F.col("back_plane") > r + SLACK)
    return both.filter((F.col("list") == F.col("other")) | ~far).select("label", "list", "other")


class _Links:
    """A block of queries that another block, or the block itself, streams past."""

    def __init__(self, block: pa.RecordBatch, model: Model, kind: str, limit: float) -> None:
        self.model, self.kind, self.limit, self.r = model, kind, limit, float(np.sqrt(max(0.0, 2 - 2 * limit)))
        self.nodes, self.weights, self.own = (block.column(block.schema.names.index(c)).to_numpy() for c in ("node", "weight", "list"))
        self.units = normal(matrix(block.column(block.schema.names.index("vector")), kind))
        self.d2 = squares(self.units, model.centres)
        self.tables = [(self.units[:, a:b] @ w.T).T.astype(np.float32) for w, (a, b) in zip(model.words, model.cuts, strict=True)]
        self.between = np.sqrt(squares(model.centres, model.centres))
        self.n, self.root = np.zeros(len(self.nodes), dtype=np.int64), np.arange(len(self.nodes))

    def probing(self, at: int, radius: float) -> np.ndarray:
        """The queries that must look into list `at`, of that radius."""
        near = np.sqrt(self.d2[:, at]) <= self.r + radius + SLACK
        to = self.between[self.own, at]
        plane = (self.d2[:, at] - self.d2[np.arange(len(self.own)), self.own]) / np.maximum(2 * to, 1e-300)
        return np.flatnonzero(near & ((to == 0) | (plane <= self.r + SLACK)))

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = rows.schema.names
        order = np.argsort(rows.column(names.index("list")).to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        at = rows.column(names.index("list")).to_numpy()
        for value in np.unique(at):
            lo, hi = np.searchsorted(at, [value, value + 1])
            for first in range(lo, hi, CHUNK):
                yield from self.compared(rows.slice(first, min(CHUNK, hi - first)), int(value))

    def compared(self, rows: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
        names = rows.schema.names
        nodes, weights, rho, of_code, error = (rows.column(names.index(c)).to_numpy() for c in ("node", "weight", "rho", "of_code", "error"))
        queries = self.probing(at, float(rho.max()))
        if not len(queries):
            return
        codes = matrix(rows.column(names.index("code")), "u1")
        table = np.zeros((len(rows), len(queries)), dtype=np.float32)
        some = len(queries) < len(self.nodes)
        for m, t in enumerate(self.tables):
            table += (t[:, queries] if some else t)[codes[:, m]]
        away = self.d2[queries, at].astype(np.float32)[None, :] + of_code.astype(np.float32)[:, None] - 2 * table
        may = away <= ((self.r + error + SLACK) ** 2).astype(np.float32)[:, None]
        if rows.column(names.index("same"))[0].as_py():  # a block and itself: each pair once, no vector with itself
            may &= self.nodes[queries][None, :] < nodes[:, None]
        row, query = np.nonzero(may)
        if not len(row):
            return
        some_rows, some_queries = np.unique(row), np.unique(query)
        units = normal(matrix(rows.column(names.index("vector")).take(pa.array(some_rows)), self.kind))
        if len(row) * 8 > len(some_rows) * len(some_queries):  # dense: all cosines at once
            cosines = (units @ self.units[queries[some_queries]].T)[np.searchsorted(some_rows, row), np.searchsorted(some_queries, query)]
        else:
            cosines = np.concatenate([np.einsum("ij,ij->i", units[np.searchsorted(some_rows, row[i : i + 8192])], self.units[queries[query[i : i + 8192]]]) for i in range(0, len(row), 8192)])
        linked = cosines >= self.limit
        row, query = row[linked], queries[query[linked]]
        if not len(row):
            return
        np.add.at(self.n, query, weights[row])
        n = np.zeros(len(nodes), dtype=np.int64)
        np.add.at(n, row, self.weights[query])
        # Queries that share a row are of one component: roots fall to the least until nothing changes.
        while True:
            least = np.full(len(nodes), len(self.nodes))
            np.minimum.at(least, row, self.root[query])
            root = self.root.copy()
            np.minimum.at(root, self.root[query], least[row])
            root = root[root]
            if (root == self.root).all():
                break
            self.root = root[self.root]
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(n[hit]), pa.array(self.nodes[least[hit]])], ["node", "n", "root"])

    def end(self) -> Iterator[pa.RecordBatch]:
        hit = np.flatnonzero(self.n)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(self.nodes[hit]), pa.array(self.n[hit]), pa.array(self.nodes[self.root[hit]])], ["node", "n", "root"])


def _links(distinct: DataFrame, kind: str, limit: float, n_lists: int | None, block: int) -> DataFrame:
    """node, n, root: parts of the number of links of each vector, and an edge to one of its component; all vectors have one length."""
    r = float(np.sqrt(max(0.0, 2 - 2 * limit)))
    width = len(distinct.first()["vector"])
    most = distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    n_lists = n_lists or max(1, min(LISTS, round(most**0.5 / 4)))
    drawn = distinct.orderBy("digest", "node").limit(max(1, min(SAMPLE, SAMPLE_BYTES // width))).select("vector").toArrow()
    model = fit(normal(matrix(drawn.column(0).combine_chunks(), kind)), n_lists)
    encoded = stash(_encoded(distinct, model, kind), "encoded")
    near = _near_lists(encoded, model, kind, r)
    sizes = encoded.groupBy("label", "list").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("label").orderBy("list")) - F.col("n"))
    # A vector's place among those of its label is drawn within its list; a block is a run of places.
    drawn_at = F.pmod(F.xxhash64(F.lit(SEED), "node"), F.lit(1 << 30)) / F.lit(1 << 30)
    placed = encoded.join(sizes, ["label", "list"]).withColumn("block", F.floor((F.col("before") + drawn_at * F.col("n")) / block)).drop("before", "n")
    placed = stash(placed, "placed")
    blocks = placed.select("label", "block", "list").distinct()
    pairs = blocks.join(near, ["label", "list"]).join(blocks.select("label", F.col("list").alias("other"), F.col("block").alias("other_block")), ["label", "other"])
    pairs = pairs.select("label", F.least("block", "other_block").alias("one"), F.greatest("block", "other_block").alias("two")).distinct()
    pairs = stash(pairs.withColumns({"unit": F.monotonically_increasing_id(), "same": F.col("one") == F.col("two")}), "units")
    columns = ["unit", "same", "node", "weight", "vector", "list", "rho", "code", "of_code", "error"]
    held = placed.join(pairs.withColumnRenamed("one", "block"), ["label", "block"]).select(columns)
    streamed = placed.join(pairs.withColumnRenamed("two", "block"), ["label", "block"]).select(columns)
    return met(held, streamed, lambda rows: _Links(rows, model, kind, limit), "node long, n long, root long", pairs.count())


def groups(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", limit: float = LIMIT, n_lists: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row a vector: how many others are linked with it, the least id of those it reaches, and whether that is its own."""
    kind = floats(rows, vector)
    own = stash(_prepared(rows, vec_id, label, vector), "prepared")
    distinct = own.filter("digest IS NOT NULL").groupBy("label", "digest").agg(F.min("vector").alias("vector"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"))
    distinct = stash(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    found = None
    for (length,) in distinct.select(F.octet_length("vector")).distinct().collect():
        part = _links(distinct.filter(F.octet_length("vector") == length), kind, limit, n_lists, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return own.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = stash(found, "links")
    n = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    told = distinct.join(n, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    told = stash(told.select("label", "digest", "root", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "told")
    told = told.join(told.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("label", "digest", "n_links", "component_id")
    linked = own.filter("digest IS NOT NULL").join(told, ["label", "digest"]).select("id", "n_links", "component_id")
    alone = own.filter("digest IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
