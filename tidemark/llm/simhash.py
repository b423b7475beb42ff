"""SimHash near-duplicate groups, found with pivot distance tables.

A fingerprint has bit i where more than half of a text's shingle hashes have it.
Two texts are linked if their fingerprints differ in at most max_bits bits, and
a group is what links connect.

Distances to many fixed reference fingerprints (pivots) are computed for each
distinct fingerprint. By the triangle inequality two fingerprints within
max_bits of each other have distances to every pivot that differ by max_bits at
most, so a pair whose largest coordinate difference is above that is discarded
without looking at the pair itself; survivors are verified bit by bit.

A pivot table alone compares everything with everything. What meets in a task
is therefore dealt by parts of the fingerprint: with the 64 bits cut into
max_bits + 2 parts, two fingerprints within max_bits agree on two whole parts
at least, so each fingerprint goes, under every pair of parts, to the group of
those that agree with it there. No link is lost. Groups larger than
`crowd` are dealt again by further pairs of parts of the remaining bits, which
is exact too, so no group is ever gathered beyond what has the same 40 or so
bits. Inside a group a breadth-first search looks only at what is not yet
reached and returns a spanning forest, never all pairs.

Copies cost nothing: equal fingerprints are one row before any comparison.

Defined results: a text without words (null and empty ones too) has fingerprint
zero and is linked like any other; repeated rows are in one group; very long
texts are hashed whole, in bounded pieces; bits in exactly half the hashes are 0;
a null id is kept, and is the least of its group only if all are null; an empty
table gives no rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import stash

SHINGLE = 3
MAX_BITS = 3
SEED = 42
N_PIVOTS = 24
CROWD = 20_000
"""A group of more fingerprints than this is dealt again by further parts."""

SMALL = 24
"""Groups up to this many are compared by shifted columns, larger ones by search."""


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The fingerprint of one text: A-Z lower-cased, words split at ASCII white space, shingles of `words` of them."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined, sizes = b" ".join(parts), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(parts) - words + 1)].tolist()
    ends = ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)], dtype=">u8")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):  # a very long text unpacks in bounded pieces
        total += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(hashes))
    return int.from_bytes(bits.tobytes(), "big")


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def pivots(n: int) -> np.ndarray:
    """Fixed references: fingerprints of the numbers 0 to n - 1."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(n)], dtype=np.uint64)


def _near(x: np.uint64, others: np.ndarray, row: np.ndarray, table: np.ndarray, max_bits: int) -> np.ndarray:
    """Positions of `others` within max_bits of x: those whose pivot distances are all that close, verified."""
    left = np.arange(len(others))
    for k in range(len(row)):  # most fall out at the first pivots
        left = left[np.abs(table[left, k] - row[k]) <= max_bits]
        if len(left) < 64:
            break
    left = left[(np.abs(table[left] - row) <= max_bits).all(axis=1)]
    return left[np.bitwise_count(others[left] ^ x) <= max_bits]


def _search(fps: np.ndarray, table: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fps."""
    unseen, out = np.arange(len(fps)), []
    while len(unseen):
        queue, unseen = [unseen[0]], unseen[1:]
        while queue and len(unseen):
            x = queue.pop()
            near = _near(fps[x], fps[unseen], table[x], table[unseen], max_bits)
            if len(near):
                found = unseen[near]
                out += [(int(x), int(y)) for y in found]
                queue += found.tolist()
                unseen = np.delete(unseen, near)
    return out


def _links(batch_fps: np.ndarray, keys: np.ndarray, pivots: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys (sorted): all of small runs' pairs, spanning forests of the others."""
    n = len(keys)
    table = np.bitwise_count(batch_fps[:, None] ^ pivots[None, :]).astype(np.int8)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[first, n])
    small = np.repeat(sizes <= SMALL, sizes)
    a, b = [], []
    for lag in range(1, min(SMALL, int(sizes.max(initial=0)))):
        i = np.flatnonzero((keys[:-lag] == keys[lag:]) & small[:-lag])
        if not len(i):
            break
        j = i + lag
        for k in range(0, len(pivots), 8):
            ok = (np.abs(table[i, k : k + 8] - table[j, k : k + 8]) <= max_bits).all(axis=1)
            i, j = i[ok], j[ok]
        ok = np.bitwise_count(batch_fps[i] ^ batch_fps[j]) <= max_bits
        a.append(batch_fps[i[ok]])
        b.append(batch_fps[j[ok]])
    for s, size in zip(first[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        own = batch_fps[s : s + size]
        for x, y in _search(own, table[s : s + size], max_bits):
            a.append(own[x : x + 1])
            b.append(own[y : y + 1])
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def _masks(width: int, parts: int, within: int) -> list[int]:
    """All pairs of parts of the bits set in `within`, as masks; `width` is how many bits that are."""
    bits = [i for i in range(64) if within >> i & 1]
    edges = [round(k * width / parts) for k in range(parts + 1)]
    own = [sum(1 << b for b in bits[lo:hi]) for lo, hi in itertools.pairwise(edges)]
    return [x | y for x, y in itertools.combinations(own, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD, n_pivots: int = N_PIVOTS) -> DataFrame:
    """a, b: links among distinct fingerprints (column fp) that connect all that are within max_bits of each other."""
    parts = max_bits + 2
    masks = _masks(64, parts, (1 << 64) - 1)
    every = F.explode(F.array(*(F.struct(F.lit(i).alias("cut"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for i, m in enumerate(masks))))
    rows = fps.select("fp", every.alias("at")).select("fp", "at.cut", "at.part")
    crowds = rows.groupBy("cut", "part").count().filter(F.col("count") > crowd).select("cut", "part").withColumn("crowded", F.lit(True))
    # A crowd is dealt again by pairs of parts of the bits that the first key leaves open.
    finer = {i: _masks((~m & (1 << 64) - 1).bit_count(), parts, ~m & (1 << 64) - 1) for i, m in enumerate(masks)}
    again = F.lit(None).cast("array<struct<cut: int, part: bigint>>")
    for i, own in finer.items():
        deals = F.array(*(F.struct(F.lit(len(masks) * (k + 1) + i).alias("cut"), F.col("fp").bitwiseAND(F.lit(_signed(m | masks[i]))).alias("part")) for k, m in enumerate(own)))
        again = F.when(F.col("cut") == i, deals).otherwise(again)
    rows = rows.join(crowds, ["cut", "part"], "left")
    as_is = F.array(F.struct("cut", "part"))
    rows = rows.select("fp", F.explode(F.when(F.col("crowded"), again).otherwise(as_is)).alias("at")).select("fp", F.xxhash64("at.cut", "at.part").alias("key"))

    references = pivots(n_pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_fp, held_key = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def emit(fp: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            a, b = _links(fp.view(np.uint64), key, references, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            fp = np.concatenate([held_fp, batch.column(0).to_numpy()])
            key = np.concatenate([held_key, batch.column(1).to_numpy()])
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last run may go on in the next batch
            if whole:
                yield emit(fp[:whole], key[:whole])
            held_fp, held_key = fp[whole:], key[whole:]
        if len(held_key):
            yield emit(held_fp, held_key)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable by links, itself included), one row per document."""
    own = stash(with_fingerprints(docs, doc_id, text, words), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = stash(distinct, "distinct")
    roots = components(links(distinct.select("fp"), max_bits, crowd))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = placed.join(least, "root").select("fp", "component_id")
    return own.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """docs without all but one document of each group, the one with the least id; of rows with that id, one.

    Rows with a null id can't be named in a group and stay.
    """
    named = docs.filter(F.col(doc_id).isNotNull())
    kept = groups(named, doc_id, text, words, max_bits).filter(F.col("doc_id") == F.col("component_id"))
    kept = kept.select(F.col("doc_id").alias(doc_id)).distinct()
    return named.join(kept, doc_id, "left_semi").dropDuplicates([doc_id]).unionByName(docs.filter(F.col(doc_id).isNull()))
