"""Near-duplicate groups by shingles of five words: exact Jaccard similarity of 0.8, candidates by SimHash and by bands.

Two texts are linked if the sets of their shingles have a Jaccard similarity of
0.8 or more, and a group is what links connect.

SimHash comes first: the search of `simhash` (parts of the fingerprint, pivot
table, bits) finds the sets whose fingerprints differ in simhash.MAX_BITS bits
at most, their shingles decide, and what is linked is one group from then on.

Fingerprints of two texts at 0.8 may lie a dozen bits and more apart, farther
than parts of 64 bits can deal out. What is still unlike is therefore dealt by
BANDS keys of ROWS minima of the shingle hashes each (a pair at 0.8 meets
under no key with odds of 3 in a million, at 0.9 below 10^-11). Where rows
meet, sizes that exclude 0.8, the SimHash pivot table (distances to some
reference fingerprint that differ by more than MAX_BITS) and then the
fingerprints of the shingle sets themselves discard a pair that is more than
MAX_BITS apart (the mean at 0.8 is 10 bits, 24 are five deviations more; a pair with
a set of fewer than FEW shingles, whose bits are not so many independent
draws, is never discarded by bits); the shingles decide on all others.

Texts with equal sets are one node before any comparison. A key with up to
`crowd` nodes gives all its pairs. In a larger one, those outside its largest
group are held against a member of that group, in ROUNDS rounds; a key of more than
PART nodes is cut into parts for that. What is still not connected where a key holds
several groups meets by rare hashes: of the LEAST least shingle hashes of each such set (all of
them in most texts) those that fewest others have come first, and two sets at 0.8 share
one of the first fifth or so, whatever the order. So texts around one
boilerplate, which share only what all have, never meet, and a large group of
near copies, being connected by then, never gives all its pairs. Hashes with the same
least node are compared in one part, each pair once, by the least hashes of both, so that
only pairs near 0.8 leave the task. Parts are split where they hold much more than HELD nodes' hashes, and
hashes that more than CROWDED have are dealt to pairs of blocks, so no task holds more than that.

Defined results: texts without words (null ones too) are equal to each other
and to nothing else; a text of fewer than five words is one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import simhash
from .components import components
from .shared import stash

SHINGLE = 5
BANDS, ROWS = 24, 4
MAX_BITS = 24
SEED = 42
CROWD = 3
"""Nodes of a key up to which all its pairs are taken at once."""

ROUNDS = 3
"""Rounds in which a larger key's nodes are held against its largest group before all its pairs are taken."""

LEAST = 256
"""So many of the least hashes of a set are kept to estimate similarities; of smaller sets, all."""

ESTIMATE = 0.66
"""A pair with a set of more than LEAST is compared in full if its estimate, whose standard deviation is 0.025, is this or more."""

FEW = 64
"""A pair with a set of fewer shingles than this is not told apart by bits."""

PART, CROWDED, HELD = 65_536, 4_096, 8_192
CHUNK = 1024


def shingle_hashes(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, of the words that simhash.fingerprint takes."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined, sizes = b" ".join(parts), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(parts) - words + 1)].tolist()
    ends = ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)], dtype=np.uint64))


def node(hashes: np.ndarray) -> int:
    """The name of a set of shingles."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0


def sketch(hashes: np.ndarray) -> int:
    """The fingerprint of a set: bit i where more than half of its hashes have it."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def _numbers(n: int, odd: bool) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"band {i} {odd}".encode(), SEED) | odd for i in range(n)], dtype=np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band, of the minima of ROWS permutations of the hashes."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    times, plus = _BANDS
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), CHUNK):
        mixed = (hashes[None, at : at + CHUNK] ^ plus[:, None]) * times[:, None]
        least = np.minimum(least, (mixed ^ mixed >> np.uint64(29)).min(axis=1))
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)], dtype=np.uint64).view(np.int64)


_BANDS = (_numbers(BANDS * ROWS, True), _numbers(BANDS * ROWS, False))


def _described(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """doc_id, node, fp, size and the keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), words) for t in batch.column(1)]
            columns = [np.array([f(s) for s in sets], dtype=np.uint64).view(np.int64) for f in (node, sketch)]
            sizes, keys = np.array([len(s) for s in sets], dtype=np.int64), [band_keys(s) for s in sets]
            least = pa.array([(s[:LEAST] >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns), pa.array(sizes), pa.array(keys, pa.list_(pa.int64())), least], ["doc_id", "node", "fp", "size", "keys", "sketch"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, node long, fp long, size long, keys array<long>, sketch binary")


def _may_be_near(a: np.ndarray | int, b: np.ndarray, fp: np.ndarray, size: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places in `b` of the rows that may be as near as 0.8 to row a (or to that at the same place of a)."""
    a = np.broadcast_to(a, b.shape)
    left = np.flatnonzero((5 * size[b] >= 4 * size[a]) & (5 * size[a] >= 4 * size[b]))
    few = np.minimum(size[a[left]], size[b[left]]) < FEW
    some, left = left[few], left[~few]
    for k in range(0, table.shape[1], 8):
        left = left[(np.abs(table[a[left], k : k + 8] - table[b[left], k : k + 8]) <= MAX_BITS).all(axis=1)]
    left = left[np.bitwise_count(fp[a[left]] ^ fp[b[left]]) <= MAX_BITS]
    return np.sort(np.concatenate([some, left])) if len(some) else left


def needed(size: np.ndarray) -> np.ndarray:
    """How many of a set's LEAST least hashes it shares at least with those of any set that may be as near as 0.8.

    Where both sets are there whole, that is 0.8 of the larger; where one may not be, the estimate's part.
    """
    held = np.minimum(size, LEAST)
    return np.where(5 * size <= 4 * LEAST, np.ceil(0.79 * size), np.ceil(ESTIMATE * 0.8 * held)).astype(np.int64)


def near_by_sketch(sets: list[np.ndarray], size: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """A function from the place of one of the sets (sorted least hashes) and others' places to those of them that may be as near as 0.8.

    Sets of up to LEAST are there whole. Else both are counted up to the least of the last hashes of those that aren't.
    """
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    held = np.array([len(s) for s in sets])
    ends = np.array([s[-1] if n > LEAST else np.iinfo(np.uint32).max for s, n in zip(sets, size, strict=True)], dtype=np.uint32)

    def near(x: int, others: np.ndarray) -> np.ndarray:
        if not len(others):
            return others
        lo, hi = np.searchsorted(flat, sets[x], side="left"), np.searchsorted(flat, sets[x], side="right")
        n = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        at = at[flat[at] <= np.minimum(ends[x], ends[of[at]])]  # up to where both sets are there
        both = np.bincount(of[at], minlength=len(sets))[others]
        cut = np.minimum(ends[x], ends[others])
        least = np.where((size[x] > LEAST) | (size[others] > LEAST), ESTIMATE, 0.79)
        own = np.searchsorted(sets[x], cut, side="right")
        some = both >= least * own
        others, both, cut, least, own = others[some], both[some], cut[some], least[some], own[some]
        theirs = np.array([held[y] if c == ends[y] else np.searchsorted(sets[y], c, side="right") for y, c in zip(others, cut, strict=True)], dtype=np.int64)
        return others[both >= least * (own + theirs - both)]

    return near


def _of_key(nodes: np.ndarray, fp: np.ndarray, size: np.ndarray, root: np.ndarray, table: np.ndarray, turn: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one crowded key: each row outside the largest group with one of that group."""
    roots, n = np.unique(root, return_counts=True)
    if len(roots) < 2:
        return
    largest = root == roots[n.argmax()] if turn else np.ones(len(nodes), dtype=bool)
    own = np.flatnonzero(largest)
    # The member most like all: what copies were made from is nearer to each of them than they are to each other.
    bits = np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    most = np.packbits(bits.sum(axis=0) * 2 > len(fp)).view(">u8").astype(np.uint64)[0]
    x = own[np.lexsort((nodes[own], np.bitwise_count(fp[own] ^ most)))[min(turn, len(own) - 1)]]
    rest = np.flatnonzero(~largest) if turn else np.flatnonzero(root != root[x])
    near = rest[_may_be_near(x, rest, fp, size, table)]
    yield np.full(len(near), x), near


def _runs(batches: Iterator[pa.RecordBatch], emit: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What emit makes of the columns of whole runs of equal values of the first column, which go over the ends of batches."""
    held: list[list[np.ndarray]] = []  # parts of the last run, which may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held and part[0][-1] != held[0][0][-1] or len(np.unique(part[0][[0, -1]])) > 1:
            held.append(part)
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.flatnonzero(whole[0] != whole[0][-1])[-1]) + 1
            yield from emit([c[:cut] for c in whole])
            held = [[c[cut:] for c in whole]]
        else:
            held.append(part)
    if held:
        yield from emit([np.concatenate(c) for c in zip(*held, strict=True)])


def _pair_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    p, q = np.concatenate(a), np.concatenate(b)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])


def by_fingerprint(distinct: DataFrame, max_bits: int = simhash.MAX_BITS) -> DataFrame:
    """a < b: pairs of nodes (columns node, fp, size) whose fingerprints differ in at most max_bits bits and whose sizes don't exclude 0.8.

    They connect equal fingerprints through the least node of each, and others as simhash.links does.
    """
    own = distinct.select("node", "fp", "size").filter("size > 0")
    first = stash(own.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("first")), "fingerprints")
    alike = own.join(first, "fp").select(F.struct("node", "size").alias("x"), F.col("first").alias("y"))
    x, y = (first.select(F.col("fp").alias(end), F.col("first").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    near = simhash.links(first.select("fp"), max_bits).join(x, "a").join(y, "b").select("x", "y")
    both = alike.unionByName(near).filter("x.node != y.node AND 5 * x.size >= 4 * y.size AND 5 * y.size >= 4 * x.size")
    return both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _pairs(rows: DataFrame, crowd: int, turn: int) -> DataFrame:
    """a < b: candidate pairs of nodes of unlike groups; rows: key, node, fp, size and root."""

    def emit(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, nodes, fp, size, root = held
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[first, len(key)])
        fp = fp.view(np.uint64)
        table = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int8)
        ends, a, b, n = np.r_[first[1:], len(key)], [], [], 0
        few = np.repeat(sizes <= crowd, sizes)
        for lag in range(1, int(sizes[sizes <= crowd].max(initial=1))):  # all pairs of small keys, by how far apart they lie
            x = np.flatnonzero((key[:-lag] == key[lag:]) & few[:-lag] & (root[:-lag] != root[lag:]))
            x = x[_may_be_near(x, x + lag, fp, size, table)]
            a.append(nodes[x])
            b.append(nodes[x + lag])
            n += len(x)
        for i in np.flatnonzero(sizes > crowd):
            own = slice(first[i], ends[i])
            for x, y in _of_key(nodes[own], fp[own], size[own], root[own], table[own], turn):
                a.append(nodes[own][x])
                b.append(nodes[own][y])
                n += len(x)
                if n > 1 << 18:
                    yield _pair_batch(a, b)
                    a, b, n = [], [], 0
        if n:
            yield _pair_batch(a, b)

    pivots = simhash.pivots(simhash.N_PIVOTS)
    own = rows.select("key", "node", "fp", "size", "root").repartition("key").sortWithinPartitions("key")
    return own.mapInArrow(lambda batches: _runs(batches, emit), "a long, b long").distinct()


def _told_apart(met: DataFrame) -> DataFrame:
    """a < b: pairs of nodes of unlike groups that share a key and may be as near as 0.8 by their least hashes.

    met: part, node, size, root, sketch and keys, one row for each node of a part; keys lie whole in a part.
    """

    def emit(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        part, *columns = held
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        a, b, n = [], [], 0
        for lo, hi in zip(first, np.r_[first[1:], len(part)], strict=True):
            nodes, size, root, sketch, keys = (c[lo:hi] for c in columns)
            of = np.repeat(np.arange(len(nodes)), [len(k) for k in keys])
            names, key = np.unique(np.concatenate(keys), return_inverse=True)
            order = np.argsort(key, kind="stable")
            starts, members = np.searchsorted(key[order], np.arange(len(names) + 1)), of[order]
            at = np.r_[0, np.cumsum([len(k) for k in keys])]
            near = near_by_sketch([np.frombuffer(s, dtype=np.uint32) for s in sketch], size)
            for x in range(len(nodes)):
                later = np.zeros(len(nodes), dtype=bool)  # each partner once, however many keys it shares
                for k in key[at[x] : at[x + 1]]:
                    later[members[starts[k] : starts[k + 1]]] = True
                later[: x + 1] = False
                others = np.flatnonzero(later & (root != root[x]) & (5 * size >= 4 * size[x]) & (5 * size[x] >= 4 * size))
                y = near(x, others)
                a.append(np.full(len(y), nodes[x]))
                b.append(nodes[y])
                n += len(y)
                if n > 1 << 18:
                    yield _pair_batch(a, b)
                    a, b, n = [], [], 0
        if n:
            yield _pair_batch(a, b)

    own = met.select("part", "node", "size", "root", "sketch", "keys").repartition("part").sortWithinPartitions("part")
    return own.mapInArrow(lambda batches: _runs(batches, emit), "a long, b long").distinct()


def _rare_first(todo: DataFrame, distinct: DataFrame) -> DataFrame:
    """a < b: pairs of the nodes of todo (node, root) of unlike groups that share one of their rarest hashes and may be as near as 0.8 by their least hashes.

    If two sets share n hashes, then they share one of the first size - n + 1 of each, in any order common to both; the rarest first makes these the least common.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(s, dtype=np.uint32).astype(np.int64) for s in batch.column(2).to_pylist()]
            first = [len(s) for s in sets] - needed(batch.column(1).to_numpy()) + 1 if len(sets) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(first, dtype=np.int64)), pa.array(sets, pa.list_(pa.int64()))], ["node", "first", "hashes"])

    own = stash(todo.join(distinct.select("node", "size", "sketch"), "node").filter("size > 0"), "todo")
    each = own.select("node", "size", "sketch").mapInArrow(hashes, "node long, first long, hashes array<long>").select("node", "first", F.explode("hashes").alias("hash"))
    each = stash(each, "hashes")
    counts = each.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    # Hashes of one set alone come first of all, so how many a set has is all that is needed of them.
    shared = each.join(counts.filter("n > 1"), "hash")
    alone = each.groupBy("node").agg(F.count(F.lit(1)).alias("all"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("n", "hash"))
    ranked = shared.withColumn("place", place).join(alone, "node")
    held = F.count(F.lit(1)).over(Window.partitionBy("node"))
    ranked = ranked.withColumn("unshared", F.col("all") - held).filter(F.col("unshared") + F.col("place") <= F.col("first"))
    met = stash(ranked.select("hash", "node").join(own.select("node", "root"), "node"), "met")
    unlike = met.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi")
    # Hashes with the same least node go to one part: they have much the same nodes, and a pair is compared once for all of them.
    unlike = unlike.select("hash", "n", "least")
    loads = unlike.groupBy("least").agg(F.ceil(F.sum("n") / HELD).cast("long").alias("parts"))
    met = met.join(unlike.join(loads, "least"), "hash").withColumn("blocks", F.ceil(F.col("n") / CROWDED).cast("long"))
    met = met.withColumns({"block": F.pmod(F.xxhash64("node"), F.col("blocks")), "other": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))})
    key = F.when(F.col("blocks") == 1, F.col("hash")).otherwise(F.xxhash64("hash", F.least("block", "other"), F.greatest("block", "other")))
    part = F.when(F.col("blocks") == 1, F.xxhash64("least", F.pmod(F.xxhash64("hash"), F.col("parts")))).otherwise(key)
    held_keys = met.select(part.alias("part"), key.alias("key"), "node").groupBy("part", "node").agg(F.collect_set("key").alias("keys"))
    return _told_apart(held_keys.join(own.select("node", "size", "root", "sketch"), "node"))


def _verified(pairs: DataFrame, docs: DataFrame, distinct: DataFrame, words: int) -> DataFrame:
    """The pairs whose shingles have a Jaccard similarity of 0.8 or more; docs: doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), words) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([node(s) for s in sets], dtype=np.uint64).view(np.int64)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ids = needed.join(distinct, "node").select(F.col("least").alias("doc_id")).distinct()
    # A repeated id may have other texts too; those are nodes that no pair needs, or the same again.
    sets = docs.join(ids, "doc_id", "left_semi").select("text").mapInArrow(run, "node long, shingles array<long>").join(needed, "node", "left_semi").dropDuplicates(["node"])
    sets = stash(sets, "shingles")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _edges(roots: DataFrame) -> DataFrame:
    """a, b: each node that isn't its group's least, with that."""
    return roots.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def links(distinct: DataFrame, docs: DataFrame, words: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """a, b: edges that connect the nodes that links of 0.8 connect, and no others; distinct: node, least, fp, size, keys; docs: doc_id and text.

    SimHash's candidates come first, then those of the bands. After each round the links found so far are replaced by edges to the least node of each group.
    """
    found = stash(_verified(stash(by_fingerprint(distinct), "pairs"), docs, distinct, words), "links")
    roots = components(found)
    known = _edges(roots)
    placed = distinct.select("node", "fp", "size", "keys").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = placed.select("node", "fp", "size", "root", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = stash(rows.join(shared, "key"), "rows")
    part = F.when(F.col("n") <= PART, F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / PART).cast("long"))))
    rows = rows.withColumn("whole", F.col("key")).withColumn("key", part)
    crowds = rows.filter(F.col("n") > crowd)
    found = stash(known.unionByName(_verified(stash(_pairs(rows, crowd, 0), "pairs"), docs, distinct, words)), "links")
    if crowds.isEmpty():
        return found
    for turn in [*range(1, ROUNDS), None]:
        roots = components(found)
        known = _edges(roots)
        placed = crowds.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if turn is None:
            unlike = placed.groupBy("whole").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("whole")
            more = _rare_first(placed.join(unlike, "whole", "left_semi").select("node", "root").distinct(), distinct)
        else:
            more = _pairs(placed, crowd, turn)
        more = stash(more, "pairs")
        if turn is None and more.isEmpty():
            return known
        found = stash(known.unionByName(_verified(more, docs, distinct, words)), "links")
    return found


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """doc_id, component_id (the least doc_id of the group), one row per document."""
    own = stash(_described(docs, doc_id, text, words), "shingled")
    distinct = stash(own.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "distinct")
    roots = components(links(distinct, docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words, crowd))
    placed = distinct.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.select("doc_id", "node").join(placed.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE) -> DataFrame:
    """docs without all but one document of each group, the one with the least id; of rows with that id, one.

    Rows with a null id can't be named in a group and stay.
    """
    named = docs.filter(F.col(doc_id).isNotNull())
    kept = groups(named, doc_id, text, words).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(doc_id)).distinct()
    return named.join(kept, doc_id, "left_semi").dropDuplicates([doc_id]).unionByName(docs.filter(F.col(doc_id).isNull()))
