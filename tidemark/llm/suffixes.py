"""Suffix-array removal of repeated byte strings.

A byte is removed if a string of LENGTH bytes that covers it also starts
anywhere else, in this or another document; matches never cross documents.

Suffixes are sorted in two stages: only those smaller than their successors are
sorted directly, the rest is induced by one scan through the buckets of first
bytes, and common prefixes of neighbours in that order tell what repeats.

One array over all texts would not fit a machine, so what is compared is dealt
out by content. Each string of LENGTH bytes owns an anchor: its GRAM bytes with
the least hash. Equal strings own equal anchors at equal places, so strings need
only be compared within an anchor's group; those of one anchor that follow each
other in a text make one snippet. Three steps keep the work small:

1. Anchors whose hash occurs once in all texts are dropped: nothing in their
   snippets repeats.
2. A snippet that occurs whole again (the hashes of its anchor and of itself)
   repeats whole. Copies and the inner parts of long passages end here, with no
   text moved.
3. Where an anchor has several different snippets (the edges of passages), each
   different one is fetched once, and blocks of such groups are suffix-sorted.
   Common prefixes are compared byte by byte.
   An anchor with more than `crowd` snippets, a passage that a large part of all
   documents share, is split further: its strings are dealt by 128-bit hashes
   and counted, which combines before the shuffle and needs no group in one place.

What is settled by hash alone is wrong only if two different snippets of one
anchor have one 64-bit hash (odds of 5e-20 a pair of the same anchor), or two
strings of crowded anchors one of 128 bits.

Defined results: a null text is empty; texts shorter than LENGTH keep all;
repeated rows of that length or more lose all, each being the other's repeat; a
null id is a row like any other, and ids may be of any type; very long texts are
gone through in pieces of a megabyte that overlap, so nothing is lost between
them; ties of anchors go to the first place; an empty table gives no rows. Other
columns of docs, whatever their names, are not looked at and not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import is_hot, stash, unstash

LENGTH = 200
GRAM = 32
CROWD = 10_000
"""Different snippets of one anchor that are suffix-sorted together; what has more is counted string by string."""

BLOCK = 1 << 19
"""Bytes of snippets that are suffix-sorted at once, or one group where that is larger."""

SEPARATOR = 0xFF
"""Never a byte of UTF-8."""

_PIECE = (1 << 20) - LENGTH
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
_TABLE = np.array([xxhash.xxh64_intdigest(bytes([i]), 7) for i in range(256)], dtype=np.uint64)


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The hash of the `gram` (a power of two) bytes at every place; each round doubles what a hash covers."""
    h, span = _TABLE[raw], 1
    while span < gram:
        h = h[:-span] * np.uint64(pow(_BASE, span, 1 << 64)) + h[span:]
        span *= 2
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ h >> np.uint64(32)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row: of the running minima to the end and from the start of blocks that wide."""
    n = len(x) - width + 1
    blocks = np.full((-(-len(x) // width), width), np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks.reshape(-1)[: len(x)] = x
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each snippet: its anchor's hash, its own hash, and first start << 16 | how many more starts."""
    whole = np.frombuffer(data, dtype=np.uint8)
    out: list[tuple[np.ndarray, list[int], np.ndarray]] = []
    low = np.uint64((1 << 20) - 1)
    for base in range(0, max(0, len(whole) - length + 1), _PIECE):
        raw = whole[base : base + _PIECE + length - 1]
        hashes = gram_hashes(raw, gram)
        packed = hashes & ~low | np.arange(len(hashes), dtype=np.uint64)  # ties go to the first
        at = (sliding_least(packed, length - gram + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        own = [xxhash.xxh64_intdigest(data[base + i : base + j + length], 1) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
        out.append((hashes[at[first]], own, base + first << 16 | last - first))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    join = lambda i, t: np.concatenate([np.asarray(x[i], dtype=t) for x in out])
    return join(0, np.uint64).view(np.int64), join(1, np.uint64).view(np.int64), join(2, np.int64)


def string_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """The hash of the `length` bytes at every place, put together from those of its binary parts."""
    n, at, out, h, span = len(raw) - length + 1, 0, None, _TABLE[raw], 1
    while span <= length:
        if length & span:
            part = h[at : at + n]
            out = part.copy() if out is None else out * np.uint64(pow(_BASE, span, 1 << 64)) + part
            at += span
        if 2 * span <= length:
            h = h[:-span] * np.uint64(pow(_BASE, span, 1 << 64)) + h[span:]
        span *= 2
    return out


def _directly_sorted(text: bytes, some: np.ndarray, depth: int) -> np.ndarray:
    """Some suffixes in the order of their first `depth` bytes. Of strings with one hash only one is compared with others."""
    if not len(some):
        return some
    hashes = string_hashes(np.frombuffer(text + bytes(depth), dtype=np.uint8), depth)[some]
    _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
    some_of = some[first]
    heads = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text + bytes(16), dtype=np.uint8), 16)[some_of].view(">u8")
    by = np.lexsort((heads[:, 1], heads[:, 0]))
    tied = (heads[by[1:]] == heads[by[:-1]]).all(axis=1)
    # Only strings whose first 16 bytes are equal are compared further, one such run after the other.
    starts = np.flatnonzero(np.r_[True, ~tied])
    ends = np.r_[starts[1:], len(by)]
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        by[a:b] = sorted(by[a:b].tolist(), key=lambda i: text[some_of[i] : some_of[i] + depth])
    place = np.empty(len(by), dtype=np.int64)
    place[by] = np.arange(len(by))
    return some[np.argsort(place[kind], kind="stable")]


def suffix_array(text: bytes, depth: int = LENGTH) -> np.ndarray:
    """All suffixes in the order of their first `depth` bytes, by two-stage sorting."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(text, dtype=np.uint8)
    # A suffix is smaller than its successor if the next byte that differs is larger; at the end nothing is, so it's larger.
    runs = np.r_[np.flatnonzero(raw[1:] != raw[:-1]) + 1, n]
    following = np.repeat(runs, np.diff(np.r_[0, runs]))
    after = np.r_[raw, 0].astype(np.int16)
    after[n] = -1
    small = after[following] > raw
    direct = _directly_sorted(text, np.flatnonzero(small), depth)
    bounds = np.searchsorted(raw[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[raw[n - 1]].append(np.array([n - 1]))  # the empty suffix is least of all and comes before this one

    def induce(now: np.ndarray, c: int) -> np.ndarray:
        """Hands the larger predecessors of suffixes of bucket c, in order, to their own buckets; returns those of c itself."""
        before = now[now > 0] - 1
        before = before[~small[before]]
        own = raw[before]
        same = before[own == c]
        before, own = before[own != c], own[own != c]
        by = np.argsort(own, kind="stable")
        before, own = before[by], own[by]
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else []
        for i, part in zip(cuts, np.split(before, cuts[1:]), strict=True) if len(own) else ():
            waiting[own[i]].append(part)
        return same

    order: list[np.ndarray] = []
    for c in np.flatnonzero(np.bincount(raw, minlength=256)).tolist():
        # In a bucket of one first byte the larger suffixes come first, the directly sorted ones last.
        now = np.concatenate([np.zeros(0, np.int64), *waiting[c]])
        while len(now):
            order.append(now)
            now = induce(now, c)
        order.append(direct[bounds[c] : bounds[c + 1]])
        induce(order[-1], c)
    return np.concatenate(order)


def repeats(text: bytes, length: int = LENGTH) -> np.ndarray:
    """Whether the `length` bytes from each place also start at another: their suffix has a neighbour with so long a common prefix.

    Strings that run over the end or a separator don't count.
    """
    n = len(text)
    out = np.zeros(n, dtype=bool)
    if n <= length:
        return out
    order = suffix_array(text, length)
    order = order[order <= n - length]
    padded = np.frombuffer(text + bytes(8), dtype=np.uint8)
    raw = np.frombuffer(text, dtype=np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + 1].copy().view(np.uint64).reshape(-1)
    stops = np.r_[0, np.cumsum(raw == SEPARATOR)]
    pairs = np.arange(len(order) - 1)
    for k in [*range(0, length - 7, 8), length - 8]:  # the common prefix grows by eight bytes a round
        pairs = pairs[words[order[pairs] + k] == words[order[pairs + 1] + k]]
    same = order[np.unique(np.r_[pairs, pairs + 1])] if len(pairs) else order[:0]
    out[same[stops[same] == stops[same + length]]] = True
    return out


def repeating_parts(snippets: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(snippet, first start, how many more) of each run of `length`-byte strings that also start elsewhere in these snippets.

    Equal strings have equal hashes, so what has no string with a hash met twice is left out before suffixes are sorted.
    """
    text = bytes([SEPARATOR]).join(snippets)
    if len(text) <= length:
        return
    raw = np.frombuffer(text, dtype=np.uint8)
    stops = np.r_[0, np.cumsum(raw == SEPARATOR)]
    valid = np.flatnonzero(stops[:-length] == stops[length:])
    hashes = string_hashes(raw, length)[valid]
    by = np.argsort(hashes)
    same = hashes[by[1:]] == hashes[by[:-1]]
    again = np.zeros(len(valid), dtype=bool)
    again[by[1:][same]] = True
    again[by[:-1][same]] = True
    at = valid[again]
    if not len(at):
        return
    own = stops[at]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    begins = np.r_[0, np.flatnonzero(raw == SEPARATOR) + 1]
    parts = [text[i : j + length] for i, j in zip(at[first].tolist(), at[last].tolist(), strict=True)]
    starts = np.flatnonzero(repeats(bytes([SEPARATOR]).join(parts), length))
    if not len(starts):
        return
    runs = np.flatnonzero(np.r_[True, np.diff(starts) > 1])
    more = np.r_[runs[1:], len(starts)] - runs - 1
    places = np.r_[0, np.cumsum([len(part) + 1 for part in parts])]
    of = np.searchsorted(places, starts[runs], side="right") - 1
    who, shift = own[first], at[first] - begins[own[first]]
    yield from zip(who[of].tolist(), (shift[of] + starts[runs] - places[of]).tolist(), more.tolist(), strict=True)


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """key and digest name a row (equal rows alike); text without nulls."""
    filled = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(F.col(doc_id).cast("string")).alias("key"), F.xxhash64(filled).alias("digest"), filled.alias("text"))


def covered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """key, digest, at: first start << 16 | how many more, for runs of strings of `length` bytes that also start elsewhere."""
    named = _named(docs, doc_id, text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(t.as_py().encode(), length, gram) for t in batch.column(2)]
            owner = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            arrays = [batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner))]
            arrays += [pa.array(np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)])) for i in range(3)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "digest", "anchor", "snippet", "at"])

    every = stash(named.filter(F.octet_length("text") >= length).mapInArrow(find, "key long, digest long, anchor long, snippet long, at long"), "anchors")
    again = stash(every.groupBy("anchor").count().filter(F.col("count") > 1), "again")
    hot = is_hot(again, F.col("anchor"), "count", every.count())
    shared = stash(every.filter(hot).unionByName(every.filter(~hot).join(again.filter(~hot), "anchor", "left_semi")), "shared")
    unstash(every)  # nothing reads it any more

    row, pair = F.struct("key", "digest", "at"), F.xxhash64("anchor", "snippet")
    kinds = stash(shared.groupBy("anchor", "snippet").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("row")), "kinds")
    copies = kinds.filter("n > 1").select("anchor", "snippet", "n")
    hot = is_hot(copies, pair, "n", shared.count())
    whole = shared.filter(hot).unionByName(shared.filter(~hot).join(copies.filter(~hot), ["anchor", "snippet"], "left_semi")).select("key", "digest", "at")
    groups = stash(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "groups")
    hot, n = F.col("anchor"), kinds.count()
    hot, crowded = is_hot(groups, hot, "kinds", n), is_hot(groups.filter(F.col("kinds") > crowd), hot, "kinds", n)
    others = kinds.filter(~hot).join(groups.filter(~hot), "anchor").withColumn("crowded", F.col("kinds") > crowd).drop("kinds")
    wanted = kinds.filter(hot).withColumn("crowded", crowded).unionByName(others).select("anchor", "n", "row.*", "crowded")
    lists = wanted.groupBy("key", "digest").agg(F.collect_list(F.struct("anchor", "n", "at", "crowded")).alias("wanted"))
    fetched = named.join(lists, ["key", "digest"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "digest", "anchor", "n", "at", "crowded", "bytes"]
        for batch in batches:
            for key, digest, t, own in zip(*(batch.column(i) for i in range(4)), strict=True):
                data, rows = t.as_py().encode(), own.as_py()
                cuts = [data[r["at"] >> 16 : (r["at"] >> 16) + (r["at"] & 0xFFFF) + length] for r in rows]
                head = [pa.array([x.as_py()] * len(rows), pa.int64()) for x in (key, digest)]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array([r[c] for r in rows]) for c in ("anchor", "n", "at", "crowded")), pa.array(cuts, pa.binary())], names)

    fetched = fetched.select("key", "digest", "text", "wanted").mapInArrow(cut, "key long, digest long, anchor long, n long, at long, crowded boolean, bytes binary")
    fetched = stash(fetched, "snippets")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def emit() -> pa.RecordBatch:
            out = [(*held[i][:2], (held[i][2] >> 16) + first << 16 | more) for i, first, more in repeating_parts([h[3] for h in held], length)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], []))], ["key", "digest", "at"])

        for batch in batches:
            for anchor, key, digest, at, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if anchor != last and size >= BLOCK:
                    yield emit()
                    held, size = [], 0
                held.append((key, digest, at, data))
                size, last = size + len(data) + 1, anchor
        if held:
            yield emit()

    calm = fetched.filter(~F.col("crowded")).select("anchor", "key", "digest", "at", "bytes")
    edges = calm.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sort, "key long, digest long, at long")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, digest, at, data, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                names = [xxhash.xxh3_128_digest(data[i : i + length]) for i in range(len(data) - length + 1)]
                starts = [(at >> 16) + i << 16 for i in range(len(names))]
                arrays = [pa.array([x] * len(names), pa.int64()) for x in (key, digest, n)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(starts, pa.int64()), pa.array(names, pa.binary())], ["key", "digest", "n", "at", "string"])

    crowded = fetched.filter("crowded").select("key", "digest", "at", "bytes", "n")
    dealt = crowded.mapInArrow(strings, "key long, digest long, n long, at long, string binary")
    common = dealt.groupBy("string").agg(F.sum("n").alias("times")).filter("times > 1").select("string")
    crowds = dealt.join(common, "string", "left_semi").select("key", "digest", "at")
    return whole.unionByName(edges).unionByName(crowds)


def kept_parts(data: bytes, ats: list[int], length: int = LENGTH) -> tuple[list[bytes], int, int]:
    """What is left of the bytes, how many are removed, and in how many runs."""
    parts, removed, runs, upto = [], 0, 0, 0
    end = -1
    for first, stop in sorted({(at >> 16, (at >> 16) + (at & 0xFFFF) + length) for at in ats}):
        if first > end:
            runs += 1
            parts.append(data[max(upto, 0) : first])
            removed += stop - first
            end = stop
        elif stop > end:
            removed += stop - end
            end = stop
        upto = end
    parts.append(data[upto:])
    return parts, removed, runs


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes left), one row per document."""
    runs = covered(docs, doc_id, text, length, gram, crowd).groupBy("key", "digest").agg(F.collect_set("at").alias("ats"))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"key": F.xxhash64(F.col("doc_id").cast("string")), "digest": F.xxhash64("text")})
    joined = rows.join(runs, ["key", "digest"], "left").select("doc_id", "text", "ats")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_bytes]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, ats in zip(batch.column(1), batch.column(2), strict=True):
                data = t.as_py().encode()
                parts, removed, spans = kept_parts(data, ats.as_py() or [], length)
                left = b"".join(parts)
                out.append((len(data), removed, spans, hashlib.sha256(left).hexdigest(), *[left] * keep_bytes))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * keep_bytes]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return joined.mapInArrow(take, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
