"""Document fingerprints by quartile bucket digests.

Every byte triplet of a text is hashed into one of BUCKETS buckets and counted.
The quartiles of the counts turn each bucket into two bits (in which quarter of
all buckets its count lies); the length goes in as a byte on a logarithmic
scale. Two digests differ by the sum of their buckets' distances, with
opposite quarters weighing more, plus that of the lengths; the sum is bounded,
so it gives a likeness from 0 to 1.

The neighbour of a document in the order of ids is found without a global sort
in one task and with one shuffle of the texts: ids are cut into ranges at
approximate quantiles, the first row of each range (one a range, found by a
slim aggregation) is sent to the range before it as well, and each range is
read in order as a stream that holds two rows.

Defined results: a null text is empty, an empty one has the digest of no
triplets; rows with a null id come first; repeated ids are in the order of
their texts; a single document is its own neighbour; very long texts are counted whole,
in pieces of a megabyte; ids may be numbers, texts or dates; an empty table gives
no rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 128
LENGTH_WEIGHT = 2
"""What one step of the length byte (a factor of about 1.1) counts as, up to LENGTH_CAP steps."""

LENGTH_CAP = 16
APART = np.array([0, 1, 2, 6], dtype=np.int64)
"""What quarters that are 0, 1, 2 or 3 apart count as."""

WORST = 6 * BUCKETS + LENGTH_WEIGHT * LENGTH_CAP
RANGE_BYTES = 32_000_000
MAX_RANGES = 1 << 16
"""Beyond this many (2 TB of text) the ranges grow; each is a sorted stream of two rows, so that costs no memory: 1.5 GB a task at 100 TB."""

_MULTIPLIER = np.uint32(2654435761)


def counts(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """How many byte triplets fall into each bucket."""
    total = np.zeros(buckets, dtype=np.int64)
    shift = np.uint32(32 - buckets.bit_length() + 1)
    raw = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, max(0, len(raw) - 2), 1 << 20):  # bounded memory for any length
        part = raw[at : at + (1 << 20) + 2].astype(np.uint32)
        triplets = part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]
        total += np.bincount(triplets * _MULTIPLIER >> shift, minlength=buckets)
    return total


def digest(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """The length byte, then four buckets a byte."""
    own = counts(data, buckets)
    ranked = np.sort(own)
    edges = ranked[[buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1]]
    quarters = (own[:, None] > edges[None, :]).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    packed = quarters[:, 0] << 6 | quarters[:, 1] << 4 | quarters[:, 2] << 2 | quarters[:, 3]
    length = min(255, round(np.log(len(data) + 1) * 10))
    return np.concatenate([[length], packed]).astype(np.uint8)


def difference(a: np.ndarray, b: np.ndarray) -> int:
    """From 0 to WORST."""
    split = lambda x: np.stack([x[1:] >> 6, x[1:] >> 4 & 3, x[1:] >> 2 & 3, x[1:] & 3]).astype(np.int64)
    return int(APART[np.abs(split(a) - split(b))].sum()) + LENGTH_WEIGHT * min(LENGTH_CAP, abs(int(a[0]) - int(b[0])))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: what is left of the largest difference, squared to spread the near end."""
    return (1.0 - difference(a, b) / WORST) ** 2


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the first as many characters of the next (or all it has)."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


COLUMNS = "doc_id {0}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judged(pairs: Iterator[tuple[object, str, str]]) -> Iterator[tuple]:
    """Rows for (id, text, next text); what is computed for a next text is used again when its turn comes."""
    held: tuple[str, np.ndarray] = ("", digest(b""))
    for doc_id, text, following in pairs:
        own = held[1] if held[0] == text else digest(text.encode())
        after = digest(following.encode())
        held = (following, after)
        new = edited(text, following).encode()
        of_new = digest(new)
        yield doc_id, len(text), hashlib.sha256(new).hexdigest(), own.tobytes().hex(), of_new.tobytes().hex(), likeness(own, of_new), likeness(own, after)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per document: its digest, that of its edited text, and how like it the edited and the next text are."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    if ranges is None:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = min(MAX_RANGES, max(1, -(-total // RANGE_BYTES)))
    is_text = kind in ("string", "binary")
    rank = F.col("doc_id")
    if ranges == 1:
        cuts = []
    elif is_text:  # quantiles of a bounded sample, drawn by hashes of the ids; they only decide how even the ranges are
        drawn = rows.select("doc_id").filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(10_000, 10 * ranges)).collect()
        drawn = sorted(bytes(r[0]) if kind == "binary" else r[0].encode() for r in drawn)
        cuts = [drawn[i * len(drawn) // ranges] for i in range(1, ranges)] if drawn else []
        cuts = sorted(set(cuts if kind == "binary" else [c.decode() for c in cuts]), key=lambda c: c if kind == "binary" else c.encode())
    else:
        cuts = sorted(set(rows.agg(F.percentile_approx(rank, [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges))).first()[0] or []))
    # The range of an id is the number of cuts that are not above it; a null id is in the first.
    edges = F.array(*map(F.lit, cuts)).cast(f"array<{kind}>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) <= rank, at + step).otherwise(at)) if cuts else F.lit(0)  # binary search
    placed = rows.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(place))
    order = F.struct(F.col("doc_id").isNotNull().alias("set"), "doc_id", F.xxhash64("text").alias("tie"))
    heads = placed.groupBy("range").agg(F.min(order).alias("head")).select("range", F.xxhash64("head.doc_id", "head.tie").alias("name"))
    heads = sorted(heads.collect(), key=lambda r: r["range"])
    if not heads:
        return docs.sparkSession.createDataFrame([], COLUMNS.format(kind))
    # The head of each range also closes the one before it, that of the first closes the last.
    names = [r["range"] for r in heads]
    closes = {r: names[i - 1] for i, r in enumerate(names)}
    spark = docs.sparkSession
    ends = spark.createDataFrame([(a, b) for a, b in closes.items()], "range int, before int")
    # A row that only has a head's hash is sent as well, comes after the head in the order and closes nothing.
    head = F.xxhash64("doc_id", "tie").isin([r["name"] for r in heads])
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("closing"))
    also = F.struct(F.col("before").alias("range"), F.lit(True).alias("closing"))
    sent = placed.join(F.broadcast(ends), "range").withColumn("tie", F.xxhash64("text")).withColumn("head", head)
    sent = sent.select("doc_id", "text", F.explode(F.when(F.col("head"), F.array(own, also)).otherwise(F.array(own))).alias("to"))
    sent = sent.select("doc_id", "text", "to.range", "to.closing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[object, str, str]]:
            now = None
            for batch in batches:
                for d, t, r, closing in zip(*(batch.column(i) for i in range(4)), strict=True):
                    row = (d.as_py(), t.as_py(), r.as_py(), closing.as_py())
                    if now is not None and now[2] == row[2] and not now[3]:
                        yield now[0], now[1], row[1]
                    now = row

        held = []
        for row in _judged(pairs()):
            held.append(row)
            if len(held) == 1000:
                yield _batch(held, schema)
                held = []
        if held:
            yield _batch(held, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(COLUMNS.format(kind)))
    inside = sent.repartitionByRange(len(names), "range").sortWithinPartitions("range", "closing", F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    return inside.mapInArrow(run, COLUMNS.format(kind))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
