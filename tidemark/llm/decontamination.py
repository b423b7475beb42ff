"""Benchmark decontamination by size-partitioned MinHash containment search; DataFrame functions only.

Which long documents hold at least `threshold` of a short test item's word
shingles? A MinHash sketch of one fixed size can't tell: the longer the
document, the rarer an item's shingle is among its minima. Documents are
therefore partitioned by size, and a partition's sketch has as many bins as its
documents have shingles, up to a power of two: the hashes are cut into bins by
their leading bits and the least of each bin is kept, all from one hash per
shingle. A shingle that document and item share is then a minimum of both with
a probability p that is the same in every partition, and an item is missed only
if that fails for all of its shared shingles. `extra_bits` doubles the bins until
that happens less than once in 10^6 for the smallest item asked for.

An item's hash that is the least of its bin with b leading bits is so with any
more bits. So one row per item shingle, with the least such b, serves as the
item's sketch for every partition at once.

Candidates are verified by exact containment of the shingle strings.

Words are lower-cased runs of letters and digits. Defined results: a document
or item of fewer than `words` words, a null or an empty one has no shingles and
matches nothing; repeated rows each match; a null id is reported as null;
empty tables give no rows; further columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, stash

WORDS = 5
THRESHOLD = 0.8
MISS = 1e-6
BROADCAST_ROWS = 500_000
"""Tables of at most this many slim rows are sent to all executors; larger ones are shuffled."""

BROADCAST_SHINGLES = 1_000_000
"""Lists of shingles of at most so many in all, some 50 MB of words, are sent to all executors."""


def words_of(text: Column) -> Column:
    """The lower-cased runs of letters and digits of a text."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _starts(words: str, n: int) -> Column:
    """The places where a shingle of n words starts; none for fewer words."""
    last = F.size(words) - n
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def hashes_of(words: str, n: int) -> Column:
    """The sorted distinct hashes of the shingles of column `words`."""
    return F.array_distinct(F.sort_array(F.transform(_starts(words, n), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))))


def shingles_of(words: str, n: int) -> Column:
    """The distinct shingles themselves, space-joined."""
    return F.array_distinct(F.transform(_starts(words, n), lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " ")))


def extra_bits(shared: int, miss: float = MISS) -> int:
    """Doublings of the bins so that `shared` common shingles all fail to be minima less often than `miss`."""
    extra = 0
    while True:
        load = 2.0**-extra  # other shingles a bin
        p = -math.expm1(-load) / load
        if (1 - p) ** max(1, shared) <= miss:
            return extra
        extra += 1


def _bin(h: Column, bits: str) -> Column:
    return F.call_function("shiftrightunsigned", h, (F.lit(64) - F.col(bits)).cast("int"))


def sketches(docs: DataFrame, hashes: str, extra: int, bits: str = "bits") -> DataFrame:
    """Add the size partition (leading bits of its bins) and `sketch`, the least hash of each bin."""
    size = F.greatest(F.size(hashes), F.lit(1))
    part = F.least(F.lit(63), F.greatest(F.lit(1), F.ceil(F.log2(size)).cast("int") + extra))
    sized = docs.withColumn(bits, part)
    first = lambda h, i: (i == 0) | (_bin(h, bits) != _bin(F.get(hashes, i - 1), bits))
    return sized.withColumn("sketch", F.filter(hashes, first))


def item_index(items: DataFrame, item_id: str, hashes: str) -> DataFrame:
    """h, item_id, from_bits: from that many leading bits on, h is the least hash of its bin in the item."""
    sorted_at = items.select(F.col(item_id).alias("item_id"), hashes, F.posexplode(hashes).alias("at", "h"))
    alike = F.col("h").bitwiseXOR(F.get(hashes, F.col("at") - 1))
    common = F.when(alike < 0, 0).otherwise(64 - F.length(F.bin(alike)))
    return sorted_at.select("h", "item_id", F.when(F.col("at") == 0, 0).otherwise(common + 1).alias("from_bits"))


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; df should be a written table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key, item_id, shared, item_shingles, containment for every pair at or above the threshold."""
    items = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("words")).select("item_id", hashes_of("words", words).alias("hashes"), shingles_of("words", words).alias("shingles"))
    items = stash(items.filter(F.size("shingles") > 0).withColumn("item_shingles", F.size("shingles")), "items")
    smallest = items.agg(F.min("item_shingles")).first()[0] or 1
    extra = extra_bits(math.ceil(threshold * smallest))
    index = _small(stash(item_index(items, "item_id", "hashes"), "index"))

    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text, F.length(text)).alias("text_key"))
    hashed = keyed.select("text_key", words_of(F.col("text")).alias("words")).select("text_key", hashes_of("words", words).alias("hashes"))
    # The outer form: from explode() Spark infers a filter on the sketch, which it would compute a second time, word list and all.
    minima = sketches(hashed, "hashes", extra).select("text_key", "bits", F.explode_outer("sketch").alias("h"))
    candidates = minima.join(index, "h").filter(F.col("bits") >= F.col("from_bits")).select("text_key", "item_id").distinct()
    candidates = _small(stash(candidates, "candidates"))

    few = (items.agg(F.sum("item_shingles")).first()[0] or 0) <= BROADCAST_SHINGLES
    lists = items.select("item_id", "shingles", "item_shingles")
    pairs = keyed.join(candidates, "text_key").withColumn("words", words_of(F.col("text"))).withColumn("own", shingles_of("words", words)).drop("text", "words")
    pairs = pairs.join(F.broadcast(lists) if few else lists, "item_id")
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("own", "shingles"))).drop("own", "shingles")
    pairs = pairs.withColumn("containment", F.col("shared") / F.col("item_shingles"))
    return pairs.filter(F.col("containment") >= threshold).select("doc_id", "text_key", "item_id", "shared", "item_shingles", "containment")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that contain an item."""
    own, key = F.col(f"`{text}`"), fresh(docs.columns, "text_key")
    found = contained(docs.select(F.lit(0).alias("id"), own.alias("text")), items, "id", "item_id", "text", words, threshold)
    bad = _small(stash(found.select(F.col("text_key").alias(key)).distinct(), "contaminated"))
    return docs.withColumn(key, F.xxhash64(own, F.length(own))).join(bad, key, "left_anti").select(*(f"`{c}`" for c in docs.columns))
