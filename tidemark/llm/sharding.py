"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each record draws a number for every shard from its key and the shard's number
alone, and goes where weight / -ln(number) is largest. A shard that is added
draws anew but changes no other draw, so records move only into it, and about
its share of them.

Defined results: a null key is a key like any other; repeated rows go to one
shard, in slots one after the other; an empty table gives no rows; a null text is
of no bytes; texts of any length are hashed whole. A column of docs that has the
name of a new one is replaced by it; others stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, running_total, shuffle_key

#: Hex digits of the MD5 that make a draw: 52 bits, as a double holds.
DRAW_DIGITS = 13


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, of a key of any type over shards with these weights (0: takes nothing)."""
    name = F.coalesce(key.cast("string"), F.lit(""))

    def bid(shard: int, weight: float) -> Column:
        digest = F.md5(F.concat(name, F.lit(f"#{shard}")).cast("binary"))
        draw = (F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("double") + 0.5) / float(16**DRAW_DIGITS)
        return F.struct((F.lit(float(weight)) / -F.log(draw)).alias("bid"), F.lit(-shard).alias("shard"))

    bids = [bid(s, w) for s, w in enumerate(weights) if w > 0]
    if not bids:
        raise ValueError("no shard has a weight")
    best = F.greatest(*bids) if len(bids) > 1 else bids[0]
    return (-best["shard"]).cast("int")


def assign(docs: DataFrame, key: str, weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """docs with their shard."""
    return docs.withColumn(shard, rendezvous(F.col(key), weights))


def with_slots(rows: DataFrame, key: str, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Add each row's place in its shard, gapless from 0, in shuffled order; rows should be slim, they are shuffled."""
    name = fresh(rows.columns, "key")
    keyed = rows.withColumn(name, shuffle_key(F.col(key)))
    out = running_total(keyed, [shard], name, [key], F.lit(1), slot)
    return out.withColumn(slot, F.col(slot) - 1).drop(name)


def write_shards(docs: DataFrame, key: str, weights: Sequence[float], path: str, files_per_shard: int = 1) -> None:
    """Write docs as Parquet in a folder for each shard (shard=0 and so on)."""
    placed = assign(docs, key, weights)
    spread = F.pmod(F.xxhash64(key), F.lit(files_per_shard))
    placed.repartition(len(weights) * files_per_shard, "shard", spread).write.partitionBy("shard").parquet(path)
