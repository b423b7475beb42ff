"""Structured Streaming over event logs: windows with watermarks, idempotent appends, and replay into state."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, at: str, late: str, width: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts per tumbling (or sliding) window and key; rows later than `late` are dropped."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *keys, "n")


def in_sessions(events: DataFrame, at: str, late: str, gap: str, keys: list[str]) -> DataFrame:
    w = F.session_window(at, gap)
    return events.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *keys, "n")


def once(events: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def replayed(events: DataFrame, key: str, seq: str, kind: str) -> DataFrame:
    """Per key: the retry state after each batch, folding kinds in the order of seq: 'error' adds a retry (five at most), 'purchase' clears."""
    key_type = events.schema[key].dataType.simpleString()

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (retries, upto) = state.get if state.exists else (0, -1)
        rows = pd.concat(list(batches)).sort_values(seq)
        for s, what in zip(rows[seq], rows[kind], strict=True):
            if s <= upto:
                continue  # replayed: it counted before
            upto = int(s)
            retries = 0 if what == "purchase" else min(5, retries + 1) if what == "error" else retries
        state.update((retries, upto))
        yield pd.DataFrame({key: [k[0]], "retries": [retries], "upto": [upto]})

    return events.groupBy(key).applyInPandasWithState(fold, f"{key} {key_type}, retries long, upto long", "retries long, upto long", "update", GroupStateTimeout.NoTimeout)


def observed(events: DataFrame, key: str, order: list[str], label: str, name: str, kinds: int) -> DataFrame:
    """Per event but a key's first: `name` and the bits of surprise at its label after the one before, by the key's counts so far (one added to each of `kinds`).

    The state of a key is its last label and a count per pair of labels seen, so it is bounded by kinds, not by the stream.
    Events are taken in order within a batch; one that comes in a later batch counts as later.
    """
    kind = {f.name: f.dataType.simpleString() for f in events.schema}

    def observe(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, before, after, n = state.get if state.exists else (None, [], [], [])
        pairs: dict[str, dict[str, int]] = {}
        for b, a, c in zip(before, after, n, strict=True):
            pairs.setdefault(b, {})[a] = int(c)
        rows = pd.concat(list(batches)).sort_values(order)
        names, bits = [], []
        for who, what in zip(rows[name], rows[label], strict=True):
            if last is not None:
                seen = pairs.setdefault(last, {})
                names.append(who)
                bits.append(-math.log2((seen.get(what, 0) + 1) / (sum(seen.values()) + kinds)))
                seen[what] = seen.get(what, 0) + 1
            last = what
        flat = [(b, a, c) for b, seen in pairs.items() for a, c in seen.items()]
        state.update((last, *([x[i] for x in flat] for i in range(3))))
        yield pd.DataFrame({name: names, "surprisal": bits}).astype({"surprisal": "float64"})

    held = "last string, before array<string>, after array<string>, n array<long>"
    slim = events.filter(F.col(label).isNotNull()).select(*dict.fromkeys([key, *order, label, name]))
    return slim.groupBy(key).applyInPandasWithState(observe, f"{name} {kind[name]}, surprisal double", held, "append", GroupStateTimeout.NoTimeout)


def append_new(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends rows with keys that the table at `path` doesn't have, so a repeated batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        fresh = batch.dropDuplicates(keys)
        if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(path).select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(path)

    return write
