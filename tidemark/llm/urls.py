"""URL filters by a sorted digest array.

The rules' keys (host and path) are a sorted array of 64-bit XXH64 digests in a
file that every executor maps into memory once, with the keys themselves beside
it. A url's possible keys are made in the JVM (each of its parent domains with
each path prefix of a length that some rule has), hashed there, probed by
vectorised binary search and confirmed against the stored string, so that a
collision of digests decides nothing. The longest confirmed key wins.

The files hold at most MAX_LOCAL_RULES rules; a longer list is joined on the
digest instead, with the same confirmation.

Defined results: a null url, or one without `://`, has an empty host and path
and fits no rule; a rule with a null part fits nothing; of two equal rules
`block` holds; repeated urls are judged alike; very long urls are read whole, but
only parents of a host that are no longer than the longest rule's are looked up;
an empty table gives no rows. Columns of pages named host, path, rule or verdict
are replaced by the new ones; others stay.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, stash

MAX_LOCAL_RULES = 1_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lowered(host), path


def lowered(host: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower())


def possible_keys(host: Column, path: Column, path_lengths: list[int], longest: int) -> Column:
    """Every parent domain of host (itself included) of at most `longest` characters, joined with each prefix of path of these lengths."""
    # A longer one fits no rule, so only what follows a dot among the last characters is split into labels.
    labels = F.split(F.when(F.length(host) > longest, F.concat(F.lit("."), F.regexp_extract(F.substr(host, -F.lit(longest + 1)), r"\.(.*)$", 1))).otherwise(host), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parents = F.filter(parents, lambda h: (F.length(h) <= longest) & ((F.length(host) <= longest) | (F.substr(h, F.lit(1), F.lit(1)) != ".")))
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths)), lambda p: p.isNotNull())
    return F.flatten(F.transform(parents, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))


_OPEN: dict[str, tuple[np.ndarray, ...]] = {}


def _open(name: str) -> tuple[np.ndarray, ...]:
    """The sorted digests, where each key starts in the bytes of all keys, those bytes, and the verdicts; mapped once a process."""
    if name not in _OPEN:
        _OPEN[name] = tuple(np.load(SparkFiles.get(f"{name}-{part}.npy"), mmap_mode="r") for part in ("digests", "starts", "keys", "blocks"))
    return _OPEN[name]


def _share(spark, rows: list) -> str:
    """Write the sorted arrays and send them to the executors; returns their name."""
    merged: dict[tuple[int, str], bool] = {}
    for r in rows:
        merged[(r["digest"], r["key"])] = merged.get((r["digest"], r["key"]), False) or r["verdict"] == "block"
    order = sorted(merged)
    keys = [k.encode() for _, k in order]
    name, folder = f"urlrules-{uuid.uuid4().hex}", tempfile.mkdtemp(prefix="spark-urlrules-")
    parts = {
        "digests": np.array([d for d, _ in order], dtype=np.int64),
        "starts": np.cumsum([0, *map(len, keys)], dtype=np.int64),
        "keys": np.frombuffer(b"".join(keys) or b"\0", dtype=np.uint8),
        "blocks": np.array([merged[x] for x in order], dtype=bool),
    }
    for part, array in parts.items():
        np.save(path := os.path.join(folder, f"{name}-{part}.npy"), array)
        spark.sparkContext.addFile(path)
    return name


def _prober(name: str):
    @F.pandas_udf("struct<key: string, verdict: string>")
    def probe(keys: pd.Series, digests: pd.Series) -> pd.DataFrame:
        rules, starts, stored, blocks = _open(name)
        sizes = np.fromiter(map(len, digests), dtype=np.int64, count=len(digests))
        flat = np.concatenate([np.zeros(0, np.int64), *digests])
        at = np.searchsorted(rules, flat)
        hits = np.flatnonzero(rules[np.minimum(at, len(rules) - 1)] == flat) if len(rules) else []
        owner = np.repeat(np.arange(len(sizes)), sizes)
        first = np.cumsum(sizes) - sizes
        key, verdict = [None] * len(sizes), [None] * len(sizes)
        for i in hits:
            row = owner[i]
            asked, j = keys.iloc[row][i - first[row]], at[i]
            while j < len(rules) and rules[j] == flat[i]:
                if stored[starts[j] : starts[j + 1]].tobytes() == asked.encode():
                    if key[row] is None or len(asked) > len(key[row]):
                        key[row], verdict[row] = asked, "block" if blocks[j] else "allow"
                    break
                j += 1
        return pd.DataFrame({"key": key, "verdict": verdict})

    return probe


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_local_rules: int = MAX_LOCAL_RULES) -> DataFrame:
    """pages with host, path, rule (the longest that fits, host and path in one) and verdict.

    rules: host, path, verdict (allow or block). Without a rule that fits, the
    digest array holds no key of the url and the verdict is `default`.
    """
    spark = pages.sparkSession
    key = F.concat(lowered(F.col("host")), F.lit("\n"), F.col("path"))
    rules = rules.filter("host IS NOT NULL AND path IS NOT NULL").select(key.alias("key"), F.xxhash64(key).alias("digest"), "host", F.length("path").alias("n"), "verdict")
    lengths = sorted(r["n"] for r in rules.select("n").distinct().collect())
    host, path = host_and_path(F.col(url))
    many, found, row = (fresh(pages.columns, c) for c in ("keys", "found", "row"))
    judged = pages.withColumns({"host": host, "path": path})
    if not lengths:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = possible_keys(F.col("host"), F.col("path"), lengths, rules.agg(F.max(F.length("host"))).first()[0])
    head = rules.select("key", "digest", "verdict").take(max_local_rules + 1)
    if len(head) <= max_local_rules:
        judged = judged.withColumn(many, keys)
        judged = judged.withColumn(found, _prober(_share(spark, head))(F.col(many), F.transform(many, lambda k: F.xxhash64(k))))
    else:
        judged = stash(judged.withColumn(row, F.monotonically_increasing_id()), "pages")
        asked = judged.select(row, F.explode(keys).alias("key")).withColumn("digest", F.xxhash64("key"))
        hits = asked.join(rules.groupBy("key", "digest").agg(F.max("verdict").alias("verdict")), ["digest", "key"])
        best = hits.groupBy(row).agg(F.max_by(F.struct("key", "verdict"), F.length("key")).alias(found))
        judged = judged.join(best, row, "left").drop(row)
    return judged.withColumns({"rule": F.replace(F.col(f"{found}.key"), F.lit("\n"), F.lit("")), "verdict": F.coalesce(f"{found}.verdict", F.lit(default))}).drop(many, found)
