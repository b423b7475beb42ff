"""Audit of how sources of a language diverge in the terms they use, with late materialization of strings.

A term is a run of letters: anything but ASCII characters that are no letters;
only A-Z are lower-cased. Texts are taken apart once; each map task sums up
what it has met and writes it, the strings in a column of their own. All that is shuffled to
count, to find the kept terms and to compare sources reads and moves fixed-width columns
only: 64-bit digests of term, language and group, and numbers.

Strings come back in two places. The least and the greatest string of each digest
that may be kept, taken in the map tasks first, tell where one digest
stands for several terms; those are counted again by their strings and from then on
known by a digest and a number of their own, so results are exact whatever collides.
And the terms that are put out get their strings, after their values have ranked them.

Sources are compared without going through all kept terms for each pair. With p0
the share of a term that a source doesn't have, the sum over all terms is V f(p0, q0),
plus what the terms of one source add to that, which depends on the other only through its
p0 and is summed up once for each of the few values of it, plus a correction for
terms that both have. Only the latter needs pairs of sources of a term; they are added
up within the task and leave it as sums. All of it is integer arithmetic.

Defined results: null text, language and source are ''; a repeated row is a document
of its own; a text without terms, a group without kept terms and a language without any
(pairs of value 0, no terms) are there; very long texts are counted whole, in pieces of a
megabyte; equal values go by the UTF-8 bytes of the item; an empty table gives no
rows. Other columns, whatever their names, play no part. Sums are 64-bit: counts beyond
9 * 10^18 raise an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stash, unstash

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP = 200
SEED = 42
PIECE = 1 << 20
HELD = 1 << 19
"""So many terms of groups a task sums up in memory before it writes them."""

PAIRS = 1 << 20
"""So many pairs of sources are held at once where those of a term are compared."""

#: Bytes of terms, A-Z lower-cased, and a space for all others.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of those of about a megabyte."""
    plain = text.translate(_LETTERS)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _counted(docs: DataFrame, bits: int) -> DataFrame:
    """lang_key, group_key, digest, n, docs, term: occurrences and documents of each term and group, summed up within tasks."""
    mask = (1 << bits) - 1

    def rows(held: dict[int, tuple[int, Counter[bytes], Counter[bytes]]]) -> pa.RecordBatch:
        names = [t for _, n, _ in held.values() for t in n]
        each = {t: xxhash.xxh64_intdigest(t, SEED) & mask for t in set(names)}
        sizes = [len(n) for _, n, _ in held.values()]
        columns = [
            np.repeat(np.array([k for k, _, _ in held.values()], dtype=np.int64), sizes),
            np.repeat(np.array(list(held), dtype=np.int64), sizes),
            np.array([each[t] for t in names], dtype=np.uint64).view(np.int64),
            np.array([c for _, n, _ in held.values() for c in n.values()], dtype=np.int64),
            np.array([d[t] for _, n, d in held.values() for t in n], dtype=np.int64),
        ]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(names, pa.binary()).cast(pa.string())], ["lang_key", "group_key", "digest", "n", "docs", "term"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, Counter[bytes], Counter[bytes]]] = {}
        for batch in batches:
            for lang, group, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
                _, n, d = held.setdefault(group, (lang, Counter(), Counter()))
                seen: set[bytes] = set()
                for terms in terms_of(text.as_py()):
                    n.update(terms)
                    seen.update(terms)
                d.update(seen)
                if sum(len(c) for _, c, _ in held.values()) > HELD:
                    yield rows(held)
                    held = {}
        if any(n for _, n, _ in held.values()):
            yield rows(held)

    return docs.select("lang_key", "group_key", F.col("text").cast("binary")).mapInArrow(run, "lang_key long, group_key long, digest long, n long, docs long, term string")


def _grouped(docs: DataFrame, lang: str, source: str, text: str) -> tuple[DataFrame, DataFrame]:
    """docs with keys of their language and group, and the groups; where two meet under one key, other keys are taken."""
    plain = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    names = stash(plain.select("lang", "source").distinct(), "groups")
    for salt in range(16):
        keys = {"lang_key": F.xxhash64(F.lit(salt), "lang"), "group_key": F.xxhash64(F.lit(salt), "lang", "source")}
        groups = names.withColumns(keys)
        n = groups.agg(F.count_distinct("lang"), F.count_distinct("lang_key"), F.count(F.lit(1)), F.count_distinct("group_key")).first()
        if n[0] == n[1] and n[2] == n[3]:
            return plain.withColumns(keys), groups
    raise RuntimeError("no keys tell the groups apart")


def _kept_counts(terms: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Counts of the kept terms by group (lang_key, group_key, digest, apart, n, lang_n), and strings (digest, apart, term).

    A digest with one string has apart 0; where several share it, they are numbered from 1. Each table is deleted once what was made of it is written, terms among them.
    """
    counts = whole = stash(terms.groupBy("lang_key", "group_key", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    # A digest of several terms has at least the documents of each, so no term is missed here.
    likely = counts.groupBy("lang_key", "digest").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("digest").distinct()
    strings = terms.groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("most"))
    strings = stash(strings.join(likely, "digest", "left_semi"), "strings")
    shared = strings.filter("term != most").select("digest")
    counts = counts.withColumn("apart", F.lit(0))
    names = strings.filter("term = most").select("digest", F.lit(0).alias("apart"), "term")
    if not shared.isEmpty():
        split = terms.join(shared, "digest", "left_semi").select("digest", "term").distinct()
        split = stash(split.withColumn("apart", F.row_number().over(Window.partitionBy("digest").orderBy("term"))), "split")
        again = stash(terms.join(split, ["digest", "term"]).groupBy("lang_key", "group_key", "digest", "apart").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "again")
        counts = counts.join(shared, "digest", "left_anti").unionByName(again)
        names = names.unionByName(split.select("digest", "apart", "term"))
    unstash(terms)
    kept = counts.groupBy("lang_key", "digest", "apart").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= min_docs).drop("docs")
    kept = stash(counts.drop("docs").join(kept, ["lang_key", "digest", "apart"]), "kept")
    unstash(whole)
    return kept, names


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), in decimals, whatever the count."""
    return (F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), total.cast("decimal(20,0)"))).cast("long")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _met(rows: DataFrame) -> DataFrame:
    """group_key, other_key, met: what the terms that both sources have add to the sum, over what they would add without each other."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def pairs(first: np.ndarray, sizes: np.ndarray, group: np.ndarray, p: np.ndarray, none: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of terms whose rows begin at `first`."""
        names, at = np.unique(group, return_inverse=True)
        each = np.repeat(sizes, sizes)  # how many rows each row meets
        start = np.repeat(first, sizes)
        ends = np.cumsum(each)
        lo = 0
        sums: dict[int, int] = {}
        while lo < len(group):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
            x = np.repeat(np.arange(lo, hi), each[lo:hi])
            y = np.repeat(start[lo:hi], each[lo:hi]) + np.arange(len(x)) - np.repeat(np.cumsum(each[lo:hi]) - each[lo:hi], each[lo:hi])
            x, y = x[x != y], y[x != y]
            more = f(p[x], p[y]) - f(p[x], none[y]) - f(none[x], p[y]) + f(none[x], none[y])
            code = at[x] * len(names) + at[y]
            order = np.argsort(code, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0]) if len(order) else np.zeros(0, dtype=int)
            if len(cut):
                for k, v in zip(code[order][cut].tolist(), np.add.reduceat(more[order], cut).tolist(), strict=True):
                    sums[k] = sums.get(k, 0) + v
            lo = hi
            if len(sums) > PAIRS or lo == len(group) and sums:
                k = np.fromiter(sums, dtype=np.int64, count=len(sums))
                yield pa.RecordBatch.from_arrays([pa.array(names[k // len(names)]), pa.array(names[k % len(names)]), pa.array(list(sums.values()), pa.int64())], ["group_key", "other_key", "met"])
                sums = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * 6  # the rows of the last term, which may go on in the next batch
        for batch in batches:
            rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            if not len(rows[0]):
                continue
            first = np.flatnonzero(np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])])
            cut = first[-1]
            held = [c[cut:] for c in rows]
            if cut:
                yield from pairs(first[:-1], np.diff(first), *(c[:cut] for c in rows[3:]))
        if len(held[0]):
            yield from pairs(np.zeros(1, dtype=np.int64), np.array([len(held[0])]), *held[3:])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.select("lang_key", "digest", F.col("apart").cast("long"), "group_key", "p", "none").repartition(n, "lang_key", "digest").sortWithinPartitions("lang_key", "digest", "apart")
    return own.mapInArrow(run, "group_key long, other_key long, met long").groupBy("group_key", "other_key").agg(F.sum("met").alias("met"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, digest_bits: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: every other source of the language with the sum of the squared differences of shares; part `term`: the `top`
    terms that the source uses more than its language does. digest_bits: fewer make digests collide, which changes no result.
    """
    keyed, groups = _grouped(docs, lang, source, text)
    terms = stash(_counted(keyed, digest_bits), "terms")
    kept, names = _kept_counts(terms, min_docs)
    langs = kept.groupBy("lang_key", "digest", "apart").agg(F.first("lang_n").alias("lang_n")).groupBy("lang_key").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    sums = kept.groupBy("group_key").agg(F.sum("n").alias("total"))
    groups = groups.join(langs, "lang_key", "left").join(sums, "group_key", "left").na.fill(0, ["v", "lang_total", "total"])
    groups = stash(groups.withColumn("none", F.when(F.col("v") > 0, share(F.lit(0), F.greatest(F.col("total") + F.col("v"), F.lit(1))))), "sized")
    scored = kept.join(groups.select("group_key", "v", "total", "lang_total", "none"), "group_key")
    scored = scored.withColumns({"p": share(F.col("n"), F.col("total") + F.col("v")), "q": share(F.col("lang_n"), F.col("lang_total") + F.col("v"))})
    scored = stash(scored.select("lang_key", "group_key", "digest", "apart", "p", "q", "none"), "scored")
    return _pairs(scored, groups).unionByName(_terms(scored, groups, names, top))


def _pairs(scored: DataFrame, groups: DataFrame) -> DataFrame:
    one, other = groups.select("lang_key", "group_key", "lang", "source", "v", "none"), groups.select("lang_key", F.col("group_key").alias("other_key"), F.col("source").alias("item"), F.col("none").alias("other_none"))
    above = scored.filter("p > none")  # others add nothing over what an absent term does
    alike = above.groupBy("lang_key", "group_key", "none", "p").agg(F.count(F.lit(1)).alias("m"))
    seen = groups.select("lang_key", F.col("none").alias("other_none")).distinct()
    alike = alike.join(seen, "lang_key")
    over = lambda x, y, x0, y0: F.sum(F.col("m") * (distance(F.col(x), F.col(y)) - distance(F.col(x0), F.col(y0))))
    alone = stash(alike.groupBy("group_key", "other_none").agg(over("p", "other_none", "none", "other_none").alias("own"), over("other_none", "p", "other_none", "none").alias("others")), "alone")
    both = one.join(other, "lang_key").filter("group_key != other_key")
    both = both.join(_met(above), ["group_key", "other_key"], "left")
    both = both.join(alone.select("group_key", "other_none", "own"), ["group_key", "other_none"], "left")
    both = both.join(alone.select(F.col("group_key").alias("other_key"), F.col("other_none").alias("none"), "others"), ["other_key", "none"], "left")
    value = F.col("v") * distance(F.col("none"), F.col("other_none")) + sum((F.coalesce(c, F.lit(0)) for c in ("own", "others", "met")), F.lit(0))
    order = Window.partitionBy("group_key").orderBy(F.desc("value"), "item")
    both = both.withColumn("value", F.coalesce(F.when(F.col("v") > 0, value), F.lit(0)).cast("long"))
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(scored: DataFrame, groups: DataFrame, names: DataFrame, top: int) -> DataFrame:
    likely = scored.filter("p > q").select("group_key", "digest", "apart", distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("group_key").orderBy(F.desc("value"), "digest", "apart")
    # The least of the top values; equal ones are told apart by their strings below.
    least = likely.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).groupBy("group_key").agg(F.min("value").alias("least"))
    named = likely.join(least, "group_key").filter("value >= least").join(names, ["digest", "apart"])
    order = Window.partitionBy("group_key").orderBy(F.desc("value"), "term")
    named = named.select("group_key", "term", "value", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= top)
    return named.join(groups.select("group_key", "lang", "source"), "group_key").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
