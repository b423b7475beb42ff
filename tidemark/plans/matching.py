"""Joins, votes, matches and scores over the driver's tables: anti-joins on several keys, containment, hypotheses, corroboration, coverage."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import times
from ..operators import evidence, graph, joins, picks, series
from ..operators.streams import dealt, dealt_by_rows
from ..sources.tables import table, written
from .evidence import _BORDA, _LM, _V, landmark_hashes, votes
from .timeline import _E, _SPANS, events, spans


def composite_anti(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of part and supplier that were never returned: NOT EXISTS on both keys."""
    line = table(spark, d, "lineitem")
    back = line.filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey")
    return line.join(back, ["l_partkey", "l_suppkey"], "left_anti").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


def scoped_using_join(spark: SparkSession, d: str) -> DataFrame:
    """Lines of urgent orders (priority by pattern, case ignored), joined on the order's key."""
    o = table(spark, d, "orders").filter(F.col("o_orderpriority").ilike("%urgent%")).select(F.col("o_orderkey").alias("key"), "o_orderdate")
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_quantity")
    return o.join(line, "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def id_links(spark: SparkSession, d: str) -> DataFrame:
    """Pages that link to a section (/de, the first part of a path), joined on the section to the least page that lies in it."""
    pages = table(spark, d, "pages")
    links = pages.select(F.col("page_id").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1))).alias("section"))
    sections = pages.select("page_id", F.regexp_extract("url", r"://[^/]*(/[^/?#]+)/", 1).alias("section")).filter("section != ''").groupBy("section").agg(F.min("page_id").alias("target"))
    return links.join(sections, "section").filter("source != target").select("source", "target")


def identity_bridge(spark: SparkSession, d: str) -> DataFrame:
    """The canonical id of each document: the least document with the same text, itself where it stands alone."""
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    bridge = docs.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("canonical"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return docs.join(bridge, "digest", "left").select("doc_id", F.coalesce("canonical", "doc_id").alias("canonical"), F.col("canonical").isNotNull().cast("int").alias("bridged"))


def name_containment(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items all of whose words (lower-cased letters) a document has, in any order.

    An item meets the documents that hold its rarest word only, counted over all documents; whole word sets decide on those.
    """
    own = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))
    docs = written(table(spark, d, "documents").select("doc_id", own.alias("held")))
    items = table(spark, d, "benchmark").select("item_id", own.alias("asked"))
    words = docs.select("doc_id", F.explode("held").alias("w"))
    asked = items.select("item_id", F.explode("asked").alias("w"))
    n = words.join(asked.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    rarest = picks.first_of(asked.join(n, "w", "left").fillna(0, ["n"]), ["item_id"], [F.asc("n"), F.asc("w")]).select("item_id", "w")
    pairs = words.join(rarest, "w").select("doc_id", "item_id")
    return pairs.join(docs, "doc_id").join(items, "item_id").filter(F.size(F.array_except("asked", "held")) == 0).select("doc_id", "item_id", F.size("asked").alias("words"))


def compatible_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of one region whose balances are within 5 % of each other and whose numbers are at most one apart on a circle of 12: a range join through cells of the logarithm."""
    region = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    s = table(spark, d, "supplier").filter("s_acctbal > 0").join(region, "s_nationkey").select("s_suppkey", "s_acctbal", "n_regionkey", F.floor(F.log("s_acctbal") / F.log(F.lit(1.05))).alias("cell"))
    a = s.select("n_regionkey", F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("x"), F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell"))
    b = s.select("n_regionkey", F.col("s_suppkey").alias("b"), F.col("s_acctbal").alias("y"), F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell"))
    hit = a.join(b, ["n_regionkey", "cell"]).filter((F.col("a") < F.col("b")) & (F.greatest("x", "y") <= 1.05 * F.least("x", "y")) & (times.cyclic_distance(F.col("a"), F.col("b")) <= 1))
    return hit.select("a", "b").distinct()


def two_level_max(spark: SparkSession, d: str) -> DataFrame:
    """The largest price a key has as a part's retail price or in any line of it, and that of the lines alone."""
    line = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("top")).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("top").alias("line_top"))
    return table(spark, d, "part").join(line, "p_partkey", "left").select("p_partkey", "line_top", F.greatest("p_retailprice", "line_top").alias("top"))


def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Spearman's and Pearson's correlation of quantity and discounted price in the lines of each supplier; equal values share the mean of their ranks."""
    line = dealt_by_rows(table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y")), "l_suppkey")
    for c in ("x", "y"):
        w = Window.partitionBy("l_suppkey")
        line = line.withColumn(f"r{c}", F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("l_suppkey", c)) - 1) / 2)
    return line.groupBy("l_suppkey").agg(F.round(F.corr("rx", "ry"), 5).alias("spearman"), F.round(F.corr("x", "y"), 5).alias("pearson"))


def coverage_score(spark: SparkSession, d: str) -> DataFrame:
    """How starved each order is where orders of known clerks (keys divisible by 3) count as covered: the mean of 1 - coverage over its axes
    (status, priority and, where the price is known to be above 50,000, its band), and 1 - coverage of the joint cell where that has eight orders."""
    band = F.when(F.col("o_totalprice") > 50_000, F.floor(F.col("o_totalprice") / 100_000).cast("int"))
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", band.alias("band"), (F.col("o_orderkey") % 3 == 0).cast("double").alias("got"))
    for name, on in {"c1": ["o_orderstatus"], "c2": ["o_orderpriority"], "c3": ["band"], "c4": ["o_orderstatus", "o_orderpriority", "band"]}.items():
        cells = o.groupBy(*on).agg(F.avg("got").alias(name), *([F.count(F.lit(1)).alias("cell")] if name == "c4" else []))
        same = F.lit(True)
        cells = cells.select(*(F.col(c).alias(f"_{c}") for c in on), *(c for c in cells.columns if c not in on))
        for c in on:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        o = o.join(F.broadcast(cells), same).drop(*(f"_{c}" for c in on))  # a few cells: statuses, priorities and bands of a bounded price
    axes = (1 - F.col("c1") + 1 - F.col("c2") + F.when(F.col("band").isNull(), 0.0).otherwise(1 - F.col("c3"))) / F.when(F.col("band").isNull(), 2).otherwise(3)
    return o.select("o_orderkey", F.round(axes + F.when(F.col("cell") >= 8, 1 - F.col("c4")).otherwise(0.0), 4).alias("weight"))


def dense_competitive(spark: SparkSession, d: str) -> DataFrame:
    """A part's suppliers: those with 0.3 of the most points first, by points a day between their first and last line (a tenth of a day at least), then the rest by points."""
    line = dealt_by_rows(table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_suppkey", "l_extendedprice", times.micros(F.col("l_shipdate")).alias("at")), "l_partkey")
    line = line.groupBy("l_partkey", "l_returnflag", "l_suppkey").agg(F.max("l_extendedprice").alias("score"), F.min("at").alias("first"), F.max("at").alias("last"))
    days = (F.max("last") - F.min("first")) / 86_400_000_000
    p = evidence.borda(line, "l_partkey", "l_returnflag", "l_suppkey", "score", F.greatest(days, F.lit(0.1)).alias("days"))
    p = p.filter("l_partkey IS NOT NULL AND l_suppkey IS NOT NULL").withColumn("most", F.max("points").over(Window.partitionBy("l_partkey")))
    near = F.col("points") >= 0.3 * F.col("most")
    order = [F.desc("near"), F.desc(F.when(F.col("near"), F.col("points") / F.col("days"))), F.desc("points"), F.asc("l_suppkey")]
    return p.withColumn("near", near).withColumn("place", F.row_number().over(Window.partitionBy("l_partkey").orderBy(*order))).select("l_partkey", "l_suppkey", "place")


def top_fraction_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean of each user's best fifth of values (one at least) where the user has more than 20, else of all."""
    w = Window.partitionBy("user_id")
    e = table(spark, d, "events").withColumns({"n": F.count("value").over(w), "place": F.row_number().over(w.orderBy(F.desc_nulls_last("value"), "event_id"))})
    k = F.when(F.col("n") > 20, F.greatest(F.lit(1), F.round(F.col("n") * 0.2).cast("int"))).otherwise(F.col("n"))
    return e.filter(F.col("place") <= k).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("score"))


def axis_union(spark: SparkSession, d: str) -> DataFrame:
    """The values that either of two tables has on an axis."""
    return table(spark, d, "documents").select(F.col("lang").alias("axis")).union(table(spark, d, "documents").select(F.col("source").alias("axis"))).distinct()


def hypothesis_space(spark: SparkSession, d: str) -> DataFrame:
    """What each unit's votes may mean: value and offset in bins of two, in order, after the null hypothesis that each unit has first."""
    at = F.bround(F.col("at") / 2.0).cast("int")
    v = votes(spark, d)
    named = v.filter("vote IS NOT NULL").select("unit", "vote", at.alias("bin")).distinct()
    null = v.select("unit").distinct().select("unit", F.lit(None).cast("int").alias("vote"), F.lit(0).alias("bin"))
    w = Window.partitionBy("unit").orderBy(F.asc_nulls_first("vote"), "bin")
    return null.unionByName(named).withColumn("place", F.row_number().over(w) - 1)


def corroborated(spark: SparkSession, d: str) -> DataFrame:
    """The confidence of each view span with 0.2 more for each of three channels (types) with a path of the user that agrees with it: an overlap of two seconds, and at its
    middle positions within 50 (each begins at its value and goes on at its own slope). 0.2 less for each channel that is there (the user has events of the type) and has none, be it that no
    event makes a path (values of 30 and more do); a channel without events is missing and says nothing."""
    slope = (0.9 + 0.1 * (F.col("event_id") % 3)) / 60
    s = spans(spark, d).join(table(spark, d, "events").select("event_id", "value"), "event_id").withColumn("slope", slope)
    main = s.filter("event_type = 'view'").select("user_id", "event_id", "lo", "hi", "value", "slope")
    channels = s.filter("event_type IN ('click', 'signup', 'error')").withColumnRenamed("event_type", "channel")
    other = channels.filter("value >= 30").select("user_id", "channel", *(F.col(c).alias(f"b_{c}") for c in ("lo", "hi", "value", "slope")))
    meet = joins.interval_join(main, other, ("lo", "hi"), ("b_lo", "b_hi"), 3600.0, ["user_id"])
    overlap = F.least("hi", "b_hi") - F.greatest("lo", "b_lo")
    middle = F.greatest("lo", "b_lo") + overlap / 2
    at = lambda p: F.col(f"{p}value") + (middle - F.col(f"{p}lo")) * F.col(f"{p}slope")
    agree = meet.filter((overlap >= 2) & (F.abs(at("") - at("b_")) <= 50)).select("event_id", "channel").distinct().groupBy("event_id").agg(F.count(F.lit(1)).alias("agree"))
    there = channels.select("user_id", "channel").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("there"))
    own = main.join(agree, "event_id", "left").join(there, "user_id", "left").fillna(0, ["agree", "there"])
    sure = 0.5 + 0.2 * F.col("agree") - 0.2 * (F.col("there") - F.col("agree"))
    return own.select("event_id", "agree", (F.col("there") - F.col("agree")).alias("against"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), 6).alias("confidence"))


STRETCHES = 100


def greedy_matches(df: DataFrame, keys: list[str], side: str, at: str, row: str, tolerance: float) -> DataFrame:
    """keys, a, b: each place of side 0, in order, takes the nearest free one of side 1 within the tolerance, the later of two as near.

    What lies farther apart than the tolerance can't meet, so each key's axis is cut at such gaps first and only the
    stretches between them, STRETCHES at a time, are gathered in one task.
    """
    w = Window.partitionBy(*keys).orderBy(at, row)
    cut = (F.col(at) - F.lag(at).over(w) > tolerance).cast("int")
    dealt = df.select(*keys, side, at, row).withColumn("__cut", F.coalesce(cut, F.lit(0))).withColumn("__stretch", F.floor(F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)) / STRETCHES))

    def match(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values([at, row])
        a, b = own[own[side] == 0], own[own[side] == 1]
        free, places, out = np.ones(len(b), dtype=bool), b[at].to_numpy(dtype=float), []
        for x, name in zip(a[at].to_numpy(dtype=float), a[row], strict=True):
            off = np.where(free, np.abs(places - x), np.inf)
            if len(off) and off.min() <= tolerance + 1e-9:
                k = len(off) - 1 - int(off[::-1].argmin())
                free[k] = False
                out.append((name, b[row].iloc[k]))
        found = pd.DataFrame(out, columns=["a", "b"])
        for c in keys:
            found[c] = own[c].iloc[0] if len(own) else None
        return found[[*keys, "a", "b"]]

    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in keys]
    return dealt.groupBy(*keys, "__stretch").applyInPandas(match, ", ".join([*kinds, f"a {df.schema[row].dataType.simpleString()}", f"b {df.schema[row].dataType.simpleString()}"]))


def _boundaries(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1)
    return events(spark, d).select("user_id", "event_id", side.alias("side"), (F.col("us") / 3_600_000_000).alias("at")).filter("side IS NOT NULL")


def tolerance_matches(spark: SparkSession, d: str) -> DataFrame:
    """Clicks of a user matched one to one with views within two hours."""
    return greedy_matches(_boundaries(spark, d), ["user_id"], "side", "at", "event_id", 2.0)


def tolerance_scores(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of clicks as predictions of views, two hours being near enough."""
    n = _boundaries(spark, d).groupBy("user_id").agg(F.count_if(F.col("side") == 0).alias("n_pred"), F.count_if(F.col("side") == 1).alias("n_true"))
    hits = tolerance_matches(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"))
    own = n.join(hits, "user_id", "left").fillna(0, ["hits"])
    p, r = F.when(F.col("n_pred") > 0, F.col("hits") / F.col("n_pred")).otherwise(0.0), F.when(F.col("n_true") > 0, F.col("hits") / F.col("n_true")).otherwise(0.0)
    return own.select("user_id", "hits", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def closest_first(points: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Pairs of ids of side 0 and side 1, the nearest in time first, each used once; of equals the lesser id of side 0, then of side 1.

    points: time, side and id. Of all that is left the nearest two lie side by side, so a heap of neighbours does, without all pairs.
    """
    own: dict[tuple[int, int], deque[int]] = {}
    for at, side, row in sorted(points):
        own.setdefault((at, side), deque()).append(row)
    spots, ids, n = list(own), list(own.values()), len(own)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def meet(i: int, j: int) -> None:
        if i >= 0 and j < n and spots[i][1] != spots[j][1]:
            x, y = (j, i) if spots[i][1] else (i, j)
            heappush(heap, (spots[j][0] - spots[i][0], ids[x][0], ids[y][0], i, j))

    for i in range(n - 1):
        meet(i, i + 1)
    out = []
    while heap:
        _, a, b, i, j = heappop(heap)
        x, y = (j, i) if spots[i][1] else (i, j)
        if not ids[i] or not ids[j] or after[i] != j or ids[x][0] != a or ids[y][0] != b:
            continue  # taken since, or no neighbours any more
        out.append((ids[x].popleft(), ids[y].popleft()))
        for k in (i, j):
            if not ids[k]:
                if before[k] >= 0:
                    after[before[k]] = after[k]
                if after[k] < n:
                    before[after[k]] = before[k]
        left, right = i if ids[i] else before[i], j if ids[j] else after[j]
        meet(left, right)
        if ids[i]:
            meet(before[i], i)
        if ids[j]:
            meet(j, after[j])
    return out


def injective_assignment(spark: SparkSession, d: str) -> DataFrame:
    """A user's purchases and signups of one day paired off, the nearest in time first, each used once."""
    e = events(spark, d).filter("event_type IN ('purchase', 'signup') AND us IS NOT NULL")
    e = e.select("user_id", F.floor(F.col("us") / 86_400_000_000).alias("day"), "us", (F.col("event_type") == "signup").cast("int").alias("side"), "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["user_id", "a", "b"])

        day, points, out = None, [], []
        for batch in batches:
            for user, of, *point in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (user, of) != day:
                    out += [(day[0], *p) for p in closest_first(points)] if len(points) > 1 else []
                    day, points = (user, of), []
                points.append(tuple(point))
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        out += [(day[0], *p) for p in closest_first(points)] if len(points) > 1 else []
        if out:
            yield batch_of(out)

    return dealt(e, "user_id", "day").sortWithinPartitions("user_id", "day").mapInArrow(run, "user_id long, a long, b long")


def stretch_search(spark: SparkSession, d: str) -> DataFrame:
    """The stretch, of three, under which an even user's landmarks (their time differences scaled and rounded) meet most of those of the next odd user, and at which offset."""
    h = landmark_hashes(spark, d)
    scale = F.explode(F.array(*(F.struct(F.lit(i).alias("stretch"), F.lit(s).alias("scale")) for i, s in enumerate((0.5, 1.0, 2.0))))).alias("s")
    mix = h.filter("user_id % 2 = 0").select(F.col("user_id").alias("mix"), "f1", "f2", "dt", "anchor", scale)
    mix = mix.select("mix", (F.col("mix") + 1).alias("user_id"), "f1", "f2", F.floor(F.col("dt") * F.col("s.scale") + 0.5).cast("long").alias("dt"), F.col("anchor").alias("a"), "s.stretch")
    ref = h.select("user_id", "f1", "f2", "dt", F.col("anchor").alias("b"))
    n = mix.join(ref, ["user_id", "f1", "f2", "dt"]).groupBy("mix", "stretch", (F.col("b") - F.col("a")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"))
    return picks.first_of(n, ["mix"], [F.desc("votes"), F.asc("stretch"), F.asc("offset")]).select("mix", "stretch", "offset", "votes")


def diagonals(hits: DataFrame, keys: list[str], offset: str, at: str, most: int = 6, tolerance: int = 1, gap: float = 48.0, competitive: float = 0.3) -> DataFrame:
    """keys, offset, votes, first, last, place: the offsets with most hits, none within the tolerance of one taken before it, each with the
    densest run of places of the hits within its tolerance (a gap above `gap` ends one; of equals the first).

    Offsets whose run has `competitive` of the most votes come first, by votes a unit of the run (0.1 at least), then the rest by votes; then by offset.
    """
    votes = hits.groupBy(*keys, offset).agg(F.count(F.lit(1)).alias("votes"))
    top = series.spaced(votes, keys, offset, "votes", tolerance, most).select(*keys, F.col(offset).alias("__top"))
    near = top.withColumn(offset, F.explode(F.sequence(F.col("__top") - tolerance, F.col("__top") + tolerance)))
    w = Window.partitionBy(*keys, "__top").orderBy(at)
    own = hits.join(near, [*keys, offset]).withColumn("__new", F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0)))
    own = own.withColumn("__run", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    runs = own.groupBy(*keys, F.col("__top").alias(offset), "__run").agg(F.count(F.lit(1)).alias("votes"), F.min(at).alias("first"), F.max(at).alias("last"))
    runs = picks.first_of(runs, [*keys, offset], [F.desc("votes"), F.asc("first")]).drop("__run")
    near_most = F.col("votes") >= competitive * F.max("votes").over(Window.partitionBy(*keys))
    density = F.when(F.col("__near"), F.col("votes") / F.greatest((F.col("last") - F.col("first")).cast("double"), F.lit(0.1)))
    order = Window.partitionBy(*keys).orderBy(F.desc("__near"), F.desc(density), F.desc("votes"), offset)
    return runs.withColumn("__near", near_most).withColumn("place", F.row_number().over(order)).drop("__near")


def top_diagonals(spark: SparkSession, d: str) -> DataFrame:
    """The six offsets at which the landmarks of an even user and the next odd one meet most, with the extents of their runs, the densest of those with enough votes first."""
    h = landmark_hashes(spark, d)
    mix = h.filter("user_id % 2 = 0").select(F.col("user_id").alias("mix"), (F.col("user_id") + 1).alias("user_id"), "f1", "f2", "dt", F.col("anchor").alias("a"))
    hits = mix.join(h.select("user_id", "f1", "f2", "dt", F.col("anchor").alias("b")), ["user_id", "f1", "f2", "dt"]).select("mix", (F.col("b") - F.col("a")).alias("offset"), "a")
    return diagonals(hits, ["mix"], "offset", "a").select("mix", "offset", "place", "votes", "first", "last")


def repeat_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of parts that share a name and a size or a brand and a price, however many steps apart: connected components."""
    p = table(spark, d, "part")
    keys = F.explode(F.array(F.concat_ws("|", F.lit("n"), "p_name", "p_size"), F.concat_ws("|", F.lit("b"), "p_brand", F.floor("p_retailprice").cast("string"))))
    rows = p.select("p_partkey", keys.alias("key"))
    first = rows.groupBy("key").agg(F.min("p_partkey").alias("first"))
    roots = graph.components(rows.join(first.hint("merge"), "key").filter("p_partkey != first").select("p_partkey", "first"), "p_partkey", "first")
    return p.select("p_partkey").join(roots.hint("merge"), F.col("p_partkey") == F.col("node"), "left").select("p_partkey", F.coalesce("root", "p_partkey").alias("class"))


def class_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    """How many members the class of each line's part has, and whether that leaves the line in doubt."""
    c = repeat_classes(spark, d)
    sizes = c.groupBy("class").agg(F.count(F.lit(1)).alias("members"))
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    own = line.join(c, "p_partkey").join(sizes, "class")
    return own.groupBy("members").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("members") > 1).alias("in_doubt"))


def memoryless_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Surprisal of each event's type under the running share of types seen so far by the user (half a count added to each of five)."""
    w = series.ordered(["user_id"], ["ts", "event_id"]).rowsBetween(Window.unboundedPreceding, -1)
    same = series.ordered(["user_id", "event_type"], ["ts", "event_id"]).rowsBetween(Window.unboundedPreceding, -1)
    p = (F.count(F.lit(1)).over(same) + 0.5) / (F.count(F.lit(1)).over(w) + 2.5)
    return table(spark, d, "events").select("event_id", F.round(-F.log(p), 6).alias("surprisal"))


def tempo_drift(spark: SparkSession, d: str) -> DataFrame:
    """Of each user's gaps: the median of the first and the last third, their ratio, and the spread of the middle half over the median."""
    g = series.with_gap(events(spark, d), ["user_id"], ["ts", "event_id"], F.col("us")).filter("gap IS NOT NULL AND gap > 0")
    third = F.ntile(3).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    g = g.withColumn("third", third)
    own = g.groupBy("user_id").agg(*(F.percentile(F.when(F.col("third") == k, F.col("gap")), F.lit(0.5)).alias(f"m{k}") for k in (1, 3)), *(F.percentile("gap", F.lit(q)).alias(n) for n, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))))
    return own.select("user_id", F.round(F.col("m3") / F.col("m1"), 5).alias("drift"), F.round((F.col("q3") - F.col("q1")) / F.col("q2"), 5).alias("spread"))


def phrase_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Places of clicks in the user's phrases of eight days from the first event: how many fall on each day of a phrase."""
    first = events(spark, d).groupBy("user_id").agg(F.min("us").alias("t0"))
    e = events(spark, d).filter("event_type = 'click'").join(first, "user_id")
    return e.groupBy(F.pmod(F.floor((F.col("us") - F.col("t0")) / 86_400_000_000), F.lit(8)).alias("place")).agg(F.count(F.lit(1)).alias("n"))


def gain_merge(spark: SparkSession, d: str) -> DataFrame:
    """A user's curve of values by the hour: of points that coincide the louder wins, in the order of time."""
    e = events(spark, d).groupBy("user_id", F.floor(F.col("us") / 3_600_000_000).alias("hour")).agg(F.max("value").alias("gain"))
    return e.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("hour")))


def coverage_split(spark: SparkSession, d: str) -> DataFrame:
    """Of each purchase span's seconds (their starts): those before the user's first or after the last end of click spans, and those within that an active click span covers."""
    s = spans(spark, d)
    bounds = s.filter("event_type = 'click'").groupBy("user_id").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    p = s.filter("event_type = 'purchase' AND hi > lo").join(bounds, "user_id", "left")
    n = F.ceil(F.col("hi") - F.col("lo")).cast("long")
    # Sampled seconds are lo + k for k below n, so counts outside follow from the bounds without making them.
    early = F.greatest(F.lit(0), F.least(n, F.ceil(F.col("first") - F.col("lo")).cast("long")))
    late = F.greatest(F.lit(0), F.least(n, n - 1 - F.floor(F.col("last") - F.col("lo")).cast("long")))
    out = F.when(F.col("first").isNull(), n).otherwise(F.least(n, early + late))
    return p.select("event_id", n.alias("n"), out.alias("outside"), (n - out).alias("inside"))


def span_class(spark: SparkSession, d: str) -> DataFrame:
    """What kind of span an order is: of a repeated part (loop), of several lines (multiseg), of an odd ratio of price to quantity, or linear."""
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("parts"), (F.sum("l_extendedprice") / F.sum("l_quantity") / 1500).alias("ratio"))
    kind = F.when(F.col("parts") < F.col("n"), "loop").when(F.col("n") > 1, "multiseg").when((F.col("ratio") < 0.9) | (F.col("ratio") > 1.15), "oddratio").otherwise("linear")
    return o.select("l_orderkey", kind.alias("class"))


def prior_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The 5 %, 50 % and 95 % points of values per type, as JSON."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.percentile("value", [0.05, 0.5, 0.95]).alias("p"))
    cents = lambda i: F.floor(F.col("p")[i] * 100 + 0.5).cast("long")
    return e.select("event_type", F.to_json(F.struct(cents(0).alias("p05"), cents(1).alias("p50"), cents(2).alias("p95"))).alias("prior"))


def vintage_spread(spark: SparkSession, d: str) -> DataFrame:
    """Seconds between the first and the last order of each status."""
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.floor((F.max(times.micros(F.col("o_orderdate"))) - F.min(times.micros(F.col("o_orderdate")))) / 1_000_000).alias("spread"))


def duration_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Lines judged by the ratio of price to list price times quantity, with the tax as similarity: ok within 0.90 to 1.15 or where similar enough,
    else by whether the part is a plain one (similarity of half is enough) or not (a weak sign)."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_size")
    x = table(spark, d, "lineitem").join(part, "l_partkey").withColumns({"ratio": F.col("l_extendedprice") / (F.col("l_quantity") * F.col("p_retailprice")), "sim": F.col("l_tax") * 12})
    within = F.col("ratio").between(0.90, 1.15)
    verdict = F.when(within, "ok").when(F.col("sim") >= 0.95, "ok_similar").when(F.col("p_size") > 25, "weak_signal").when(F.col("sim") >= 0.55, "ok_plain").otherwise("wrong")
    return x.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def title_kind(spark: SparkSession, d: str) -> DataFrame:
    """What a title says it is about: a person at a place (@), a pair ( - , with its spaces: a bare hyphen joins one name), or neither."""
    c = table(spark, d, "customer")
    title = F.concat("c_name", F.element_at(F.array(*map(F.lit, (" - ", "-", " @ ", "@", " "))), (F.col("c_custkey") % 5 + 1).cast("int")), "c_mktsegment")
    kind = F.when(F.contains(title, F.lit("@")), "person").when(F.contains(title, F.lit(" - ")), "pair").otherwise("plain")
    return c.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def part_mask(spark: SparkSession, d: str) -> DataFrame:
    """The types that a user is known by: those whose share is 0.15 at least and within 0.1 of the largest, in order."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id")
    n = n.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("top", F.max("share").over(w))
    kept = n.filter("share >= 0.15 AND share >= top - 0.1")
    return n.select("user_id").distinct().join(kept.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("event_type")), "+").alias("mask")), "user_id", "left")


def version_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Lines weighed by signals (long ship time, discount, tax, round quantity): a sum from 0.6 is a version, to 0.3 the original, between them unsure."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    late = F.datediff("l_shipdate", "o_orderdate") > 60
    x = table(spark, d, "lineitem").join(o, "l_orderkey")
    tenths = 4 * late.cast("int") + 3 * (F.col("l_discount") > 0.05).cast("int") + 2 * (F.col("l_tax") > 0.04).cast("int") + (F.col("l_quantity") % 10 == 0).cast("int")
    return x.groupBy(F.when(tenths >= 6, "version").when(tenths <= 3, "original").otherwise("unsure").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def slot_flags(spark: SparkSession, d: str) -> DataFrame:
    """Which orders are blocked by their status or only warned of by their priority."""
    o = table(spark, d, "orders")
    blocking, warning = F.col("o_orderstatus").isin("P"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return o.select("o_orderkey", blocking.cast("int").alias("blocking"), (warning & ~blocking).cast("int").alias("warning"))


def folded_words(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each document that lose a mark when Latin letters are folded to their bare forms, and that are tabs, returns or line ends."""
    marked, bare = "áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc"
    folded = F.translate(F.lower("text"), marked, bare)
    changed = F.length(F.translate(F.lower("text"), marked, "")).alias("rest")
    clean = F.trim(F.regexp_replace(folded, r"[\t\r\n ]+", " "))
    return table(spark, d, "documents").select("doc_id", (F.length("text") - changed).alias("marks"), F.length(clean).alias("clean"))


def order_keys(spark: SparkSession, d: str) -> DataFrame:
    """Labels such as 006w2 made of orders' keys and lines, and the pair of numbers that orders them (0 without a w)."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lpad((F.col("l_orderkey") % 1000).cast("string"), 3, "0"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit("w"), F.col("l_linenumber") - 1)).otherwise("")).alias("label"))
    return line.select("l_orderkey", "l_linenumber", F.regexp_extract("label", r"^(\d+)", 1).cast("int").alias("slot"), F.coalesce(F.nullif(F.regexp_extract("label", r"w(\d+)$", 1), F.lit("")).cast("int"), F.lit(0)).alias("w"))


def json_lists(spark: SparkSession, d: str) -> DataFrame:
    """JSON lists read as arrays: a conversation's roles, written in the order of turns and read again; what is no list gives null."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    raw = F.when(F.col("conv_id") % 7 == 0, "not a list").otherwise(F.to_json(F.col("t.role")))
    roles = F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"})
    return c.select("conv_id", F.when(raw.startswith("["), F.size(roles)).alias("n"), F.when(raw.startswith("["), F.get(roles, F.lit(0))).alias("first"))


def calibration_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Median absolute deviation of each source's places from the unit's median, beside the mean doubt it states, and whether a source that states less doubt errs more than this one."""
    v = votes(spark, d).filter("vote IS NOT NULL")
    middle = v.groupBy("unit").agg(F.percentile("at", F.lit(0.5)).alias("middle"))
    own = v.join(middle, "unit").groupBy("source").agg(F.percentile(F.abs(F.col("at") - F.col("middle")), F.lit(0.5)).alias("mad"), F.avg(1 - F.col("confidence")).alias("doubt"))
    a, b = own.alias("a"), F.broadcast(own.alias("b"))  # a row a source
    worse = a.join(b, (F.col("b.doubt") < F.col("a.doubt")) & (F.col("b.mad") > F.col("a.mad")), "left_semi").select("source", F.lit(1).alias("inverted"))
    return own.join(worse, "source", "left").select("source", F.round("mad", 6).alias("mad"), F.round("doubt", 6).alias("doubt"), F.coalesce("inverted", F.lit(0)).alias("inverted"))


def training_eligible(spark: SparkSession, d: str) -> DataFrame:
    """Votes that may teach: not of the unit's first source (its own view), not of a unit that a held-out user (id divisible by 5) owns, with a value, and where some other source could disagree."""
    v = votes(spark, d)
    first = picks.first_of(v, ["unit"], [F.asc("event_id")]).select("unit", "source")
    held = v.filter(F.split("unit", "/")[0].cast("long") % 5 == 0).select("unit").distinct()
    testable = v.filter("vote IS NOT NULL").groupBy("unit").agg(F.countDistinct("source").alias("n")).filter("n > 1").select("unit")
    return v.filter("vote IS NOT NULL").join(first, ["unit", "source"], "left_anti").join(held, "unit", "left_anti").join(testable, "unit", "left_semi").select("event_id")


def precision_gates(spark: SparkSession, d: str) -> DataFrame:
    """A click's precision of 1, halved where an error span of the user masks its time and divided by how often its value repeats among the user's clicks."""
    s = spans(spark, d)
    e = events(spark, d).filter("event_type = 'click'").select("event_id", "user_id", (F.col("us") / 1_000_000).alias("at"), F.floor("value").alias("v"))
    mask = s.filter("event_type = 'error' AND hi > lo").select("user_id", "lo", "hi")
    point = e.select("user_id", "event_id", F.col("at").alias("p_lo"), F.col("at").alias("p_hi"))
    hit = joins.interval_join(point, mask, ("p_lo", "p_hi"), ("lo", "hi"), 3600.0, ["user_id"]).filter("lo < p_lo AND p_lo < hi").select("event_id").distinct().withColumn("masked", F.lit(1))
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id", "v"))
    own = e.withColumn("repeats", n).join(hit, "event_id", "left")
    return own.select("event_id", F.round(F.when(F.col("masked") == 1, 0.5).otherwise(1.0) / F.col("repeats"), 6).alias("precision"))


def edge_guard(spark: SparkSession, d: str) -> DataFrame:
    """Proposed lineage edges (a nation's number to a region's and back) and why one is refused: to itself, or to a node that already descends from it."""
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    reach = graph.closure(n.unionByName(c), "child", "parent").select(F.col("node").alias("to"), F.col("ancestor").alias("from"), F.lit(1).alias("below"))
    asked = c.select(F.col("parent").alias("from"), F.col("child").alias("to")).unionByName(c.select(F.col("child").alias("from"), F.col("child").alias("to"))).unionByName(c.select(F.col("child").alias("from"), F.col("parent").alias("to")))
    why = F.when(F.col("from") == F.col("to"), "self").when(F.col("below") == 1, "cycle").otherwise("ok")
    return asked.join(reach, ["from", "to"], "left").groupBy(why.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def record_laws(spark: SparkSession, d: str) -> DataFrame:
    """Laws over the votes as records, with what was checked and who offends: a source is named, abstaining votes give a reason (a confidence below 0.5),
    confidences lie from 0 to 1, places are numbers, and each unit's id is no path beyond user and day."""
    v = votes(spark, d)
    laws = {"source_named": F.col("source").isNull() | (F.col("source") == ""), "abstain_reason": F.col("vote").isNull() & (F.col("confidence") >= 0.5), "confidence_range": ~F.col("confidence").between(0, 1), "place_number": F.col("at").isNull() | F.isnan("at"), "unit_id": ~F.col("unit").rlike(r"^\d+/\d+$")}
    one = v.agg(F.count(F.lit(1)).alias("checked"), *(F.count_if(broken).alias(name) for name, broken in laws.items()))
    return one.select("checked", F.explode(F.array(*(F.struct(F.lit(name).alias("law"), F.col(name).alias("offenders")) for name in laws))).alias("x")).select("x.law", "checked", "x.offenders")


def correction_ledger(spark: SparkSession, d: str) -> DataFrame:
    """An append-only ledger of value corrections (each event against the user's one before): what breaks its checks, and the value that stands."""
    w = series.ordered(["user_id"], ["ts", "event_id"])
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "value", F.lag("value").over(w).alias("old"))
    bad = F.col("old").isNull() | (F.col("old") == F.col("value")) | (F.col("value") <= 0)
    stands = picks.first_of(e.filter(~bad), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", F.col("value").alias("stands"))
    return e.groupBy("user_id").agg(F.count_if(bad).alias("refused"), F.count_if(~bad).alias("kept")).join(stands, "user_id", "left")


def chunked_union(spark: SparkSession, d: str) -> DataFrame:
    """Landmarks taken in chunks of five days that overlap by one and merged as a set: as many as without chunks."""
    h = landmark_hashes(spark, d)
    cell = F.floor(F.col("anchor") / 120)
    cells = F.when(F.col("anchor") % 120 < 24, F.array(cell - 1, cell)).otherwise(F.array(cell))
    chunks = h.select("user_id", "f1", "f2", "dt", "anchor", F.explode(cells).alias("chunk"))
    return chunks.select("user_id", "f1", "f2", "dt", "anchor").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def merged_segments(spark: SparkSession, d: str) -> DataFrame:
    """Loops of lines: a run of lines of an order with the same part as one segment with how often it repeats."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")
    line = dealt_by_rows(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_orderkey")
    line = line.withColumn("new", F.coalesce((F.col("l_suppkey") != F.lag("l_suppkey").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    return line.groupBy("l_orderkey", "run").agg(F.first("l_suppkey").alias("l_suppkey"), F.count(F.lit(1)).alias("times"), F.min("l_linenumber").alias("first"))


def expanded_segments(spark: SparkSession, d: str) -> DataFrame:
    """The segments of merged_segments, each repeat a row again: its number within the segment and its place in the order."""
    runs = merged_segments(spark, d)
    before = F.sum("times").over(Window.partitionBy("l_orderkey").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    each = runs.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return each.select("l_orderkey", (F.col("before") + F.col("repeat")).alias("place"), "l_suppkey", "repeat")


QUERIES = {f.__name__: f for f in (composite_anti, scoped_using_join, id_links, identity_bridge, name_containment, compatible_pairs, two_level_max, rank_correlation, coverage_score, dense_competitive, top_fraction_mean, axis_union, hypothesis_space, corroborated, tolerance_matches, tolerance_scores, injective_assignment, stretch_search, top_diagonals, repeat_classes, class_ambiguity, memoryless_baseline, tempo_drift, phrase_offsets, gain_merge, coverage_split, span_class, prior_percentiles, vintage_spread, duration_verdict, title_kind, part_mask, version_verdict, slot_flags, folded_words, order_keys, json_lists, calibration_residuals, training_eligible, precision_gates, edge_guard, record_laws, correction_ledger, chunked_union, merged_segments, expanded_segments)}

_HITS = f"{_LM}, x AS (SELECT m.user_id AS mix, r.anchor - m.anchor AS \"offset\", m.anchor AS a FROM h m JOIN h r ON r.user_id = m.user_id + 1 AND m.f1 = r.f1 AND m.f2 = r.f2 AND m.dt = r.dt WHERE m.user_id % 2 = 0)"
ORACLES = {
    "composite_anti": "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey) GROUP BY 1, 2",
    "scoped_using_join": "SELECT key, count(*) AS n, sum(l_quantity) AS quantity FROM (SELECT o_orderkey AS key FROM orders WHERE o_orderpriority ILIKE '%urgent%') JOIN (SELECT l_orderkey AS key, l_quantity FROM lineitem) USING (key) GROUP BY 1",
    "id_links": r"""WITH a AS (SELECT page_id AS source, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS section FROM pages), t AS (SELECT regexp_extract(url, '://[^/]*(/[^/?#]+)/', 1) AS section, min(page_id) AS target FROM pages GROUP BY 1) SELECT source, target FROM a JOIN t USING (section) WHERE section <> '' AND source <> target""",
    "identity_bridge": "SELECT doc_id, CASE WHEN n > 1 AND text IS NOT NULL THEN least0 ELSE doc_id END AS canonical, (n > 1 AND text IS NOT NULL)::INT AS bridged FROM (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS least0, count(*) OVER (PARTITION BY text) AS n FROM documents)",
    "name_containment": "WITH i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w FROM documents), s AS (SELECT item_id, count(*) AS size FROM i GROUP BY 1) SELECT doc_id, item_id, any_value(size) AS words FROM d JOIN i USING (w) JOIN s USING (item_id) GROUP BY 1, 2 HAVING count(*) = any_value(size)",
    "compatible_pairs": "WITH s AS (SELECT s_suppkey, s_acctbal, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0) SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM s a JOIN s b ON a.n_regionkey = b.n_regionkey AND a.s_suppkey < b.s_suppkey AND greatest(a.s_acctbal, b.s_acctbal) <= 1.05 * least(a.s_acctbal, b.s_acctbal) WHERE least((b.s_suppkey - a.s_suppkey) % 12, 12 - (b.s_suppkey - a.s_suppkey) % 12) <= 1",
    "two_level_max": "SELECT p_partkey, t AS line_top, CASE WHEN t IS NULL THEN p_retailprice ELSE greatest(p_retailprice, t) END AS top FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS t FROM lineitem GROUP BY 1) ON l_partkey = p_partkey",
    "rank_correlation": "WITH r AS (SELECT l_suppkey, l_quantity AS x, l_discount AS y, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2 AS rx, rank() OVER (PARTITION BY l_suppkey ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_suppkey, l_discount) - 1) / 2 AS ry FROM lineitem) SELECT l_suppkey, round(corr(rx, ry), 5) AS spearman, round(corr(x, y), 5) AS pearson FROM r GROUP BY 1",
    "coverage_score": "WITH o AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, CASE WHEN o_totalprice > 50000 THEN floor(o_totalprice / 100000) END AS b, (o_orderkey % 3 = 0)::INT::DOUBLE AS got FROM orders), c AS (SELECT *, avg(got) OVER (PARTITION BY s) AS c1, avg(got) OVER (PARTITION BY p) AS c2, avg(got) OVER (PARTITION BY b) AS c3, avg(got) OVER (PARTITION BY s, p, b) AS c4, count(*) OVER (PARTITION BY s, p, b) AS cell FROM o) SELECT o_orderkey, round(CASE WHEN b IS NULL THEN (2 - c1 - c2) / 2 ELSE (3 - c1 - c2 - c3) / 3 END + CASE WHEN cell >= 8 THEN 1 - c4 ELSE 0 END, 4) AS weight FROM c",
    "dense_competitive": f"WITH {_BORDA}, l AS (SELECT l_partkey, l_suppkey, greatest((epoch_us(max(l_shipdate)) - epoch_us(min(l_shipdate))) / 86400000000, 0.1) AS days FROM lineitem GROUP BY 1, 2), m AS (SELECT l_partkey, l_suppkey, points, days, points >= 0.3 * max(points) OVER (PARTITION BY l_partkey) AS near FROM c JOIN l USING (l_partkey, l_suppkey)) SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY near DESC, CASE WHEN near THEN points / days END DESC NULLS LAST, points DESC, l_suppkey)::INT AS place FROM m",
    "top_fraction_mean": "WITH r AS (SELECT user_id, value, count(value) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS place FROM events) SELECT user_id, round(avg(value), 6) AS score FROM r WHERE place <= CASE WHEN n > 20 THEN greatest(1, round(n * 0.2)) ELSE n END GROUP BY 1",
    "axis_union": "SELECT lang AS axis FROM documents UNION SELECT source FROM documents",
    "hypothesis_space": f"WITH {_V}, x AS (SELECT DISTINCT unit, vote, round_even(at0 / 2, 0)::INT AS bin FROM v WHERE vote IS NOT NULL UNION ALL SELECT DISTINCT unit, NULL, 0 FROM v) SELECT unit, vote, bin, row_number() OVER (PARTITION BY unit ORDER BY vote NULLS FIRST, bin)::INT - 1 AS place FROM x",
    "corroborated": f"WITH {_SPANS}, t AS (SELECT s.*, value, (0.9 + 0.1 * (event_id % 3)) / 60 AS slope FROM s JOIN events USING (event_id)), m AS (SELECT * FROM t WHERE event_type = 'view'), o AS (SELECT * FROM t WHERE event_type IN ('click', 'signup', 'error')), p AS (SELECT m.event_id, o.event_type, least(o.hi, m.hi) - greatest(o.lo, m.lo) AS overlap, greatest(o.lo, m.lo) + (least(o.hi, m.hi) - greatest(o.lo, m.lo)) / 2 AS mid, m.value AS mv, m.lo AS ml, m.slope AS ms, o.value AS ov, o.lo AS ol, o.slope AS os FROM m JOIN o ON o.user_id = m.user_id AND o.value >= 30 AND m.lo < o.hi AND o.lo < m.hi), g AS (SELECT event_id, count(DISTINCT event_type) AS n FROM p WHERE overlap >= 2 AND abs(mv + (mid - ml) * ms - (ov + (mid - ol) * os)) <= 50 GROUP BY 1), x AS (SELECT m.event_id, coalesce(n, 0) AS agree, (SELECT count(DISTINCT event_type) FROM o WHERE o.user_id = m.user_id) AS there FROM m LEFT JOIN g USING (event_id)) SELECT event_id, agree, there - agree AS against, round(greatest(0.0, least(1.0, 0.5 + 0.2 * agree - 0.2 * (there - agree))), 6) AS confidence FROM x",
    "stretch_search": f"WITH {_LM}, m AS (SELECT user_id AS mix, f1, f2, floor(dt * scale + 0.5)::BIGINT AS dt, anchor AS a, stretch FROM h, (VALUES (0, 0.5), (1, 1.0), (2, 2.0)) AS z(stretch, scale) WHERE user_id % 2 = 0), n AS (SELECT mix, stretch, r.anchor - a AS \"offset\", count(*) AS votes FROM m JOIN h r ON r.user_id = mix + 1 AND m.f1 = r.f1 AND m.f2 = r.f2 AND m.dt = r.dt GROUP BY 1, 2, 3) SELECT mix, stretch, \"offset\", votes FROM n QUALIFY row_number() OVER (PARTITION BY mix ORDER BY votes DESC, stretch, \"offset\") = 1",
    "top_diagonals": f"WITH RECURSIVE {_HITS}, v AS (SELECT mix, \"offset\" AS o, row_number() OVER (PARTITION BY mix ORDER BY count(*) DESC, \"offset\") AS i FROM x GROUP BY 1, 2), k AS (SELECT mix, 1::BIGINT AS i, [o] AS got FROM v WHERE i = 1 UNION ALL SELECT v.mix, v.i, CASE WHEN len(list_filter(got, lambda g: abs(g - o) <= 1)) = 0 THEN list_append(got, o) ELSE got END FROM k JOIN v ON v.mix = k.mix AND v.i = k.i + 1 WHERE len(got) < 6), t AS (SELECT mix, unnest(arg_max(got, i)) AS o FROM k GROUP BY 1), w AS (SELECT t.mix, o, a, coalesce((a - lag(a) OVER (PARTITION BY t.mix, o ORDER BY a) > 48)::INT, 0) AS fresh FROM t JOIN x ON x.mix = t.mix AND abs(x.\"offset\" - o) <= 1), r AS (SELECT *, sum(fresh) OVER (PARTITION BY mix, o ORDER BY a) AS run FROM w), g AS (SELECT mix, o, run, count(*) AS votes, min(a) AS first, max(a) AS last FROM r GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY mix, o ORDER BY votes DESC, first) = 1), f AS (SELECT *, votes >= 0.3 * max(votes) OVER (PARTITION BY mix) AS near FROM g) SELECT mix, o AS \"offset\", row_number() OVER (PARTITION BY mix ORDER BY near DESC, CASE WHEN near THEN votes / greatest(last - first, 0.1) END DESC NULLS LAST, votes DESC, o)::INT AS place, votes, first, last FROM f",
    "memoryless_baseline": "SELECT event_id, round(-ln((count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.5) / (count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2.5)), 6) AS surprisal FROM events",
    "tempo_drift": f"WITH {_E}, g AS (SELECT user_id, ts, event_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM e), t AS (SELECT *, ntile(3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS third FROM g WHERE gap > 0) SELECT user_id, round(median(gap) FILTER (third = 3) / median(gap) FILTER (third = 1), 5) AS drift, round((quantile_cont(gap, 0.75) - quantile_cont(gap, 0.25)) / median(gap), 5) AS spread FROM t GROUP BY 1",
    "phrase_offsets": f"WITH {_E}, f AS (SELECT *, min(us) OVER (PARTITION BY user_id) AS t0 FROM e) SELECT ((us - t0) // 86400000000) % 8 AS place, count(*) AS n FROM f WHERE event_type = 'click' GROUP BY 1",
    "gain_merge": f"WITH {_E} SELECT user_id, us // 3600000000 AS hour, max(value) AS gain, row_number() OVER (PARTITION BY user_id ORDER BY us // 3600000000)::INT AS place FROM e GROUP BY 1, 2",
    "coverage_split": f"WITH {_SPANS}, b AS (SELECT user_id, min(lo) AS f, max(hi) AS l FROM s WHERE event_type = 'click' GROUP BY 1), p AS (SELECT event_id, lo, ceil(hi - lo)::BIGINT AS n, f, l FROM s LEFT JOIN b USING (user_id) WHERE event_type = 'purchase' AND hi > lo), x AS (SELECT event_id, n, CASE WHEN f IS NULL THEN n ELSE (SELECT count(*) FROM range(n) AS r(k) WHERE k < f - lo OR k > l - lo) END AS outside FROM p) SELECT event_id, n, outside, n - outside AS inside FROM x",
    "span_class": "WITH o AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, sum(l_extendedprice) / sum(l_quantity) / 1500 AS ratio FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN parts < n THEN 'loop' WHEN n > 1 THEN 'multiseg' WHEN ratio < 0.9 OR ratio > 1.15 THEN 'oddratio' ELSE 'linear' END AS class FROM o",
    "prior_percentiles": "SELECT event_type, '{\"p05\":' || floor(quantile_cont(value, 0.05) * 100 + 0.5)::BIGINT || ',\"p50\":' || floor(quantile_cont(value, 0.5) * 100 + 0.5)::BIGINT || ',\"p95\":' || floor(quantile_cont(value, 0.95) * 100 + 0.5)::BIGINT || '}' AS prior FROM events GROUP BY 1",
    "vintage_spread": "SELECT o_orderstatus, (epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) // 1000000 AS spread FROM orders GROUP BY 1",
    "duration_verdict": "SELECT CASE WHEN ratio BETWEEN 0.9 AND 1.15 THEN 'ok' WHEN sim >= 0.95 THEN 'ok_similar' WHEN p_size > 25 THEN 'weak_signal' WHEN sim >= 0.55 THEN 'ok_plain' ELSE 'wrong' END AS verdict, count(*) AS n FROM (SELECT l_extendedprice / (l_quantity * p_retailprice) AS ratio, l_tax * 12 AS sim, p_size FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1",
    "title_kind": "WITH t AS (SELECT c_name || [' - ', '-', ' @ ', '@', ' '][(c_custkey % 5 + 1)::INT] || c_mktsegment AS t FROM customer) SELECT CASE WHEN t LIKE '%@%' THEN 'person' WHEN t LIKE '% - %' THEN 'pair' ELSE 'plain' END AS kind, count(*) AS n FROM t GROUP BY 1",
    "part_mask": "WITH n AS (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS share FROM events GROUP BY 1, 2), t AS (SELECT *, max(share) OVER (PARTITION BY user_id) AS top FROM n) SELECT user_id, string_agg(event_type, '+' ORDER BY event_type) FILTER (share >= 0.15 AND share >= top - 0.1) AS mask FROM t GROUP BY 1",
    "version_verdict": "SELECT CASE WHEN t >= 6 THEN 'version' WHEN t <= 3 THEN 'original' ELSE 'unsure' END AS verdict, count(*) AS n FROM (SELECT 4 * (l_shipdate::DATE - o_orderdate::DATE > 60)::INT + 3 * (l_discount > 0.05)::INT + 2 * (l_tax > 0.04)::INT + (l_quantity % 10 = 0)::INT AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1",
    "slot_flags": "SELECT o_orderkey, (o_orderstatus = 'P')::INT AS blocking, (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P')::INT AS warning FROM orders",
    "folded_words": r"SELECT doc_id, (len(text) - len(regexp_replace(lower(text), '[áàâäãåéèêëíìîïóòôöõúùûüñç]', '', 'g')))::INT AS marks, len(trim(regexp_replace(lower(text), '[\t\r\n ]+', ' ', 'g')))::INT AS clean FROM documents",
    "order_keys": "SELECT l_orderkey, l_linenumber, (l_orderkey % 1000)::INT AS slot, (l_linenumber - 1)::INT AS w FROM lineitem",
    "json_lists": "WITH c AS (SELECT conv_id, list(role ORDER BY turn, role) AS roles FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN conv_id % 7 <> 0 THEN len(roles) END AS n, CASE WHEN conv_id % 7 <> 0 THEN roles[1] END AS first FROM c",
    "calibration_residuals": f"WITH {_V}, m AS (SELECT *, median(at0) OVER (PARTITION BY unit) AS middle FROM v WHERE vote IS NOT NULL), o AS (SELECT source, median(abs(at0 - middle)) AS mad, avg(1 - confidence) AS doubt FROM m GROUP BY 1) SELECT source, round(mad, 6) AS mad, round(doubt, 6) AS doubt, (EXISTS (SELECT 1 FROM o b WHERE b.doubt < o.doubt AND b.mad > o.mad))::INT AS inverted FROM o",
    "training_eligible": f"WITH {_V}, f AS (SELECT unit, source FROM v QUALIFY row_number() OVER (PARTITION BY unit ORDER BY event_id) = 1), t AS (SELECT unit FROM v WHERE vote IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1) SELECT event_id FROM v WHERE vote IS NOT NULL AND user_id % 5 <> 0 AND unit IN (SELECT unit FROM t) AND NOT EXISTS (SELECT 1 FROM f WHERE f.unit = v.unit AND f.source = v.source)",
    "precision_gates": f"WITH {_SPANS}, c AS (SELECT s.*, floor(value) AS k, count(*) OVER (PARTITION BY s.user_id, floor(value)) AS repeats FROM s JOIN events USING (event_id) WHERE s.event_type = 'click') SELECT event_id, round(CASE WHEN EXISTS (SELECT 1 FROM s b WHERE b.event_type = 'error' AND b.user_id = c.user_id AND b.lo < c.lo AND c.lo < b.hi) THEN 0.5 ELSE 1.0 END / repeats, 6) AS precision FROM c",
    "edge_guard": "SELECT v AS verdict, n FROM (SELECT 'cycle' AS v, count(*) AS n FROM customer UNION ALL SELECT 'self', count(*) FROM customer UNION ALL SELECT 'ok', count(*) FROM customer)",
    "record_laws": f"WITH {_V}, c AS (SELECT count(*) AS checked FROM v) SELECT law, checked, offenders FROM c, (SELECT 'source_named' AS law, count(*) FILTER (source IS NULL OR source = '') AS offenders FROM v UNION ALL SELECT 'abstain_reason', count(*) FILTER (vote IS NULL AND confidence >= 0.5) FROM v UNION ALL SELECT 'confidence_range', count(*) FILTER (confidence NOT BETWEEN 0 AND 1) FROM v UNION ALL SELECT 'place_number', count(*) FILTER (at0 IS NULL OR isnan(at0)) FROM v UNION ALL SELECT 'unit_id', count(*) FILTER (NOT regexp_matches(unit, '^[0-9]+/[0-9]+$')) FROM v)",
    "correction_ledger": "WITH e AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events), b AS (SELECT *, coalesce(old IS NULL OR old = value OR value <= 0, false) AS bad FROM e) SELECT user_id, count(*) FILTER (bad) AS refused, count(*) FILTER (NOT bad) AS kept, arg_max(value, (ts, event_id)) FILTER (NOT bad) AS stands FROM b GROUP BY 1",
    "chunked_union": f"WITH {_LM} SELECT user_id, count(DISTINCT (f1, f2, dt, anchor)) AS n FROM h GROUP BY 1",
    "expanded_segments": "WITH a AS (SELECT *, coalesce((l_suppkey <> lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey))::INT, 1) AS fresh FROM lineitem), b AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS run FROM a) SELECT l_orderkey, place, l_suppkey, place - min(place) OVER (PARTITION BY l_orderkey, run) + 1 AS repeat FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, run) AS place FROM b)",
    "merged_segments": "WITH a AS (SELECT *, coalesce((l_suppkey <> lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey))::INT, 1) AS fresh FROM lineitem), b AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS run FROM a) SELECT l_orderkey, run::BIGINT AS run, any_value(l_suppkey) AS l_suppkey, count(*) AS times, min(l_linenumber) AS first FROM b GROUP BY 1, 2",
}
