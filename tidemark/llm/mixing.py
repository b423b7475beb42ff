"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, which starts over
when it ends. A document's copy has a virtual finish time: the words of its
source up to and with it, over the source's target. All copies are put in the
order of these times and cut off where the total budget ends, so each source
gets its share at every moment of the mix, not at the end alone.

Where the budget ends is found by sums over bins of virtual time, finer bins
within the one that it cuts, and an order of the rows in the last; the mixed
documents are range-sorted by their times.

Defined results: a null text is of size 0; documents of size 0 take 0 words; a
null source is a source of its own, the last; repeated rows count each; equal
times are in the shuffled order of the ids; very long texts count whole; an
empty table gives an empty mix; columns besides the named ones, whatever their
names, play no part and stay with their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import fresh, running_total, shuffle_key, stash, word_count

WEIGHTS = (5, 2, 1)
EPOCHS = 3
BINS = 4096
"""Bins of a unit of virtual time, and finer ones of the bin that the budget cuts: about one row in BINS squared is ordered in one task."""


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size -> also target: the share of all sizes by weight, at most epochs times the size.

    What a capped source leaves is shared by weight among the others until none
    is above its cap. That level is found by one sort: with sources ordered by
    cap per weight, the level with the first k capped is (total - their caps) /
    (weights of the others), and the right one is the largest of these.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight.cast("long"), "cap": F.lit(epochs) * F.col("source_size")})
    earlier = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    leveled = ranked.withColumn("level", rest.cast("double") / open_weight.cast("double"))
    leveled = leveled.withColumn("level", F.max("level").over(everything))
    return leveled.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (times the mix takes it), taken (words)."""
    out = _planned(docs, doc_id, source, word_count(F.col("text")) if size is None else size, F.lit(0), weights, epochs)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _planned(docs: DataFrame, doc_id: str, source: str, size: Column, tie: Column, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """One row per document: also tie, key (the shuffled order) and times (the finish time of each copy, taken or not)."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.cast("long").alias("size"), shuffle_key(F.col(doc_id)).alias("key"), tie.alias("tie"))
    slim = stash(slim, "sizes")
    sources = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    queued = running_total(slim, ["source"], "key", ["doc_id", "size"], F.col("size"), "served")
    sources = sources.withColumnRenamed("source", "__source")
    queued = queued.join(sources, queued["source"].eqNullSafe(sources["__source"])).drop("__source")
    times = [F.when(F.col("target") > 0, (F.lit(e) * F.col("source_size") + F.col("served")).cast("double") / F.col("target")) for e in range(epochs)]
    queued = stash(queued.withColumn("times", F.array(*times)), "queues")

    edge = queued.filter("size > 0").select("doc_id", "key", "size", "served", F.posexplode("times").alias("epoch", "at")).filter("at IS NOT NULL")
    types, left, bins = dict(edge.dtypes), queued.agg(F.sum("size")).first()[0] or 0, BINS
    taken_times = F.size("times")
    for bins in (BINS, BINS**2):
        span = edge.groupBy(F.floor(F.col("at") * bins).alias("bin")).agg(F.sum("size").alias("sum"))
        over = span.withColumn("upto", F.sum("sum").over(Window.orderBy("bin"))).filter(F.col("upto") > left).orderBy("bin").limit(1).collect()
        if not over:
            break
        (cut,) = over
        edge, left = edge.filter(F.floor(F.col("at") * bins) == cut["bin"]), left - (cut["upto"] - cut["sum"])
    else:
        order = ["at", "key", "doc_id", "served", "epoch"]
        edge = edge.withColumn("upto", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        last = edge.filter(F.col("upto") <= left).orderBy(*(F.desc(c) for c in order)).limit(1).collect()
        if last:
            (row,) = last
            bound = F.struct(*(F.lit(row[c]).cast(types[c]).alias(c) for c in order))
            fits = lambda at, e: F.struct(at.alias("at"), F.col("key"), F.col("doc_id"), F.col("served"), e.alias("epoch")) <= bound
        else:
            fits = lambda at, e: F.floor(at * bins) < cut["bin"]
        taken_times = F.aggregate(F.transform("times", lambda at, e: F.coalesce(fits(at, e), F.lit(False)).cast("int")), F.lit(0), lambda a, b: a + b)
    taken_times = F.when((F.col("size") > 0) & (F.col("target") > 0), taken_times).otherwise(F.lit(0))
    return queued.withColumn("copies", taken_times.cast("int"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, finish: str | None = None) -> DataFrame:
    """The documents that the mix takes, each as many times as it takes it, with their own columns, in the order of the mix.

    finish: the name of a column to add for the virtual finish time, which tells the order where rows are written and read again.
    """
    names = ["id", "source", "size", "tie", "n", "copies", "times", "key", "twin", "copy"]
    of = dict(zip(names, (fresh([*docs.columns, finish or ""], c) for c in names), strict=True))
    same = [of[c] for c in ("id", "source", "size", "tie")]
    plan = _planned(docs, doc_id, source, word_count(F.col("text")), F.xxhash64("text"), weights, epochs).filter("copies > 0")
    plan = plan.select(*(F.col(c).alias(of[k]) for k, c in {"id": "doc_id", "source": "source", "size": "size", "tie": "tie", "copies": "copies", "times": "times", "key": "key"}.items()))
    taken = F.struct(of["copies"], of["times"], of["key"])
    # Rows that repeat with id and text share one line of the plan here and are told apart below; they alone need a window.
    lines = plan.groupBy(*same).agg(F.count(F.lit(1)).alias(of["n"]), F.max(taken).alias("taken")).select(*same, of["n"], "taken.*")
    own = [F.col(doc_id), F.col(source), word_count(F.col("text")), F.xxhash64("text")]
    on = own[0].eqNullSafe(F.col(same[0])) & own[1].eqNullSafe(F.col(same[1])) & (own[2] == F.col(same[2])) & (own[3] == F.col(same[3]))
    rows = docs.join(lines, on)
    twins = plan.withColumn(of["twin"], F.row_number().over(Window.partitionBy(*same).orderBy(of["times"])))
    several = rows.filter(F.col(of["n"]) > 1).drop(of["copies"], of["times"], of["key"])
    several = several.withColumn(of["twin"], F.row_number().over(Window.partitionBy(*same).orderBy(same[0])))
    a, b = several.alias("a"), twins.alias("b")
    on = F.col(f"a.{of['twin']}") == F.col(f"b.{of['twin']}")
    for c in same:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    columns = [*docs.columns, *(of[c] for c in ("copies", "times", "key"))]
    several = a.join(b, on).select(*(F.col(f"a.`{c}`") for c in docs.columns), *(F.col(f"b.{of[c]}") for c in ("copies", "times", "key")))
    rows = rows.filter(F.col(of["n"]) == 1).select(*(F.col(f"`{c}`") for c in columns)).unionByName(several)
    at = finish or of["copy"]
    rows = rows.select(*(F.col(f"`{c}`") for c in docs.columns if c != finish), of["key"], F.explode(F.slice(of["times"], F.lit(1), F.col(of["copies"]))).alias(at))
    return rows.orderBy(at, of["key"]).drop(of["key"], *([] if finish else [at]))
