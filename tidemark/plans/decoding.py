"""Decoders over the driver's tables: directional paths, stretches, ordered choices, covers and classes of repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import classes, decoders, mixtures, observers, series
from ..operators.streams import dealt_by_rows
from ..sources.tables import table, written
from .evidence import votes
from .timeline import events

KEY = ["user_id"]
HOUR = 3_600_000_000


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """Events with their day from 0, hour, and the number k in their properties."""
    first = F.lit(1_704_067_200_000_000)  # 2024-01-01
    hours = (F.col("us") - first) / HOUR
    k = F.get_json_object("props", "$.k").cast("int")
    return events(spark, d).select("event_id", "user_id", "event_type", "value", k.alias("k"), F.floor(hours / 24).cast("int").alias("day"), hours.alias("hour"))


def directional_decode(spark: SparkSession, d: str) -> DataFrame:
    """The tenth of k that each user is in on each day, by the values there: going up costs 20 and 2 a tenth, going down 60 and 5 a tenth."""
    e = _placed(spark, d).groupBy("user_id", "day", F.floor(F.col("k") / 10).cast("int").alias("tenth")).agg(F.sum("value").alias("score"))
    path = decoders.directional_path(e, KEY, "day", "tenth", "score", 20.0, 60.0, 2.0, 5.0)
    return path.select("user_id", "day", F.col("tenth").cast("int").alias("tenth"), F.round("total", 4).alias("total"))


def stretch_segments(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of the line that each user's k follows over the days, of three slopes the one that explains most; a place is that of day 0 to the next multiple of eight."""
    slope = F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0)))).alias("slope")
    e = _placed(spark, d).select("user_id", "day", "k", "value", slope)
    e = e.groupBy("user_id", "day", "slope", (F.round((F.col("k") - F.col("day") * F.col("slope")) / 8) * 8).alias("place")).agg(F.sum("value").alias("score"))
    found = decoders.path_segments(e.withColumn("end", F.lit(31.0)), KEY, "slope", "day", "place", "score", "end", forward=15.0, backward=30.0, forward_slope=0.1, backward_slope=0.4)
    return found.select("user_id", "mix_start", "ref_start", "ref_end", "slope", F.round("total", 4).alias("total"))


def monotone_decode(spark: SparkSession, d: str) -> DataFrame:
    """An hour or none for each user's day from its events, in order: at most five hours back, weighed by the distance from the day's middle on the user's own pace."""
    e = _placed(spark, d)
    pace = e.groupBy("user_id").agg(F.avg(F.col("hour") - 24 * F.col("day")).alias("pace"))
    own = e.join(pace, "user_id").select("user_id", "day", F.round(F.col("hour") + F.col("k") - 50, 3).alias("place"), (F.col("value") / 100).alias("score"), (24 * F.col("day") + F.col("pace")).alias("expected"))
    path = decoders.monotone_choice(own, KEY, "day", "place", "score", F.col("expected"), sigma=40.0)
    return path.select("user_id", "day", "place", F.round("total", 4).alias("total"))


def cover_segments(spark: SparkSession, d: str) -> DataFrame:
    """Times in which one of the three most common tens of k explains each user's events, and times that nothing explains."""
    e = _placed(spark, d)
    points = written(e.select("user_id", (F.col("hour") / 8).alias("at"), (F.col("k") / 2).alias("offset"), F.lit(1.0).alias("weight"), F.lit(93.0).alias("span")))
    bins = points.groupBy("user_id", F.floor(F.col("offset") / 2).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.percentile("offset", F.lit(0.5)).alias("intercept"))
    top = bins.withColumn("line", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "bin")) - 1).filter("line < 3")
    found = decoders.segment_cover(points, top.select("user_id", "line", "intercept"), KEY, "span", F.lit(0.0))
    return found.select("user_id", "run", "line", "at", "until", F.round("ref_at", 4).alias("ref_at"), F.round("evidence", 4).alias("evidence"))


ALIKE = ["user_id", "event_type"]


def _alike(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of events of one type at most five apart in a user's order, by how near their values are."""
    order = series.ordered(ALIKE, ["us", "event_id"])
    before = F.array_compact(F.array(*(F.lag(F.struct("event_id", "value"), i).over(order) for i in range(1, 6))))
    e = dealt_by_rows(events(spark, d).select(*ALIKE, "us", "event_id", "value"), *ALIKE).withColumn("before", before).select(*ALIKE, "event_id", "value", F.explode("before").alias("b"))
    return e.select(*ALIKE, F.col("b.event_id").alias("a"), F.col("event_id").alias("b"), (1 / (1 + F.abs(F.col("value") - F.col("b.value")) / 20)).alias("similarity"))


def average_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of a user's repeats by average linkage at one half, and each one's mean likeness to its mates."""
    found = classes.average_linkage(_alike(spark, d), "a", "b", "similarity", 0.5, ALIKE)
    return found.select(F.col("node").alias("event_id"), "class", F.round("mates", 6).alias("mates"))


def placement_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    """Whether each purchase falls into a stretch of its user (an event of another type, as many minutes as its value) whose class has others."""
    e = events(spark, d).withColumn("at", F.col("us") / 60_000_000)
    found = classes.average_linkage(_alike(spark, d), "a", "b", "similarity", 0.5, ALIKE)
    sections = e.filter("event_type != 'purchase'").join(found, F.col("event_id") == F.col("node")).select("user_id", F.col("at").alias("lo"), (F.col("at") + F.col("value")).alias("hi"), "class", "mates")
    told = classes.placed_ambiguity(e.filter("event_type = 'purchase'").select("event_id", "user_id", "at"), sections, KEY, "at", "lo", "hi", 4.0, 120.0)
    return told.select("event_id", "class", "instances", F.round("membership", 6).alias("membership"), "ambiguous")


def fused_placements(spark: SparkSession, d: str) -> DataFrame:
    """Each unit's value and place fused from its votes by the continuous mixture, after three steps."""
    found, _ = mixtures.continuous_fusion(votes(spark, d), "unit", "source", "vote", "at", rounds=3, tolerance=0.0)
    return found.select("unit", "vote", F.round("at", 4).alias("at"), F.round("posterior", 5).alias("posterior"), "n")


def fused_noise(spark: SparkSession, d: str) -> DataFrame:
    """What the mixture learns of each source in three steps: accuracy, spread and share of inliers."""
    _, noise = mixtures.continuous_fusion(votes(spark, d), "unit", "source", "vote", "at", rounds=3, tolerance=0.0)
    return noise.select("source", *(F.round(c, 5).alias(c) for c in ("accuracy", "sigma", "inlier")))


TYPES = ("click", "view", "purchase", "signup", "error")


def markov_readouts(spark: SparkSession, d: str) -> DataFrame:
    """Everything an adaptive Markov chain with decaying counts tells at each of a user's events."""
    symbol = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1
    found = observers.adaptive_markov(events(spark, d).withColumn("symbol", symbol), KEY, ["ts", "event_id"], "symbol", "event_id", len(TYPES))
    return found.select("event_id", *(F.round(c, 6).alias(c) for c in observers.READOUTS))


def _in_order(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as sequences: ten by the tens of the ids."""
    return table(spark, d, "embeddings").select((F.col("vec_id") % 10).alias("sequence"), "vec_id", "embedding")


def vector_novelty(spark: SparkSession, d: str) -> DataFrame:
    """Checkerboard novelty, six before and six after, along ten sequences of embeddings."""
    found = observers.novelty(_in_order(spark, d), ["sequence"], ["vec_id"], "vec_id", "embedding", 6)
    return found.select("vec_id", F.round("novelty", 5).alias("novelty"))


def novelty_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Boundaries of the sequences: peaks of novelty above both neighbours and the sequence's 75th percentile, none within four places of a higher one."""
    found = observers.novelty(_in_order(spark, d), ["sequence"], ["vec_id"], "vec_id", "embedding", 6).withColumn("place", F.floor(F.col("vec_id") / 10))
    found = written(found.withColumn("novelty", F.round("novelty", 5)))
    floor = found.groupBy("sequence").agg(F.percentile("novelty", F.lit(0.75)).alias("floor"))
    peaks = series.local_peaks(found, ["sequence"], ["place"], "novelty").join(floor, "sequence").filter("novelty >= floor").drop("floor")
    return series.spaced(peaks, ["sequence"], "place", "novelty", 3).select("vec_id", "sequence", "novelty")


def window_matches(spark: SparkSession, d: str) -> DataFrame:
    """Where, and at which of three stretches, the values from each of a user's purchases on (eight, later ones weighing less) fit best among those of the next user."""
    w = series.ordered(KEY, ["ts", "event_id"]).rowsBetween(0, 7)
    e = events(spark, d).withColumn("window", F.collect_list("value").over(w)).filter("event_type = 'purchase' AND size(window) = 8")
    asked = e.select("event_id", (F.col("user_id") + 1).alias("user_id"), "window", F.array(*(F.lit(1.0 - i / 16) for i in range(8))).alias("gain"))
    found = observers.matched_filter(asked, events(spark, d).withColumnRenamed("event_id", "at"), KEY, ["event_id"], "window", "gain", ["ts", "at"], "at", "value", (0.5, 1.0, 2.0), 16)
    return found.select("event_id", "at", "stretch", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (directional_decode, stretch_segments, monotone_decode, cover_segments, average_classes, placement_ambiguity, fused_placements, fused_noise, markov_readouts, vector_novelty, novelty_boundaries, window_matches)}
#: Dynamic programs, greedy merging, EM and adaptive chains have none: tests hold the operators against exhaustive search or plain Python.
ORACLES: dict[str, str] = {
    "vector_novelty": """WITH u AS (SELECT vec_id % 10 AS q, vec_id, row_number() OVER (PARTITION BY vec_id % 10 ORDER BY vec_id) AS i, count(*) OVER (PARTITION BY vec_id % 10) AS n, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y)))) AS e FROM embeddings),
k AS (SELECT d, sign(d + 0.5) * exp(-(d + 0.5) * (d + 0.5) / 18) AS w FROM range(-6, 6) AS r(d)),
s AS (SELECT a.vec_id, sum(x.w * y.w * list_inner_product(b.e, c.e)) AS v FROM u a, k x, k y, u b, u c WHERE a.i > 6 AND a.i <= a.n - 5 AND b.q = a.q AND c.q = a.q AND b.i = a.i + x.d AND c.i = a.i + y.d GROUP BY 1)
SELECT u.vec_id, round(greatest(coalesce(v, 0), 0), 5) AS novelty FROM u LEFT JOIN s USING (vec_id)""",
    "window_matches": """WITH e AS (SELECT *, row_number() OVER w AS i, sum(value * value) OVER (w ROWS UNBOUNDED PRECEDING) AS upto, count(*) OVER (PARTITION BY user_id) AS n, list(value) OVER (w ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
q AS (SELECT event_id, user_id + 1 AS user_id, s AS stretch, list_transform(range((8 * s)::INT), lambda j: nxt[least(floor(j / s)::INT, 7) + 1] * (1.0 - least(floor(j / s)::INT, 7) / 16.0)) AS w FROM e, unnest([0.5, 1.0, 2.0]) AS t(s) WHERE event_type = 'purchase' AND i + 7 <= n),
m AS (SELECT q.event_id, e.event_id AS "at", stretch, e.i, list_inner_product(list_transform(w, lambda x: x / (sqrt(list_sum(list_transform(w, lambda y: y * y))) + 1e-9)), e.nxt[1:len(w)]) / sqrt(greatest(list_sum(list_transform(e.nxt[1:len(w)], lambda y: y * y)), 1e-9)) AS score FROM q JOIN e USING (user_id) WHERE e.n > len(w) AND e.i + len(w) - 1 <= e.n)
SELECT event_id, "at", stretch::DOUBLE AS stretch, round(score, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(score, 9) DESC, stretch, i) = 1""",
}
