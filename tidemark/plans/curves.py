"""Curves, trajectories and scorecards over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import times, vectors
from ..operators import joins, picks, ranks, series
from ..sources.tables import table
from .timeline import _E, _NEAR, _SPANS, _W, events, nearest_cue, spans


def tempo_curve(spark: SparkSession, d: str) -> DataFrame:
    """Hours between events of a user, as the median of five gaps."""
    e = series.with_gap(events(spark, d), ["user_id"], ["ts", "event_id"], F.col("us"))
    return e.select("event_id", F.round(series.rolling_median("gap", series.centred(["user_id"], ["ts", "event_id"], 2)) / 3_600_000_000, 6).alias("hours"))


def history_latest(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's latest order by generation, and how many came before."""
    o = table(spark, d, "orders")
    n = o.groupBy("o_custkey").agg((F.count(F.lit(1)) - 1).alias("generation"))
    return picks.first_of(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey").join(n, "o_custkey")


def trajectory_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Share of orders that two trajectories (pieces with a jump back) place within 5,000 of each other, per status."""
    piece = lambda lo, hi, dst, slope: F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(dst).alias("dst"), F.lit(slope).alias("slope"))
    a = F.array(piece(0.0, 200000.0, 0.0, 1.0), piece(200000.0, 600000.0, 100000.0, 1.0))
    b = F.array(piece(0.0, 150000.0, 2000.0, 1.0), piece(150000.0, 600000.0, 152000.0, 0.9))
    o = table(spark, d, "orders").withColumns({"a": times.trajectory_value(a, F.col("o_totalprice")), "b": times.trajectory_value(b, F.col("o_totalprice"))})
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.abs(F.col("a") - F.col("b")) < 5000).cast("double")), 6).alias("accuracy"))


def corroborating_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Views and signups of a user that overlap for two seconds and whose values differ by 50 at most."""
    s = spans(spark, d).join(table(spark, d, "events").select("event_id", "value"), "event_id")
    side = lambda kind, p: s.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(p), F.col("lo").alias(f"{p}_lo"), F.col("hi").alias(f"{p}_hi"), F.col("value").alias(f"{p}_v"))
    pairs = joins.interval_join(side("view", "a"), side("signup", "b"), ("a_lo", "a_hi"), ("b_lo", "b_hi"), 3600.0, ["user_id"])
    shared = joins.overlap(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"))
    return pairs.filter((shared >= 2) & (F.abs(F.col("a_v") - F.col("b_v")) <= 50)).select("a", "b")


def scorecard(spark: SparkSession, d: str) -> DataFrame:
    """How many purchases have a click of the user within one, six and twenty-four hours."""
    n = nearest_cue(spark, d).join(events(spark, d).select("event_id", "us"), "event_id").withColumn("off", F.abs(F.col("near") - F.col("us")) / 3_600_000_000)
    return n.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("off") <= h).alias(f"within_{h}") for h in (1, 6, 24)))


def pairwise_corr(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of the days' counts of each two event types."""
    e = events(spark, d).groupBy(F.floor(F.col("us") / 86_400_000_000).alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    other = e.select("day", F.col("event_type").alias("other"), F.col("n").alias("m"))
    return e.join(other, "day").filter("event_type < other").groupBy("event_type", "other").agg(F.round(F.corr("n", "m"), 6).alias("corr"))


def frame_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine of each vector with the one before it, per label: neighbours meet by their places, so no label's vectors are sorted in one task."""
    e = ranks.ranked(table(spark, d, "embeddings"), ["label"], "vec_id", []).select("label", "place", "embedding")
    before = e.select(F.col("label").alias("of"), (F.col("place") + 1).alias("next"), F.col("embedding").alias("prev"))
    both = e.join(before, F.col("label").eqNullSafe(F.col("of")) & (F.col("place") == F.col("next")))
    return both.groupBy("label").agg(F.round(F.avg(vectors.cosine(F.col("embedding"), F.col("prev"))), 4).alias("cosine"))


def curve_precision(spark: SparkSession, d: str) -> DataFrame:
    """How far each user's best value stands out: margin to the second, and its deviation from all."""
    w = Window.partitionBy("user_id")
    e = table(spark, d, "events").withColumns({"place": F.row_number().over(w.orderBy(F.desc("value"), "event_id")), "second": F.lead("value").over(w.orderBy(F.desc("value"), "event_id")), "z": (F.col("value") - F.avg("value").over(w)) / (F.stddev_pop("value").over(w) + 1e-9)})
    return e.filter("place = 1").select("user_id", F.round(F.col("value") - F.col("second"), 4).alias("margin"), F.round("z", 6).alias("z"))


def ridge_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Per part size: mean line price near the middle quantity over that away from it."""
    near = F.abs(F.col("l_quantity") - 25) <= 5
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy("p_size").agg(F.round(F.avg(F.when(near, F.col("l_extendedprice"))) / F.avg(F.when(~near, F.col("l_extendedprice"))), 6).alias("contrast"))


QUERIES = {f.__name__: f for f in (tempo_curve, history_latest, trajectory_accuracy, corroborating_pairs, scorecard, pairwise_corr, frame_cosine, curve_precision, ridge_contrast)}

_DOT = "list_aggregate(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE), 'sum')"
ORACLES = {
    "tempo_curve": f"WITH {_E}, g AS (SELECT *, us - lag(us) OVER {_W} AS gap FROM e) SELECT event_id, round(median(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 3600000000, 6) AS hours FROM g",
    "history_latest": "SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) - 1 AS generation FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "trajectory_accuracy": "WITH t AS (SELECT o_orderstatus, CASE WHEN o_totalprice <= 200000 THEN o_totalprice ELSE 100000 + (o_totalprice - 200000) END AS a, CASE WHEN o_totalprice <= 150000 THEN 2000 + o_totalprice ELSE 152000 + (o_totalprice - 150000) * 0.9 END AS b FROM orders) SELECT o_orderstatus, count(*) AS n, round(avg((abs(a - b) < 5000)::INT), 6) AS accuracy FROM t GROUP BY 1",
    "corroborating_pairs": f"WITH {_SPANS}, x AS (SELECT s.*, value FROM s JOIN events USING (event_id)) SELECT p.event_id AS a, q.event_id AS b FROM x p JOIN x q ON p.user_id = q.user_id AND least(p.hi, q.hi) - greatest(p.lo, q.lo) >= 2 AND abs(p.value - q.value) <= 50 WHERE p.event_type = 'view' AND q.event_type = 'signup'",
    "scorecard": f"WITH {_NEAR}, o AS (SELECT abs(near - t0) / 3600000000 AS f FROM r) SELECT count(*) AS n, count(*) FILTER (f <= 1) AS within_1, count(*) FILTER (f <= 6) AS within_6, count(*) FILTER (f <= 24) AS within_24 FROM o",
    "pairwise_corr": f"WITH {_E}, n AS (SELECT us // 86400000000 AS day, event_type, count(*) AS n FROM e GROUP BY 1, 2) SELECT a.event_type, b.event_type AS other, round(corr(a.n, b.n), 6) AS corr FROM n a JOIN n b ON a.day = b.day AND a.event_type < b.event_type GROUP BY 1, 2",
    "frame_cosine": f"WITH p AS (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings) SELECT label, round(avg({_DOT.format('embedding', 'prev')} / (sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format('prev', 'prev')}))), 4) AS cosine FROM p WHERE prev IS NOT NULL GROUP BY 1",
    "curve_precision": "WITH a AS (SELECT user_id, value, row_number() OVER w AS place, lead(value) OVER w AS second, (value - avg(value) OVER (PARTITION BY user_id)) / (stddev_pop(value) OVER (PARTITION BY user_id) + 1e-9) AS z FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)) SELECT user_id, round(value - second, 4) AS margin, round(z, 6) AS z FROM a WHERE place = 1",
    "ridge_contrast": "SELECT p_size, round(avg(l_extendedprice) FILTER (abs(l_quantity - 25) <= 5) / avg(l_extendedprice) FILTER (abs(l_quantity - 25) > 5), 6) AS contrast FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
}
