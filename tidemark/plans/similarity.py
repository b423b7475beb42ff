"""Similarity matrices, repeats, slopes and tokens over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import times
from ..operators import joins, picks, series, tokens
from ..sources.tables import table
from .evidence import _LM, landmark_hashes
from .timeline import _E, events

BIN, PEAKS, SLOPES = 24, 3, (0.5, 1.0, 2.0)
LAGS, RUN = range(2, 17), 4
TOKENS = 8
TURNS, NEAR = 20, 7_200_000_000
REPLICATES = 40
#: The distribution function of a Poisson variable of mean 1 at 0 to 6.
POISSON = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406, 0.999917)


def slope_quality(spark: SparkSession, d: str) -> DataFrame:
    """The slope, of three, whose histogram of intercepts is the most peaked (three top bins above the median bin), for an even user's landmarks met in the next odd one's."""
    h = landmark_hashes(spark, d)
    mix = h.filter("user_id % 2 = 0").select(F.col("user_id").alias("mix"), (F.col("user_id") + 1).alias("user_id"), "f1", "f2", "dt", F.col("anchor").alias("a"))
    hits = mix.join(h.select("user_id", "f1", "f2", "dt", F.col("anchor").alias("b")), ["user_id", "f1", "f2", "dt"])
    at = hits.select("mix", "a", "b", F.explode(F.array(*map(F.lit, SLOPES))).alias("slope")).groupBy("mix", "slope", (F.col("b") - F.col("slope") * F.col("a")).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    at = at.withColumn("least", F.min("at").over(Window.partitionBy("mix", "slope")))
    bins = at.groupBy("mix", "slope", F.floor((F.col("at") - F.col("least")) / BIN).alias("bin")).agg(F.sum("n").alias("n"))
    flat = bins.groupBy("mix", "slope").agg(F.median("n").alias("flat"))
    top = picks.first_of(bins, ["mix", "slope"], [F.desc("n"), F.asc("bin")], PEAKS).join(flat, ["mix", "slope"])
    score = top.groupBy("mix", "slope").agg(F.sum(F.greatest(F.col("n") - F.col("flat"), F.lit(0.0))).alias("peaked"))
    return picks.first_of(score, ["mix"], [F.desc("peaked"), F.asc("slope")]).select("mix", "slope", "peaked")


def sparse_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Each user's matrix of days by hours (the largest value of a cell), made sparse: cells no neighbour exceeds, at 0.7 of the user's largest or more."""
    at = F.floor(F.col("us") / 3_600_000_000)
    cells = events(spark, d).filter("value > 0").groupBy("user_id", F.floor(at / 24).alias("day"), (at % 24).alias("hour")).agg(F.max("value").alias("weight"))
    largest = cells.groupBy("user_id").agg(F.max("weight").alias("largest"))
    return joins.local_maxima(cells, ["user_id"], ("day", "hour"), "weight").join(largest, "user_id").filter("weight >= 0.7 * largest").drop("largest")


def repeat_runs(spark: SparkSession, d: str) -> DataFrame:
    """Repeats in a user's own sequence of event types: runs of four events or more that equal those 2 to 16 places before, with their lag."""
    w = series.ordered(["user_id"], ["ts", "event_id"])
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.row_number().over(w).alias("place"))
    same = F.filter(F.array(*(F.when(F.col("event_type") == F.lag("event_type", k).over(w), k) for k in LAGS)), lambda k: k.isNotNull())
    hits = e.withColumn("same", same).select("user_id", "place", F.explode("same").alias("lag"))
    run = F.col("place") - F.row_number().over(Window.partitionBy("user_id", "lag").orderBy("place"))
    runs = hits.withColumn("run", run).groupBy("user_id", "lag", "run").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    return runs.filter(F.col("n") >= RUN).select("user_id", "lag", "first", "n")


def joint_bins(spark: SparkSession, d: str) -> DataFrame:
    """Customers in the joint cells of three fractions (of urgent, finished and dear orders), each none, low (to 0.15) or high."""
    level = lambda x: F.when(x <= 0, "none").when(x <= 0.15, "low").otherwise("high")
    part = lambda flag: level(F.avg(F.expr(flag).cast("double")))
    o = table(spark, d, "orders").groupBy("o_custkey").agg(part("o_orderpriority = '1-URGENT'").alias("urgent"), part("o_orderstatus = 'F'").alias("finished"), part("o_totalprice > 300000").alias("dear"))
    return o.groupBy("urgent", "finished", "dear").agg(F.count(F.lit(1)).alias("n"))


def vector_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The token of each embedding: the nearest of eight centres of unit vectors (seeded k-means)."""
    return tokens.quantized(table(spark, d, "embeddings"), "embedding", TOKENS).select("vec_id", "token")


def shift_null(spark: SparkSession, d: str) -> DataFrame:
    """Whether a user's clicks lie near views (within two hours) more often than the same clicks turned around the user's span by 1/20 to 19/20: hits, the most hits of a turned pattern, and p."""
    e = events(spark, d).filter("event_type IN ('click', 'view')").select("user_id", "event_id", "event_type", "us")
    span = e.groupBy("user_id").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    turned = e.filter("event_type = 'click'").join(span, "user_id").select("user_id", "event_id", "us", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1))).alias("turn"))
    turned = turned.withColumn("at", F.when(F.col("turn") == 0, F.col("us")).otherwise(F.expr(f"lo + (us - lo + turn * (hi - lo) div {TURNS}) % nullif(hi - lo, 0)")))
    cell = F.floor(F.col("us") / NEAR)
    truth = e.filter("event_type = 'view'").select("user_id", F.col("us").alias("truth"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    turned = turned.withColumn("cell", F.floor(F.col("at") / NEAR))
    near = turned.alias("t").join(truth.alias("v"), (F.col("t.user_id") == F.col("v.user_id")) & (F.col("t.cell") == F.col("v.cell")) & (F.abs(F.col("at") - F.col("truth")) <= NEAR), "left_semi")
    hits = near.groupBy("user_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    own = span.join(hits.filter("turn = 0").select("user_id", F.col("n").alias("hits")), "user_id", "left").select("user_id", F.coalesce("hits", F.lit(0)).alias("hits"))
    other = own.join(hits.filter("turn > 0"), "user_id", "left").groupBy("user_id", "hits").agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count_if(F.col("n") >= F.col("hits")).alias("as_many"))
    return other.select("user_id", "hits", "most", F.round((1 + F.when(F.col("hits") == 0, TURNS - 1).otherwise(F.col("as_many"))) / TURNS, 6).alias("p"))


def bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean value of each event type and the middle 95 % of its bootstrap means: every row draws its weight (Poisson, mean 1) in each of 40 replicates from a hash of its id, so one pass does and reruns agree."""
    e = table(spark, d, "events").filter("value IS NOT NULL").select("event_id", "event_type", "value", F.explode(F.sequence(F.lit(1), F.lit(REPLICATES))).alias("replicate"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", "event_id", "replicate").cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296
    weight = sum((F.when(draw >= p, 1).otherwise(0) for p in POISSON), F.lit(0))
    e = e.withColumn("weight", weight)
    means = e.groupBy("event_type", "replicate").agg((F.sum(F.col("weight") * F.col("value")) / F.nullif(F.sum("weight"), F.lit(0))).alias("mean"), F.avg("value").alias("plain"))
    low, high = (F.round(F.percentile("mean", F.lit(p)), 4) for p in (0.025, 0.975))
    return means.groupBy("event_type").agg(F.round(F.max(F.when(F.col("replicate") == 1, F.col("plain"))), 4).alias("mean"), low.alias("low"), high.alias("high"))


def wheel_distance(spark: SparkSession, d: str) -> DataFrame:
    """Customers by how many steps their key on a wheel of twelve hours and two sides lies from their nation's; null where a key is none."""
    side = lambda x: F.when(x % 2 == 0, "A").otherwise("B")
    own = F.when(F.col("c_custkey") % 17 == 0, "n/a").otherwise(F.concat((F.col("c_custkey") % 12 + 1).cast("string"), side(F.floor(F.col("c_acctbal")))))
    theirs = F.concat((F.col("c_nationkey") % 12 + 1).cast("string"), side(F.col("c_nationkey")))
    return table(spark, d, "customer").select(times.wheel_steps(own, theirs).alias("steps")).groupBy("steps").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (slope_quality, sparse_peaks, repeat_runs, joint_bins, vector_tokens, shift_null, bootstrap_mean, wheel_distance)}

ORACLES = {
    "slope_quality": f"WITH {_LM}, x AS (SELECT m.user_id AS mix, slope, r.anchor - slope * m.anchor AS at0 FROM h m JOIN h r ON r.user_id = m.user_id + 1 AND m.f1 = r.f1 AND m.f2 = r.f2 AND m.dt = r.dt, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) AS z(slope) WHERE m.user_id % 2 = 0), b AS (SELECT mix, slope, floor((at0 - low) / 24) AS bin, count(*) AS n FROM (SELECT *, min(at0) OVER (PARTITION BY mix, slope) AS low FROM x) GROUP BY 1, 2, 3), t AS (SELECT *, median(n) OVER (PARTITION BY mix, slope) AS flat, row_number() OVER (PARTITION BY mix, slope ORDER BY n DESC, bin) AS place FROM b), s AS (SELECT mix, slope, sum(greatest(n - flat, 0)) AS peaked FROM t WHERE place <= 3 GROUP BY 1, 2) SELECT mix, slope, peaked FROM s QUALIFY row_number() OVER (PARTITION BY mix ORDER BY peaked DESC, slope) = 1",
    "sparse_peaks": f"WITH {_E}, c AS (SELECT user_id, us // 86400000000 AS day, (us // 3600000000) % 24 AS hour, max(value) AS weight FROM e WHERE value > 0 GROUP BY 1, 2, 3) SELECT user_id, day, hour, weight FROM c WHERE weight >= 0.7 * (SELECT max(weight) FROM c m WHERE m.user_id = c.user_id) AND NOT EXISTS (SELECT 1 FROM c o WHERE o.user_id = c.user_id AND abs(o.day - c.day) <= 1 AND abs(o.hour - c.hour) <= 1 AND o.weight > c.weight)",
    "repeat_runs": "WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events), x AS (SELECT b.user_id, b.place, b.place - a.place AS lag FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.place - a.place BETWEEN 2 AND 16), r AS (SELECT *, place - row_number() OVER (PARTITION BY user_id, lag ORDER BY place) AS run FROM x) SELECT user_id, lag, min(place) AS first, count(*) AS n FROM r GROUP BY user_id, lag, run HAVING count(*) >= 4",
    "joint_bins": "WITH f AS (SELECT avg((o_orderpriority = '1-URGENT')::INT) AS u, avg((o_orderstatus = 'F')::INT) AS f, avg((o_totalprice > 300000)::INT) AS d FROM orders GROUP BY o_custkey) SELECT CASE WHEN u <= 0 THEN 'none' WHEN u <= 0.15 THEN 'low' ELSE 'high' END AS urgent, CASE WHEN f <= 0 THEN 'none' WHEN f <= 0.15 THEN 'low' ELSE 'high' END AS finished, CASE WHEN d <= 0 THEN 'none' WHEN d <= 0.15 THEN 'low' ELSE 'high' END AS dear, count(*) AS n FROM f GROUP BY 1, 2, 3",
    "shift_null": f"WITH {_E}, c AS (SELECT * FROM e WHERE event_type IN ('click', 'view')), s AS (SELECT user_id, min(us) AS lo, max(us) AS hi FROM c GROUP BY 1), t AS (SELECT user_id, turn, CASE WHEN turn = 0 THEN us ELSE lo + (us - lo + turn * (hi - lo) // 20) % nullif(hi - lo, 0) END AS at0 FROM c JOIN s USING (user_id), range(20) AS r(turn) WHERE event_type = 'click'), h AS (SELECT user_id, turn, count(*) AS n FROM t WHERE EXISTS (SELECT 1 FROM c v WHERE v.event_type = 'view' AND v.user_id = t.user_id AND abs(v.us - at0) <= 7200000000) GROUP BY 1, 2), o AS (SELECT user_id, coalesce(n, 0) AS hits FROM s LEFT JOIN (SELECT user_id, n FROM h WHERE turn = 0) USING (user_id)) SELECT user_id, any_value(hits) AS hits, coalesce(max(n), 0) AS most, round((1 + CASE WHEN any_value(hits) = 0 THEN 19 ELSE count(*) FILTER (n >= hits) END) / 20, 6) AS p FROM o LEFT JOIN (SELECT * FROM h WHERE turn > 0) USING (user_id) GROUP BY 1",
    "bootstrap_mean": "WITH x AS (SELECT event_type, value, k, ('0x' || substr(md5(event_id || ':' || k), 1, 8))::BIGINT / 4294967296 AS u FROM events, range(1, 41) AS r(k) WHERE value IS NOT NULL), w AS (SELECT *, (u >= 0.367879)::INT + (u >= 0.735759)::INT + (u >= 0.919699)::INT + (u >= 0.981012)::INT + (u >= 0.996340)::INT + (u >= 0.999406)::INT + (u >= 0.999917)::INT AS n FROM x), m AS (SELECT event_type, k, sum(n * value) / nullif(sum(n), 0) AS b, avg(value) AS plain FROM w GROUP BY 1, 2) SELECT event_type, round(max(plain) FILTER (k = 1), 4) AS mean, round(quantile_cont(b, 0.025), 4) AS low, round(quantile_cont(b, 0.975), 4) AS high FROM m GROUP BY 1",
    "wheel_distance": "WITH k AS (SELECT c_custkey % 12 + 1 AS h, CASE WHEN floor(c_acctbal)::BIGINT % 2 = 0 THEN 'A' ELSE 'B' END AS s, c_nationkey % 12 + 1 AS nh, CASE WHEN c_nationkey % 2 = 0 THEN 'A' ELSE 'B' END AS ns, c_custkey % 17 <> 0 AS ok FROM customer) SELECT CASE WHEN ok THEN (least((h - nh + 12) % 12, (nh - h + 12) % 12) + (s <> ns)::INT)::INT END AS steps, count(*) AS n FROM k GROUP BY 1",
}
