"""Time-axis queries over events and orders: gaps, fills, sessions, rolling statistics, intervals, maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import times
from ..operators import intervals, joins, picks, series
from ..sources.tables import table

KEY, ORDER = ["user_id"], ["ts", "event_id"]


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with `us`, microseconds of their time."""
    return table(spark, d, "events").withColumn("us", times.micros(F.col("ts")))


def gap_series(spark: SparkSession, d: str) -> DataFrame:
    """Microseconds since the user's event before."""
    return series.with_gap(events(spark, d), KEY, ORDER, F.col("us")).select("event_id", "user_id", "gap")


def section_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Per user: events and mean gap, (last - first) / (n - 1) from two on."""
    return events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.when(F.count(F.lit(1)) >= 2, (F.max("us") - F.min("us")) / (F.count(F.lit(1)) - 1)), 3).alias("mean_gap"))


def gap_rate(spark: SparkSession, d: str) -> DataFrame:
    """Events a day from the median gap of each user."""
    g = series.with_gap(events(spark, d), KEY, ORDER, F.col("us")).groupBy("user_id").agg(F.percentile("gap", F.lit(0.5)).alias("m"))
    return g.select("user_id", F.round(86_400_000_000 / F.nullif(F.col("m"), F.lit(0.0)), 6).alias("rate"))


def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    """The user's last purchase value known at each event."""
    e = events(spark, d).withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("value")))
    return series.filled(e, KEY, ORDER, "bought", "last_bought").select("event_id", "last_bought")


def slot_label_state(spark: SparkSession, d: str) -> DataFrame:
    """Turns labelled as primary (the user's) and what follows them."""
    c = table(spark, d, "conversations")
    return series.label_state(c, ["conv_id"], ["turn"], F.col("role") == "user").select("conv_id", "turn", "role", "label")


def moving_average(spark: SparkSession, d: str) -> DataFrame:
    """Centred mean and median of five values in the order of time."""
    e = events(spark, d)
    w = series.centred(KEY, ORDER, 2)
    return e.select("event_id", F.round(F.avg("value").over(w), 6).alias("mean5"), F.round(series.rolling_median("value", w), 6).alias("median5"))


def rolling_z_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Local maxima that stand 1.2 population deviations above the median of eleven values about them."""
    w = series.centred(KEY, ORDER, 5)
    near = F.sort_array(F.collect_list("value").over(w))
    median = (F.get(near, F.floor((F.size(near) - 1) / 2).cast("int")) + F.get(near, F.floor(F.size(near) / 2).cast("int"))) / 2
    z = (F.col("value") - median) / (F.stddev_pop("value").over(w) + 1e-9)
    e = events(spark, d).withColumn("z", F.round(z, 6))
    return series.local_peaks(e, KEY, ORDER, "value").filter("z >= 1.2").select("event_id", "z")


def forward_window_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of a value and the three after it; null past the end."""
    out = series.forward_mean(events(spark, d), KEY, ORDER, "value", 4, "ahead")
    return out.select("event_id", F.round("ahead", 6).alias("ahead"))


def band_zscore(spark: SparkSession, d: str) -> DataFrame:
    """Values as deviations from their type's mean: a mean and a deviation a type, joined back."""
    e = events(spark, d)
    bands = e.groupBy(F.col("event_type").alias("band")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
    return e.join(bands, F.col("event_type").eqNullSafe(F.col("band"))).select("event_id", F.round((F.col("value") - F.col("mean")) / F.col("deviation"), 6).alias("z"))


def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user's events, parted by gaps above two hours."""
    e = series.sessions(events(spark, d), KEY, ORDER, F.col("us"), 2 * 3600 * 1e6)
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first"), F.max("us").alias("last"), F.round(F.sum("value"), 4).alias("value"))


def merge_within_tol(spark: SparkSession, d: str) -> DataFrame:
    """Event times in seconds, less those within an hour of the last one kept."""
    e = events(spark, d).select("user_id", (F.col("us") / 1_000_000).alias("at"))
    return series.merged_within(e, KEY, "at", 3600.0)


def spaced_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Each user's largest values, none within six hours of a larger."""
    e = events(spark, d).select("user_id", "event_id", "us", "value")
    return series.spaced(e, KEY, "us", "value", 6 * 3600 * 1e6)


def suppressed_topk(spark: SparkSession, d: str) -> DataFrame:
    """The six largest values of each user, none within a day of a larger."""
    e = events(spark, d).select("user_id", "event_id", "us", "value")
    return series.spaced(e, KEY, "us", "value", 86_400e6, 6)


def grid_repair(spark: SparkSession, d: str) -> DataFrame:
    """Each user's hours with an event, repaired to an even grid."""
    e = events(spark, d).select("user_id", F.floor(F.col("us") / 3_600_000_000).alias("hour")).distinct()
    return series.grid_repaired(e, KEY, "hour")


def runner_up_sep(spark: SparkSession, d: str) -> DataFrame:
    """Each user's best value and the best at least a day away from it."""
    e = events(spark, d).select("user_id", "us", "value", "event_id")
    best = picks.first_of(e, KEY, [F.desc("value"), F.asc("event_id")]).select("user_id", F.col("us").alias("at"), F.col("value").alias("best"))
    apart = e.join(best, "user_id").filter(F.abs(F.col("us") - F.col("at")) >= 86_400_000_000).groupBy("user_id").agg(F.max("value").alias("second"))
    return best.select("user_id", "best").join(apart, "user_id", "left")


def phase_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per type: how events gather in the day (resultant length and Rayleigh's p), and the fullest of eight parts."""
    e = events(spark, d).withColumn("phase", (F.col("us") % 86_400_000_000) / 86_400_000_000)
    r, p = times.circular_stats(F.col("phase"))
    parts = [F.count_if(F.least(F.lit(7), F.floor(F.col("phase") * 8)) == i).alias(f"part_{i}") for i in range(8)]
    return e.groupBy("event_type").agg(F.round(r, 6).alias("r"), F.round(p, 6).alias("p"), *parts)


def nearest_cue(spark: SparkSession, d: str) -> DataFrame:
    """For each purchase the nearest click of the same user, before or after."""
    e = events(spark, d)
    buys = e.filter("event_type = 'purchase'").select("user_id", "event_id", "us")
    clicks = e.filter("event_type = 'click'").select("user_id", F.col("us").alias("click_us"))
    return joins.nearest(buys, clicks, "us", "click_us", KEY).select("event_id", "before", "after", "near")


def asof_click(spark: SparkSession, d: str) -> DataFrame:
    """For each purchase the last click of the user at or before it, with its value."""
    e = events(spark, d)
    buys = e.filter("event_type = 'purchase'").select("user_id", "event_id", "us")
    clicks = e.filter("event_type = 'click'").select("user_id", F.col("us").alias("click_us"), F.col("value").alias("click_value"))
    return joins.asof(buys, clicks, "us", "click_us", KEY, ["click_value"]).select("event_id", "click_us_before", "click_value")


def grid_snap(spark: SparkSession, d: str) -> DataFrame:
    """A user's purchases moved to the nearest of the user's clicks (the earlier of two as near) where it is within half the
    median gap of these; where that isn't after the last time kept, the purchase stays where it is if that is, else it goes. Without two clicks nothing moves."""
    e = events(spark, d).filter("event_type IN ('purchase', 'click')")
    click = F.when(F.col("event_type") == "click", F.col("us"))
    w = Window.partitionBy("user_id").orderBy("us")
    e = e.withColumns({"b": F.max(click).over(w.rangeBetween(Window.unboundedPreceding, 0)), "a": F.min(click).over(w.rangeBetween(0, Window.unboundedFollowing))})
    clicks = series.with_gap(e.filter("event_type = 'click'").select("user_id", "us").distinct(), KEY, ["us"], F.col("us"))
    half = clicks.groupBy("user_id").agg((F.percentile("gap", F.lit(0.5)) / 2).alias("half"))
    p = e.filter("event_type = 'purchase'").join(half, "user_id", "left")
    near = F.when(F.col("a").isNull() | (F.col("us") - F.col("b") <= F.col("a") - F.col("us")), F.col("b")).otherwise(F.col("a"))
    p = p.select("user_id", F.col("us").alias("snapped"), F.when(F.abs(near - F.col("us")) <= F.col("half"), near).otherwise(F.col("us")).alias("near"))
    return series.snapped(p, KEY, "snapped", "near").withColumn("snapped", F.col("snapped").cast("long"))


def spans(spark: SparkSession, d: str) -> DataFrame:
    """An interval for each event: its value's minutes from its time, in seconds."""
    return events(spark, d).select("event_id", "user_id", "event_type", (F.col("us") / 1_000_000).alias("lo"), (F.col("us") / 1_000_000 + F.col("value") * 60).alias("hi"))


def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a click span and a purchase span of one user that overlap, with the seconds."""
    s = spans(spark, d)
    a = s.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    b = s.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    pairs = joins.interval_join(a, b, ("a_lo", "a_hi"), ("b_lo", "b_hi"), 3600.0, KEY)
    return pairs.select("a", "b", F.round(joins.overlap(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi")), 3).alias("overlap"))


def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each user's spans merged where they touch or overlap."""
    return intervals.merged(spans(spark, d), KEY, "lo", "hi").select("user_id", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"), "n")


def interval_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What lies between each user's merged spans."""
    return intervals.complement(intervals.merged(spans(spark, d), KEY, "lo", "hi"), KEY, "lo", "hi").select("user_id", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"))


def audible_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Seconds that each user's spans cover, overlaps once."""
    m = intervals.merged(spans(spark, d), KEY, "lo", "hi")
    return m.groupBy("user_id").agg(F.round(F.sum(F.col("hi") - F.col("lo")), 3).alias("seconds"))


def active_density(spark: SparkSession, d: str) -> DataFrame:
    """How many purchase spans of all users are active at the start of each click span (starts count, ends don't)."""
    s = spans(spark, d)
    return intervals.active_at(s.filter("event_type = 'click'").select("event_id", F.col("lo").alias("at")), s.filter("event_type = 'purchase'"), "at", "lo", "hi", 3600.0).select("event_id", "active")


def piecewise_map(spark: SparkSession, d: str) -> DataFrame:
    """Order prices through a piecewise-linear map and back."""
    knots = [(0.0, 0.0), (100000.0, 50000.0), (300000.0, 350000.0), (500000.0, 400000.0)]
    anchors = F.array(*(F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in knots))
    o = table(spark, d, "orders").withColumn("mapped", times.map_apply(anchors, F.col("o_totalprice")))
    return o.select("o_orderkey", F.round("mapped", 4).alias("mapped"), F.round(times.map_inverse(anchors, F.col("mapped")), 4).alias("back"))


def ext_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Events of each type in windows of a day (extension)."""
    e = table(spark, d, "events").withColumn("start", F.date_trunc("DAY", "ts").cast("timestamp_ntz"))
    return e.groupBy("start", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


def ext_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Events in windows of a day that start every six hours, as microseconds of the start (extension)."""
    step, width = 6 * 3600 * 1_000_000, 4
    e = events(spark, d).withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: (F.floor(F.col("us") / step) - k) * step)))
    return e.groupBy("start").agg(F.count(F.lit(1)).alias("n"))


def ordering_soft_votes(spark: SparkSession, d: str) -> DataFrame:
    """Whether each event's value (as a start in seconds) keeps the order of its neighbours: in order within two seconds with
    confidence 0.8, else out of order with one that falls from 0.4 by the size of the largest violation, 0.02 at least; without neighbours none."""
    w = series.ordered(KEY, ORDER)
    e = events(spark, d).withColumns({"before": F.lag("value").over(w), "after": F.lead("value").over(w)})
    back = F.greatest(F.lit(0.0), F.coalesce(F.col("before") - F.col("value"), F.lit(0.0)), F.coalesce(F.col("value") - F.col("after"), F.lit(0.0)))
    alone = F.col("before").isNull() & F.col("after").isNull()
    label = F.when(alone, "none").when(back <= 2, "in_order").otherwise("out_of_order")
    sure = F.when(alone, 0.0).when(back <= 2, 0.8).otherwise(F.greatest(F.lit(0.02), 0.4 * F.exp(-(back - 2) / 30)))
    return e.select("event_id", label.alias("label"), F.round(sure, 6).alias("confidence"))


def plateau_count(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one type in a row, per user."""
    w = series.ordered(KEY, ORDER)
    e = events(spark, d).withColumn("new", F.coalesce((F.col("event_type") != F.lag("event_type").over(w)).cast("int"), F.lit(1)))
    return e.groupBy("user_id").agg(F.sum("new").alias("runs"))


def lag_autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    """Per user: correlation of values with those one, two and three events before."""
    w = series.ordered(KEY, ORDER)
    e = events(spark, d).select("user_id", "value", *(F.lag("value", k).over(w).alias(f"l{k}") for k in (1, 2, 3)))
    return e.groupBy("user_id").agg(*(F.round(F.corr("value", f"l{k}"), 6).alias(f"lag_{k}") for k in (1, 2, 3)))


def positive_flux(spark: SparkSession, d: str) -> DataFrame:
    """Sum of rises from one event to the next, per user."""
    e = series.with_gap(events(spark, d), KEY, ORDER, F.col("value"), "rise")
    return e.groupBy("user_id").agg(F.round(F.sum(F.greatest(F.lit(0.0), F.coalesce("rise", F.lit(0.0)))), 4).alias("flux"))


def markov_surprisal(spark: SparkSession, d: str) -> DataFrame:
    """Bits of surprise at each event's type under the user's counts so far (one added to each of five types)."""
    w = series.ordered(KEY, ORDER)
    e = events(spark, d).withColumn("prev", F.lag("event_type").over(w))
    earlier = lambda *keys: Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    pair, any_ = F.count(F.lit(1)).over(earlier("user_id", "prev", "event_type")), F.count(F.lit(1)).over(earlier("user_id", "prev"))
    return e.filter("prev IS NOT NULL").select("event_id", F.round(-F.log2((pair + 1) / (any_ + 5)), 6).alias("surprisal"))


QUERIES = {f.__name__: f for f in (gap_series, section_gaps, gap_rate, forward_fill, slot_label_state, moving_average, rolling_z_peaks, forward_window_mean, band_zscore, gap_sessions, merge_within_tol, spaced_peaks, suppressed_topk, grid_repair, runner_up_sep, phase_stats, nearest_cue, asof_click, grid_snap, interval_overlap, interval_merge, interval_gaps, audible_seconds, active_density, piecewise_map, ext_tumbling, ext_sliding, ordering_soft_votes, plateau_count, lag_autocorrelation, positive_flux, markov_surprisal)}

_E = "e AS (SELECT *, epoch_us(ts) AS us FROM events)"
_W = "(PARTITION BY user_id ORDER BY ts, event_id)"
_SPANS = f"{_E}, s AS (SELECT event_id, user_id, event_type, us / 1000000 AS lo, us / 1000000 + value * 60 AS hi FROM e)"
_MERGED = f"""{_SPANS}, f AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-9 THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM f), m AS (SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM g GROUP BY user_id, island)"""
_NEAR = f"""{_E}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), c AS (SELECT user_id, us FROM e WHERE event_type = 'click'),
n AS (SELECT event_id, p.us AS t0, (SELECT max(us) FROM c WHERE c.user_id = p.user_id AND c.us <= p.us) AS b0, (SELECT min(us) FROM c WHERE c.user_id = p.user_id AND c.us >= p.us) AS a0 FROM p),
r AS (SELECT *, CASE WHEN b0 IS NULL THEN a0 WHEN a0 IS NULL THEN b0 WHEN t0 - b0 < a0 - t0 THEN b0 ELSE a0 END AS near FROM n)"""
ORACLES = {
    "gap_series": f"WITH {_E} SELECT event_id, user_id, us - lag(us) OVER {_W} AS gap FROM e",
    "section_gaps": f"WITH {_E} SELECT user_id, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN (max(us) - min(us)) / (count(*) - 1) END, 3) AS mean_gap FROM e GROUP BY 1",
    "gap_rate": f"WITH {_E}, g AS (SELECT user_id, us - lag(us) OVER {_W} AS gap FROM e) SELECT user_id, round(86400000000 / nullif(median(gap), 0), 6) AS rate FROM g GROUP BY 1",
    "forward_fill": f"SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_bought FROM events",
    "slot_label_state": "WITH a AS (SELECT *, (role = 'user')::INT AS p, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM conversations) SELECT conv_id, turn, role, CASE WHEN n = 0 THEN NULL WHEN p = 1 THEN lpad(n::VARCHAR, 3, '0') ELSE lpad(n::VARCHAR, 3, '0') || 'w' || sum(1 - p) OVER (PARTITION BY conv_id, n ORDER BY turn ROWS UNBOUNDED PRECEDING) END AS label FROM a",
    "moving_average": "SELECT event_id, round(avg(value) OVER w, 6) AS mean5, round(median(value) OVER w, 6) AS median5 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "rolling_z_peaks": f"WITH a AS (SELECT event_id, value, round((value - median(value) OVER w) / (stddev_pop(value) OVER w + 1e-9), 6) AS z, lag(value) OVER {_W} AS b, lead(value) OVER {_W} AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) SELECT event_id, z FROM a WHERE value > b AND value > c AND z >= 1.2",
    "forward_window_mean": "SELECT event_id, round(CASE WHEN count(*) OVER w = 4 THEN avg(value) OVER w END, 6) AS ahead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)",
    "band_zscore": "SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z FROM events WINDOW w AS (PARTITION BY event_type)",
    "gap_sessions": f"WITH {_E}, f AS (SELECT *, coalesce((us - lag(us) OVER {_W} > 7200000000)::INT, 0) AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM f) SELECT user_id, session, count(*) AS n, min(us) AS first, max(us) AS last, round(sum(value), 4) AS value FROM s GROUP BY 1, 2",
    "runner_up_sep": f"WITH {_E}, b AS (SELECT user_id, us AS at, value AS best FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1) SELECT user_id, best, (SELECT max(value) FROM e WHERE e.user_id = b.user_id AND abs(e.us - b.at) >= 86400000000) AS second FROM b",
    "phase_stats": f"WITH {_E}, p AS (SELECT event_type, (us % 86400000000) / 86400000000 AS ph FROM e), a AS (SELECT event_type, count(*) AS n, sqrt(pow(avg(cos(2 * pi() * ph)), 2) + pow(avg(sin(2 * pi() * ph)), 2)) AS r, {', '.join(f'count(*) FILTER (least(7, floor(ph * 8)) = {i}) AS part_{i}' for i in range(8))} FROM p GROUP BY 1) SELECT event_type, round(r, 6) AS r, round(greatest(0, least(1, exp(-n * r * r) * (1 + (2 * n * r * r - pow(n * r * r, 2)) / (4 * n)))), 6) AS p, {', '.join(f'part_{i}' for i in range(8))} FROM a",
    "nearest_cue": f'WITH {_NEAR} SELECT event_id, b0 AS "before", a0 AS "after", near FROM r',
    "asof_click": f"WITH {_E} SELECT p.event_id, c.us AS click_us_before, c.value AS click_value FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.us >= c.us",
    "merge_within_tol": f"WITH RECURSIVE {_E}, o AS (SELECT user_id, us / 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i FROM e), fold AS (SELECT user_id, i, t AS last, t AS \"at\" FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, CASE WHEN t - last > 3600 THEN t ELSE last END, CASE WHEN t - last > 3600 THEN t END FROM fold JOIN o ON o.user_id = fold.user_id AND o.i = fold.i + 1) SELECT user_id, \"at\" FROM fold WHERE \"at\" IS NOT NULL",
    "grid_snap": f"WITH RECURSIVE {_E}, c AS (SELECT DISTINCT user_id, us FROM e WHERE event_type = 'click'), h AS (SELECT user_id, median(gap) / 2 AS half FROM (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS gap FROM c) GROUP BY 1), n AS (SELECT user_id, us AS t0, (SELECT max(us) FROM c WHERE c.user_id = e.user_id AND c.us <= e.us) AS b0, (SELECT min(us) FROM c WHERE c.user_id = e.user_id AND c.us >= e.us) AS a0 FROM e WHERE event_type = 'purchase'), r AS (SELECT *, CASE WHEN a0 IS NULL OR t0 - b0 <= a0 - t0 THEN b0 ELSE a0 END AS near FROM n), o AS (SELECT user_id, t0, CASE WHEN abs(near - t0) <= half THEN near ELSE t0 END AS s0, row_number() OVER (PARTITION BY user_id ORDER BY t0) AS i FROM r LEFT JOIN h USING (user_id)), fold AS (SELECT user_id, i, s0 AS last, s0 AS snapped FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, CASE WHEN s0 > last THEN s0 WHEN t0 > last THEN t0 ELSE last END, CASE WHEN s0 > last THEN s0 WHEN t0 > last THEN t0 END FROM fold JOIN o ON o.user_id = fold.user_id AND o.i = fold.i + 1) SELECT user_id, snapped FROM fold WHERE snapped IS NOT NULL",
    "interval_overlap": f"WITH {_SPANS} SELECT x.event_id AS a, y.event_id AS b, round(least(x.hi, y.hi) - greatest(x.lo, y.lo), 3) AS overlap FROM s x JOIN s y ON x.user_id = y.user_id AND x.lo < y.hi AND y.lo < x.hi WHERE x.event_type = 'click' AND y.event_type = 'purchase'",
    "interval_merge": f"WITH {_MERGED} SELECT user_id, round(lo, 3) AS lo, round(hi, 3) AS hi, n FROM m",
    "interval_gaps": f"WITH {_MERGED}, l AS (SELECT user_id, hi AS lo, lead(lo) OVER (PARTITION BY user_id ORDER BY lo) AS hi FROM m) SELECT user_id, round(lo, 3) AS lo, round(hi, 3) AS hi FROM l WHERE hi IS NOT NULL",
    "audible_seconds": f"WITH {_MERGED} SELECT user_id, round(sum(hi - lo), 3) AS seconds FROM m GROUP BY 1",
    "active_density": f"WITH {_SPANS} SELECT event_id, (SELECT count(*) FROM s b WHERE b.event_type = 'purchase' AND b.lo <= a.lo AND a.lo < b.hi) AS active FROM s a WHERE event_type = 'click'",
    "piecewise_map": "SELECT o_orderkey, round(CASE WHEN o_totalprice < 100000 THEN o_totalprice * 0.5 WHEN o_totalprice < 300000 THEN 50000 + (o_totalprice - 100000) * 1.5 ELSE 350000 + (o_totalprice - 300000) * 0.25 END, 4) AS mapped, round(o_totalprice, 4) AS back FROM orders",
    "ext_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "ext_sliding": f"WITH {_E} SELECT (us // 21600000000 - k) * 21600000000 AS start, count(*) AS n FROM e, range(4) AS r(k) GROUP BY 1",
    "ordering_soft_votes": f"WITH a AS (SELECT event_id, value, lag(value) OVER {_W} AS b, lead(value) OVER {_W} AS c FROM events), v AS (SELECT *, greatest(0.0, coalesce(b - value, 0.0), coalesce(value - c, 0.0)) AS x FROM a) SELECT event_id, CASE WHEN b IS NULL AND c IS NULL THEN 'none' WHEN x <= 2 THEN 'in_order' ELSE 'out_of_order' END AS label, round(CASE WHEN b IS NULL AND c IS NULL THEN 0.0 WHEN x <= 2 THEN 0.8 ELSE greatest(0.02, 0.4 * exp(-(x - 2) / 30)) END, 6) AS confidence FROM v",
    "plateau_count": f"WITH a AS (SELECT user_id, coalesce((event_type <> lag(event_type) OVER {_W})::INT, 1) AS new FROM events) SELECT user_id, sum(new)::BIGINT AS runs FROM a GROUP BY 1",
    "lag_autocorrelation": f"WITH a AS (SELECT user_id, value, lag(value, 1) OVER {_W} AS l1, lag(value, 2) OVER {_W} AS l2, lag(value, 3) OVER {_W} AS l3 FROM events) SELECT user_id, round(corr(value, l1), 6) AS lag_1, round(corr(value, l2), 6) AS lag_2, round(corr(value, l3), 6) AS lag_3 FROM a GROUP BY 1",
    "positive_flux": f"WITH a AS (SELECT user_id, value - lag(value) OVER {_W} AS rise FROM events) SELECT user_id, round(sum(greatest(0, coalesce(rise, 0))), 4) AS flux FROM a GROUP BY 1",
    "markov_surprisal": f"WITH a AS (SELECT *, lag(event_type) OVER {_W} AS prev FROM events), b AS (SELECT event_id, prev, count(*) OVER (PARTITION BY user_id, prev, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pair, count(*) OVER (PARTITION BY user_id, prev ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tot FROM a) SELECT event_id, round(-log2((pair + 1) / (tot + 5)), 6) AS surprisal FROM b WHERE prev IS NOT NULL",
}
