"""Eligibility of labels, calibration by family and axis, paired bootstraps, and the axes that a title claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evidence
from ..sources.tables import table
from .evidence import _V, votes
from .similarity import POISSON, REPLICATES

def label_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Each unit's votes as a label for a round of co-training of the view family, and why it may not teach there, by the first rule that it breaks."""
    v = votes(spark, d)
    k = F.split("unit", "/")
    own = v.groupBy("unit").agg(F.array_sort(F.collect_set(F.when(F.col("vote").isNotNull(), F.col("source")))).alias("families"), F.min("event_id").alias("first"))
    day, user = k[1].cast("long"), k[0].cast("long")
    fault = evidence.label_fault(
        revoked=F.col("first") % 11 == 0, eligible_from=day % 4, produced_in=day % 3, families=F.col("families"),
        target=F.when(user % 5 == 0, "click").otherwise("view"), round_index=2, round_id=1, parent_id=0, consumer="view",
    )
    return own.select("unit", F.coalesce(fault, F.lit("eligible")).alias("verdict"))


def axis_calibration(spark: SparkSession, d: str) -> DataFrame:
    """For each half of the users held out: how often each source is right on either axis among the other half, under a uniform prior; a source with
    fewer than five known outcomes there takes what all have together. Placement is right within three of five; structure by confidence, unknown for abstentions."""
    v = votes(spark, d).withColumn("half", F.split("unit", "/")[0].cast("long") % 2)
    outcome = F.explode(F.array(F.struct(F.lit("placement").alias("axis"), (F.abs(F.col("at") - 5) < 3).alias("hit")), F.struct(F.lit("structure").alias("axis"), F.when(F.col("vote").isNotNull(), F.col("confidence") >= 0.5).alias("hit"))))
    known = v.select("source", "half", outcome.alias("o")).select("source", (1 - F.col("half")).alias("held"), "o.*").filter("hit IS NOT NULL")
    return evidence.family_calibration(known, ["held", "axis"], "source", F.col("hit"), 5).select("held", "axis", "source", "n", F.round("precision", 6).alias("precision"))


def paired_lift(spark: SparkSession, d: str) -> DataFrame:
    """How much more a user's clicks are worth than the same user's views: the mean difference and the ratio of means over users with both, with the middle 95 %
    of replicates in which every user draws a weight (Poisson, mean 1) from a hash."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    e = e.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES))))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", "user_id", "replicate").cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296
    weight = F.when(F.col("replicate") == 0, 1).otherwise(sum((F.when(draw >= p, 1).otherwise(0) for p in POISSON), F.lit(0)))
    e = e.withColumn("w", weight)
    mean = lambda c: F.sum(F.col("w") * c) / F.nullif(F.sum("w"), F.lit(0))
    told = e.groupBy("replicate").agg(mean(F.col("a") - F.col("b")).alias("delta"), (mean(F.col("a")) / F.nullif(mean(F.col("b")), F.lit(0.0))).alias("lift"), F.count(F.lit(1)).alias("n"))
    plain = lambda c: F.round(F.max(F.when(F.col("replicate") == 0, F.col(c))), 5).alias(c)
    bound = lambda c, p, name: F.round(F.percentile(F.when(F.col("replicate") > 0, F.col(c)), F.lit(p)), 5).alias(f"{c}_{name}")
    return told.agg(F.max("n").alias("users"), plain("delta"), bound("delta", 0.025, "low"), bound("delta", 0.975, "high"), plain("lift"), bound("lift", 0.025, "low"), bound("lift", 0.975, "high"))


SUFFIXES = (" (Live)", " Remix", " vs Other Mashup", " Bootleg remix", " rework", " edit", " flip", " VIP", " (Extended Mix)", " (EXTENDED) edit remix", " remixed", " vs. all")


def title_axes(spark: SparkSession, d: str) -> DataFrame:
    """The version and the variant that a title claims, by precedence, and whether it is some sort of remix."""
    p = table(spark, d, "part")
    title = F.concat("p_name", F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("p_partkey") % len(SUFFIXES) + 1).cast("int")))
    flag = F.col("p_partkey") % 5 == 0
    return p.select("p_partkey", text.version_tag(title, flag).alias("version"), text.is_remixish(title, flag).alias("remixish"), text.variant(title).alias("variant"))


QUERIES = {f.__name__: f for f in (label_eligibility, axis_calibration, paired_lift, title_axes)}

_POISSON = " + ".join(f"(u >= {p:.6f})::INT" for p in POISSON)
_TITLES = ", ".join(f"'{s}'" for s in SUFFIXES)
ORACLES = {
    "label_eligibility": f"WITH {_V}, u AS (SELECT unit, list_sort(list(DISTINCT source) FILTER (vote IS NOT NULL)) AS f, min(event_id) AS first, split_part(unit, '/', 1)::BIGINT AS who, split_part(unit, '/', 2)::BIGINT AS day FROM v GROUP BY unit) SELECT unit, CASE WHEN first % 11 = 0 THEN 'revoked' WHEN day % 4 > 2 THEN 'too_early' WHEN day % 3 = 1 THEN 'cycle' WHEN day % 3 <> 0 THEN 'not_parent' WHEN coalesce(len(f), 0) = 0 THEN 'unfalsifiable' WHEN list_contains(f, 'view') THEN 'view_leakage' WHEN who % 5 = 0 THEN 'other_view' ELSE 'eligible' END AS verdict FROM u",
    "axis_calibration": f"WITH {_V}, h AS (SELECT 1 - user_id % 2 AS held, source, unnest(['placement', 'structure']) AS axis, unnest([abs(at0 - 5) < 3, CASE WHEN vote IS NOT NULL THEN confidence >= 0.5 END]) AS hit FROM v), f AS (SELECT held, axis, source, count(hit) AS n, count(*) FILTER (hit) AS hits FROM h WHERE hit IS NOT NULL GROUP BY 1, 2, 3) SELECT held, axis, source, n, round(CASE WHEN n < 5 THEN (sum(hits) OVER w + 1) / (sum(n) OVER w + 2) ELSE (hits + 1) / (n + 2) END, 6) AS precision FROM f WINDOW w AS (PARTITION BY held, axis)",
    "paired_lift": f"WITH e AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events GROUP BY 1), x AS (SELECT *, ('0x' || substr(md5(user_id || ':' || k), 1, 8))::BIGINT / 4294967296 AS u FROM e, range({REPLICATES + 1}) AS r(k) WHERE a IS NOT NULL AND b IS NOT NULL), w AS (SELECT *, CASE WHEN k = 0 THEN 1 ELSE {_POISSON} END AS w FROM x), t AS (SELECT k, sum(w * (a - b)) / nullif(sum(w), 0) AS delta, (sum(w * a) / nullif(sum(w), 0)) / nullif(sum(w * b) / nullif(sum(w), 0), 0) AS lift, count(*) AS n FROM w GROUP BY 1) SELECT max(n) AS users, round(max(delta) FILTER (k = 0), 5) AS delta, round(quantile_cont(delta, 0.025) FILTER (k > 0), 5) AS delta_low, round(quantile_cont(delta, 0.975) FILTER (k > 0), 5) AS delta_high, round(max(lift) FILTER (k = 0), 5) AS lift, round(quantile_cont(lift, 0.025) FILTER (k > 0), 5) AS lift_low, round(quantile_cont(lift, 0.975) FILTER (k > 0), 5) AS lift_high FROM t",
    "title_axes": f"WITH t AS (SELECT p_partkey, lower(p_name || [{_TITLES}][(p_partkey % {len(SUFFIXES)} + 1)::INT]) AS t, p_partkey % 5 = 0 AS flag FROM part) SELECT p_partkey, CASE WHEN contains(t, ' mashup') OR contains(t, ' vs ') OR contains(t, ' vs. ') THEN 'Mashup' WHEN contains(t, ' bootleg') THEN 'Bootleg' WHEN contains(t, ' rework') THEN 'Rework' WHEN contains(t, ' remix') THEN 'Remix' WHEN contains(t, ' edit') THEN 'Edit' WHEN contains(t, ' flip') OR contains(t, ' vip') OR flag THEN 'AltVersion' END AS version, flag OR contains(t, ' rework') OR contains(t, ' remix') OR contains(t, ' mashup') OR contains(t, ' vs ') OR contains(t, ' vs. ') OR contains(t, ' bootleg') AS remixish, CASE WHEN regexp_matches(t, '\\bextended\\s+(mix|version|edit)\\b') OR contains(t, '(extended)') THEN 'extended' ELSE 'regular' END AS variant FROM t",
}
