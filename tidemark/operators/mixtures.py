"""Fusion of votes that name a value and a place: a categorical mixture over values with Gaussian inliers of the place, fitted by EM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written

# Fixed values of the model: prior odds of "none of these", half the range of outliers, bounds and starts, refinements of a mean.
NULL_PRIOR, HALF_RANGE, SIGMA_FLOOR, LOW, HIGH = 1.05, 240.0, 0.05, 0.02, 0.98
START_ACCURACY, START_INLIER, START_SIGMA, PRIOR_SIGMA, PRIOR_WEIGHT, REFINEMENTS = 0.7, 0.8, 5.0, 5.0, 3.0, 3
UNIFORM = 1 / (2 * HALF_RANGE)


def _density(x: Column, mean: Column) -> Column:
    """Of an inlier, times the share of inliers."""
    z = (x - mean) / F.col("sigma")
    return F.col("inlier") * F.exp(-0.5 * z * z - F.log("sigma") - 0.5 * math.log(2 * math.pi))


def _expected(fired: DataFrame, noise: DataFrame, unit: str, source: str, value: str, offset: str) -> DataFrame:
    """fired with `mean` (of its unit and value), `gamma` (how likely it is an inlier), `q` (posterior of its value), `q_null` and `alike` (votes for the same value)."""
    group = Window.partitionBy(unit, value)
    votes = fired.join(noise, source).withColumn("weight", 1 / (F.col("sigma") * F.col("sigma")))
    votes = votes.withColumn("mean", F.sum(F.col("weight") * F.col(offset)).over(group) / F.sum("weight").over(group))
    for _ in range(REFINEMENTS):
        inlier = _density(F.col(offset), F.col("mean"))
        votes = votes.withColumn("gamma", inlier / (inlier + (1 - F.col("inlier")) * UNIFORM))
        mass = F.sum(F.col("gamma") * F.col("weight")).over(group)
        votes = votes.withColumn("mean", F.when(mass > 0, F.sum(F.col("gamma") * F.col("weight") * F.col(offset)).over(group) / mass).otherwise(F.col("mean")))
    density = F.greatest(_density(F.col(offset), F.col("mean")) + (1 - F.col("inlier")) * UNIFORM, F.lit(1e-300))
    votes = votes.withColumns({"right": F.log("accuracy") + F.log(density), "wrong": F.log(1 - F.col("accuracy")) + math.log(UNIFORM)})
    own = votes.groupBy(unit, value).agg(F.sum(F.col("right") - F.col("wrong")).alias("gain"), F.count(F.lit(1)).alias("alike"), F.sum("wrong").alias("wrong"))
    whole = Window.partitionBy(unit)
    k, n = F.count(F.lit(1)).over(whole), F.sum("alike").over(whole)
    others = F.log(F.greatest(k - 1, F.lit(1)))  # a wrong vote is spread over the other values
    own = own.withColumns({"lp": F.col("gain") + F.sum("wrong").over(whole) - others * (n - F.col("alike")), "lp_null": math.log(NULL_PRIOR) + F.sum("wrong").over(whole) - F.log(k) * n})
    peak = F.greatest(F.max("lp").over(whole), F.col("lp_null"))
    own = own.withColumns({"odds": F.exp(F.col("lp") - peak), "odds_null": F.exp(F.col("lp_null") - peak)})
    z = F.sum("odds").over(whole) + F.col("odds_null")
    own = own.select(unit, value, "alike", (F.col("odds") / z).alias("q"), (F.col("odds_null") / z).alias("q_null"))
    return votes.select(unit, source, value, offset, "mean", "gamma").join(own, [unit, value])


def continuous_fusion(votes: DataFrame, unit: str, source: str, value: str, offset: str, rounds: int = 50, tolerance: float = 1e-4, sigma_start: dict[str, float] | None = None, sigma_prior: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(unit, value, offset, posterior, n) and (source, accuracy, sigma, inlier): each unit's most likely value, null for none of these, with its fused place; each source's noise.

    A source that fires names the true value with its accuracy, else one of the others; where it is right its place is off by a Gaussian of its sigma, or
    anywhere with 1 - inlier. Means are refined with the inliers' weights; sigma is learned from values with two votes
    at least and shrunk to the source's prior. A vote without a value or an offset abstains; a unit where all do has the null value with certainty. Null wins ties, then the
    least value. Parameters are a row a source, written after each step, and steps end when none changes by more than the tolerance;
    votes stay distributed, in windows over their unit.
    """
    fired = written(votes.filter(F.col(value).isNotNull() & F.col(offset).isNotNull()).select(unit, source, value, F.col(offset).cast("double").alias(offset)))
    given = lambda of, default: F.coalesce(F.try_element_at(F.create_map(*(x for k, v in of.items() for x in (F.lit(k), F.lit(v)))), F.col(source).cast("string")), F.lit(default)) if of else F.lit(default)
    noise = written(fired.select(source).distinct().select(source, F.lit(START_ACCURACY).alias("accuracy"), given(sigma_start, START_SIGMA).alias("sigma"), F.lit(START_INLIER).alias("inlier")))
    clamp = lambda c: F.greatest(F.lit(LOW), F.least(F.lit(HIGH), c))
    prior = F.pow(given(sigma_prior, PRIOR_SIGMA), 2)
    for _ in range(rounds):
        e = _expected(fired, noise, unit, source, value, offset)
        inner = F.col("q") * F.col("gamma")
        two = F.when(F.col("alike") >= 2, inner).otherwise(0.0)
        sums = e.groupBy(source).agg(F.sum("q").alias("hit"), F.sum(1 - F.col("q_null")).alias("fire"), F.sum(inner).alias("in"), F.sum(two * F.pow(F.col(offset) - F.col("mean"), 2)).alias("square"), F.sum(two).alias("mass"))
        learned = noise.join(sums, source).select(
            source, F.when(F.col("fire") > 0, clamp(F.col("hit") / F.col("fire"))).otherwise(F.col("accuracy")).alias("accuracy"),
            F.greatest(F.lit(SIGMA_FLOOR), F.sqrt((F.col("square") + PRIOR_WEIGHT * prior) / (F.col("mass") + PRIOR_WEIGHT))).alias("sigma"),
            F.when(F.col("hit") > 0, clamp(F.col("in") / F.col("hit"))).otherwise(F.col("inlier")).alias("inlier"),
            *(F.col(c).alias(f"__{c}") for c in ("accuracy", "sigma", "inlier")),
        )
        learned = written(learned)
        change = learned.agg(F.max(F.greatest(*(F.abs(F.col(c) - F.col(f"__{c}")) for c in ("accuracy", "sigma", "inlier"))))).first()[0]
        noise = learned.select(source, "accuracy", "sigma", "inlier")
        if change is None or change < tolerance:
            break
    told = _expected(fired, noise, unit, source, value, offset).groupBy(unit, value, "q", "q_null").agg(F.max("mean").alias("mean"), F.max("alike").alias("alike"))
    best = told.groupBy(unit).agg(F.min_by(F.struct(value, "mean", "q"), F.struct(-F.col("q"), value)).alias("best"), F.max("q_null").alias("q_null"), F.sum("alike").alias("n"))
    named = F.col("best.q") > F.col("q_null")
    found = best.select(unit, F.when(named, F.col(f"best.{value}")).alias(value), F.when(named, F.col("best.mean")).otherwise(0.0).alias(offset), F.when(named, F.col("best.q")).otherwise(F.col("q_null")).alias("posterior"), "n")
    silent = votes.select(unit).distinct().join(fired.select(unit).distinct(), unit, "left_anti")
    kinds = dict(found.dtypes)
    return found.unionByName(silent.select(unit, F.lit(None).cast(kinds[value]).alias(value), F.lit(0.0).alias(offset), F.lit(1.0).alias("posterior"), F.lit(0).cast("long").alias("n"))), noise
