"""Learned verifiers, judged on groups they haven't seen: every row's score comes from a model fitted without its group's fold."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def critic(features: list[str]) -> Pipeline:
    """Logistic regression on scaled features, weighted by the column `weight`."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol="label", weightCol="weight", regParam=1e-3, maxIter=50)])


def forest(features: list[str], trees: int = 100, depth: int = 8) -> Pipeline:
    """A random forest with two rows a leaf at least, weighted by the column `weight`."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=42)])


def balanced(rows: DataFrame) -> DataFrame:
    """rows with a `weight` under which both labels weigh alike."""
    n = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    return rows.withColumn("weight", F.when(F.col("label") == 1, n[0] / (2 * max(n[1] or 0, 1))).otherwise(n[0] / (2 * max(n[0] - (n[1] or 0), 1))))


def out_of_fold(rows: DataFrame, features: list[str], label: str, group: Column, model: Estimator, folds: int = 5, weight: Column | None = None) -> DataFrame:
    """rows with `fold` and `score`, the probability of label 1.

    Folds are hashes of the group, so a group is never in training and in test. A row with a null feature counts it as 0; rows with a null label
    are scored but not learned from. A fold whose training rows have but one label has null scores. weight: what a row weighs in training (else both labels weigh alike).
    """
    ready = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}).withColumns({"fold": F.pmod(F.xxhash64(F.coalesce(group.cast("string"), F.lit(""))), F.lit(folds)).cast("int"), "label": F.col(label).cast("double")})
    ready = written(ready)
    out = None
    for i in range(folds):
        train, test = ready.filter((F.col("fold") != i) & F.col("label").isNotNull()), ready.filter(F.col("fold") == i)
        if train.select("label").distinct().count() < 2:
            told = test.withColumn("score", F.lit(None).cast("double"))
        else:
            train = balanced(train) if weight is None else train.withColumn("weight", weight)
            told = model.fit(train).transform(test.withColumn("weight", F.lit(1.0))).withColumn("score", vector_to_array("probability")[1])
        told = told.select(*(c for c in ready.columns if c != "label" or label == "label"), "score")
        out = told if out is None else out.unionByName(told)
    return out
