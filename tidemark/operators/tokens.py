"""Vectors as tokens: seeded k-means on unit vectors."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors


def quantized(df: DataFrame, column: str, k: int, seed: int = 0, token: str = "token") -> DataFrame:
    """df with the number of the nearest of k centres; only the centres come to the driver.

    Rows whose vector is null, empty or zero have no direction: they train nothing and their token is null.
    A vector's length must be the same in all rows.
    """
    length = vectors.norm(F.col(column))
    rows = df.withColumn("__vector", F.when(length > 0, array_to_vector(F.col(column).cast("array<double>"))))
    # The normalizer takes each norm once; in a lambda over the elements it would be taken for each of them.
    whole = Normalizer(inputCol="__vector", outputCol="__unit").transform(rows.filter(F.col("__vector").isNotNull()))
    if whole.isEmpty():
        return df.withColumn(token, F.lit(None).cast("int"))
    model = KMeans(k=k, seed=seed, featuresCol="__unit", predictionCol=token).fit(whole)
    rest = rows.filter(F.col("__vector").isNull()).withColumn(token, F.lit(None).cast("int"))
    return model.transform(whole).drop("__unit").unionByName(rest).drop("__vector")
