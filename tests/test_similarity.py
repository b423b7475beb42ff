"""Peaks, tokens and the join guard on small frames."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.operators import joins, tokens
from tidemark.sources.tables import table


def test_local_maxima(spark):
    m = {(0, 0): 3.0, (0, 1): 2.0, (1, 1): 1.0, (3, 3): 1.0, (3, 4): 1.0, (-1, -1): 2.5}
    got = joins.local_maxima(spark.createDataFrame([("g", *at, w) for at, w in m.items()], "g string, i int, j int, w double"), ["g"], ("i", "j"), "w")
    assert {(r["i"], r["j"]) for r in got.collect()} == {(0, 0), (3, 3), (3, 4)}


def test_tokens_are_the_nearest_centres(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = tokens.quantized(e, "embedding", 8).toPandas()
    x = np.array(out["embedding"].tolist(), dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = np.array([x[out["token"] == k].mean(axis=0) for k in range(8)])
    nearest = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert len(out) == e.count() and (nearest == out["token"]).mean() > 0.95
    assert out.equals(tokens.quantized(e, "embedding", 8).toPandas()) or set(zip(out["vec_id"], out["token"])) == set(zip(*tokens.quantized(e, "embedding", 8).toPandas()[["vec_id", "token"]].values.T))


def test_tokens_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [0.0, 2.0]), (6, [3.0, 0.0])]
    got = {r["id"]: r["token"] for r in tokens.quantized(spark.createDataFrame(rows, "id int, v array<double>"), "v", 2).collect()}
    assert got[1] == got[6] != got[5] and {got[k] for k in (2, 3, 4)} == {None}
    assert tokens.quantized(spark.createDataFrame(rows[1:3], "id int, v array<double>"), "v", 2).count() == 2


def test_same_subject(spark):
    one, other = (spark.createDataFrame([(k, 1)], "k string, x int") for k in ("a", "b"))
    joins.same_subject(one, one, "k")
    with pytest.raises(ValueError):
        joins.same_subject(one, other, "k")


def test_wheel_steps(spark):
    cases = [("8A", "8A", 0), ("8A", "8B", 1), ("12A", "1A", 1), ("1A", "12B", 2), ("3B", "9B", 6), ("x", "1A", None), (None, "1A", None)]
    got = spark.createDataFrame(cases, "a string, b string, want int").select(times.wheel_steps(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_work_of_tokens_grows_with_a_vectors_length_not_its_square(spark):
    rows = spark.range(64).select("id", F.transform(F.sequence(F.lit(1), F.lit(8192)), lambda i: (F.col("id") % 2 * 2 - 1) * i.cast("double")).alias("v"))
    began = time.monotonic()
    got = {(r["id"] % 2, r["token"]) for r in tokens.quantized(rows, "v", 2).collect()}
    assert len(got) == 2 and len({t for _, t in got}) == 2
    assert time.monotonic() - began < 40
