"""Word pairs shared with benchmark items: alike by both joins, and summed up in more than one task."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import structure


@pytest.mark.parametrize("few", [0, 250_000])
def test_diagonals_by_either_join(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(structure, "FEW_PAIRS", few)
    item = "a b c d e f a b"  # "a b" twice on one diagonal counts once
    spark.createDataFrame([(1, item), (2, "x y"), (3, None), (4, "one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, "w " * k + item) for k in range(40)] + [(99, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = structure.bigram_diagonals(spark, str(tmp_path))
    assert sorted(map(tuple, own.collect())) == [(k, 1, k, 6.0) for k in range(40)]
    assert own.select(F.spark_partition_id().alias("p")).distinct().count() > 1
