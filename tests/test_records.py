"""Objects, banks, contracts, guarded edges, binned ranks and folds on small frames."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text, vectors
from tidemark.operators import graph, ranks, series
from tidemark.sources import tables


@pytest.mark.parametrize("bins", [1, 5, 64])
def test_ranks_are_those_of_a_sort(spark, bins):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, float(rng.randrange(40))) for i in range(500)] + [("a", 900, None)]
    got = {r["i"]: r for r in ranks.ranked(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], "v", ["i"], bins).collect()}
    assert 900 not in got and len(got) == 500
    for k in ("a", "b", None):
        own = sorted((v, i) for g, i, v in rows if g == k and v is not None)
        for place, (v, i) in enumerate(own, 1):
            r = got[i]
            assert (r["place"], r["rank"], r["ties"], r["of"]) == (place, 1 + sum(x < v for x, _ in own), sum(x == v for x, _ in own), len(own))


def test_q_values_fall_with_p_and_ties_share_theirs(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, round(rng.random() ** 2, 2)) for i in range(300)]
    got = {r["i"]: r["q"] for r in series.benjamini_hochberg(spark.createDataFrame(rows, "k string, i int, p double"), ["k"], "p").collect()}
    for k in "ab":
        own = sorted(p for g, _, p in rows if g == k)
        for _, i, p in (r for r in rows if r[0] == k):
            assert got[i] == pytest.approx(min(1, min(x * len(own) / (j + 1) for j, x in enumerate(own) if x >= p)))


def test_objects_are_stored_once_and_found_spoiled(spark):
    path = tempfile.mkdtemp(prefix="spark-objects-") + "/store"
    df = spark.createDataFrame([(b"a",), (b"b",), (b"a",), (None,)], "c binary")
    tables.put_objects(df, "c", path)
    tables.put_objects(df.unionByName(spark.createDataFrame([(b"new",)], "c binary")), "c", path)
    stored = spark.read.parquet(path)
    assert sorted(bytes(r["content"]) for r in stored.collect()) == [b"a", b"b", b"new"]
    told = tables.rehashed(stored.withColumn("content", F.when(F.col("content") == b"b", F.lit(b"B")).otherwise(F.col("content")))).collect()
    assert {bytes(r["content"]): (r["byte_size"], r["intact"]) for r in told} == {b"a": (1, True), b"B": (1, False), b"new": (3, True)}


def test_banks_are_led_by_what_they_hold(spark):
    path = tempfile.mkdtemp(prefix="spark-banks-") + "/banks"
    tables.write_banks(spark.createDataFrame([(1, 10, "x"), (1, 11, None), (2, 12, "y")], "bank int, id int, s string"), "bank", path)
    got = sorted(map(tuple, tables.read_banks(spark, path, "bank", "bank int, id int, s string").collect()), key=str)
    assert got == [(1, 10, "x", 2), (1, 11, None, 2), (2, 12, "y", 1)]
    spark.createDataFrame([('{"bank":"3","id":1}', 3)], "value string, of int").write.partitionBy("of").mode("append").text(path)
    with pytest.raises(ValueError, match="bank 3"):
        tables.read_banks(spark, path, "bank", "bank int, id int, s string")


def test_contracts_name_every_broken_rule(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "i int, v int")
    got = {r["i"]: r["problems"] for r in tables.checked(df, {"missing": F.col("v").isNull(), "negative": F.col("v") < 0}).collect()}
    assert got == {1: [], 2: ["missing"], 3: ["negative"]}


def test_edges_that_would_close_a_cycle_are_refused(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("d", "a")], "child string, parent string")
    asked = spark.createDataFrame([("a", "d"), ("a", "a"), ("b", "d"), ("d", "b"), ("x", "a"), ("a", "x")], "child string, parent string")
    got = {(r["child"], r["parent"]): r["verdict"] for r in graph.guarded(edges, asked, "child", "parent").collect()}
    assert got == {("a", "d"): "cycle", ("a", "a"): "self", ("b", "d"): "cycle", ("d", "b"): "ok", ("x", "a"): "ok", ("a", "x"): "ok"}


def test_folds_blobs_and_wrapped_urls(spark):
    df = spark.createDataFrame([("Ünïcödé ﬁ ½",), (None,), ("plain",)], "w string")
    assert [r[0] for r in df.select(text.folded("w")).collect()] == ["Unicode fi 1⁄2", None, "plain"]
    blobs = spark.createDataFrame([([1.5, -2.0, 3.0, 4.0],), (None,), ([1.0],)], "v array<float>").select(vectors.to_blob("v").alias("b"))
    assert [r[0] for r in blobs.select(vectors.from_blob("b", 2)).collect()] == [[[1.5, -2.0], [3.0, 4.0]], None, None]
    urls = ["http://a/?url=http%3A%2F%2Fb%2F%3Fu%3Dhttps%253A%252F%252Fc%252F", "http://a/?x=1", "http://a/?url=not%20one", "http://a/?curl=http%3A%2F%2Fb", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(text.unwrapped(F.col("u"), ("url", "u"))).collect()]
    assert got == ["https://c/", *urls[1:]]


def test_versions_by_precedence(spark):
    cases = [("A Remix", False, "Remix", True, "regular"), ("A vs B remix", False, "Mashup", True, "regular"), ("A edit remix", False, "Remix", True, "regular"), ("A edit", False, "Edit", False, "regular"), ("A", True, "AltVersion", True, "regular"), ("A", False, None, False, "regular"), ("A VIP", None, "AltVersion", False, "regular"), ("A (Extended  Mix)", False, None, False, "extended"), ("remix", False, None, False, "regular")]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, r boolean")
    got = df.select(text.version_tag(F.col("t"), F.col("r")), text.is_remixish(F.col("t"), F.col("r")), text.variant(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [c[2:] for c in cases]


def test_labels_are_refused_by_the_first_rule_they_break(spark):
    from tidemark.operators.evidence import label_fault

    rows = [("revoked", True, 9, 1, ["a"], "v"), ("too_early", False, 3, 1, ["a"], "v"), ("cycle", False, 2, 1, ["a"], "v"), ("not_parent", None, 2, 7, ["a"], "v"), ("unfalsifiable", False, 2, 0, [], "v"), ("view_leakage", False, 0, 0, ["a", "v"], "w"), ("other_view", False, 0, 0, ["a"], "w"), (None, False, 2, 0, ["a"], "v"), ("unfalsifiable", False, 2, 0, None, "v")]
    df = spark.createDataFrame(rows, "want string, revoked boolean, since int, made int, families array<string>, target string")
    c = F.col
    got = df.select("want", label_fault(c("revoked"), c("since"), c("made"), c("families"), c("target"), 2, 1, 0, "v").alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
