"""Operators on small literal frames: nulls, ties, touching ends; greedy ones against plain Python."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import text, times, vectors
from tidemark.operators import evidence, graph, intervals, joins, picks, series
from tidemark.sources import tables


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "long", list: "array<double>"}
    schema = ", ".join(f"{k} {kinds[type(v)] if v is not None else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_pick_breaks_ties_by_a_total_order(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 0, 5), ("b", 2, None), (None, 3, 1)], "k string, id int, v int")
    got = {r["k"]: r["id"] for r in picks.first_of(df, ["k"], [F.desc("v"), F.asc("id")]).collect()}
    assert got == {"a": 0, "b": 2, None: 3}


def test_first_known_skips_nulls(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 3, "late"), ("a", 2, "early"), ("b", 1, None)], "k string, o int, v string")
    assert {r["k"]: r["v"] for r in df.groupBy("k").agg(*picks.first_known(df, ["k"], ["o"], ["v"])).collect()} == {"a": "early", "b": None}


def test_either_key_gives_each_pair_once(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    right = spark.createDataFrame([(1, 1, "same"), (1, 2, "two"), (None, 2, "half")], "a int, b int, n string")
    got = sorted((r["x"], r["n"]) for r in joins.either_key(left, right, "x", ("a", "b")).collect())
    assert got == [(1, "same"), (1, "two"), (2, "half"), (2, "two")]


def test_interval_join_matches_brute_force_and_touching_ends_do_not_count(spark):
    rng = random.Random(1)
    a = [(i, rng.randrange(3), x := float(rng.randrange(50)), x + rng.randrange(0, 30)) for i in range(60)]
    b = [(i, rng.randrange(3), x := float(rng.randrange(50)), x + rng.randrange(0, 30)) for i in range(60)] + [(99, 0, 0.0, 0.0)]
    left = spark.createDataFrame(a, "a int, k int, lo double, hi double")
    right = spark.createDataFrame(b, "b int, k int, lo2 double, hi2 double")
    got = sorted((r["a"], r["b"]) for r in joins.interval_join(left, right, ("lo", "hi"), ("lo2", "hi2"), 7.0, ["k"]).collect())
    assert got == sorted((i, j) for i, k, lo, hi in a for j, m, x, y in b if k == m and lo < y and x < hi)


def test_asof_and_nearest(spark):
    left = spark.createDataFrame([(1, "u", 10), (2, "u", 4), (3, "v", 1), (4, "u", 15)], "id int, k string, t int")
    right = spark.createDataFrame([("u", 5, "a"), ("u", 10, "b"), ("u", 20, "c")], "k string, s int, v string")
    assert {r["id"]: (r["v"], r["s_before"]) for r in joins.asof(left, right, "t", "s", ["k"], ["v"]).collect()} == {1: ("b", 10), 2: (None, None), 3: (None, None), 4: ("b", 10)}
    assert {r["id"]: r["near"] for r in joins.nearest(left, right, "t", "s", ["k"]).collect()} == {1: 10, 2: 5, 3: None, 4: 20}


def test_capped_matches_leave_out_hot_keys(spark):
    left, right = spark.createDataFrame([(1,)] * 9 + [(2,)], "k int"), spark.createDataFrame([(1,)] * 9 + [(2,)], "k int")
    assert joins.capped_matches(left, right, ["k"], 64).collect() == [(2, 1)]


def test_label_state(spark):
    df = spark.createDataFrame([(1, "x"), (2, "p"), (3, "x"), (4, "x"), (5, "p"), (6, "x")], "o int, kind string").withColumn("k", F.lit(1))
    got = [r["label"] for r in series.label_state(df, ["k"], ["o"], F.col("kind") == "p").orderBy("o").collect()]
    assert got == [None, "001", "001w1", "001w2", "002", "002w1"]


def test_sessions_part_only_above_the_gap(spark):
    df = spark.createDataFrame([(0,), (10,), (20,), (31,)], "t int").withColumn("k", F.lit(1))
    assert [r["session"] for r in series.sessions(df, ["k"], ["t"], F.col("t"), 10).orderBy("t").collect()] == [0, 0, 0, 1]


@given(st.lists(st.integers(0, 60), min_size=1, max_size=25), st.integers(0, 9))
@settings(max_examples=8, deadline=None)
def test_merge_within_keeps_what_is_far_from_the_last_kept(spark, points, tolerance):
    kept = []
    for p in sorted(points):
        if not kept or p - kept[-1] > tolerance:
            kept.append(p)
    df = spark.createDataFrame([(1, float(p)) for p in points], "k int, t double")
    assert sorted(r["t"] for r in series.merged_within(df, ["k"], "t", float(tolerance)).collect()) == kept


def test_spaced_is_greedy_from_the_top(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (1, 1.0, 9.0), (1, 2.0, 8.0), (1, 9.0, 1.0), (1, 20.0, 9.0)], "k int, t double, v double")
    assert sorted(r["t"] for r in series.spaced(df, ["k"], "t", "v", 1.5).collect()) == [1.0, 9.0, 20.0]
    assert sorted(r["t"] for r in series.spaced(df, ["k"], "t", "v", 1.5, 2).collect()) == [1.0, 20.0]


def test_grid_repair_fills_and_drops(spark):
    times_ = [0.0, 1.0, 1.2, 2.0, 3.0, 6.0, 7.0]
    df = spark.createDataFrame([(1, t) for t in times_] + [(2, 5.0), (2, 5.1)], "k int, t double")
    got = {k: sorted(round(r["t"], 6) for r in series.grid_repaired(df, ["k"], "t").collect() if r["k"] == k) for k in (1, 2)}
    assert got == {1: [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0], 2: [5.0, 5.1]}


def test_interval_algebra(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 2.0, 3.0), (1, 5.0, 9.0), (1, 6.0, 7.0), (1, 8.0, 10.0)], "k int, lo double, hi double")
    m = intervals.merged(df, ["k"], "lo", "hi")
    assert sorted((r["lo"], r["hi"], r["n"]) for r in m.collect()) == [(0.0, 3.0, 2), (5.0, 10.0, 3)]
    assert [(r["lo"], r["hi"]) for r in intervals.complement(m, ["k"], "lo", "hi").collect()] == [(3.0, 5.0)]
    assert sorted((r["lo"], r["hi"]) for r in intervals.clipped(m, "lo", "hi", 1.0, 5.0).collect()) == [(1.0, 3.0)]


def test_majority_keeps_silence_as_data(spark):
    v = spark.createDataFrame([("u", 1), ("u", 1), ("u", 2), ("w", None), ("w", None)], "unit string, vote int")
    got = {(r["unit"], r["vote"]): round(r["share"], 3) for r in evidence.majority(v, "unit", "vote").collect()}
    assert got == {("u", 1): 0.667, ("u", 2): 0.333, ("w", None): 1.0}


def test_dawid_skene_recovers_truth(spark):
    rng = random.Random(6)
    truth = {f"u{i}": rng.randrange(3) for i in range(200)}
    rows = [(u, s, t if rng.random() < a else rng.randrange(3)) for u, t in truth.items() for s, a in (("good", 0.95), ("fair", 0.7), ("poor", 0.4), ("bad", 0.35))]
    p = evidence.dawid_skene(spark.createDataFrame(rows, "unit string, source string, vote int"), "unit", "source", "vote", 4)
    best = {r["unit"]: r["vote"] for r in picks.first_of(p, ["unit"], [F.desc("posterior"), F.asc("vote")]).collect()}
    assert sum(best[u] == t for u, t in truth.items()) >= 175


def test_closure_survives_diamonds_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "y"), ("y", "x"), ("q", "q")], "child string, parent string")
    got = {(r["node"], r["ancestor"]): r["depth"] for r in graph.closure(edges, "child", "parent").collect()}
    assert got[("a", "d")] == 2 and got[("a", "e")] == 3 and got[("x", "y")] == 1 and ("q", "q") not in got
    assert {r["child"] for r in graph.on_cycles(edges, "child", "parent").collect()} == {"x", "y", "q"}


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(p,) for p in (0.01, 0.04, 0.03, 0.5)], "p double").withColumn("k", F.lit(1))
    got = {r["p"]: round(r["q"], 6) for r in series.benjamini_hochberg(df, ["k"], "p").collect()}
    assert got == {0.01: 0.04, 0.03: 0.053333, 0.04: 0.053333, 0.5: 0.5}


def test_upsert_and_append(spark):
    base = spark.createDataFrame([(1, 1, "old"), (2, 5, "keep")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 1, "new"), (2, 4, "stale"), (3, 1, "add")], "k int, v int, x string")
    assert {r["k"]: r["x"] for r in tables.latest_upsert(base, new, ["k"], "v").collect()} == {1: "new", 2: "keep", 3: "add"}
    assert [r["k"] for r in tables.append_dedup(base, new.unionByName(new), ["k"], "v").collect()] == [3]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    df.write.json(str(tmp_path / "log"))
    assert tables.json_log(spark, str(tmp_path / "log"), "k string, v int").count() == 2
    tables.replace_children(df, str(tmp_path / "t"), "k")
    tables.replace_children(df.filter("k = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "t"), "k")
    assert {(r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 9), ("b", 2)}
    assert tables.content_addressed(spark, str(tmp_path / "log")).count() >= 1


@pytest.mark.parametrize(("value", "whole", "part"), [("1h 28m", 88, 88), ("45m", 45, 45), ("2h", 120, 120), ("about 1h", None, 60), ("", None, None), ("none", None, None)])
def test_play_time(spark, value, whole, part):
    assert one(spark, times.play_time_minutes(F.col("x")), x=value) == whole
    assert one(spark, times.play_time_minutes(F.col("x"), whole=False), x=value) == part


@pytest.mark.parametrize(("value", "seconds"), [("PT1H2M3S", 3723), ("PT5S", 5), ("PT", None), ("1H", None)])
def test_iso(spark, value, seconds):
    assert one(spark, times.iso_seconds(F.col("x")), x=value) == seconds


@pytest.mark.parametrize(("value", "seconds"), [("3:07", 187), ("1:02:03", 3723), ("x", None), ("1:2:3:4", None)])
def test_timecode(spark, value, seconds):
    assert one(spark, times.timecode_seconds(F.col("x")), x=value) == seconds


def test_text_functions(spark):
    assert one(spark, F.array_join(text.artists(F.col("x")), "|"), x="A & B ft. C - T") == "A|B"
    assert one(spark, F.array_join(text.performers(F.col("x")), "|"), x="Ann B2B Bob & ann vs C") == "ann|bob"
    assert one(spark, text.plain_label(F.col("x")), x="006w2") == "6w2"
    assert one(spark, text.repaired(F.col("x")), x="BeyoncÃ©") == "Beyoncé"
    assert one(spark, text.repaired(F.col("x")), x="Beyoncé") == "Beyoncé"
    assert one(spark, text.axis_key(F.col("x"), F.lit(None).cast("string"), F.lit(" A ")), x="Remix") == "remix__regular__a"
    assert one(spark, times.cyclic_distance(F.col("x"), F.lit(11)), x=1) == 2
    assert one(spark, times.fold_interval(F.col("x"), F.lit(0.5)), x=0.98) == pytest.approx(0.49)
    assert one(spark, times.fold_interval(F.col("x"), F.lit(1.0)), x=1.45) == 1.45
    assert one(spark, times.fold_interval(F.col("x"), F.lit(1.0)), x=0.2) == pytest.approx(0.8)


@given(st.lists(st.floats(0.1, 50), min_size=2, max_size=6), st.floats(-20, 200))
@settings(max_examples=10, deadline=None)
def test_time_map_inverts(spark, steps, x):
    src, dst, knots = 0.0, 5.0, []
    for i, s in enumerate(steps):
        knots.append((src, dst))
        src, dst = src + s, dst + s * (0.5 + i % 3)
    anchors = F.array(*(F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in knots))
    assert one(spark, times.map_inverse(anchors, times.map_apply(anchors, F.col("x"))), x=float(x)) == pytest.approx(x, abs=1e-6)


def test_vectors(spark):
    assert one(spark, vectors.cosine(F.col("x"), F.array(F.lit(0.0), F.lit(2.0))), x=[0.0, 1.0]) == 1.0
    assert one(spark, vectors.cosine(F.col("x"), F.array(F.lit(0.0), F.lit(2.0))), x=[0.0, 0.0]) == 0.0
    assert one(spark, vectors.bit_agreement(F.col("x"), F.lit(0)), x=3) == 1 - 2 / 32
