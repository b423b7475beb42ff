"""Greedy matches, assignments and classes by plain Python, and the mended rules by hand."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.operators import evidence, graph, intervals
from tidemark.plans import catalog, matching
from tidemark.plans.timeline import events


def greedy(a, b, tolerance):
    used, out = set(), []
    for x, name in sorted(a):
        best, off = None, tolerance + 1e-9
        for k, (y, _) in enumerate(sorted(b)):
            if k not in used and abs(x - y) <= off:
                best, off = k, abs(x - y)
        if best is not None:
            used.add(best)
            out.append((name, sorted(b)[best][1]))
    return out


def test_tolerance_matches(spark, sf_dir):
    sides = defaultdict(lambda: ([], []))
    for r in matching._boundaries(spark, sf_dir).collect():
        sides[r["user_id"]][r["side"]].append((r["at"], r["event_id"]))
    want = sorted((u, *p) for u, (a, b) in sides.items() for p in greedy(a, b, 2.0))
    got = sorted((r["user_id"], r["a"], r["b"]) for r in matching.tolerance_matches(spark, sf_dir).collect())
    assert got == want and want
    scores = {r["user_id"]: r for r in matching.tolerance_scores(spark, sf_dir).collect()}
    for u, (a, b) in sides.items():
        hits = sum(1 for w in want if w[0] == u)
        assert scores[u]["hits"] == hits and scores[u]["recall"] == pytest.approx(hits / len(b) if b else 0, abs=1e-6)


def test_injective_assignment(spark, sf_dir):
    days = defaultdict(lambda: ([], []))
    for r in events(spark, sf_dir).filter("event_type IN ('purchase', 'signup')").collect():
        days[r["user_id"], r["us"] // 86_400_000_000][r["event_type"] == "signup"].append((r["event_id"], r["us"]))
    want = []
    for (u, _), (a, b) in days.items():
        pairs, seen = sorted((abs(x - y), i, j) for i, x in a for j, y in b), set()
        for _, i, j in pairs:
            if not {("a", i), ("b", j)} & seen:
                seen |= {("a", i), ("b", j)}
                want.append((u, i, j))
    assert sorted(map(tuple, matching.injective_assignment(spark, sf_dir).collect())) == sorted(want) != []


def test_repeat_classes(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").collect()
    root = {p["p_partkey"]: p["p_partkey"] for p in parts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    for p in parts:
        for key in (("n", p["p_name"], p["p_size"]), ("b", p["p_brand"], int(p["p_retailprice"]))):
            a, b = find(first.setdefault(key, p["p_partkey"])), find(p["p_partkey"])
            root[max(a, b)] = min(a, b)
    got = {r["p_partkey"]: r["class"] for r in matching.repeat_classes(spark, sf_dir).collect()}
    assert got == {k: find(k) for k in root}


def test_long_chains_are_whole(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert graph.closure(edges, "a", "b").count() == 60 * 61 // 2
    assert graph.on_cycles(edges, "a", "b").count() == 0
    assert {r["root"] for r in graph.components(edges, "a", "b").collect()} == {0}


def test_abstaining_votes_are_no_channels(spark):
    rows = [("u", "a", 1.0, 0.6, 1), ("u", "b", 1.2, 0.9, None), ("v", "a", 1.0, 0.9, None), ("w", "a", 1.0, 0.6, 1), ("w", "b", 1.5, 0.6, 1)]
    votes = spark.createDataFrame(rows, "unit string, source string, at double, confidence double, vote int")
    got = {r["unit"]: (r["n"], r["band"]) for r in evidence.bands(votes, "unit", "source", "at", "confidence", F.col("vote").isNull()).collect()}
    assert got == {"u": (1, "ABSTAIN"), "v": (0, "ABSTAIN"), "w": (2, "ACCEPT")}


def test_none_of_these_is_a_hypothesis(spark):
    rows = [("u", "a", 1), ("u", "b", 1), ("v", "a", None), ("w", "a", 2), ("w", "b", 3)]
    votes = spark.createDataFrame(rows, "unit string, source string, vote int")
    got = {(r["unit"], r["vote"]): r["posterior"] for r in evidence.dawid_skene(votes, "unit", "source", "vote", 0).collect()}
    assert got["v", None] == 1.0
    # One value, K = 1: right twice 0.49, none of these 1.05 * 0.3 ** 2.
    assert got["u", 1] == pytest.approx(0.49 / (0.49 + 1.05 * 0.09)) and got["u", None] == pytest.approx(1 - got["u", 1])
    value, null = 0.7 * 0.3, 1.05 * 0.15 * 0.15
    assert got["w", 2] == pytest.approx(value / (2 * value + null))
    assert [(r["vote"], r["place"]) for r in evidence.hypotheses(votes, "unit", "vote").filter("unit = 'w'").orderBy("place").collect()] == [(None, 0), (2, 1), (3, 2)]


def test_trajectories_go_on_at_their_edges(spark):
    piece = lambda lo, hi, dst, slope: F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(dst).alias("dst"), F.lit(slope).alias("slope"))
    pieces = F.array(piece(0.0, 10.0, 5.0, 1.0), piece(10.0, 20.0, 100.0, 2.0))
    got = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 10.0, 12.0, 25.0)], "x double").select(times.trajectory_value(pieces, F.col("x")).alias("y"))
    assert [r["y"] for r in got.collect()] == [4.0, 5.0, 15.0, 104.0, 130.0]


def test_repeated_and_missing_points_are_counted_right(spark):
    points = spark.createDataFrame([("p", 5.0, None), ("p", 5.0, None), ("q", None, 1)], "name string, at double, x int")
    spans = spark.createDataFrame([(0.0, 10.0), (5.0, 6.0), (6.0, 4.0)], "lo double, hi double")
    assert sorted((r["name"], r["active"]) for r in intervals.active_at(points, spans, "at", "lo", "hi", 3.0).collect()) == [("p", 2), ("p", 2), ("q", 0)]


def test_offset_votes_answer_for_all_pairs_that_share_a_landmark(spark, sf_dir):
    from tidemark.plans import evidence as plans

    users = defaultdict(set)
    for r in plans.landmark_hashes(spark, sf_dir).collect():
        users[r["f1"], r["f2"], r["dt"]].add(r["user_id"])
    want = {(m, n) for own in users.values() for m in own for n in own if m % 2 == 0 and n % 2 == 1}
    got = plans.offset_votes(spark, sf_dir).collect()
    assert {(r["mix"], r["ref"]) for r in got} == want and len(got) == len(want) > 3 * len({m for m, _ in want})


@pytest.mark.parametrize("name", ["expanded_segments", "merged_segments", "rank_correlation", "borda_points", "margin_gate", "dense_competitive", "chunked_union", "window_matches"])
def test_windows_run_in_as_many_tasks_as_a_shuffle_has(spark, sf_dir, name):
    """Adaptive execution would put these small tables, and large ones up to the bytes it aims at, into few tasks."""
    own = catalog.QUERIES[name](spark, sf_dir)
    assert own.select(F.spark_partition_id().alias("p")).distinct().count() > 1


@pytest.mark.parametrize("name", ["rank_correlation", "borda_points", "margin_gate", "dense_competitive", "merged_segments", "landmark_hashes"])
def test_large_tables_are_dealt_to_more_tasks(spark, sf_dir, name, monkeypatch):
    """However few parts a shuffle has, a task's rows and memory don't grow with the table."""
    from tidemark.operators import streams

    monkeypatch.setattr(streams, "ROWS", 50, raising=False)
    own = catalog.QUERIES[name](spark, sf_dir)
    assert own.select(F.spark_partition_id().alias("p")).distinct().count() > streams.tasks_of(own)


@pytest.mark.parametrize("name", ["borda_points", "margin_gate"])
def test_a_tasks_rows_do_not_grow_with_the_table(spark, sf_dir, tmp_path, monkeypatch, name):
    """Eight copies of the lines under keys of their own, dealt once for all windows and sums."""
    from tidemark.operators import streams

    monkeypatch.setattr(streams, "ROWS", 300)
    keys = ("l_orderkey", "l_partkey", "l_suppkey")
    copies = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    copies.withColumns({c: F.col(c) + 1_000_000 * F.col("k") for c in keys}).drop("k").write.parquet(f"{tmp_path}/lineitem.parquet")
    one, eight = (catalog.QUERIES[name](spark, d) for d in (sf_dir, str(tmp_path)))
    assert eight.count() == 8 * one.count()
    most = [own.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] for own in (one, eight)]
    assert most[1] < 2 * most[0]
    assert eight._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_dense_competitive_leaves_out_lines_without_part_or_supplier(spark, tmp_path):
    rows = [(1, "A", 7, 5.0, "2024-01-01"), (1, "A", 8, 4.0, "2024-01-02"), (1, "A", None, 9.0, "2024-01-01"), (None, "A", 7, 1.0, "2024-01-01")]
    line = spark.createDataFrame(rows, "l_partkey long, l_returnflag string, l_suppkey long, l_extendedprice double, d string")
    line.select("*", F.to_timestamp_ntz("d").alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, matching.dense_competitive(spark, str(tmp_path)).collect())) == [(1, 7, 1), (1, 8, 2)]


def test_closest_first_is_what_sorting_all_pairs_gives():
    draw = random.Random(8)
    for _ in range(400):
        points = [(draw.randrange(draw.choice((3, 12, 60))), draw.randrange(2), row) for row in draw.sample(range(99), draw.randrange(14))]
        pairs, seen, want = sorted((abs(x - y), i, j) for x, a, i in points for y, b, j in points if (a, b) == (0, 1)), set(), []
        for _, i, j in pairs:
            if not {i, j} & seen:
                seen |= {i, j}
                want.append((i, j))
        assert matching.closest_first(points) == want


def test_a_day_of_many_events_is_paired_without_all_pairs():
    draw = random.Random(9)
    assert len(matching.closest_first([(draw.randrange(86_400_000_000), row % 2, row) for row in range(60_000)])) == 30_000  # 7 GB of distances else


def test_components_send_no_table_through_the_driver(spark, sf_dir):
    own = matching.repeat_classes(spark, sf_dir)
    own.collect()
    assert "Broadcast" not in own._jdf.queryExecution().executedPlan().toString()
