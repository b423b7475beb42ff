"""Streaming decoders and average linkage against exhaustive search on small grids."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import classes, decoders


def paths(frames):
    return itertools.product(*[sorted(f) for f in frames])


@pytest.mark.parametrize("costs", [{"forward": 1.0}, {"forward": 0.5, "backward": 2.0}, {"forward": 0.3, "backward": 1.0, "forward_slope": 0.2, "backward_slope": 0.4}, {"forward": 0.5, "early": 0.3}])
def test_directional_path_is_the_best_of_all(spark, costs):
    rng = random.Random(7)
    groups = {f"g{g}": [{s: round(rng.random() * 3, 2) for s in rng.sample(range(6), rng.randrange(1, 6))} for _ in range(5)] for g in range(8)}
    rows = [(g, t, s, v) for g, frames in groups.items() for t, f in enumerate(frames) for s, v in f.items()]
    rows += [(None, 0, 1, 1.0), (None, 1, 1, 1.0), ("g0", 0, 99, None), ("g0", 0, None, 5.0), ("g0", 0, 98, float("nan"))]
    df = spark.createDataFrame(rows, "g string, t int, s int, v double").repartition(5)
    got = {}
    for r in decoders.directional_path(df, ["g"], "t", "s", "v", **costs).collect():
        got.setdefault(r["g"], {})[r["t"]] = (r["s"], r["total"])
    up, down, u, w, early = costs["forward"], costs.get("backward", costs["forward"]), costs.get("forward_slope", 0), costs.get("backward_slope", 0), costs.get("early", 0)

    def worth(frames, path):
        jump = lambda a, b: 0 if a == b else up + u * (b - a) if b > a else down + w * (a - b)
        return sum(f[s] - early * s for f, s in zip(frames, path, strict=True)) - sum(jump(a, b) for a, b in itertools.pairwise(path))

    for g, frames in groups.items():
        best = max(worth(frames, p) for p in paths(frames))
        found = [got[g][t][0] for t in range(5)]
        assert got[g][0][1] == pytest.approx(best) and worth(frames, found) == pytest.approx(best)
    assert got[None] == {0: (1.0, pytest.approx(2.0 - 2 * early)), 1: (1.0, pytest.approx(2.0 - 2 * early))}


def test_staying_wins_ties_and_long_groups_go_through_many_batches(spark):
    df = spark.createDataFrame([(0, 0, 5.0), (0, 1, 5.0), (1, 0, 1.0), (1, 1, 2.0)], "t int, s int, v double").withColumn("g", F.lit(1))
    got = {r["t"]: r["s"] for r in decoders.directional_path(df, ["g"], "t", "s", "v", 1.0).collect()}
    assert got == {0: 1.0, 1: 1.0}  # 6 by staying at 0 or by going up, 7 by staying at 1
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        long = spark.range(900).select(F.lit(1).alias("g"), F.floor(F.col("id") / 3).cast("int").alias("t"), (F.col("id") % 3).cast("int").alias("s")).withColumn("v", F.when(F.col("s") == F.floor(F.col("t") / 100), 1.0).otherwise(0.0))
        path = decoders.directional_path(long, ["g"], "t", "s", "v", 2.0).orderBy("t").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert [r["s"] for r in path] == [float(t // 100) for t in range(300)] and path[0]["total"] == 296.0


def test_staying_wins_ties_over_jumping(spark):
    df = spark.createDataFrame([(1, 0, 0, 4.0), (1, 0, 1, 5.0), (1, 1, 0, 3.0), (1, 1, 1, 1.0)], "g int, t int, s int, v double")
    got = decoders.directional_path(df, ["g"], "t", "s", "v", 1.0).orderBy("t").collect()
    assert [(r["s"], r["total"]) for r in got] == [(0.0, 7.0), (0.0, 7.0)]  # 1 then down to 0 is worth 7 as well


def test_segments_end_where_the_next_begins_and_the_best_stretch_wins(spark):
    rows = [("a", st, t, p, v) for st, line in ((1.0, [10, 10, 40, 40]), (2.0, [5, 5, 5, 9])) for t, q in enumerate(line) for p, v in ((q, 1.0 if st == 1.0 else 0.8), (3, 0.1))]
    df = spark.createDataFrame(rows, "g string, stretch double, t int, place int, v double").withColumn("end", F.lit(6.0))
    got = decoders.path_segments(df, ["g"], "stretch", "t", "place", "v", "end", forward=0.5).orderBy("mix_start").collect()
    assert [(r["mix_start"], r["ref_start"], r["ref_end"], r["stretch"], r["total"]) for r in got] == [(0, 10.0, 12.0, 1.0, 3.5), (2, 42.0, 46.0, 1.0, 3.5)]


def test_monotone_choice_is_the_best_of_all(spark):
    rng = random.Random(3)
    slack, abstain, sigma = 2.0, 0.6, 20.0
    groups = {g: [[(round(rng.uniform(0, 40), 1), round(rng.random() * 2, 2)) for _ in range(rng.randrange(0, 4))] for _ in range(5)] for g in range(8)}
    rows = [(g, i, p, s, float(8 * i)) for g, spans in groups.items() for i, own in enumerate(spans) for p, s in [*own, (None, None)]]
    df = spark.createDataFrame(rows, "g int, i int, p double, s double, e double")
    got = {}
    for r in decoders.monotone_choice(df, ["g"], "i", "p", "s", F.col("e"), sigma, slack, abstain).collect():
        got.setdefault(r["g"], {})[r["i"]] = (r["p"], r["total"])
    for g, spans in groups.items():
        options = [[*((p, s * math.exp(-0.5 * ((p - 8 * i) / sigma) ** 2)) for p, s in own), (None, abstain)] for i, own in enumerate(spans)]
        allowed = lambda a, b: a[0] is None or b[0] is None or b[0] >= a[0] - slack
        best = max(sum(x[1] for x in path) for path in itertools.product(*options) if all(allowed(a, b) for a, b in itertools.pairwise(path)))
        assert got[g][0][1] == pytest.approx(best)
        chosen = [next(x for x in options[i] if x[0] == got[g][i][0]) for i in range(5)]
        assert all(allowed(a, b) for a, b in itertools.pairwise(chosen)) and sum(max(x[1] for x in options[i] if x[0] == c[0]) for i, c in enumerate(chosen)) == pytest.approx(best)


def test_cover_finds_two_lines_and_the_gap_between(spark):
    rng = random.Random(5)
    points = [("a", t / 2, 10.0 + rng.uniform(-0.2, 0.2), 1.0) for t in range(40)] + [("a", 40 + t / 2, 30.0 + rng.uniform(-0.2, 0.2), 1.0) for t in range(40)]
    points += [("a", rng.uniform(0, 60), rng.uniform(0, 60), 1.0) for _ in range(10)] + [("b", 1.0, 5.0, 1.0)]
    df = spark.createDataFrame(points, "g string, at double, offset double, weight double").withColumn("span", F.lit(60.0))
    lines = spark.createDataFrame([("a", 0, 10.0), ("a", 1, 30.0)], "g string, line int, intercept double")
    got = decoders.segment_cover(df, lines, ["g"], "span", F.lit(1.0)).orderBy("at").collect()
    assert [r["line"] for r in got] == [0, 1] and {r["g"] for r in got} == {"a"}
    assert abs(got[0]["at"]) < 1 and 18 < got[0]["until"] < 27 and 33 < got[1]["at"] < 42 and got[1]["until"] > 57
    assert got[0]["ref_at"] == pytest.approx(10 + got[0]["at"]) and got[1]["ref_until"] == pytest.approx(30 + got[1]["until"])


def test_support_sums_kernels_of_points_on_the_line(spark):
    points = [("a", 1.0, 5.0, 2.0), ("a", 3.0, 5.59, 1.0), ("a", 3.0, 5.61, 1.0), ("a", 2.0, 4.4, 1.0)]
    df = spark.createDataFrame(points, "g string, at double, offset double, weight double")
    lines = spark.createDataFrame([("a", 0, 5.0)], "g string, line int, intercept double")
    got = {r["step"]: r["support"] for r in decoders.support(df, lines, ["g"], ["line"], 0.5, 0.6, 1.0).collect()}
    on = [(1.0, 2.0), (3.0, 1.0), (2.0, 1.0)]
    for step, value in got.items():
        assert value == pytest.approx(sum(w * math.exp(-0.5 * (step / 2 - t) ** 2) for t, w in on if abs(step / 2 - t) <= 5))


def merged_greedily(nodes, similarity, threshold):
    groups = [[i] for i in nodes]
    while len(groups) > 1:
        mean = lambda x, y: sum(similarity.get((min(a, b), max(a, b)), 0.0) for a in x for b in y) / (len(x) * len(y))
        best, i, j = max((mean(groups[i], groups[j]), -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if best <= threshold:
            break
        groups[-i] += groups.pop(-j)
    return {x: min(g) for g in groups for x in g}


@pytest.mark.parametrize("seed", range(3))
def test_average_linkage_merges_what_greedy_merging_does(spark, seed):
    rng = random.Random(seed)
    nodes = range(40)
    similarity = {(a, b): rng.random() ** (1 if a % 5 == b % 5 else 4) for a in nodes for b in range(a + 1, 40) if rng.random() < 0.5}
    rows = [(a, b, s) if rng.random() < 0.5 else (b, a, s) for (a, b), s in similarity.items()] + [(3, 3, 1.0), (None, 1, 1.0), (1, 2, None), (90, 91, 0.1), (92, 93, 0.9), (93, 92, 0.2)]
    got = {r["node"]: (r["class"], r["mates"]) for r in classes.average_linkage(spark.createDataFrame(rows, "x long, y long, s double"), "x", "y", "s", 0.45).collect()}
    want = merged_greedily(nodes, similarity, 0.45)
    assert {k: v[0] for k, v in got.items() if k < 40} == {k: v for k, v in want.items() if k in got}
    assert got[90] == (90, 0.0) and got[91] == (91, 0.0) and got[92] == (92, 0.9) and got[93] == (92, 0.9)
    for i, (c, mates) in got.items():
        if i < 40:
            others = [j for j in want if want[j] == c and j != i]
            assert mates == pytest.approx(sum(similarity.get((min(i, j), max(i, j)), 0.0) for j in others) / len(others) if others else 0.0)


def test_a_placement_is_ambiguous_in_a_class_with_two_sections(spark):
    sections = spark.createDataFrame([("a", 0.0, 10.0, 1, 0.8), ("a", 20.0, 30.0, 1, 0.7), ("a", 40.0, 50.0, 2, 0.0), ("a", 60.0, 61.0, 2, 0.3), ("a", 45.0, 48.0, 3, 0.5)], "g string, lo double, hi double, class long, mates double")
    places = spark.createDataFrame([("a", 5.0), ("a", 30.0), ("a", 41.0), ("a", 46.0), ("b", 5.0), ("a", None)], "g string, at double")
    got = {(r["g"], r["at"]): (r["class"], r["instances"], r["membership"], r["ambiguous"]) for r in classes.placed_ambiguity(places, sections, ["g"], "at", "lo", "hi", 4.0, 7.0).collect()}
    assert got == {("a", 5.0): (1, 2, 0.8, True), ("a", 30.0): (None, 1, None, False), ("a", 41.0): (2, 1, 0.0, False), ("a", 46.0): (3, 1, 0.5, False), ("b", 5.0): (None, 1, None, False), ("a", None): (None, 1, None, False)}


def test_small_and_large_frames_alike_in_any_batches(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(u, t, float(s), float(draw.choice((0, 1, 2, 5)))) for u in range(7) for t in range(draw.randint(1, 9)) for s in draw.sample(range(9), draw.randint(1, 7))]
    e = spark.createDataFrame(rows, "u int, t int, s double, v double")
    found = []
    for small, batch in ((0, 10_000), (32, 10_000), (6, 2), (1_000, 5)):
        monkeypatch.setattr(decoders, "SMALL", small)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            found.append(sorted(map(tuple, decoders.directional_path(e, ["u"], "t", "s", "v", 2.0, 3.0, 0.25, 0.5).collect())))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) == len({r[:2] for r in rows})


def test_decoders_deal_keys_to_tasks_by_number(spark):
    """Few bytes that make much work stay dealt to as many tasks as a shuffle has; adaptive execution doesn't put them into one."""
    e = spark.range(4_000).select((F.col("id") % 400).alias("u"), F.floor(F.col("id") / 400).alias("t"), F.lit(1.0).alias("s"), F.lit(1.0).alias("v"))
    path = decoders.directional_path(e, ["u"], "t", "s", "v", 1.0)
    assert path.count() == 4_000 and path.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_classes_within_keys_are_those_of_all_links_without_rounds(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, 100 * k + a, 100 * k + b, rng.random()) for k in range(6) for a in range(25) for b in range(a + 1, 25) if rng.random() < 0.3]
    links = spark.createDataFrame([*rows, *((k, b, a, s / 2) for k, a, b, s in rows[::3]), (7, 900, 901, 0.1), (7, 902, 902, 0.9), (None, 910, 911, 0.9)], "k int, a long, b long, s double")
    want = sorted(map(tuple, classes.average_linkage(links, "a", "b", "s", 0.6).collect()))
    monkeypatch.setattr(classes.graph, "components", None)
    assert sorted(map(tuple, classes.average_linkage(links, "a", "b", "s", 0.6, ["k"]).collect())) == want and len(want) > 100
