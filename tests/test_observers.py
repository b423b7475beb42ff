"""Special functions, the adaptive chain, novelty, matched filters and the continuous mixture against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import special
from tidemark.operators import mixtures, observers, series
from tidemark.operators.evidence import margin_gate
from tidemark.operators.joins import interval_join
from tidemark.plans.matching import diagonals


def test_log_gamma_and_digamma(spark):
    xs = [1e-6, 0.1, 0.5, 1.0, 1.5, 2.0, 7.3, 100.0, 1e6]
    df = spark.createDataFrame([(x,) for x in [*xs, 0.0, -1.0, None]], "x double")
    got = df.select(special.log_gamma(F.col("x")), special.digamma(F.col("x"))).collect()
    for x, (a, b) in zip(xs, got, strict=False):
        assert a == pytest.approx(math.lgamma(x), rel=1e-10, abs=1e-10)
        h = 1e-4 * x
        assert b == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel=1e-5, abs=1e-5)
    assert all(r == (None, None) for r in map(tuple, got[len(xs) :]))
    assert got[3][1] == pytest.approx(-0.5772156649015329, abs=1e-11)


def test_dirichlet_divergence(spark):
    df = spark.createDataFrame([([1.5, 2.0, 3.0], [0.5, 2.0, 4.0]), ([2.0, 2.0], [2.0, 2.0])], "q array<double>, p array<double>")
    got = [r[0] for r in df.select(special.dirichlet_divergence(F.col("q"), F.col("p"))).collect()]
    rng = np.random.default_rng(1)
    q, p = np.array([1.5, 2.0, 3.0]), np.array([0.5, 2.0, 4.0])
    draws = np.log(rng.dirichlet(q, 400_000))
    norm = lambda a: math.lgamma(a.sum()) - sum(map(math.lgamma, a))
    assert got[0] == pytest.approx(norm(q) - norm(p) + (draws @ (q - p)).mean(), abs=0.02) and got[1] == pytest.approx(0)


def test_the_chain_tells_what_plain_formulas_do(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.choice([0, 0, 1, 2])) for g in ("a", "b") for i in range(40)] + [("a", 100, None), ("a", 101, 7)]
    got = {(r["g"], r["i"]): r for r in observers.adaptive_markov(spark.createDataFrame(rows, "g string, i int, s int").repartition(3), ["g"], ["i"], "s", "i", 3).collect()}
    assert len(got) == 80
    for g in ("a", "b"):
        theta, prev, doubt = np.full((3, 3), 0.5), None, None
        for i in range(40):
            s = next(x for k, j, x in rows if k == g and j == i)
            r = got[g, i]
            if prev is None:
                assert all(r[c] == 0 for c in observers.READOUTS)
                own = None
            else:
                a = theta / theta.sum(axis=0)
                p = a[:, prev]
                own = -(p * np.log(p)).sum()
                assert r["surprisal"] == pytest.approx(-math.log(p[s])) and r["uncertainty"] == pytest.approx(own)
                assert r["uncertainty_drop"] == pytest.approx(0 if doubt is None else doubt - own)
                q, col = theta[:, prev] + np.eye(3)[s], theta[:, prev]
                lbeta = lambda x: sum(map(math.lgamma, x)) - math.lgamma(sum(x))
                want = lbeta(col) - lbeta(q) + sum((u - v) * (observers.digamma(u) - observers.digamma(sum(q))) for u, v in zip(q, col, strict=True))
                assert r["model_information"] == pytest.approx(want, abs=1e-9)
                gain = [max(0, sum(a[k, j] * math.log(a[k, j] / (a @ a)[k, prev]) for k in range(3))) for j in range(3)]
                assert r["predictive_information"] == pytest.approx(gain[s]) and r["expected_information"] == pytest.approx(p @ gain)
                pi = np.linalg.matrix_power(a, 500)[:, 0]
                h = lambda x: -(x * np.log(x)).sum(axis=0) @ pi  # noqa: E731, B023
                assert r["information_rate"] == pytest.approx(max(0, h(a @ a) - h(a)), abs=1e-6)
                theta[s, prev] += 1
                theta /= 1 + 0.01 * theta
            prev, doubt = s, own


@pytest.mark.parametrize("batch", [3, 10_000])
def test_novelty_is_that_of_the_similarity_matrix(spark, batch):
    rng = np.random.default_rng(2)
    width, rows = 3, []
    for g, n in (("a", 20), ("b", 5), ("c", 1)):
        x = rng.normal(size=(n, 4))
        if g == "a":
            x[4], x[5, 1] = 0, np.nan
        rows += [(g, i, x[i].tolist() if (g, i) != ("a", 7) else None) for i in range(n)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {(r["g"], r["i"]): r["novelty"] for r in observers.novelty(spark.createDataFrame(rows, "g string, i int, v array<double>").repartition(4), ["g"], ["i"], "i", "v", width).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for g in "abc":
        own = [v for k, _, v in rows if k == g]
        x = np.array([np.array(v) / np.linalg.norm(v) if v is not None and np.isfinite(v).all() and any(v) else np.zeros(4) for v in own])
        matrix = x @ x.T
        matrix -= matrix.mean()
        u = np.arange(-width, width) + 0.5
        k = np.sign(u) * np.exp(-(u**2) / (2 * (width / 2) ** 2))
        for t in range(len(own)):
            want = max(0, (np.outer(k, k) * matrix[t - width : t + width, t - width : t + width]).sum()) if width <= t < len(own) - width + 1 else 0
            assert got[g, t] == pytest.approx(want, abs=1e-9), (g, t)


def test_matched_filter_finds_where_a_window_was_cut(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=60).round(3)
    series_ = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(x)] + [("s", i, 0.0) for i in range(4)], "g string, i int, x double")
    cuts = [("r", 1, (2.5 * x[20:28]).tolist()), ("r", 2, x[10:26:2].tolist()), ("s", 3, x[:8].tolist())]
    got = {r["q"]: (r["i"], r["stretch"], r["score"]) for r in observers.matched_filter(spark.createDataFrame(cuts, "g string, q int, w array<double>"), series_, ["g"], ["q"], "w", None, ["i"], "i", "x", (1.0, 2.0), 16).collect()}
    assert got[1] == (20, 1.0, pytest.approx(1, abs=1e-6)) and set(got) == {1, 2}
    best = (-2, None)
    for stretch in (1.0, 2.0):
        w = np.array(cuts[1][2])[np.minimum((np.arange(int(8 * stretch)) / stretch).astype(int), 7)]
        for i in range(60 - len(w) + 1):
            best = max(best, (w @ x[i : i + len(w)] / np.linalg.norm(w) / np.linalg.norm(x[i : i + len(w)]), (i, stretch)))
    assert got[2] == (*best[1], pytest.approx(best[0], abs=1e-6))


def fused_by_hand(spans, rounds):
    names = {s for span in spans.values() for s, v, x in span if v is not None}
    noise = {s: [0.7, 5.0, 0.8] for s in names}

    def span_eval(votes):
        fired = [v for v in votes if v[1] is not None]
        values = sorted({v[1] for v in fired})
        log_u, k = math.log(1 / 480), len(values)
        lps, mus, gammas = {None: math.log(1.05) + sum(math.log(1 - noise[s][0]) - math.log(k) + log_u for s, _, _ in fired)}, {}, {}
        for r in values:
            match = [v for v in fired if v[1] == r]
            pdf = lambda v, mu: noise[v[0]][2] * math.exp(-0.5 * ((v[2] - mu) / noise[v[0]][1]) ** 2) / noise[v[0]][1] / math.sqrt(2 * math.pi)
            w = [1 / noise[v[0]][1] ** 2 for v in match]
            mu = sum(a * v[2] for a, v in zip(w, match, strict=True)) / sum(w)
            for _ in range(3):
                g = [pdf(v, mu) / (pdf(v, mu) + (1 - noise[v[0]][2]) / 480) for v in match]
                mu = sum(a * b * v[2] for a, b, v in zip(g, w, match, strict=True)) / sum(a * b for a, b in zip(g, w, strict=True))
            mus[r], gammas[r] = mu, g
            lps[r] = sum(math.log(noise[v[0]][0]) + math.log(pdf(v, mu) + (1 - noise[v[0]][2]) / 480) if v[1] == r else math.log(1 - noise[v[0]][0]) - math.log(max(k - 1, 1)) + log_u for v in fired)
        top = max(lps.values())
        z = sum(math.exp(x - top) for x in lps.values())
        return {r: math.exp(x - top) / z for r, x in lps.items()}, mus, gammas

    for _ in range(rounds):
        sums = {s: [0.0] * 6 for s in names}
        for votes in spans.values():
            if not any(v[1] is not None for v in votes):
                continue
            q, mus, gammas = span_eval(votes)
            for r in mus:
                match = [v for v in votes if v[1] == r]
                for v, g in zip(match, gammas[r], strict=True):
                    two = len(match) >= 2
                    for i, x in enumerate((q[r], 1 - q[None], q[r] * g, q[r], q[r] * g * (v[2] - mus[r]) ** 2 * two, q[r] * g * two)):
                        sums[v[0]][i] += x
        clamp = lambda x: min(0.98, max(0.02, x))
        noise.update({s: [clamp(h / f), max(0.05, math.sqrt((sq + 3 * 25) / (sw + 3))), clamp(i / m)] for s, (h, f, i, m, sq, sw) in sums.items()})
    return {u: span_eval(v)[:2] if any(x[1] is not None for x in v) else ({None: 1.0}, {}) for u, v in spans.items()}, noise


def test_the_mixture_is_fitted_as_by_hand(spark):
    rng = random.Random(8)
    spans = {}
    for u in range(60):
        truth, place = rng.choice("xyz"), rng.uniform(0, 100)
        spans[u] = [(s, (truth if rng.random() < 0.8 else rng.choice("xyz")) if rng.random() < 0.9 else None, place + rng.gauss(0, sd) + rng.choice([0, 0, 0, 90])) for s, sd in (("p", 0.5), ("q", 3.0), ("r", 8.0))]
    spans[99] = [("p", None, None), ("q", None, 1.0)]
    rows = [(u, s, v, x) for u, votes in spans.items() for s, v, x in votes]
    found, noise = mixtures.continuous_fusion(spark.createDataFrame(rows, "u int, s string, v string, x double"), "u", "s", "v", "x", rounds=4, tolerance=0.0)
    want, own = fused_by_hand(spans, 4)
    for r in noise.collect():
        assert [r["accuracy"], r["sigma"], r["inlier"]] == pytest.approx(own[r["s"]], rel=1e-6)
    for r in found.collect():
        q, mus = want[r["u"]]
        best = max(q, key=q.get)
        assert r["v"] == best and r["posterior"] == pytest.approx(q[best], rel=1e-6) and r["x"] == pytest.approx(mus.get(best, 0.0), rel=1e-6)


def test_margin_gate_protects_a_claim_that_has_no_score(spark):
    rows = [("override", "a", 9.0, "b", 5.0), ("accept", "a", 9.0, "b", None), ("accept", "a", 9.0, "b", 8.0), ("accept", "a", 3.0, "b", 0.0), ("override", "a", 9.0, None, None), ("abstain", "a", 3.0, None, None), ("accept", "a", 9.0, "a", 9.0), ("abstain", None, None, None, None), ("accept", None, None, "b", None)]
    df = spark.createDataFrame(rows, "want string, best string, score double, claim string, own double")
    got = df.select("want", margin_gate(F.col("best"), F.col("score"), F.col("claim"), F.col("own"), 6, 2).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_snapping_keeps_a_raw_time_that_still_advances(spark):
    rows = [("a", 1.0, 0.0), ("a", 2.0, 0.0), ("b", 4.0, 10.0), ("b", 9.0, 10.0), ("b", 11.0, 10.0), ("b", 12.0, 12.0)]
    got = sorted(map(tuple, series.snapped(spark.createDataFrame(rows, "k string, t double, n double"), ["k"], "t", "n").collect()))
    assert got == [("a", 0.0), ("a", 2.0), ("b", 10.0), ("b", 11.0), ("b", 12.0)]


def test_intervals_that_end_before_they_begin_meet_nothing(spark):
    a = spark.createDataFrame([(10.0, 2.0), (5.0, 5.0), (0.0, 3.0)], "lo double, hi double")
    b = spark.createDataFrame([(1.0, 11.0)], "b_lo double, b_hi double")
    assert sorted(tuple(r) for r in interval_join(a, b, ("lo", "hi"), ("b_lo", "b_hi"), 2.0).collect()) == [(0.0, 3.0, 1.0, 11.0), (5.0, 5.0, 1.0, 11.0)]


def test_diagonals_suppress_neighbours_and_put_dense_ones_first(spark):
    hits = [(7, a) for a in range(0, 400, 40)] + [(8, 500)] + [(20, a) for a in (100, 101, 102, 103)] + [(40, 5)] + [(60, 7), (61, 8)]
    got = diagonals(spark.createDataFrame([("m", o, a) for o, a in hits], "mix string, offset int, a int"), ["mix"], "offset", "a").orderBy("place").collect()
    assert [(r["offset"], r["votes"], r["first"], r["last"]) for r in got] == [(20, 4, 100, 103), (7, 10, 0, 360), (60, 2, 7, 8), (40, 1, 5, 5)]
