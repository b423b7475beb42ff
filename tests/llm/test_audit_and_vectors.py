"""Operators 11 to 13 on small tables with nulls, ties, repeated rows, odd values and clashing columns, against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence, negatives, vector_copies
from tidemark.llm.blocks import Best

DOCS = "doc_id long, text string, lang string, source string, term string, n long, `a.b` int"


# 11. Source divergence


def audited_by_hand(rows, min_docs=3, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups[lang or ""].add(source or "")
        count[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = Counter({t: sum(count[lang, s][t] for s in sources) for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(count[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(11)
    word = lambda i: rng.choice([f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}", f"Ä{'uvwxyz'[i % 6]}", "THE"])
    rows = [(i, " ".join(word(rng.randrange(60 if i % 3 else 20)) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", None, ""]), "x", 1, 1) for i in range(120)]
    rows += [(200, None, "en", "s9", "x", 1, 1), (201, "", "fr", "s0", "x", 1, 1), (202, "1 2 3 !?", "fr", "s1", None, None, None), (203, "once only here", "fr", "s2", "x", 1, 1)]
    rows += [rows[5], rows[5], (None, rows[7][1], "en", "s3", "x", 1, 1), (204, "wak " * 300_000 + "Ende", "de", "s1", "x", 1, 1), (205, "a-b_c'd[e`f{g\x7fh 😀 é", "en", "s1", "x", 1, 1)]
    rows += [(300 + i, "tie tied ties 😀", "xx", f"s{i}", "x", 1, 1) for i in range(4)]
    return rows


def test_audit_matches_a_plain_reading(spark, spoken):
    docs, want = spark.createDataFrame(spoken, DOCS), audited_by_hand(spoken)
    for bits in (64, 4):  # with four bits nearly every digest stands for several terms
        got = divergence.audit(docs.repartition(3), digest_bits=bits)
        assert sorted(map(tuple, got.collect())) == want
    few = divergence.audit(docs, min_docs=1, top=3)
    assert sorted(map(tuple, few.collect())) == audited_by_hand(spoken, 1, 3)


def test_audit_of_nothing_and_of_large_counts(spark):
    empty = spark.createDataFrame([], DOCS)
    assert divergence.audit(empty).count() == 0
    n = spark.createDataFrame([(10**17, 3 * 10**17)], "n long, total long").select(divergence.share(F.col("n"), F.col("total"))).first()[0]
    assert n == 1 + 10**9 * (10**17 + 1) // (3 * 10**17)


def test_pieces_cut_no_term():
    text = (b"abc " * 700_000 + b"q" * 3_000_000 + b" tail").upper()
    found = Counter(t for part in divergence.terms_of(text) for t in part)
    assert found == Counter({b"abc": 700_000, b"q" * 3_000_000: 1, b"tail": 1})


# 12. Embedding near-dedup


def linked_by_hand(rows, limit=0.93):
    units = {}
    for i, (_, label, v) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            w = np.array(v, dtype=np.float64) / max(map(abs, v))
            units[i] = w / np.linalg.norm(w)
    near = {i: {j for j in units if j != i and rows[i][1] == rows[j][1] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= limit} for i in units}
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((str(vec_id), len(near.get(i, ())), str(least), vec_id == least))
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>, node long, digest string"


@pytest.fixture(scope="module")
def placed():
    rng = np.random.default_rng(12)
    bases = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        v = bases[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.3, 1.0])
        rows.append((i, [1, 1, 1, 2, 3, None][i % 6], v.astype(np.float32).tolist()))
    rows += [(500 + i, 1, (bases[0] + rng.normal(size=16) * 0.02).astype(np.float32).tolist()) for i in range(150)]  # a large group of near copies
    rows += [(700 + i, 2, rows[3][2]) for i in range(20)]  # equal vectors
    rows += [(800, 1, None), (801, 1, [0.0] * 16), (802, 1, [None] + [1.0] * 15), (803, 1, [float("nan")] + [1.0] * 15), (804, 1, [float("inf")] + [1.0] * 15), (805, 1, [1.0] * 3), (806, 1, [2.0] * 3), (807, 1, [])]
    rows += [(808, 1, [3e38] * 16), (809, 1, [1e-38] * 16), (None, 1, [5.0] * 16), (None, 9, [1.0] * 16), rows[7], rows[7]]
    return rows


@pytest.mark.parametrize(("n_lists", "block"), [(None, vector_copies.BLOCK), (9, 40), (40, 13)])
def test_links_are_all_found(spark, placed, n_lists, block):
    rows = spark.createDataFrame([(*r, 1, "x") for r in placed], VECTORS)
    got = vector_copies.groups(rows, n_lists=n_lists, block=block)
    assert sorted((str(a), b, str(c), d) for a, b, c, d in got.collect()) == linked_by_hand(placed)


def test_links_in_doubles_and_of_nothing(spark, placed):
    wide = spark.createDataFrame([r for r in placed], "vec_id long, label int, embedding array<double>")
    assert sorted((str(a), b, str(c), d) for a, b, c, d in vector_copies.groups(wide, limit=0.8).collect()) == linked_by_hand(placed, 0.8)
    empty = spark.createDataFrame([], VECTORS)
    assert vector_copies.groups(empty).count() == 0
    odd = vector_copies.groups(spark.createDataFrame([(1, None, [1.0], 1, "x"), (2, 3, [0.0], 1, "x")], VECTORS))
    assert sorted(map(tuple, odd.collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_probes_leave_out_lists_of_separate_clusters(spark):
    rng = np.random.default_rng(3)
    axes = np.eye(24)
    units = vector_copies.normal(np.concatenate([axes[i % 24] + rng.normal(size=24) * 0.02 for i in range(600)]).reshape(-1, 24))
    model = vector_copies.fit(units, 24)
    frame = spark.createDataFrame([(i, 1, 1, bytearray(u.astype("<f8").tobytes())) for i, u in enumerate(units)], "node long, label int, weight long, vector binary")
    near = vector_copies._near_lists(vector_copies._encoded(frame, model, "<f8"), model, "<f8", 0.374)
    assert near.count() < 24 * 24 / 4


def test_asymmetric_distances_are_within_the_coding_error():
    rng = np.random.default_rng(4)
    units, queries = (vector_copies.normal(rng.normal(size=(n, 20))) for n in (500, 40))
    model = vector_copies.fit(units, 6, n_words=16)
    own, rho, codes, of_code, error = vector_copies.coded(units, model)
    stands = model.centres[own] + np.concatenate([w[codes[:, m]] for m, w in enumerate(model.words)], axis=1)
    assert np.allclose(np.linalg.norm(units - stands, axis=1), error)
    assert np.allclose(rho, np.linalg.norm(units - model.centres[own], axis=1))
    table = sum((queries[:, a:b] @ w.T)[:, codes[:, m]] for m, (w, (a, b)) in enumerate(zip(model.words, model.cuts, strict=True)))
    away = vector_copies.squares(queries, model.centres)[:, own] + of_code - 2 * table
    assert np.allclose(away, vector_copies.squares(queries, stands))


# 13. Hard negatives


def mined_by_hand(rows, anchor, positives=5, negatives=10, low=30, high=90):
    own = {}
    for vec_id, label, v in rows:
        if vec_id is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(256 * x) for x in v]
            own[vec_id] = min(own.get(vec_id, (label + 1, 0, 0)), (label, np.array(whole, dtype="<i8").tobytes(), whole))
    out = []
    for a in filter(anchor, own):
        score = {b: sum(x * y for x, y in zip(own[a][2], own[b][2], strict=True)) for b in own if b != a and len(own[b][2]) == len(own[a][2])}
        best = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in best if own[b][0] == own[a][0]][:positives]:
            fit = [b for b in best if own[b][0] != own[a][0] and low * score[p] <= 100 * score[b] <= high * score[p]][:negatives]
            out += [(a, p, i + 1, b, score[p], score[b]) for i, b in enumerate(fit)]
    return sorted(out)


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(13)
    rows = [(i, int(rng.integers(0, 4)), (rng.normal(size=8) + 0.5 * (i % 3)).round(1).tolist()) for i in range(500)]
    rows += [(600 + i, i % 4, rows[10][2]) for i in range(60)]  # ties
    rows += [(700, None, rows[0][2]), (701, 1, None), (702, 1, [None] * 8), (703, 1, [float("nan")] * 8), (704, 1, [0.0] * 8), (705, 2, [0.0] * 8), (706, 1, []), (707, 1, [1.0, 2.0]), (708, 1, [1.0, 1.0]), (709, 2, [1.0, 0.8])]
    return [*rows, (None, 1, rows[0][2]), rows[20], rows[20], (21, 0, rows[22][2])]


@pytest.mark.parametrize(("anchors", "tile"), [(negatives.ANCHORS, negatives.TILE), (7, 50)])
def test_negatives_match_a_full_search(spark, scored, monkeypatch, anchors, tile):
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "TILE", tile)
    rows = spark.createDataFrame([(*r, 1, "x") for r in scored], "vec_id long, label int, embedding array<double>, slot int, `an.chor` string")
    got = negatives.hard_negatives(rows, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == mined_by_hand(scored, lambda i: i % 10 == 0)
    other = negatives.hard_negatives(rows, F.col("vec_id") % 25 == 4, positives=9, negatives=3, low=55, high=60)
    assert sorted(map(tuple, other.collect())) == mined_by_hand(scored, lambda i: i % 25 == 4, 9, 3, 55, 60)


def test_negatives_of_nothing_and_of_one_label(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert negatives.hard_negatives(spark.createDataFrame([], schema), F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(i, 1, [1.0, float(i)]) for i in range(20)], schema)
    assert negatives.hard_negatives(alone, F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(alone, F.col("vec_id") == -1).count() == 0


def test_products_are_exact_beyond_doubles():
    a, b = np.array([[2**29 + 1, 3]], dtype=np.int64), np.array([[2**29 + 3, 5]], dtype=np.int64)
    assert negatives.products(a, b)[0, 0] == (2**29 + 1) * (2**29 + 3) + 15
    with pytest.raises(ValueError, match="64 bits"):
        negatives.products(np.array([[2**40]]), np.array([[2**40]]))


def test_best_keeps_the_best_of_each_slot():
    rng = random.Random(1)
    best, every = Best(3, 4, room=30), []
    for _ in range(50):
        rows = [(rng.randrange(3), rng.randrange(6), rng.randrange(1000)) for _ in range(20)]
        every += rows
        best.add(*(np.array(c) for c in zip(*rows, strict=True)))
    want = [x for s in range(3) for x in sorted([(s, -v, i) for t, v, i in every if t == s])[:4]]
    assert [(s, -v, i) for s, v, i in zip(*best.all(), strict=True)] == want
