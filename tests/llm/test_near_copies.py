"""The pipeline's near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import near_copies
from tidemark.llm.components import components


def shingles(text):
    parts = (text or "").encode().lower().split()
    return frozenset(b" ".join(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))) if parts else frozenset()


def least_by_hand(rows):
    """The least id of each row's group."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        same, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if 5 * same >= 4 * every:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def near_texts():
    rng = random.Random(3)
    draw = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = [" ".join(draw(rng.randrange(1, 80))) for _ in range(60)]
    for n in (12, 40, 150):  # copies with more and more words exchanged, about the limit
        for _ in range(4):
            base = draw(n)
            for edits in range(1, 9):
                own = list(base)
                for at in rng.sample(range(n), min(edits, n // 4)):
                    own[at] = f"x{rng.randrange(5000)}"
                texts.append(" ".join(own))
            texts.append(" ".join(base))
    hot = draw(100)
    for k in range(60):  # one large group, of a base and what is left out at its end
        texts.append(" ".join(hot[: 100 - k] if k < 40 else [*hot, *draw(k // 4)]))
    return [*enumerate(texts), (1000, None), (1001, ""), (1002, "one two"), (1003, "One  TWO")]


@pytest.mark.parametrize("crowd", [24, 2])
def test_groups_are_those_of_brute_force(spark, crowd):
    rows = near_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.groups(docs, crowd=crowd).collect()}
    want = least_by_hand(rows)
    assert got == want and len(set(want.values())) < len(want) - 60


def test_simhash_finds_links_by_itself(spark):
    """Without any band key, texts whose fingerprints are at most three bits apart are still linked where their shingles say so."""
    rows = [r for r in near_texts() if shingles(r[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    distinct = near_copies._described(docs, "doc_id", "text", 5).withColumnRenamed("doc_id", "least").dropDuplicates(["node"]).cache()
    bare = distinct.withColumn("keys", F.array().cast("array<long>"))
    sets = {r["node"]: (r["fp"], shingles(dict(rows)[r["least"]])) for r in distinct.collect()}
    bits = lambda a, b: ((sets[a][0] ^ sets[b][0]) & (1 << 64) - 1).bit_count()
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if bits(a, b) <= 3 and 5 * len(sets[a][1] & sets[b][1]) >= 4 * len(sets[a][1] | sets[b][1])}
    met = {(r["a"], r["b"]) for r in near_copies.by_fingerprint(distinct).collect()}
    assert all(a < b and bits(a, b) <= 3 for a, b in met)
    root = {r["node"]: r["root"] for r in components(near_copies.links(bare, docs)).collect()}
    assert len(want) > 20 and all(root[a] == root[b] for a, b in want)


def test_the_stage_keeps_one_of_each_group(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = least_by_hand([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    kept = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_nulls_repeats_and_nothing(spark):
    rows = [(None, "a b c"), (None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "A B C"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in near_copies.one_of_each(docs).collect()) == [0, 0, 1, 3]
    assert near_copies.one_of_each(docs.filter("false")).count() == 0


def test_short_texts_are_told_by_their_shingles_alone(spark):
    """Texts of 9 words and the same less the last: five and four shingles, exactly 0.8, whose fingerprints may lie far apart."""
    rng = random.Random(9)
    rows = []
    for i in range(0, 6000, 2):
        words = [f"w{rng.randrange(100_000)}" for _ in range(9)]
        rows += [(i, " ".join(words)), (i + 1, " ".join(words[:-1]))]
    got = near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).filter("component_id % 2 = 0")
    assert got.count() == len(rows) and got.select("component_id").distinct().count() == len(rows) // 2


def test_unlike_texts_around_one_boilerplate_stay_apart(spark):
    rng = random.Random(10)
    shared = [f"b{i}" for i in range(130)]
    own = lambda: [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(i, " ".join([*shared, *own()])) for i in range(3000)]
    rows += [(5000, rows[7][1] + " end"), (5001, " ".join([*shared, *own()[:10]])), (5002, rows[8][1].replace("b50 ", ""))]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: {5000: 7, 5002: 8}.get(i, i) for i, _ in rows}


def test_two_sets_at_the_limit_share_as_many_least_hashes_as_needed():
    rng = random.Random(4)
    for n in (5, 20, 100, 200, 204, 205, 240, 256, 257, 300, 320, 1000, 4000):
        for m in {n, math.ceil(0.8 * n), n * 9 // 10}:
            both = math.ceil(4 / 9 * (n + m))
            if both > m:
                continue
            draw = [rng.getrandbits(64) for _ in range(n + m - both)]
            a, b = (np.unique(np.array(x, dtype=np.uint64)) for x in (draw[:n], draw[n - both :]))
            x, y = ((h[: near_copies.LEAST] >> np.uint64(32)).astype(np.uint32) for h in (a, b))
            shared = len(np.intersect1d(x, y))
            need = near_copies.needed(np.array([len(a), len(b)]))
            near = near_copies.near_by_sketch([x, y], np.array([len(a), len(b)]))
            assert near(0, np.array([1])).tolist() == [1] and near(1, np.array([0])).tolist() == [0] and shared >= need.max()
    x, y = np.arange(10, dtype=np.uint32), np.arange(5, 15, dtype=np.uint32)
    assert not len(near_copies.near_by_sketch([x, y], np.array([10, 10]))(0, np.array([1])))


def test_sketches_of_many_sets_are_compared_as_pair_by_pair():
    rng = random.Random(9)
    base, sets = [rng.getrandbits(32) for _ in range(400)], []
    for _ in range(60):
        n = rng.choice([30, 250, 256, 260, 330, 400])
        sets.append(np.unique(np.array(rng.sample(base, n - n // 10) + [rng.getrandbits(32) for _ in range(n // 10)], dtype=np.uint32)))
    size, held = np.array([len(s) for s in sets]), [s[: near_copies.LEAST] for s in sets]
    near = near_copies.near_by_sketch(held, size)
    found = 0
    for x in range(len(sets)):
        want = []
        for y in range(len(sets)):
            ends = [held[i][-1] for i in (x, y) if size[i] > near_copies.LEAST]
            a, b = ({h for h in held[i].tolist() if not ends or h <= min(ends)} for i in (x, y))
            if len(a & b) >= (near_copies.ESTIMATE if ends else 0.79) * len(a | b):
                want.append(y)
        assert near(x, np.arange(len(sets))).tolist() == want
        found += len(want) - 1
    assert 0 < found < len(sets) * (len(sets) - 1)
