"""The pipeline's stages by brute force, and the registered queries against DuckDB."""

from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_near_copies import least_by_hand
from tests.test_queries import rows
from tidemark.llm import mixing, queries
from tidemark.sources.tables import TABLES


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    want = con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def shingles(text):
    letters = "".join(c if c.isalpha() or c.isnumeric() else " " for c in (text or "").lower()).split()
    return {tuple(letters[i : i + 5]) for i in range(len(letters) - 4)}


def odd_rows(spark, docs):
    """docs, and with them null, empty and repeated rows and a very long text."""
    first = docs.orderBy("doc_id").limit(2)
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", None, 0), (10**6 + 1, None, "en", "web", 0), (10**6 + 2, "the river and the house " * 40_000, "en", "web", 1)], docs.schema)
    return docs.unionByName(first).unionByName(odd)


def test_stages_by_brute_force(spark, sf_dir):
    docs = odd_rows(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    stages, pairs = dict(corpus_pipeline.STAGES), lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    known = stages["language_id"](spark, docs, sf_dir).cache()
    assert known.columns == docs.columns and not pairs(known) - pairs(docs)
    gone = pairs(docs) - pairs(known)
    assert {(None, None), (10**6, ""), (10**6 + 1, None)} <= set(gone) and sum(gone.values()) <= 0.05 * docs.count()

    kept = stages["simhash_near_dedup"](spark, known, sf_dir).cache()
    want = set(least_by_hand([(r["doc_id"], r["text"]) for r in known.collect()]).values())
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)

    clean = stages["decontamination"](spark, kept, sf_dir).cache()
    items = [s for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if (s := shingles(r["text"]))]
    dirty = {r["doc_id"] for r in kept.collect() if any(len(i & own) >= 0.8 * len(i) for own in [shingles(r["text"])] for i in items)}
    assert dirty and {r["doc_id"] for r in clean.collect()} == want - dirty

    mixed = stages["mixing"](spark, clean, sf_dir).cache()
    sizes, sources = {}, defaultdict(int)
    for r in clean.collect():
        sizes[r["doc_id"]] = (r["source"], len((r["text"] or "").encode().split()))
        sources[r["source"]] += sizes[r["doc_id"]][1]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}
    targets, left = {}, sum(sources.values())
    while len(targets) < len(sources):
        level = left / sum(w for s, w in weights.items() if s not in targets)
        full = [s for s in sources if s not in targets and 3 * sources[s] < weights[s] * level]
        targets |= {s: 3 * sources[s] for s in full} if full else {s: weights[s] * level for s in sources if s not in targets}
        left = sum(sources.values()) - sum(targets[s] for s in targets)
    took = Counter(r["doc_id"] for r in mixed.collect())
    assert max(took.values()) <= 3
    for s in sources:
        words = sum(n * sizes[d][1] for d, n in took.items() if sizes[d][0] == s)
        assert abs(words - targets[s]) <= max(n for o, n in sizes.values() if o == s) + 1

    sharded = stages["sharding"](spark, mixed, sf_dir)
    assert sharded.columns == [*docs.columns, "shard"] and pairs(sharded) == pairs(mixed)
    shards = defaultdict(set)
    for r in sharded.collect():
        shards[r["doc_id"]].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values()) and {x for s in shards.values() for x in s} <= set(range(24))


def test_stages_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0, name


def test_the_mix_is_in_the_order_of_its_times(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(docs.limit(5)).withColumn("__key", docs["doc_id"])
    got = mixing.mixed_documents(docs, finish="at").collect()
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r["doc_id"]] += r["copies"]
    assert [r["at"] for r in got] == sorted(r["at"] for r in got) and Counter(r["doc_id"] for r in got) == +plan
    assert all(r["__key"] == r["doc_id"] for r in got)
