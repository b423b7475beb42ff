"""Held-out recall and false alarms of toxicity, and the memory of the largest group that is suffix-sorted at once."""

import random
import tracemalloc

from tidemark.llm import queries, suffixes


def test_toxicity_recall_and_false_alarms(spark):
    d = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in queries.op9_toxicity(spark, d).collect() if r["held_out"] and r["doc_id"] in truth]
    toxic, clean = [p for t, p in held if t == 1], [p for t, p in held if t == 0]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.06 * len(clean)


def test_the_largest_group_fits():
    rng = random.Random(1)
    names = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(names) for _ in range(60))[:n].encode()
    passage = text(210)
    snippets = [(text(80) + passage + text(80))[:369] for _ in range(suffixes.CROWD)]
    tracemalloc.start()
    found = list(suffixes.repeating_parts(snippets))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(snippets) and peak < 600_000_000
