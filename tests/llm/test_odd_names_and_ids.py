"""Ids that are texts with one beginning, columns with the helpers' names or with dots, capital letters beyond A-Z, repeated rows."""

import time

from pyspark.sql import functions as F

from tidemark.llm import decontamination, fingerprints, suffixes, urls


def test_text_ids_with_one_beginning_are_spread_over_the_ranges(spark):
    rows = [(f"https://site/{i:05d}", f"text {i} of a site") for i in range(400)] + [(None, "no id"), ("https://site/00007", "again")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = fingerprints.fingerprints(docs, ranges=8)
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 6 and max(r["count"] for r in sizes) < 200
    one = fingerprints.fingerprints(docs, ranges=1)
    key = lambda r: (r["doc_id"] or "", r["fingerprint"], r["edited_sha256"])
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
    assert len({key(r) for r in one.collect()}) == 402


def test_decontaminate_leaves_columns_alone_whatever_their_names(spark):
    item = "a b c d e f g h i j"
    docs = spark.createDataFrame([(1, 7, "x", f"so {item} it is"), (2, 8, "y", "nothing of that"), (3, 9, None, None)], "doc_id int, __text_key int, `a.b` string, text string")
    left = decontamination.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id int, text string"))
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == [(2, 8, "y", "nothing of that"), (3, 9, None, None)]


def test_rules_and_pages_lower_the_same_letters(spark):
    rules = spark.createDataFrame([("BÜCHER.de", "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://BÜCHER.de/"), (2, "http://bÜcher.DE/x"), (3, "http://bücher.de/")], "page_id int, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages, rules).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_repeated_rows_take_time_in_proportion(spark):
    text = " ".join(f"w{i}" for i in range(250))
    began = time.monotonic()
    got = suffixes.without_repeats(spark.createDataFrame([(1, text)] * 2000, "doc_id int, text string"), keep_bytes=False).distinct().collect()
    assert len(got) == 1 and got[0]["n_removed"] == len(text) and time.monotonic() - began < 60
