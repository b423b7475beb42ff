"""Texts of no known language are rejected, long and short; clean ones stay."""

import random

from tidemark.llm import language

ITALIAN = "La mattina dopo il sole entrava dalla finestra aperta e i bambini giocavano nel cortile mentre la nonna preparava il pranzo per tutta la famiglia che sarebbe arrivata da lontano. Nessuno sapeva ancora quanto tempo sarebbero rimasti gli ospiti."
FINNISH = "Aamulla aurinko nousi metsän takaa ja lapset juoksivat rantaan uimaan. Isoäiti keitti kahvia keittiössä ja odotti vieraita, jotka olivat tulossa kaukaa pohjoisesta junalla illaksi kotiin. Vanha talo seisoi järven rannalla."


def test_unseen_languages_and_gibberish_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.filter("doc_id % 4 <> 0"))
    rng = random.Random(2)
    gibberish = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(200))
    odd = {"Italian": ITALIAN, "Finnish": FINNISH, "Finnish, short": FINNISH[:70], "gibberish": gibberish, "gibberish, short": gibberish[:60]}
    odd |= {"Russian, short": "Утром солнце взошло над лесом, и дети", "Chinese, short": "今天天气很好", "repeated": "xqzj qxzv " * 5}
    judged = language.identify(spark.createDataFrame(list(odd.items()), "name string, text string"), model).collect()
    assert {r["name"]: r["lang_rejected"] for r in judged} == dict.fromkeys(odd, True)
    clean = docs.filter("doc_id % 4 = 0 AND length(text) > 40")
    assert language.known(clean, model).count() >= 0.995 * clean.count()
    short = clean.selectExpr("substring(text, 1, 60) AS text")
    assert language.known(short, model).count() >= 0.99 * short.count()
