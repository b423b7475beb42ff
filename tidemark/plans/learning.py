"""Beliefs, confident learning, learned verifiers and spectra over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors
from ..operators import evidence, joins, spectra, verifiers
from ..sources.tables import table, written
from .evidence import _V, votes
from .timeline import _SPANS, events, spans


def belief_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Places that a unit's votes agree on within two, the heaviest vote first taking all near it; with their share of the weight, the trust in
    their sources (purchase and signup are one group) and the quality, share times trust."""
    v = votes(spark, d).filter("vote IS NOT NULL").withColumn("group", F.when(F.col("source").isin("purchase", "signup"), "sale").otherwise(F.col("source")))
    found = evidence.belief_clusters(v, "unit", "at", "confidence", "group", "event_id", 2.0)
    return found.select("unit", "seed", "n", F.round("center", 6).alias("center"), F.round("share", 6).alias("share"), F.round("trust", 6).alias("trust"), F.round(F.col("share") * F.col("trust") + 1e-9, 6).alias("quality"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("p1"))
    x = table(spark, d, "labels").select("doc_id", "quality").join(docs, "doc_id")
    return evidence.confident_guess(x.select("doc_id", "quality", F.explode(F.array(F.struct(F.lit(0).alias("class"), (1 - F.col("p1")).alias("p")), F.struct(F.lit(1).alias("class"), F.col("p1").alias("p")))).alias("x")).select("doc_id", "quality", "x.*"), "doc_id", "quality", "class", "p")


def calibrated_joint(spark: SparkSession, d: str) -> DataFrame:
    """The joint distribution of labels and confident guesses, counted and calibrated to the margins."""
    j = evidence.calibrated_joint(_judged(spark, d), "quality", "guess")
    return j.select("quality", "guess", "n", F.round("calibrated", 6).alias("calibrated"))


def confident_errors(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose label the confident guess contradicts: what pruning takes out."""
    return _judged(spark, d).filter("guess != quality").select("doc_id", "quality", "guess")


def sliding_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The best agreement of the words of a user's day with those of the next of its days, over slides of up to three places that overlap in two at least."""
    word = ((F.col("event_id") * 2654435761) % 4294967296).alias("word")
    day = F.floor(F.col("us") / 86_400_000_000).alias("day")
    e = events(spark, d).select("user_id", day, "us", "event_id", word).groupBy("user_id", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", "word"))), lambda x: x["word"]).alias("words"))
    e = e.withColumn("after", F.lead("words").over(Window.partitionBy("user_id").orderBy("day"))).filter("after IS NOT NULL")
    return e.select("user_id", "day", F.round(vectors.sliding_agreement(F.col("words"), F.col("after"), 3, 2), 6).alias("agreement"))


def identity_recall(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with an identity (k mod 3, none where k is divisible by 7) that a click span of the user with the same identity overlaps within five
    seconds either way; purchases without one can't be judged and count apart."""
    k = F.get_json_object("props", "$.k").cast("int")
    who = table(spark, d, "events").select("event_id", F.when(k % 7 != 0, k % 3).alias("who"))
    s = spans(spark, d).join(who, "event_id")
    a = s.filter("event_type = 'purchase'").select("user_id", "event_id", "who", (F.col("lo") - 5).alias("a_lo"), (F.col("hi") + 5).alias("a_hi"))
    b = s.filter("event_type = 'click' AND who IS NOT NULL").select("user_id", "who", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    hit = joins.interval_join(a.filter("who IS NOT NULL"), b, ("a_lo", "a_hi"), ("b_lo", "b_hi"), 3600.0, ["user_id", "who"]).select("event_id").distinct().withColumn("hit", F.lit(1))
    n = a.join(hit, "event_id", "left").agg(F.count("who").alias("bound"), F.count_if(F.col("who").isNull()).alias("abstained"), F.count("hit").alias("hits"))
    return n.select("bound", "abstained", "hits", F.round(F.coalesce(F.col("hits") / F.nullif("bound", F.lit(0)), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(F.col("bound") / F.nullif(F.col("bound") + F.col("abstained"), F.lit(0)), F.lit(0.0)), 6).alias("adjudicable"))


FEATURES = ["chars", "words", "long_words", "digits", "marks", "lines"]


def _described(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with a few numbers that describe their text."""
    left = lambda pattern: F.length(F.regexp_replace("text", pattern, "")) / F.greatest(F.length("text"), F.lit(1))
    words = F.size(F.split("text", r"\s+"))
    docs = table(spark, d, "documents").select(
        "doc_id", "source", F.log1p(F.length("text")).alias("chars"), F.log1p(words).alias("words"), (F.length("text") / words).alias("long_words"),
        left(r"[^0-9]").alias("digits"), left(r"[\p{L}\p{N}\s]").alias("marks"), left(r"[^\n]").alias("lines"),
    )
    return docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


def critic_scores(spark: SparkSession, d: str) -> DataFrame:
    """How likely each labelled document is good, by a critic that learned from other sources only; false accepts weigh four times."""
    found = verifiers.out_of_fold(_described(spark, d), FEATURES, "quality", F.col("source"), verifiers.critic(FEATURES), 3, F.when(F.col("label") == 0, 4.0).otherwise(1.0))
    return found.select("doc_id", "fold", "quality", F.round("score", 4).alias("score"))


def forest_scores(spark: SparkSession, d: str) -> DataFrame:
    """The same by a random forest in which both labels weigh alike."""
    found = verifiers.out_of_fold(_described(spark, d), FEATURES, "quality", F.col("source"), verifiers.forest(FEATURES, 20), 3)
    return found.select("doc_id", "fold", "quality", F.round("score", 4).alias("score"))


def whitened_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The first four whitened components of each embedding."""
    found = spectra.whitened(table(spark, d, "embeddings"), "embedding", 4)
    return found.select("vec_id", *(F.round(F.get("whitened", F.lit(i)), 5).alias(f"c{i}") for i in range(4)))


def label_subspaces(spark: SparkSession, d: str) -> DataFrame:
    """How alike the leading three directions of the embeddings of two labels are."""
    bases = written(spectra.subspaces(table(spark, d, "embeddings").filter("label IS NOT NULL"), "label", "embedding", 3))
    return spectra.subspace_similarity(bases, "label").select("a", "b", F.round("similarity", 5).alias("similarity"))


def _incidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col")).distinct()


def incidence_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """The four largest singular values of the incidence of suppliers and parts, rows of length 1, and of its rewired null model."""
    own = _incidence(spark, d)
    models = {"data": own, "null": spectra.rewired(own, "row", "col", 7)}
    told = [(name, i + 1, round(v, 3)) for name, entries in models.items() for i, v in enumerate(spectra.singular_values(spectra.unit_rows(entries.withColumn("w", F.lit(1.0)), "row", "w"), "row", "col", "w", 4, rounds=2))]
    return spark.createDataFrame(told, "model string, place int, value double")


def rewired_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Parts of each supplier before and after rewiring: as many."""
    own = _incidence(spark, d)
    after = spectra.rewired(own, "row", "col", 7).groupBy("row").agg(F.count(F.lit(1)).alias("after"))
    n = own.groupBy("row").agg(F.count(F.lit(1)).alias("before")).join(after, "row", "left")
    return n.select("row", "before", (F.coalesce("after", F.lit(0)) <= F.col("before")).alias("no_more"), (F.coalesce("after", F.lit(0)) >= 0.8 * F.col("before")).alias("nearly_all"))


QUERIES = {f.__name__: f for f in (belief_clusters, calibrated_joint, confident_errors, sliding_agreement, identity_recall, critic_scores, forest_scores, whitened_vectors, label_subspaces, incidence_spectrum, rewired_degrees)}

_GUESS = "x AS (SELECT doc_id, quality, least(1.0, n_chars / 4000) AS p1, 1 - least(1.0, n_chars / 4000) AS p0 FROM labels JOIN documents USING (doc_id)), t AS (SELECT avg(p1) FILTER (quality = 1) AS t1, avg(p0) FILTER (quality = 0) AS t0 FROM x), g AS (SELECT doc_id, quality, CASE WHEN p1 >= t1 AND p0 >= t0 OR p1 < t1 AND p0 < t0 THEN (p1 > p0)::INT WHEN p1 >= t1 THEN 1 ELSE 0 END AS guess FROM x, t)"
#: Models, whitening and spectra have none: tests hold them against plain computations.
ORACLES: dict[str, str] = {
    "belief_clusters": f"WITH RECURSIVE {_V}, o AS (SELECT *, CASE WHEN source IN ('purchase', 'signup') THEN 'sale' ELSE source END AS grp, row_number() OVER (PARTITION BY unit ORDER BY confidence DESC, at0, event_id) AS i FROM v WHERE vote IS NOT NULL AND confidence > 0), k AS (SELECT unit, i, [at0] AS got FROM o WHERE i = 1 UNION ALL SELECT o.unit, o.i, CASE WHEN len(list_filter(got, lambda g: abs(g - o.at0) <= 2)) = 0 THEN list_append(got, o.at0) ELSE got END FROM k JOIN o ON o.unit = k.unit AND o.i = k.i + 1), s AS (SELECT unit, arg_max(got, i) AS seeds FROM k GROUP BY 1), m AS (SELECT o.*, list_filter(seeds, lambda g: abs(g - o.at0) <= 2)[1] AS seed FROM o JOIN s USING (unit)), p AS (SELECT unit, seed, grp, max(confidence) AS top FROM m GROUP BY ALL), q AS (SELECT unit, seed, 1 - product(1 - top) AS trust FROM p GROUP BY 1, 2), c AS (SELECT unit, seed, count(*) AS n, sum(at0 * confidence) / sum(confidence) AS center, sum(confidence) AS w FROM m GROUP BY 1, 2) SELECT unit, seed, n, round(center, 6) AS center, round(w / sum(w) OVER (PARTITION BY unit), 6) AS share, round(trust, 6) AS trust, round(w / sum(w) OVER (PARTITION BY unit) * trust + 1e-9, 6) AS quality FROM c JOIN q USING (unit, seed)",
    "calibrated_joint": f"WITH {_GUESS}, c AS (SELECT quality, guess, count(*) AS n FROM g GROUP BY 1, 2), r AS (SELECT *, n / (sum(n) OVER (PARTITION BY quality) * sum(n) OVER (PARTITION BY guess)) AS q FROM c) SELECT quality, guess, n, round(q / sum(q) OVER (), 6) AS calibrated FROM r",
    "confident_errors": f"WITH {_GUESS} SELECT doc_id, quality, guess FROM g WHERE guess <> quality",
    "sliding_agreement": "WITH w AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, list((event_id * 2654435761) % 4294967296 ORDER BY ts, event_id) AS words FROM events GROUP BY 1, 2), p AS (SELECT user_id, day, words AS a, lead(words) OVER (PARTITION BY user_id ORDER BY day) AS b FROM w), o AS (SELECT *, unnest(range(-3, 4)) AS off FROM p WHERE b IS NOT NULL), s AS (SELECT user_id, day, a[greatest(off, 0) + 1:least(len(a), len(b) + off)] AS x, b[greatest(-off, 0) + 1:least(len(b), len(a) - off)] AS y FROM o), t AS (SELECT user_id, day, CASE WHEN len(x) >= 2 THEN 1 - list_sum(list_transform(list_zip(x, y), lambda z: bit_count(xor(z[1], z[2])))) / len(x) / 32 END AS v FROM s) SELECT user_id, day, round(coalesce(max(v), 0), 6) AS agreement FROM t GROUP BY 1, 2",
    "identity_recall": f"WITH {_SPANS}, t AS (SELECT s.*, CASE WHEN (props->>'$.k')::INT % 7 <> 0 THEN (props->>'$.k')::INT % 3 END AS who FROM s JOIN events USING (event_id)), a AS (SELECT *, EXISTS (SELECT 1 FROM t b WHERE b.event_type = 'click' AND b.user_id = t.user_id AND b.who = t.who AND t.lo - 5 < b.hi AND b.lo < t.hi + 5) AS hit FROM t WHERE event_type = 'purchase') SELECT count(who) AS bound, count(*) - count(who) AS abstained, count(*) FILTER (hit) AS hits, round(coalesce(count(*) FILTER (hit) / nullif(count(who), 0), 0), 6) AS recall, round(coalesce(count(who) / nullif(count(*), 0), 0), 6) AS adjudicable FROM a",
    "rewired_degrees": "SELECT l_suppkey AS row, count(DISTINCT l_partkey) AS before, true AS no_more, true AS nearly_all FROM lineitem GROUP BY 1",
}
