"""Weak supervision, similarity, provenance and evaluation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, times, vectors
from ..operators import evidence, graph, joins, nearest, offsets, picks, ranks, series
from ..operators.streams import dealt_by_rows
from ..sources.tables import table, written


def votes(spark: SparkSession, d: str) -> DataFrame:
    """Events as votes: the user's day is the unit, the type's number mod 3 the value (null: abstain), the type the source."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    value = F.when(k % 7 == 0, None).otherwise(k % 3)
    return e.select(F.concat_ws("/", "user_id", F.floor(times.micros(F.col("ts")) / 86_400_000_000)).alias("unit"), F.col("event_type").alias("source"), value.alias("vote"), (k / 100).alias("confidence"), (F.col("value") % 10).alias("at"), "event_id")


def json_attr_extract(spark: SparkSession, d: str) -> DataFrame:
    """The JSON property of each event, with a class of it."""
    k = F.get_json_object("props", "$['k']").cast("int")
    return table(spark, d, "events").select("event_id", k.alias("k"), F.when(k < 33, "low").when(k < 66, "mid").otherwise("high").alias("class"))


def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return evidence.majority(votes(spark, d), "unit", "vote").select("unit", "vote", "mass", F.round("share", 6).alias("share"))


def weighted_vote(spark: SparkSession, d: str) -> DataFrame:
    m = evidence.majority(votes(spark, d), "unit", "vote", F.col("confidence"))
    return m.select("unit", "vote", F.round("mass", 6).alias("mass"), F.round("share", 6).alias("share"))


def decision_gate(spark: SparkSession, d: str) -> DataFrame:
    """Decisions from unweighted majorities; units of users divisible by 13 are quarantined."""
    m = evidence.majority(votes(spark, d), "unit", "vote")
    top = evidence.best_value(m, "unit", "vote").join(evidence.entropy(m, "unit"), "unit")
    quarantined = F.substring_index("unit", "/", 1).cast("int") % 13 == 0
    p = F.when(F.col("vote").isNotNull(), F.col("share"))
    return top.select("unit", "vote", evidence.decided(p, F.col("entropy"), quarantined).alias("decision"))


def density_gate(spark: SparkSession, d: str) -> DataFrame:
    """Votes a unit on average decide which aggregator is used."""
    per = votes(spark, d).groupBy("unit").agg(F.count("vote").alias("n"))
    return per.agg(F.count(F.lit(1)).alias("units"), F.round(F.avg("n"), 6).alias("density")).withColumn("aggregator", F.when(F.col("density") < 2, "majority").otherwise("label_model"))


def agreement_band(spark: SparkSession, d: str) -> DataFrame:
    b = evidence.bands(votes(spark, d), "unit", "source", "at", "confidence", F.col("vote").isNull())
    return b.select("unit", F.round("consensus", 6).alias("consensus"), "n", "close", "near", "band")


def harness_merge(spark: SparkSession, d: str) -> DataFrame:
    """The winner by source priority and confidence, with 0.1 more for each other of the same value within two, at most 1."""
    v = votes(spark, d).filter("vote IS NOT NULL")
    rank = F.when(F.col("source") == "purchase", 0).when(F.col("source") == "click", 1).otherwise(2)
    win = picks.first_of(v.withColumn("priority", rank), ["unit"], [F.asc("priority"), F.desc("confidence"), F.asc("event_id")])
    win = win.select("unit", F.col("vote").alias("winner"), F.col("at").alias("w_at"), F.col("confidence").alias("w_conf"), F.col("event_id").alias("w_id"))
    near = v.join(win, "unit").filter("event_id != w_id AND vote = winner AND abs(at - w_at) <= 2").groupBy("unit").agg(F.count(F.lit(1)).alias("bonus"))
    return win.join(near, "unit", "left").select("unit", "winner", F.round(F.least(F.lit(1.0), F.col("w_conf") + 0.1 * F.coalesce("bonus", F.lit(0))), 6).alias("confidence"))


def borda_points(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers ranked by price in each return flag of a part, fused by points."""
    line = dealt_by_rows(table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_suppkey", "l_extendedprice"), "l_partkey")
    line = line.groupBy("l_partkey", "l_returnflag", "l_suppkey").agg(F.max("l_extendedprice").alias("score"))
    return evidence.borda(line, "l_partkey", "l_returnflag", "l_suppkey", "score")


def margin_gate(spark: SparkSession, d: str) -> DataFrame:
    """A part's claimed supplier (its key mod 13, plus 1; none where the key is divisible by 7) against the best by points, with a floor of
    six points and a margin of two; a claim without points can't be compared and stands."""
    claim = F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey") % 13 + 1)
    points = borda_points(spark, d).withColumn("claim", claim)
    points = points.withColumn("claimed", F.max(F.when(F.col("l_suppkey") == F.col("claim"), F.col("points"))).over(Window.partitionBy("l_partkey")))
    top = picks.first_of(points, ["l_partkey"], [F.desc("points"), F.asc("l_suppkey")])
    gate = evidence.margin_gate(F.col("l_suppkey"), F.col("points"), F.col("claim"), F.col("claimed"), 6, 2)
    return top.withColumn("gate", gate).select("l_partkey", "gate", F.when(F.col("gate") == "override", F.col("l_suppkey")).otherwise(F.col("claim")).alias("chosen"))


def beta_precision(spark: SparkSession, d: str) -> DataFrame:
    """Precision of each source against the unit's majority."""
    v = votes(spark, d)
    top = evidence.best_value(evidence.majority(v, "unit", "vote"), "unit", "vote").select("unit", F.col("vote").alias("gold"))
    own = evidence.beta_update(v.join(top, "unit"), "source", F.when(F.col("vote").isNotNull(), F.col("vote") == F.col("gold")))
    return own.select("source", "hits", "n", F.round("precision", 6).alias("precision"))


def lf_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Coverage and fired/abstained counts of each source."""
    return votes(spark, d).groupBy("source").agg(F.count("vote").alias("fired"), F.count_if(F.col("vote").isNull()).alias("abstained"), F.round(F.count("vote") / F.count(F.lit(1)), 6).alias("coverage"))


def dawid_skene_k(spark: SparkSession, d: str) -> DataFrame:
    """Posteriors after two EM steps."""
    p = evidence.dawid_skene(votes(spark, d), "unit", "source", "vote", 2)
    return p.select("unit", "vote", F.round("posterior", 5).alias("posterior"))


def belief_quality(spark: SparkSession, d: str) -> DataFrame:
    """Noisy-or over sources of the best confidence of each, times the share of the unit's votes."""
    v = votes(spark, d).filter("vote IS NOT NULL")
    best = v.groupBy("unit", "vote", "source").agg(F.max("confidence").alias("p"), F.count(F.lit(1)).alias("n"))
    own = best.groupBy("unit", "vote").agg((1 - F.exp(F.sum(F.log(1 - F.col("p") * 0.999)))).alias("belief"), F.sum("n").alias("n"))
    return own.select("unit", "vote", F.round(F.col("belief") * F.col("n") / F.sum("n").over(Window.partitionBy("unit")), 6).alias("quality"))


def confident_joint(spark: SparkSession, d: str) -> DataFrame:
    """Confident-learning counts: quality labels against classes that a score (length of the text) puts above its class's mean."""
    docs = table(spark, d, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("p1"))
    x = table(spark, d, "labels").select("doc_id", "quality").join(docs, "doc_id")
    x = x.withColumn("p0", 1 - F.col("p1"))
    t = x.agg(F.avg(F.when(F.col("quality") == 1, F.col("p1"))).alias("t1"), F.avg(F.when(F.col("quality") == 0, F.col("p0"))).alias("t0")).first()
    above1, above0 = F.col("p1") >= F.lit(t["t1"]), F.col("p0") >= F.lit(t["t0"])
    guess = F.when(above1 & above0, (F.col("p1") >= F.col("p0")).cast("int")).when(above1, 1).when(above0, 0).otherwise((F.col("p1") >= F.col("p0")).cast("int"))
    return x.groupBy("quality", guess.alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def budget_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Per user: the first three purchases go to the first budget, what overflows and the first views to the second, of four."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id", "first").orderBy("event_id")
    e = e.withColumn("first", F.col("event_type") == "purchase").withColumn("r1", F.row_number().over(w))
    one = F.col("first") & (F.col("r1") <= 3)
    rest = (~one) & F.col("event_type").isin("purchase", "view")
    e = e.withColumns({"one": one, "two": rest}).withColumn("r2", F.row_number().over(Window.partitionBy("user_id", "two").orderBy("event_id")))
    return e.filter("one OR (two AND r2 <= 4)").select("event_id", F.when(F.col("one"), 1).otherwise(2).alias("budget"))


def reacquire_queue(spark: SparkSession, d: str) -> DataFrame:
    """Units where all abstain, each once, if tried fewer than three times."""
    v = votes(spark, d).groupBy("unit").agg(F.count("vote").alias("fired"), F.count(F.lit(1)).alias("attempts"))
    return v.filter("fired = 0 AND attempts < 3").select("unit", "attempts")


def retry_state(spark: SparkSession, d: str) -> DataFrame:
    """Attempts folded into states: failures of a user since its last purchase, capped at five."""
    e = table(spark, d, "events")
    last = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("last_ok"))
    since = e.filter("event_type = 'error'").join(last, "user_id", "left").filter("last_ok IS NULL OR event_id > last_ok").groupBy("user_id").agg(F.count(F.lit(1)).alias("retries"))
    users = e.select("user_id").distinct().join(since, "user_id", "left")
    n = F.coalesce("retries", F.lit(0))
    return users.select("user_id", F.least(n, F.lit(5)).alias("retries"), F.when(n >= 5, "dead").when(n > 0, "retry").otherwise("ok").alias("state"))


def latest_belief(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each user and type, and how many it supersedes."""
    w = Window.partitionBy("user_id", "event_type")
    e = table(spark, d, "events").withColumns({"place": F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))), "n": F.count(F.lit(1)).over(w)})
    return e.filter("place = 1").select("user_id", "event_type", "event_id", (F.col("n") - 1).alias("supersedes"))


def generation_chain(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as generations with the one before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", (F.row_number().over(w) - 1).alias("generation"), F.lag("o_orderkey").over(w).alias("previous"))


def lineage_edges(spark: SparkSession, d: str) -> DataFrame:
    """customer -> nation -> region as edges of names."""
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("child"), F.concat(F.lit("c"), "o_custkey").alias("parent"))
    return c.unionByName(o).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent")))


def lineage_depth(spark: SparkSession, d: str) -> DataFrame:
    """All ancestors with their least distance."""
    return graph.closure(lineage_edges(spark, d), "child", "parent")


def lineage_closure(spark: SparkSession, d: str) -> DataFrame:
    """How many descendants each ancestor has."""
    return lineage_depth(spark, d).groupBy("ancestor").agg(F.count(F.lit(1)).alias("descendants"))


def law_checks(spark: SparkSession, d: str) -> DataFrame:
    """Offenders of reference laws: orders without customer, lines without order, part or supplier."""
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    checks = [graph.dangling(o, "o_custkey", table(spark, d, "customer"), "c_custkey", "order_has_customer"), graph.dangling(line, "l_orderkey", o, "o_orderkey", "line_has_order"), graph.dangling(line, "l_partkey", table(spark, d, "part").filter("p_size < 49"), "p_partkey", "line_has_sold_part"), graph.dangling(line, "l_suppkey", table(spark, d, "supplier"), "s_suppkey", "line_has_supplier")]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def canonical_hash(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of each document's text."""
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("n"))


def artist_split(spark: SparkSession, d: str) -> DataFrame:
    """Names made of part columns, split into artists."""
    name = F.concat(F.col("p_type"), F.lit(" & "), F.col("p_brand"), F.lit(" ft. Guest - "), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.artists(name), "|").alias("artists"))


def text_axes(spark: SparkSession, d: str) -> DataFrame:
    """Axes of parts by ordered patterns, as one key."""
    rules = [("bolt", "remix"), ("ring", "edit"), ("widget", "bootleg")]
    key = text.axis_key(text.first_match(F.col("p_name"), rules), F.lit(" Vocal "), F.when(F.col("p_size") > 25, "Extended"))
    return table(spark, d, "part").select("p_partkey", key.alias("axis"), text.axis_parts(key)["version"].alias("version"))


def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Urls without query and fragment, with platform and a query parameter."""
    u = F.col("url")
    host = F.lower(F.regexp_extract(u, r"^[a-z]+://([^/?#]*)", 1))
    return table(spark, d, "pages").select("page_id", F.regexp_replace(u, r"[?#].*$", "").alias("plain"), text.first_match(host, [(r"^blog\.", "blog"), (r"^www\.", "www")], "other").alias("platform"), F.nullif(F.regexp_extract(u, r"[?&]page=(\d+)", 1), F.lit("")).alias("page"))


def timecodes(spark: SparkSession, d: str) -> DataFrame:
    """Order keys as seconds, written as timecodes, ISO durations and play times, and read back."""
    s = F.col("o_orderkey") % 20_000
    o = table(spark, d, "orders").select("o_orderkey", times.timecode(s).alias("code"), F.format_string("PT%dH%dM%dS", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60).alias("iso"), F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)).alias("played"))
    return o.select("o_orderkey", "code", times.timecode_seconds(F.col("code")).alias("from_code"), times.iso_seconds(F.col("iso")).alias("from_iso"), times.play_time_minutes(F.col("played")).alias("minutes"))


def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Each order's two lines' part names by shared words, for neighbouring line numbers."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.split("p_name", " ").alias("words"))
    line = table(spark, d, "lineitem").join(part, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "words")
    a = line.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("other"), F.col("words").alias("w2"))
    return line.join(a, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "other", F.round(text.token_jaccard(F.col("words"), F.col("w2")), 6).alias("jaccard")).distinct()


def year_coerce(spark: SparkSession, d: str) -> DataFrame:
    """Orders per year of a date read from text, null where it can't be."""
    raw = F.when(F.col("o_orderkey") % 11 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").groupBy(F.year(F.try_to_date(raw, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.when(raw.rlike(r"^\d{4}-"), raw))).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def cyclic_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distances on a circle of twelve between supplier and part numbers."""
    return table(spark, d, "lineitem").groupBy(times.cyclic_distance(F.col("l_suppkey"), F.col("l_partkey")).alias("distance")).agg(F.count(F.lit(1)).alias("n"))


def bit_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the bits of consecutive event ids' hashes of a user (multiplied ids)."""
    w = series.ordered(["user_id"], ["ts", "event_id"])
    word = (F.col("event_id") * 2654435761) % 4294967296
    e = table(spark, d, "events").select("event_id", "user_id", "ts", word.alias("word")).withColumn("prev", F.lag("word").over(w))
    return e.filter("prev IS NOT NULL").select("event_id", F.round(vectors.bit_agreement(F.col("word"), F.col("prev")), 6).alias("agreement"))


def landmark_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Peak pairs: each event with up to eight after it within 80 hours, as (type, type, hours) with the anchor's hour."""
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    e = table(spark, d, "events").select("user_id", "event_id", "ts", kind.alias("f1"), F.floor(times.micros(F.col("ts")) / 3_600_000_000).alias("anchor"))
    e = dealt_by_rows(e, "user_id")
    w = series.ordered(["user_id"], ["ts", "event_id"])
    after = F.filter(F.array(*(F.lead(F.struct(F.col("f1").alias("f2"), F.col("anchor").alias("t2")), k).over(w) for k in range(1, 9))), lambda x: x.isNotNull())
    e = e.withColumn("after", after).select("user_id", "f1", "anchor", F.explode("after").alias("x"))
    return e.select("user_id", "f1", "x.f2", (F.col("x.t2") - F.col("anchor")).alias("dt"), "anchor").filter("dt BETWEEN 1 AND 80")


def offset_votes(spark: SparkSession, d: str) -> DataFrame:
    """For pairs of an even user and an odd one: the offset with the most common landmarks, and its sharpness.

    Landmarks that fall together in place are counted before they meet, so a hot one is one row a place.
    """
    mark = (F.col("f1") * 5 + F.col("f2")) * 81 + F.col("dt")
    h = landmark_hashes(spark, d).groupBy(F.col("user_id").alias("who"), mark.alias("key"), F.col("anchor").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    h = written(h)
    n = offsets.best_offsets(h.filter("who % 2 = 0"), h.filter("who % 2 = 1"))
    return n.select("mix", "ref", "offset", "votes", F.round(F.col("votes") / F.greatest("second", F.lit(1)), 6).alias("sharpness"))


def capped_matches(spark: SparkSession, d: str) -> DataFrame:
    """Landmarks of two groups of users by weight 1 / log2(2 + n * m), those above 64 left out as the rule says."""
    h = landmark_hashes(spark, d)
    mix = h.filter("user_id < 75").select("f1", "f2", "dt", F.col("user_id").alias("mix"))
    ref = h.filter("user_id >= 75").select("f1", "f2", "dt", F.col("user_id").alias("ref"))
    m = joins.capped_matches(mix, ref, ["f1", "f2", "dt"], 64)
    return m.groupBy("mix", "ref").agg(F.round(F.sum(1 / F.log2(2 + F.col("freq"))), 5).alias("weight"), F.count(F.lit(1)).alias("n"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest by cosine among all for each query vector (ids divisible by 20)."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest.top_cosines(e.filter("id % 20 = 0"), e, 5).select("q", F.col("id").alias("vec_id"), "cosine", "place")


def chamfer_rank(spark: SparkSession, d: str) -> DataFrame:
    """Labels ranked by the mean, over query vectors of another, of the best cosine in it."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("mark"), F.col("embedding").alias("vector"))
    best = nearest.highest_cosines(e.filter("id % 20 = 0"), e)
    return best.groupBy("own", F.col("mark").alias("label")).agg(F.round(F.avg("best"), 4).alias("chamfer"))


def bh_qvalues(spark: SparkSession, d: str) -> DataFrame:
    """Benjamini-Hochberg over p-values made of each user's values."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.round(F.exp(-F.max("value") / 100), 9).alias("p")).withColumn("family", F.col("user_id") % 3)
    return series.benjamini_hochberg(e, ["family"], "p").select("user_id", "p", F.round("q", 6).alias("q"))


def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    """Area under the curve of text length for quality labels, by average ranks; per language."""
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    x = ranks.ranked(x, ["lang"], "n_chars", ["doc_id"]).withColumn("rank", F.col("rank") + (F.col("ties") - 1) / 2)
    a = x.groupBy("lang").agg(F.sum(F.when(F.col("quality") == 1, F.col("rank"))).alias("r"), F.count_if(F.col("quality") == 1).alias("p"), F.count_if(F.col("quality") == 0).alias("n"))
    return a.select("lang", F.round((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("n"), F.lit(0)), 6).alias("auc"))


def tie_fair(spark: SparkSession, d: str) -> DataFrame:
    """Credit for each supplier's top quantity in a part, shared among ties."""
    w = Window.partitionBy("l_partkey")
    line = table(spark, d, "lineitem").withColumn("top", F.max("l_quantity").over(w)).filter("l_quantity = top")
    line = line.withColumn("credit", 1 / F.count(F.lit(1)).over(w))
    return line.groupBy("l_suppkey").agg(F.round(F.sum("credit"), 6).alias("credit"))


def fixed_denominator(spark: SparkSession, d: str) -> DataFrame:
    """Mean quality over all documents of a language, unlabelled ones as 0."""
    docs = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("quality", F.lit(0))), 6).alias("score"))


def ablation_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Mean price per segment and status."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    wide = o.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 2))
    return wide.select("c_mktsegment", F.col("F").alias("status_f"), F.col("O").alias("status_o"), F.col("P").alias("status_p"))


QUERIES = {f.__name__: f for f in (json_attr_extract, majority_vote, weighted_vote, decision_gate, density_gate, agreement_band, harness_merge, borda_points, margin_gate, beta_precision, lf_accuracy, dawid_skene_k, belief_quality, confident_joint, budget_allocation, reacquire_queue, retry_state, latest_belief, generation_chain, lineage_depth, lineage_closure, law_checks, canonical_hash, artist_split, text_axes, url_normalize, timecodes, token_jaccard, year_coerce, cyclic_distance, bit_agreement, landmark_hashes, offset_votes, capped_matches, cosine_topk, chamfer_rank, bh_qvalues, auc_rank, tie_fair, fixed_denominator, ablation_pivot)}

_V = "j AS (SELECT *, (props->>'$.k')::INT AS k FROM events), v AS (SELECT user_id || '/' || (epoch_us(ts) // 86400000000) AS unit, user_id, event_type AS source, CASE WHEN k % 7 = 0 THEN NULL ELSE k % 3 END AS vote, k / 100 AS confidence, value % 10 AS at0, event_id FROM j)"
_M = f"{_V}, m AS (SELECT unit, vote, count(*)::DOUBLE AS mass FROM v WHERE vote IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT unit, NULL, 1.0 FROM v GROUP BY unit HAVING count(vote) = 0), s AS (SELECT *, mass / sum(mass) OVER (PARTITION BY unit) AS share FROM m)"
_TOP = f"{_M}, t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY unit ORDER BY share DESC, vote NULLS LAST) = 1)"
_BORDA = "a AS (SELECT l_partkey, l_returnflag, l_suppkey, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL), b AS (SELECT *, count(*) OVER (PARTITION BY l_partkey, l_returnflag) - row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY score DESC, l_suppkey) + 1 AS p FROM a), c AS (SELECT l_partkey, l_suppkey, sum(p)::BIGINT AS points FROM b GROUP BY 1, 2)"
_EDGES = "edges AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), walk AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM edges UNION ALL SELECT w.node, e.parent, depth + 1 FROM walk w JOIN edges e ON w.ancestor = e.child), least0 AS (SELECT node, ancestor, min(depth) AS depth FROM walk GROUP BY 1, 2)"
_LM = "e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS f1, epoch_us(ts) // 3600000000 AS anchor, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), h AS (SELECT a.user_id, a.f1, b.f1 AS f2, b.anchor - a.anchor AS dt, a.anchor FROM e a JOIN e b ON a.user_id = b.user_id AND b.rn BETWEEN a.rn + 1 AND a.rn + 8 WHERE b.anchor - a.anchor BETWEEN 1 AND 80)"
_EM = "(SELECT *, exp(lg - max(lg) OVER (PARTITION BY unit)) * CASE WHEN vote IS NULL THEN 1.05 ELSE 1 END AS o FROM (SELECT unit, vote, sum(ln(CASE WHEN given = vote THEN a WHEN vote IS NULL THEN (1 - a) / k0 ELSE (1 - a) / greatest(k0 - 1, 1) END)) AS lg FROM cells JOIN {} USING (source) GROUP BY 1, 2))"
_COS = "list_aggregate(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE), 'sum') / (sqrt(list_aggregate(list_transform(q.embedding, lambda p: p::DOUBLE * p::DOUBLE), 'sum')) * sqrt(list_aggregate(list_transform(e.embedding, lambda p: p::DOUBLE * p::DOUBLE), 'sum')))"
ORACLES = {
    "json_attr_extract": "SELECT event_id, k, CASE WHEN k < 33 THEN 'low' WHEN k < 66 THEN 'mid' ELSE 'high' END AS class FROM (SELECT event_id, (props->>'$.k')::INT AS k FROM events)",
    "majority_vote": f"WITH {_M} SELECT unit, vote, mass, round(share, 6) AS share FROM s",
    "weighted_vote": f"WITH {_V}, m AS (SELECT unit, vote, sum(confidence) AS mass FROM v WHERE vote IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT unit, NULL, 1.0 FROM v GROUP BY unit HAVING count(vote) = 0) SELECT unit, vote, round(mass, 6) AS mass, round(mass / sum(mass) OVER (PARTITION BY unit), 6) AS share FROM m",
    "decision_gate": f"WITH {_TOP}, h AS (SELECT unit, -sum(share * ln(share)) AS h FROM s GROUP BY 1) SELECT unit, vote, CASE WHEN split_part(unit, '/', 1)::INT % 13 = 0 THEN 'quarantined' WHEN vote IS NULL THEN 'unresolved' WHEN share < 0.15 THEN 'rejected' WHEN share < 0.55 OR h > 1.5 THEN 'unresolved' ELSE 'accepted' END AS decision FROM t JOIN h USING (unit)",
    "density_gate": f"WITH {_V}, n AS (SELECT unit, count(vote) AS n FROM v GROUP BY 1) SELECT count(*) AS units, round(avg(n), 6) AS density, CASE WHEN round(avg(n), 6) < 2 THEN 'majority' ELSE 'label_model' END AS aggregator FROM n",
    "agreement_band": f"WITH {_V}, u AS (SELECT DISTINCT unit FROM v), o AS (SELECT * FROM v WHERE vote IS NOT NULL QUALIFY row_number() OVER (PARTITION BY unit, source ORDER BY confidence DESC, at0) = 1), c AS (SELECT *, median(at0) OVER (PARTITION BY unit) AS consensus FROM o), g AS (SELECT unit, consensus, count(*) AS n, count(*) FILTER (abs(at0 - consensus) <= 1) AS close, count(*) FILTER (abs(at0 - consensus) <= 3) AS near, avg(confidence) FILTER (abs(at0 - consensus) <= 1) AS mc, max(confidence) AS top FROM c GROUP BY 1, 2) SELECT unit, round(consensus, 6) AS consensus, coalesce(n, 0) AS n, coalesce(close, 0) AS close, coalesce(near, 0) AS near, CASE WHEN n >= 2 AND close >= 2 AND mc >= 0.55 THEN 'ACCEPT' WHEN near >= 2 OR top >= 0.7 THEN 'REVIEW' ELSE 'ABSTAIN' END AS band FROM u LEFT JOIN g USING (unit)",
    "harness_merge": f"WITH {_V}, x AS (SELECT *, CASE source WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS pr FROM v WHERE vote IS NOT NULL), w AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY unit ORDER BY pr, confidence DESC, event_id) = 1) SELECT unit, vote AS winner, round(least(1.0, confidence + 0.1 * (SELECT count(*) FROM x WHERE x.unit = w.unit AND x.event_id <> w.event_id AND x.vote = w.vote AND abs(x.at0 - w.at0) <= 2)), 6) AS confidence FROM w",
    "borda_points": f"WITH {_BORDA} SELECT * FROM c",
    "margin_gate": f"WITH {_BORDA}, t AS (SELECT *, CASE WHEN l_partkey % 7 <> 0 THEN l_partkey % 13 + 1 END AS claim FROM c QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY points DESC, l_suppkey) = 1), r AS (SELECT t.*, CASE WHEN claim IS NULL THEN t.points >= 6 WHEN o.points IS NULL THEN false ELSE t.l_suppkey <> claim AND t.points >= 6 AND t.points - o.points >= 2 END AS over0 FROM t LEFT JOIN c o ON o.l_partkey = t.l_partkey AND o.l_suppkey = claim) SELECT l_partkey, CASE WHEN over0 THEN 'override' WHEN claim IS NOT NULL THEN 'accept' ELSE 'abstain' END AS gate, CASE WHEN over0 THEN l_suppkey ELSE claim END AS chosen FROM r",
    "beta_precision": f"WITH {_TOP} SELECT source, count(*) FILTER (v.vote = t.vote) AS hits, count(*) AS n, round((1 + count(*) FILTER (v.vote = t.vote)) / (2 + count(*)), 6) AS precision FROM v JOIN t USING (unit) WHERE v.vote IS NOT NULL GROUP BY 1",
    "lf_accuracy": f"WITH {_V} SELECT source, count(vote) AS fired, count(*) - count(vote) AS abstained, round(count(vote) / count(*), 6) AS coverage FROM v GROUP BY 1",
    "dawid_skene_k": f"""WITH {_V}, given0 AS (SELECT unit, source, vote AS given FROM v WHERE vote IS NOT NULL), ks AS (SELECT unit, count(DISTINCT given) AS k0 FROM given0 GROUP BY 1), vals AS (SELECT DISTINCT unit, given AS vote FROM given0 UNION ALL SELECT unit, NULL FROM ks),
cells AS (SELECT unit, source, given, vote, k0 FROM given0 JOIN vals USING (unit) JOIN ks USING (unit)), a0 AS (SELECT DISTINCT source, 0.7::DOUBLE AS a FROM given0),
p0 AS (SELECT unit, vote, o / sum(o) OVER (PARTITION BY unit) AS p FROM {_EM.format('a0')}), a1 AS (SELECT source, greatest(0.01, least(0.99, avg(p))) AS a FROM given0 g JOIN p0 ON g.unit = p0.unit AND given = vote GROUP BY 1),
p1 AS (SELECT unit, vote, o / sum(o) OVER (PARTITION BY unit) AS p FROM {_EM.format('a1')}), a2 AS (SELECT source, greatest(0.01, least(0.99, avg(p))) AS a FROM given0 g JOIN p1 ON g.unit = p1.unit AND given = vote GROUP BY 1)
SELECT unit, vote, round(o / sum(o) OVER (PARTITION BY unit), 5) AS posterior FROM {_EM.format('a2')} UNION ALL SELECT unit, NULL, 1.0 FROM v GROUP BY unit HAVING count(vote) = 0""",
    "belief_quality": f"WITH {_V}, b AS (SELECT unit, vote, source, max(confidence) AS p, count(*) AS n FROM v WHERE vote IS NOT NULL GROUP BY ALL), c AS (SELECT unit, vote, 1 - exp(sum(ln(1 - p * 0.999))) AS belief, sum(n) AS n FROM b GROUP BY 1, 2) SELECT unit, vote, round(belief * n / sum(n) OVER (PARTITION BY unit), 6) AS quality FROM c",
    "confident_joint": "WITH x AS (SELECT quality, least(1.0, n_chars / 4000) AS p1, 1 - least(1.0, n_chars / 4000) AS p0 FROM labels JOIN documents USING (doc_id)), t AS (SELECT avg(p1) FILTER (quality = 1) AS t1, avg(p0) FILTER (quality = 0) AS t0 FROM x) SELECT quality, CASE WHEN p1 >= t1 AND p0 >= t0 THEN (p1 >= p0)::INT WHEN p1 >= t1 THEN 1 WHEN p0 >= t0 THEN 0 ELSE (p1 >= p0)::INT END AS guess, count(*) AS n FROM x, t GROUP BY 1, 2",
    "budget_allocation": "WITH a AS (SELECT *, event_type = 'purchase' AS f, row_number() OVER (PARTITION BY user_id, event_type = 'purchase' ORDER BY event_id) AS r1 FROM events), b AS (SELECT *, f AND r1 <= 3 AS one, NOT (f AND r1 <= 3) AND event_type IN ('purchase', 'view') AS two FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY user_id, two ORDER BY event_id) AS r2 FROM b) SELECT event_id, CASE WHEN one THEN 1 ELSE 2 END AS budget FROM c WHERE one OR (two AND r2 <= 4)",
    "reacquire_queue": f"WITH {_V} SELECT unit, count(*) AS attempts FROM v GROUP BY 1 HAVING count(vote) = 0 AND count(*) < 3",
    "retry_state": "WITH u AS (SELECT user_id, (SELECT count(*) FROM events e WHERE e.user_id = x.user_id AND event_type = 'error' AND event_id > coalesce(x.ok, -1)) AS n FROM (SELECT user_id, max(event_id) FILTER (event_type = 'purchase') AS ok FROM events GROUP BY 1) x) SELECT user_id, least(n, 5) AS retries, CASE WHEN n >= 5 THEN 'dead' WHEN n > 0 THEN 'retry' ELSE 'ok' END AS state FROM u",
    "latest_belief": "SELECT user_id, event_type, event_id, count(*) OVER (PARTITION BY user_id, event_type) - 1 AS supersedes FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "generation_chain": "SELECT o_orderkey, row_number() OVER w - 1 AS generation, lag(o_orderkey) OVER w AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "lineage_depth": f"WITH RECURSIVE {_EDGES} SELECT node, ancestor, depth FROM least0",
    "lineage_closure": f"WITH RECURSIVE {_EDGES} SELECT ancestor, count(*) AS descendants FROM least0 GROUP BY 1",
    "law_checks": "SELECT DISTINCT 'order_has_customer' AS law, o_custkey::VARCHAR AS offender FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT DISTINCT 'line_has_order', l_orderkey::VARCHAR FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT DISTINCT 'line_has_sold_part', l_partkey::VARCHAR FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 49) UNION ALL SELECT DISTINCT 'line_has_supplier', l_suppkey::VARCHAR FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)",
    "canonical_hash": "SELECT doc_id, sha256(text) AS sha256, length(text) AS n FROM documents",
    "artist_split": "SELECT p_partkey, p_type || '|' || p_brand AS artists FROM part",
    "text_axes": "SELECT p_partkey, version || '__vocal__' || CASE WHEN p_size > 25 THEN 'extended' ELSE 'regular' END AS axis, version FROM (SELECT *, CASE WHEN p_name LIKE '%bolt%' THEN 'remix' WHEN p_name LIKE '%ring%' THEN 'edit' WHEN p_name LIKE '%widget%' THEN 'bootleg' ELSE 'regular' END AS version FROM part)",
    "url_normalize": r"SELECT page_id, regexp_replace(url, '[?#].*$', '') AS plain, CASE WHEN lower(url) LIKE '%://blog.%' THEN 'blog' WHEN lower(url) LIKE '%://www.%' THEN 'www' ELSE 'other' END AS platform, nullif(regexp_extract(url, '[?&]page=(\d+)', 1), '') AS page FROM pages",
    "timecodes": "WITH a AS (SELECT o_orderkey, o_orderkey % 20000 AS s FROM orders) SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS code, s::INT AS from_code, s::INT AS from_iso, (s // 60)::INT AS minutes FROM a",
    "token_jaccard": "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, string_split(p_name, ' ') AS w FROM lineitem JOIN part ON l_partkey = p_partkey ) SELECT DISTINCT x.l_orderkey, x.l_linenumber, x.l_partkey, y.l_partkey AS other, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) AS jaccard FROM l x JOIN l y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = y.l_linenumber + 1",
    "year_coerce": "SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE year(o_orderdate) END AS year, count(*) AS n FROM orders GROUP BY 1",
    "cyclic_distance": "SELECT least(((l_suppkey - l_partkey) % 12 + 12) % 12, 12 - ((l_suppkey - l_partkey) % 12 + 12) % 12) AS distance, count(*) AS n FROM lineitem GROUP BY 1",
    "bit_agreement": "WITH a AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS w, lag((event_id * 2654435761) % 4294967296) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT event_id, round(1 - bit_count(xor(w, p)) / 32, 6) AS agreement FROM a WHERE p IS NOT NULL",
    "landmark_hashes": f"WITH {_LM} SELECT user_id, f1, f2, dt, anchor FROM h",
    "offset_votes": f"WITH {_LM}, n AS (SELECT m.user_id AS mix, r.user_id AS ref, r.anchor - m.anchor AS \"offset\", count(*)::BIGINT AS votes FROM h m JOIN h r USING (f1, f2, dt) WHERE m.user_id % 2 = 0 AND r.user_id % 2 = 1 GROUP BY 1, 2, 3), p AS (SELECT *, row_number() OVER w AS place, lead(votes) OVER w AS second FROM n WINDOW w AS (PARTITION BY mix, ref ORDER BY votes DESC, \"offset\")) SELECT mix, ref, \"offset\", votes, round(votes / greatest(coalesce(second, 0), 1), 6) AS sharpness FROM p WHERE place = 1",
    "capped_matches": f"WITH {_LM}, m AS (SELECT f1, f2, dt, user_id AS mix FROM h WHERE user_id < 75), r AS (SELECT f1, f2, dt, user_id AS ref FROM h WHERE user_id >= 75), c AS (SELECT f1, f2, dt, (SELECT count(*) FROM r WHERE r.f1 = x.f1 AND r.f2 = x.f2 AND r.dt = x.dt) * n AS freq FROM (SELECT f1, f2, dt, count(*) AS n FROM m GROUP BY 1, 2, 3) x) SELECT mix, ref, round(sum(1 / log2(2 + freq)), 5) AS weight, count(*) AS n FROM m JOIN c USING (f1, f2, dt) JOIN r USING (f1, f2, dt) WHERE freq <= 64 GROUP BY 1, 2",
    "cosine_topk": f"WITH s AS (SELECT q.vec_id AS q, e.vec_id, round({_COS}, 5) AS cosine FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0) SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, vec_id)::INT AS place FROM s QUALIFY place <= 5",
    "chamfer_rank": f"WITH s AS (SELECT q.label AS own, e.label, q.vec_id AS q, max({_COS}) AS best FROM embeddings q JOIN embeddings e ON q.label <> e.label WHERE q.vec_id % 20 = 0 GROUP BY 1, 2, 3) SELECT own, label, round(avg(best), 4) AS chamfer FROM s GROUP BY 1, 2",
    "bh_qvalues": "WITH e AS (SELECT user_id, round(exp(-max(value) / 100), 9) AS p FROM events GROUP BY 1), r AS (SELECT *, user_id % 3 AS f, p * count(*) OVER (PARTITION BY user_id % 3) / row_number() OVER (PARTITION BY user_id % 3 ORDER BY p) AS raw FROM e) SELECT user_id, p, round(least(1.0, min(raw) OVER (PARTITION BY f ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS q FROM r",
    "auc_rank": "WITH x AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS r FROM labels JOIN documents USING (doc_id)) SELECT lang, round((sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2) / nullif(count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0), 0), 6) AS auc FROM x GROUP BY 1",
    "tie_fair": "WITH a AS (SELECT *, max(l_quantity) OVER (PARTITION BY l_partkey) AS top FROM lineitem), b AS (SELECT l_suppkey, 1 / count(*) OVER (PARTITION BY l_partkey) AS c FROM a WHERE l_quantity = top) SELECT l_suppkey, round(sum(c), 6) AS credit FROM b GROUP BY 1",
    "fixed_denominator": "SELECT lang, count(*) AS n, round(avg(coalesce(quality, 0)), 6) AS score FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "ablation_pivot": "SELECT c_mktsegment, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS status_f, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS status_o, round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS status_p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
}
