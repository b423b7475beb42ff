"""Pages, catalogs, routing, alignment pairs and scorecards over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import times
from ..operators import decoders, evidence, graph, joins, picks, series
from ..operators.streams import dealt
from ..sources.tables import table, written
from .evidence import landmark_hashes, votes
from .timeline import events, spans

FEW_PAIRS = 250_000
"""Word pairs of the benchmark up to which they are broadcast."""


def explode_list(spark: SparkSession, d: str) -> DataFrame:
    """Comma lists of part words, trimmed and counted."""
    parts = table(spark, d, "part").select(F.explode(F.split(F.concat_ws(" , ", F.split("p_name", " ")), ",")).alias("w"))
    return parts.select(F.trim("w").alias("word")).filter("word != ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def entity_bucket(spark: SparkSession, d: str) -> DataFrame:
    """One entity per part with its suppliers in order and how many flags they came with."""
    line = table(spark, d, "lineitem")
    return line.groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("l_suppkey")).cast("array<string>"), ",").alias("suppliers"), F.countDistinct("l_returnflag").alias("flags"))


def role_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Roles of lines: primary (bed or solo), then payload or constituent."""
    concurrent, vocal = F.col("l_linestatus") == "O", F.col("l_returnflag") == "R"
    role = F.when((F.col("l_linenumber") == 1) & concurrent, "bed").when(F.col("l_linenumber") == 1, "solo").when(vocal | (F.col("l_linenumber") == 2), "payload").otherwise("constituent")
    return table(spark, d, "lineitem").groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("n"))


def duration_band(spark: SparkSession, d: str) -> DataFrame:
    """Line prices against the part's list price times quantity: within, short or long of a band."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    ratio = F.col("l_extendedprice") / F.nullif(F.col("p_retailprice") * F.col("l_quantity"), F.lit(0.0))
    band = F.when(ratio.isNull(), "unknown").when(ratio < 0.9, "short").when(ratio <= 1.15, "ok").otherwise("long")
    return table(spark, d, "lineitem").join(part, "l_partkey").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def placement_votes(spark: SparkSession, d: str) -> DataFrame:
    """A vote with its reason from each event's property; abstaining is a row too."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", F.when((k >= 10) & (k < 90), k / 100).alias("place"), F.when(k < 10, "too_early").when(k >= 90, "too_late").otherwise("ok").alias("reason"))


def posterior_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Natural-log entropy of each unit's vote shares."""
    e = evidence.entropy(evidence.majority(votes(spark, d), "unit", "vote"), "unit")
    return e.select("unit", (F.round("entropy", 6) + 0.0).alias("entropy"))


def fold_interval(spark: SparkSession, d: str) -> DataFrame:
    """Prices folded towards 150,000, and the share of each status that needed it."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", times.fold_interval(F.col("o_totalprice"), F.lit(150000.0)).alias("x"))
    share = o.groupBy("o_orderstatus").agg(F.round(F.avg((F.col("x") != F.col("o_totalprice")).cast("double")), 6).alias("flips"))
    return o.join(share, "o_orderstatus").select("o_orderkey", F.round("x", 4).alias("folded"), "flips")


def explain_subject(spark: SparkSession, d: str) -> DataFrame:
    """Per user: the latest event of every type as one list, in the order of types."""
    latest = picks.first_of(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return latest.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "event_id"))), lambda x: F.concat(x["event_type"], F.lit(":"), x["event_id"])), ",").alias("axes"))


def orphan_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Orders in process that no line refers to, and processed ones, by what is to be done."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    flagged = joins.with_flag(table(spark, d, "orders"), line, ["o_orderkey"], "used")
    act = F.when(F.col("used") == 1, "keep").when(F.col("o_orderstatus") == "P", "fail").otherwise("reap")
    return flagged.groupBy(act.alias("action")).agg(F.count(F.lit(1)).alias("n"))


def segment_explode(spark: SparkSession, d: str) -> DataFrame:
    """Each order's lines as segments of a cumulative axis."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    upto = F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (upto - F.col("l_quantity")).alias("lo"), upto.alias("hi"))


def blocked_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of suppliers of one nation with the difference of their balances: pairs only within a block."""
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    t = s.select("s_nationkey", F.col("s_suppkey").alias("other"), F.col("s_acctbal").alias("other_bal"))
    return s.join(t, "s_nationkey").filter("s_suppkey < other").select("s_suppkey", "other", F.round(F.abs(F.col("s_acctbal") - F.col("other_bal")), 2).alias("apart"))


def feature_vectorize(spark: SparkSession, d: str) -> DataFrame:
    """Features with missing ones as 0 and a mark."""
    x = F.when(F.col("l_quantity") > 10, F.col("l_discount"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg(F.coalesce(x, F.lit(0.0))), 6).alias("discount"), F.count_if(x.isNull()).alias("missing"))


def label_density(spark: SparkSession, d: str) -> DataFrame:
    """How many units have how many votes."""
    return votes(spark, d).groupBy("unit").agg(F.count("vote").alias("votes")).groupBy("votes").agg(F.count(F.lit(1)).alias("units"))


def loso_calibration(spark: SparkSession, d: str) -> DataFrame:
    """For each source held out: hit rate of all others together under a uniform prior."""
    v = votes(spark, d)
    top = evidence.best_value(evidence.majority(v, "unit", "vote"), "unit", "vote").select("unit", F.col("vote").alias("gold"))
    per = v.filter("vote IS NOT NULL").join(top, "unit").groupBy("source").agg(F.count_if(F.col("vote") == F.col("gold")).alias("h"), F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    return per.select("source", F.round((F.sum("h").over(every) - F.col("h") + 1) / (F.sum("n").over(every) - F.col("n") + 2), 6).alias("precision"))


def canary_gate(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose hit rate is within 0.2 of what is asked; one that is missing fails."""
    asked = spark.createDataFrame([("click", 0.9), ("view", 0.8), ("purchase", 0.1), ("absent", 0.5)], "source string, asked double")
    v = votes(spark, d)
    top = evidence.best_value(evidence.majority(v, "unit", "vote"), "unit", "vote").select("unit", F.col("vote").alias("gold"))
    per = v.filter("vote IS NOT NULL").join(top, "unit").groupBy("source").agg(F.avg((F.col("vote") == F.col("gold")).cast("double")).alias("rate"))
    return asked.join(per, "source", "left").select("source", F.coalesce((F.abs(F.col("rate") - F.col("asked")) <= 0.2).cast("int"), F.lit(0)).alias("passes"))


def hough_bins(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of common landmarks between even and odd users in bins of 24 hours, smoothed by the neighbours, five votes at least.

    Landmarks are counted by day and hour of the day. The bin of a pair is the difference of the days, less one where the hour of the second is the lesser, so a day of one
    side meets a day of the other as two arrays of 24 counts: a landmark has at most as many pairs as there are pairs of days, whatever the users.
    """
    h = landmark_hashes(spark, d).select((F.col("user_id") % 2).alias("side"), "f1", "f2", "dt", F.floor(F.col("anchor") / 24).alias("day"), F.pmod("anchor", F.lit(24)).alias("hour"))
    counts = h.groupBy("side", "f1", "f2", "dt", "day").agg(F.array(*(F.count_if(F.col("hour") == i) for i in range(24))).alias("n"))
    a = counts.filter("side = 0").select("f1", "f2", "dt", F.col("day").alias("a"), F.col("n").alias("na"))
    b = counts.filter("side = 1").select("f1", "f2", "dt", F.col("day").alias("b"), F.col("n").alias("nb"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y)
    from_hour = b.withColumn("upto", F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: total(F.slice("nb", i, F.lit(25) - i)))).withColumn("all", total(F.col("nb"))).drop("nb")
    met = a.join(from_hour, ["f1", "f2", "dt"]).withColumn("same", total(F.zip_with("na", "upto", lambda x, y: x * y)))
    met = met.groupBy((F.col("b") - F.col("a")).alias("days")).agg(F.sum("same").alias("same"), F.sum(total(F.col("na")) * F.col("all") - F.col("same")).alias("less"))
    bins = met.select(F.explode(F.array(F.struct(F.col("days").alias("bin"), F.col("same").alias("n")), F.struct((F.col("days") - 1).alias("bin"), F.col("less").alias("n")))).alias("x")).select("x.*")
    spread = bins.select(F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), "n")
    return spread.groupBy("bin").agg(F.sum("n").alias("votes")).filter("votes >= 5")


def bigram_diagonals(spark: SparkSession, d: str) -> DataFrame:
    """Word pairs that a document shares with a benchmark item, weighed by how many items have them; the diagonal with most weight."""
    def grams(texts: DataFrame, key: str) -> DataFrame:
        w = F.split(F.lower("text"), r"[ \n]+")
        pos = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 2))
        return texts.select(F.col(key).alias("id"), w.alias("w")).filter(F.size("w") >= 2).select("id", F.explode(F.transform(pos, lambda i: F.struct(i.alias("at"), F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)).alias("g")))).alias("x")).select("id", "x.at", "x.g")

    items = grams(table(spark, d, "benchmark"), "item_id")
    df = written(items.groupBy("g").agg(F.countDistinct("id").alias("df")).withColumn("pair", F.monotonically_increasing_id()))
    items = written(items.join(df, "g").select("g", "pair", F.col("id").alias("item_id"), F.col("at").alias("at2"), "df"))
    docs, few = table(spark, d, "documents").select("doc_id", "text"), items.limit(FEW_PAIRS + 1).count() <= FEW_PAIRS
    # Few pairs of the benchmark go to where documents are dealt to, so hits are summed up where they arise; else both sides meet by pair.
    hits = grams(dealt(docs, "doc_id") if few else docs, "doc_id").join(F.broadcast(items) if few else items.hint("merge"), "g")
    hits = hits.select("id", "item_id", (F.col("at") - F.col("at2")).alias("diagonal"), "pair", "df")
    hits = (hits if few else dealt(hits, "id")).distinct()
    diag = hits.groupBy("id", "item_id", "diagonal").agg(F.round(F.sum(1 / F.col("df")), 6).alias("weight"))
    best = picks.first_of(diag.filter("weight >= 5"), ["id", "item_id"], [F.desc("weight"), F.asc("diagonal")])
    return best.select(F.col("id").alias("doc_id"), "item_id", F.col("diagonal").cast("long").alias("diagonal"), "weight")


def cycle_check(spark: SparkSession, d: str) -> DataFrame:
    """Edges from suppliers' to parts' numbers that no peeling removes: those on or above a cycle."""
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("child"), F.col("l_partkey").alias("parent")).filter("child != parent")
    return graph.on_cycles(edges, "child", "parent").groupBy().agg(F.count(F.lit(1)).alias("n_edges"))


def monotone_chain(spark: SparkSession, d: str) -> DataFrame:
    """The longest rising run of values (not adjacent) of each user in time."""
    e = events(spark, d).select("user_id", "us", "value", "event_id")
    return decoders.monotone_chain(e, ["user_id"], "us", "value")


def recall_adjudicable(spark: SparkSession, d: str) -> DataFrame:
    """Share of purchase spans met by a click span of the same user within five seconds on either side."""
    s = spans(spark, d)
    a = s.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a"), (F.col("lo") - 5).alias("a_lo"), (F.col("hi") + 5).alias("a_hi"))
    b = s.filter("event_type = 'click'").select("user_id", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    hit = joins.interval_join(a, b, ("a_lo", "a_hi"), ("b_lo", "b_hi"), 3600.0, ["user_id"]).select("a").distinct().withColumn("hit", F.lit(1))
    return a.join(hit, "a", "left").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))


def window_hits(spark: SparkSession, d: str) -> DataFrame:
    """Days (overlapping by half) with at least as many events of a type as a deviation above its mean."""
    half = 43_200_000_000
    e = events(spark, d).withColumn("w", F.explode(F.array(F.floor(F.col("us") / half), F.floor(F.col("us") / half) - 1)))
    n = e.groupBy("event_type", "w").agg(F.count(F.lit(1)).alias("votes"))
    by = Window.partitionBy("event_type")
    z = (F.col("votes") - F.avg("votes").over(by)) / (F.stddev_pop("votes").over(by) + 1e-9)
    return n.withColumn("z", F.round(z, 6)).filter("z >= 1.0")


def routed_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Events sent to the functions competent for their type, by a routing table."""
    routes = spark.createDataFrame([("click", "onset"), ("click", "tempo"), ("view", "tempo"), ("purchase", "key")], "event_type string, function string")
    return table(spark, d, "events").join(routes, "event_type").groupBy("function", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


def nearest_index_set(spark: SparkSession, d: str) -> DataFrame:
    """Per user: the indices of clicks that are nearest to some purchase."""
    e = events(spark, d)
    w = Window.partitionBy("user_id").orderBy("us")
    clicks = e.filter("event_type = 'click'").select("user_id", F.col("us").alias("click_us")).withColumn("idx", F.row_number().over(w.orderBy("click_us")) - 1)
    near = joins.nearest(e.filter("event_type = 'purchase'").select("user_id", "event_id", "us"), clicks, "us", "click_us", ["user_id"])
    hit = near.join(clicks.select("user_id", F.col("click_us").alias("near"), "idx"), ["user_id", "near"])
    return hit.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("idx")).cast("array<string>"), ",").alias("indices"))


def event_replay(spark: SparkSession, d: str) -> DataFrame:
    """The log folded per user in order: gains of purchases and losses of errors, never below zero, as a running floor."""
    step = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    w = series.ordered(["user_id"], ["event_id"]).rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, d, "events").withColumn("sum", F.sum(step).over(w))
    e = e.withColumn("level", F.col("sum") - F.least(F.lit(0), F.min("sum").over(w)))
    return picks.first_of(e, ["user_id"], [F.desc("event_id")]).select("user_id", "level")


def ext_session(spark: SparkSession, d: str) -> DataFrame:
    """Session windows of thirty minutes per user (extension)."""
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    s = e.groupBy(F.session_window("at", "2 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", times.micros(F.col("w.start")).alias("first"), "n")


QUERIES = {f.__name__: f for f in (explode_list, entity_bucket, role_ladder, duration_band, placement_votes, posterior_entropy, fold_interval, explain_subject, orphan_reconcile, segment_explode, blocked_pairs, feature_vectorize, label_density, loso_calibration, canary_gate, hough_bins, bigram_diagonals, cycle_check, monotone_chain, recall_adjudicable, window_hits, routed_fanout, nearest_index_set, event_replay, ext_session)}

from .evidence import _LM, _M, _TOP, _V  # noqa: E402
from .timeline import _E, _NEAR, _SPANS  # noqa: E402

ORACLES = {
    "explode_list": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> '' GROUP BY 1",
    "entity_bucket": "SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS suppliers, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1",
    "role_ladder": "SELECT CASE WHEN l_linenumber = 1 AND l_linestatus = 'O' THEN 'bed' WHEN l_linenumber = 1 THEN 'solo' WHEN l_returnflag = 'R' OR l_linenumber = 2 THEN 'payload' ELSE 'constituent' END AS role, count(*) AS n FROM lineitem GROUP BY 1",
    "duration_band": "WITH a AS (SELECT l_extendedprice / nullif(p_retailprice * l_quantity, 0) AS r FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT CASE WHEN r IS NULL THEN 'unknown' WHEN r < 0.9 THEN 'short' WHEN r <= 1.15 THEN 'ok' ELSE 'long' END AS band, count(*) AS n FROM a GROUP BY 1",
    "placement_votes": "SELECT event_id, CASE WHEN k >= 10 AND k < 90 THEN k / 100 END AS place, CASE WHEN k < 10 THEN 'too_early' WHEN k >= 90 THEN 'too_late' ELSE 'ok' END AS reason FROM (SELECT event_id, (props->>'$.k')::INT AS k FROM events)",
    "posterior_entropy": f"WITH {_M} SELECT unit, round(-sum(share * ln(share)), 6) + 0.0 AS entropy FROM s GROUP BY 1",
    "fold_interval": "WITH x AS (SELECT o_orderkey, o_orderstatus, o_totalprice AS p, CASE WHEN o_totalprice > 225000 THEN o_totalprice / pow(2.0, ceil(log2(o_totalprice / 225000.0))) WHEN o_totalprice < 150000 / 1.5 THEN o_totalprice * pow(2.0, ceil(log2(150000 / 1.5 / o_totalprice))) ELSE o_totalprice END AS f FROM orders) SELECT o_orderkey, round(f, 4) AS folded, round(avg((f <> p)::INT::DOUBLE) OVER (PARTITION BY o_orderstatus), 6) AS flips FROM x",
    "explain_subject": "WITH a AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, string_agg(event_type || ':' || event_id, ',' ORDER BY event_type) AS axes FROM a GROUP BY 1",
    "orphan_reconcile": "SELECT CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'keep' WHEN o_orderstatus = 'P' THEN 'fail' ELSE 'reap' END AS action, count(*) AS n FROM orders GROUP BY 1",
    "segment_explode": "SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER w - l_quantity AS lo, sum(l_quantity) OVER w AS hi FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)",
    "blocked_pairs": "SELECT a.s_suppkey, b.s_suppkey AS other, round(abs(a.s_acctbal - b.s_acctbal), 2) AS apart FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "feature_vectorize": "SELECT l_orderkey, round(avg(CASE WHEN l_quantity > 10 THEN l_discount ELSE 0 END), 6) AS discount, count(*) FILTER (l_quantity <= 10) AS missing FROM lineitem GROUP BY 1",
    "label_density": f"WITH {_V} SELECT votes, count(*) AS units FROM (SELECT unit, count(vote) AS votes FROM v GROUP BY 1) GROUP BY 1",
    "loso_calibration": f"WITH {_TOP}, p AS (SELECT source, count(*) FILTER (v.vote = t.vote) AS h, count(*) AS n FROM v JOIN t USING (unit) WHERE v.vote IS NOT NULL GROUP BY 1) SELECT source, round((sum(h) OVER () - h + 1) / (sum(n) OVER () - n + 2), 6) AS precision FROM p",
    "canary_gate": f"WITH {_TOP}, p AS (SELECT source, avg((v.vote = t.vote)::INT) AS r FROM v JOIN t USING (unit) WHERE v.vote IS NOT NULL GROUP BY 1), a(source, asked) AS (VALUES ('click', 0.9), ('view', 0.8), ('purchase', 0.1), ('absent', 0.5)) SELECT a.source, coalesce((abs(r - asked) <= 0.2)::INT, 0) AS passes FROM a LEFT JOIN p USING (source)",
    "hough_bins": f"WITH {_LM}, b AS (SELECT floor((y.anchor - x.anchor) / 24)::BIGINT AS bin, count(*) AS n FROM h x JOIN h y USING (f1, f2, dt) WHERE x.user_id % 2 = 0 AND y.user_id % 2 = 1 GROUP BY 1) SELECT bin + k AS bin, sum(n)::BIGINT AS votes FROM b, unnest([-1, 0, 1]) AS u(k) GROUP BY 1 HAVING sum(n) >= 5",
    "bigram_diagonals": r"WITH t AS (SELECT 'd' AS kind, doc_id AS id, string_split_regex(lower(text), '[ \n]+') AS w FROM documents UNION ALL SELECT 'b', item_id, string_split_regex(lower(text), '[ \n]+') FROM benchmark), g AS (SELECT kind, id, i AS at0, w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT kind, id, w, unnest(range(len(w) - 1)) AS i FROM t)), f AS (SELECT g, count(DISTINCT id) AS df FROM g WHERE kind = 'b' GROUP BY 1), y AS (SELECT DISTINCT d.id AS doc_id, b.id AS item_id, d.at0 - b.at0 AS diagonal, b.g, df FROM g d JOIN g b ON d.g = b.g AND d.kind = 'd' AND b.kind = 'b' JOIN f ON f.g = b.g), x AS (SELECT doc_id, item_id, diagonal, round(sum(1 / df), 6) AS weight FROM y GROUP BY 1, 2, 3 HAVING round(sum(1 / df), 6) >= 5) SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY weight DESC, diagonal) = 1",
    "recall_adjudicable": f"WITH {_SPANS}, a AS (SELECT *, EXISTS (SELECT 1 FROM s b WHERE b.event_type = 'click' AND b.user_id = s.user_id AND s.lo - 5 < b.hi AND b.lo < s.hi + 5) AS hit FROM s WHERE event_type = 'purchase') SELECT count(*) AS n, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*), 6) AS recall FROM a",
    "window_hits": f"WITH {_E}, w AS (SELECT event_type, us // 43200000000 - k AS w, count(*) AS votes FROM e, range(2) AS r(k) GROUP BY 1, 2), z AS (SELECT *, round((votes - avg(votes) OVER p) / (stddev_pop(votes) OVER p + 1e-9), 6) AS z FROM w WINDOW p AS (PARTITION BY event_type)) SELECT * FROM z WHERE z >= 1.0",
    "routed_fanout": "WITH r(event_type, \"function\") AS (VALUES ('click', 'onset'), ('click', 'tempo'), ('view', 'tempo'), ('purchase', 'key')) SELECT \"function\", event_type, count(*) AS n, round(sum(value), 4) AS value FROM events JOIN r USING (event_type) GROUP BY 1, 2",
    "nearest_index_set": f"WITH {_NEAR}, i AS (SELECT user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS idx FROM c) SELECT user_id, array_to_string(list_sort(list(DISTINCT idx)), ',') AS indices FROM r JOIN p USING (event_id) JOIN i ON p.user_id = i.user_id AND near = i.us GROUP BY ALL".replace("SELECT user_id, array_to_string", "SELECT i.user_id, array_to_string"),
    "event_replay": "WITH a AS (SELECT *, sum(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM events), b AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS level FROM a) SELECT user_id, arg_max(level, event_id)::BIGINT AS level FROM b GROUP BY 1",
    "ext_session": f"WITH {_E}, f AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY user_id ORDER BY us) >= 7200000000)::INT, 1) AS new FROM e), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, min(us) AS first, count(*) AS n FROM g GROUP BY user_id, k",
}
