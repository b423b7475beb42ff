"""Relational queries: filters, joins, aggregates, picks and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import joins, picks, ranks
from ..sources import tables
from ..sources.tables import table

MIN_BALANCE, MAX_URGENT, MIN_SHIPPED, MIN_ORDERS = 5000, 3, 0.88, 8
CHOSEN = [1, 2, 3, 4, 5, 6]


def quality_tier_union(spark: SparkSession, d: str) -> DataFrame:
    """Customers that pass a quality tier, with a chosen list, in priority order."""
    orders = table(spark, d, "orders")
    urgent = orders.filter(F.col("o_orderpriority").startswith("1")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_urgent"))
    shipped = orders.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_shipped"))
    total = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    customer = table(spark, d, "customer")
    tier = customer.withColumnRenamed("c_custkey", "o_custkey").join(urgent, "o_custkey", "left").join(shipped, "o_custkey", "left").join(total, "o_custkey", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    tier = tier.filter((zero("n_urgent") <= MAX_URGENT) & (F.col("c_acctbal") >= MIN_BALANCE) & (zero("n_shipped") / F.nullif(F.col("n_orders"), F.lit(0)) >= MIN_SHIPPED) & (F.col("n_orders") >= MIN_ORDERS) & (F.col("c_mktsegment") != ""))
    keys = tier.select(F.col("o_custkey").alias("c_custkey")).unionByName(spark.createDataFrame([(k,) for k in CHOSEN], "c_custkey long")).distinct()
    listed = F.col("c_custkey").isin(CHOSEN).cast("int")
    return customer.join(keys, "c_custkey").select("c_custkey", "c_name", "c_acctbal", listed.alias("listed")).orderBy(F.desc("listed"), F.desc("c_acctbal"), "c_custkey")


def claim_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose claim (from the supplier number) is known and differs from the part's brand."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_suppkey") % 7 != 0, F.concat(F.lit("Brand#"), F.col("l_suppkey") % 25 + 1)).alias("claimed"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return line.join(part, "l_partkey").filter(F.col("claimed").isNotNull() & (F.col("claimed") != F.col("p_brand")))


def row_family_counts(spark: SparkSession, d: str) -> DataFrame:
    """Conditional sums per return flag."""
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(q < 10).alias("n_low"), F.count_if((q >= 10) & (q < 30)).alias("n_mid"), F.count_if(q >= 30).alias("n_high"), F.sum(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("n_open"))


def grammar_fractions(spark: SparkSession, d: str) -> DataFrame:
    """Per customer: semantic bins of discounts as fractions, counts, extremes and the statuses met; at least 20 lines."""
    x = F.col("l_discount")
    band = F.when(x <= 0, "none").when(x <= 0.03, "low").when(x <= 0.07, "mid").otherwise("high")
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("band", band)
    share = lambda b: F.round(F.avg(F.when(F.col("band") == b, 1.0).otherwise(0.0)), 6).alias(f"share_{b}")
    out = rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), *(share(b) for b in ("none", "low", "mid", "high")), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"))
    return out.filter("n >= 20")


def density_quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    """Orders by the quarter of their price; inner edges are the sorted values at n * k / 4, a bin counts the edges below."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    n = orders.count()
    places = {max(0, min(n - 1, n * k // 4)) + 1 for k in (1, 2, 3)}
    # The three edges are single rows; range-ordering and a running count find them without one task sorting all.
    ranked = orders.groupBy("o_totalprice").agg(F.count(F.lit(1)).alias("m"))
    ranked = ranked.withColumn("bucket", F.floor(F.col("o_totalprice") / 1000))
    before = ranked.groupBy("bucket").agg(F.sum("m").alias("s")).select("bucket", F.coalesce(F.sum("s").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = ranked.join(before, "bucket").withColumn("upto", F.col("before") + F.sum("m").over(Window.partitionBy("bucket").orderBy("o_totalprice")))
    hit = F.lit(False)
    for p in places:
        hit = hit | ((F.col("upto") >= p) & (F.col("upto") - F.col("m") < p))
    edges = sorted(r[0] for r in upto.filter(hit).select("o_totalprice").collect())
    edges = [edges[min(len(edges) - 1, i)] for i in range(3)] if edges else []
    binned = sum((F.when(F.col("o_totalprice") > e, 1).otherwise(0) for e in edges), F.lit(0))
    return orders.withColumn("bin", binned).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


def coverage_starvation(spark: SparkSession, d: str) -> DataFrame:
    """Share of customers with an order above 400,000, per segment, per nation and per both: one pass of grouping sets."""
    rich = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    flagged = joins.with_flag(table(spark, d, "customer"), rich, ["c_custkey"], "covered")
    sets = flagged.groupingSets([["c_mktsegment"], ["c_nationkey"], ["c_mktsegment", "c_nationkey"]], "c_mktsegment", "c_nationkey")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("covered"), 6).alias("coverage"))


def platform_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Per user: events of each type, their total, and the largest purchase."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    events = table(spark, d, "events")
    wide = events.groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).fillna(0, kinds)
    total = sum((F.col(k) for k in kinds), F.lit(0))
    return wide.withColumn("total", total).join(events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("top_purchase")), "user_id")


def confusion_crosstab(spark: SparkSession, d: str) -> DataFrame:
    """Quality against toxicity of labelled documents, with precision of each row."""
    t = table(spark, d, "labels").groupBy("quality").agg(F.count_if(F.col("toxic") == 0).alias("toxic_0"), F.count_if(F.col("toxic") == 1).alias("toxic_1"))
    return t.withColumn("share_toxic", F.round(F.col("toxic_1") / F.nullif(F.col("toxic_0") + F.col("toxic_1"), F.lit(0)), 6))


def loss_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Lines by the first cause that binds, with sizes, means and shares of all quantity."""
    cause = F.when(F.col("l_tax") == 0, "no_tax").when(F.col("l_discount") > 0.08, "discount").when(F.col("l_quantity") < 5, "small").when(F.col("l_returnflag") == "R", "returned").otherwise("none")
    by = table(spark, d, "lineitem").groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))
    return by.withColumn("share", F.round(F.col("quantity") / F.sum("quantity").over(Window.partitionBy()), 6))


def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    """One row per part from its lines: first known values in line order, flags, extremes, distinct counts."""
    line = table(spark, d, "lineitem").withColumn("note", F.when(F.col("l_quantity") > 25, F.col("l_returnflag")))
    firsts = picks.first_known(line, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"], ["note"])
    return line.groupBy("l_partkey").agg(*firsts, F.bool_or(F.col("l_linestatus") == "F").cast("int").alias("any_final"), F.max("l_extendedprice").alias("top_price"), F.countDistinct("l_suppkey").alias("n_suppliers"))


def reference_pick(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's reference order: urgent ones first, else the newest."""
    orders = table(spark, d, "orders").withColumn("is_reference", F.col("o_orderpriority").startswith("1").cast("int"))
    return picks.first_of(orders, ["o_custkey"], [F.desc("is_reference"), F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "is_reference")


def min_id_pick_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their least order, through a pre-aggregate instead of a correlated subquery."""
    orders = table(spark, d, "orders")
    least = picks.least_per_key(orders, ["o_custkey"], "o_orderkey", "o_orderkey").select("o_orderkey")
    return orders.join(least, "o_orderkey", "left_semi").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


def census_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Where each customer falls out first: no order, no urgent order, no large line, else eligible."""
    orders, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("any_order"))
    urgent = orders.filter(F.col("o_orderpriority").startswith("1")).groupBy("o_custkey").agg(F.min("o_orderkey").alias("urgent_order"))
    large = line.filter("l_quantity >= 49").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.min("o_orderkey").alias("large_order"))
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey").join(first, "o_custkey", "left").join(urgent, "o_custkey", "left").join(large, "o_custkey", "left")
    state = F.when(F.col("any_order").isNull(), "no_order").when(F.col("urgent_order").isNull(), "no_urgent").when(F.col("large_order").isNull(), "no_large").otherwise("eligible")
    return c.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def slot_resolve_tier(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate line for each part: tier of the match, then reference flag, platform rank and newest."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 3).alias("want_stem"), (F.col("p_size") % 2).alias("want_variant"))
    line = table(spark, d, "lineitem").withColumns({"stem": F.col("l_linenumber") % 3, "variant": F.col("l_linenumber") % 2, "is_ref": (F.col("l_returnflag") == "R").cast("int")})
    same_s, same_v = F.col("stem") == F.col("want_stem"), F.col("variant") == F.col("want_variant")
    tier = F.when(same_s & same_v, 0).when(same_s & (F.col("variant") == 0), 1).when((F.col("stem") == 0) & same_v, 2).when((F.col("stem") == 0) & (F.col("variant") == 0), 3).otherwise(4)
    platform = F.when(F.col("l_linestatus") == "O", 0).otherwise(1)
    best = picks.first_of(line.join(part, "l_partkey").withColumns({"tier": tier, "platform": platform}), ["l_partkey"], [F.asc("tier"), F.desc("is_ref"), F.asc("platform"), F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_suppkey"), F.asc("l_quantity")])
    return best.select("l_partkey", "tier", "is_ref", "platform", "l_orderkey")


def slot_satisfaction(spark: SparkSession, d: str) -> DataFrame:
    """What each part's best candidate means, and the actions it suggests (none, one or two rows a part)."""
    best = slot_resolve_tier(spark, d)
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 5 == 0).alias("payload")).join(best, "l_partkey", "left")
    state = F.when(F.col("tier").isNull(), "MISSING").when((F.col("tier") == 4) | ((F.col("tier") == 2) & F.col("payload")), "WRONG_STEM").when(F.col("tier") == 0, "SATISFIED").otherwise("FALLBACK")
    acts = F.array_compact(F.array(F.when(F.col("state") == "MISSING", "acquire"), F.when(F.col("state") == "WRONG_STEM", "separate"), F.when(F.col("state").isin("WRONG_STEM", "FALLBACK"), "review")))
    return parts.withColumn("state", state).withColumn("action", F.explode_outer(acts)).groupBy("state", "action").agg(F.count(F.lit(1)).alias("n"))


def missing_anti(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an order of 450,000 or more."""
    large = table(spark, d, "orders").filter("o_totalprice >= 450000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(large, "c_custkey", "left_anti").select("c_custkey", "c_name")


def orphan_multi_anti(spark: SparkSession, d: str) -> DataFrame:
    """Parts in no line of 48 or more, in none returned in small, and whose key is no order key of either kind."""
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    key = lambda df, c: df.select(F.col(c).alias("p_partkey")).distinct()
    either = key(orders.filter("o_orderstatus = 'P'"), "o_orderkey").unionByName(key(orders.filter("o_orderpriority LIKE '1%'"), "o_custkey")).distinct()
    out = table(spark, d, "part").join(key(line.filter("l_quantity >= 48"), "l_partkey"), "p_partkey", "left_anti")
    return out.join(key(line.filter("l_returnflag = 'R' AND l_quantity < 3"), "l_partkey"), "p_partkey", "left_anti").join(either, "p_partkey", "left_anti").select("p_partkey")


def scope_semi_or(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers met in a large line or sharing a nation with a customer in debt: a semi-join against united keys."""
    met = table(spark, d, "lineitem").filter("l_quantity >= 50").select(F.col("l_suppkey").alias("s_suppkey"))
    nations = table(spark, d, "customer").filter("c_acctbal < -900").select(F.col("c_nationkey").alias("s_nationkey")).distinct()
    supplier = table(spark, d, "supplier")
    ids = met.unionByName(supplier.join(nations, "s_nationkey", "left_semi").select("s_suppkey")).distinct()
    return supplier.join(ids, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


def existence_flag(spark: SparkSession, d: str) -> DataFrame:
    """Customers with 1 if they have an urgent order, else 0."""
    urgent = table(spark, d, "orders").filter("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.with_flag(table(spark, d, "customer").select("c_custkey"), urgent, ["c_custkey"], "has_urgent")


def or_key_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with the parts whose key or size is theirs, those without any kept."""
    supplier, part = table(spark, d, "supplier").select("s_suppkey"), table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size"))
    return supplier.join(joins.either_key(supplier, part, "s_suppkey", ("p_partkey", "p_size")).select("s_suppkey", "p_partkey"), "s_suppkey", "left")


def set_except(spark: SparkSession, d: str) -> DataFrame:
    """Parts ordered returned but never open."""
    line = table(spark, d, "lineitem")
    return line.filter("l_returnflag = 'R'").select("l_partkey").subtract(line.filter("l_quantity > 45").select("l_partkey"))


def wanted_union(spark: SparkSession, d: str) -> DataFrame:
    """Keys wanted for either reason, once each."""
    line = table(spark, d, "lineitem")
    return line.filter("l_discount >= 0.1").select(F.col("l_partkey").alias("k")).unionByName(line.filter("l_quantity = 1").select(F.col("l_suppkey").alias("k"))).distinct()


def intersect_ext(spark: SparkSession, d: str) -> DataFrame:
    """Customers with both an urgent and a low order (extension)."""
    o = table(spark, d, "orders")
    return o.filter("o_orderpriority LIKE '1%'").select("o_custkey").intersect(o.filter("o_orderpriority LIKE '5%'").select("o_custkey"))


def top_ranked_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The 50 orders that rank first: status by a fixed priority, then price."""
    priority = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", priority.alias("priority")).orderBy("priority", F.desc("o_totalprice"), "o_orderkey").limit(50)


def cte_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Three chained aggregates: orders, customers, segments."""
    per_order = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"))
    per_customer = table(spark, d, "orders").join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").join(per_customer, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.sum("quantity").alias("quantity"), F.sum("n").alias("n_orders"), F.max("n").alias("most_orders"))


def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    """Order keys that no line has."""
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


def table_scan_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every table."""
    out = None
    for name in tables.TABLES:
        one = table(spark, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def job_select(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 open orders of 1996 and later, in a seeded order that no engine's generator decides."""
    seeded = F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit("#17")).cast("binary"))
    return table(spark, d, "orders").filter("o_orderstatus = 'O' AND o_orderdate >= '1996-01-01'").select("o_orderkey", "o_custkey", seeded.alias("draw")).orderBy("draw", "o_orderkey").limit(100)


def append_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Users (with the first event each) that the second half of the log appends to the first."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") * 1000 + F.floor(F.col("value") * 10) % 97).alias("k"))
    return tables.append_dedup(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["k"], "event_id")


def latest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The latest order of each customer after purchases are upserted over the rest."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return tables.latest_upsert(o.filter("o_orderkey % 3 != 0"), o.filter("o_orderkey % 3 = 0"), ["o_custkey"], "o_orderkey")


def ext_cube(spark: SparkSession, d: str) -> DataFrame:
    """All groupings of flag and status (extension)."""
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def performer_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Share of each supplier's lines whose part name has the word of the supplier's number in it, or whose first word lies in that word."""
    words = F.array(*map(F.lit, ("red", "blue", "small", "large", "ring", "bolt", "widget")))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    own = F.element_at(words, (F.col("l_suppkey") % 7 + 1).cast("int"))
    return table(spark, d, "lineitem").join(part, "l_partkey").groupBy("l_suppkey").agg(F.round(F.avg((F.contains(F.col("p_name"), own) | F.contains(own, F.substring_index("p_name", " ", 1))).cast("double")), 6).alias("fraction"), F.count(F.lit(1)).alias("n"))


def duplicate_identity(spark: SparkSession, d: str) -> DataFrame:
    """Part names that more than one key has, with their keys in order."""
    return table(spark, d, "part").groupBy("p_name", "p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("p_partkey")).cast("array<string>"), ",").alias("part_keys")).filter("n > 1")


def order_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per status: interpolated median and the value at index n * 9 / 10 of the sorted prices, which are not the same thing."""
    o = ranks.ranked(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderstatus"], "o_totalprice", ["o_orderkey"])
    price, place, n = F.col("o_totalprice"), F.col("place"), F.col("of")
    middle = (F.max(F.when(place == F.floor((n + 1) / 2), price)) + F.max(F.when(place == F.floor(n / 2) + 1, price))) / 2
    return o.groupBy("o_orderstatus", F.col("of").alias("n")).agg(F.round(middle, 4).alias("median"), F.max(F.when(place == F.floor(n * 9 / 10) + 1, price)).alias("p90"))


def incidence_norms(spark: SparkSession, d: str) -> DataFrame:
    """Supplier by return flag counts as unit rows, in coordinate form."""
    cells = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("l_suppkey")))
    return cells.select("l_suppkey", "l_returnflag", F.round(F.col("n") / norm, 6).alias("weight"))


def majority_share(spark: SparkSession, d: str) -> DataFrame:
    """Per user: the share of its most frequent event type."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("user_id").agg(F.round(F.max("n") / F.sum("n"), 6).alias("share"))


def next_generation(spark: SparkSession, d: str) -> DataFrame:
    """Per customer: the number its next order will have, counted from 0."""
    o = table(spark, d, "orders").withColumn("generation", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1)
    gens = o.groupBy("o_custkey").agg(F.max("generation").alias("last"))
    return table(spark, d, "customer").join(gens, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", (F.coalesce("last", F.lit(-1)) + 1).alias("next"))


QUERIES = {f.__name__: f for f in (quality_tier_union, claim_mismatch, row_family_counts, grammar_fractions, density_quantile_bins, coverage_starvation, platform_pivot, confusion_crosstab, loss_attribution, metadata_merge, reference_pick, min_id_pick_join, census_funnel, slot_resolve_tier, slot_satisfaction, missing_anti, orphan_multi_anti, scope_semi_or, existence_flag, or_key_left_join, set_except, wanted_union, intersect_ext, top_ranked_jobs, cte_pipeline, missing_ids, table_scan_counts, job_select, append_dedup, latest_upsert, ext_cube, performer_fraction, duplicate_identity, order_stats, incidence_norms, majority_share, next_generation)}

_RESOLVED = """
line AS (SELECT *, l_linenumber % 3 AS stem, l_linenumber % 2 AS variant, (l_returnflag = 'R')::INT AS is_ref, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS platform FROM lineitem),
tiered AS (SELECT line.*, CASE WHEN stem = p_size % 3 AND variant = p_size % 2 THEN 0 WHEN stem = p_size % 3 AND variant = 0 THEN 1 WHEN stem = 0 AND variant = p_size % 2 THEN 2 WHEN stem = 0 AND variant = 0 THEN 3 ELSE 4 END AS tier FROM line JOIN part ON l_partkey = p_partkey),
best AS (SELECT l_partkey, tier, is_ref, platform, l_orderkey FROM tiered QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY tier, is_ref DESC, platform, l_shipdate DESC, l_orderkey, l_linenumber, l_suppkey, l_quantity) = 1)"""

ORACLES = {
    "quality_tier_union": """
WITH urgent AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1),
shipped AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
total AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
tier AS (SELECT c_custkey FROM customer LEFT JOIN urgent u ON c_custkey = u.o_custkey LEFT JOIN shipped s ON c_custkey = s.o_custkey LEFT JOIN total t ON c_custkey = t.o_custkey
  WHERE coalesce(u.n, 0) <= 3 AND c_acctbal >= 5000 AND coalesce(s.n, 0) * 1.0 / nullif(t.n, 0) >= 0.88 AND t.n >= 8 AND c_mktsegment <> ''),
keys AS (SELECT c_custkey FROM tier UNION SELECT * FROM (VALUES (1), (2), (3), (4), (5), (6)) v(c_custkey))
SELECT c.c_custkey, c_name, c_acctbal, (c.c_custkey IN (1, 2, 3, 4, 5, 6))::INT AS listed FROM customer c JOIN keys USING (c_custkey) ORDER BY listed DESC, c_acctbal DESC, c_custkey""",
    "claim_mismatch": "SELECT l_partkey, l_orderkey, l_linenumber, claimed, p_brand FROM (SELECT *, CASE WHEN l_suppkey % 7 <> 0 THEN 'Brand#' || (l_suppkey % 25 + 1) END AS claimed FROM lineitem) JOIN part ON l_partkey = p_partkey WHERE claimed IS NOT NULL AND claimed <> p_brand",
    "row_family_counts": "SELECT l_returnflag, count(*) FILTER (l_quantity < 10) AS n_low, count(*) FILTER (l_quantity >= 10 AND l_quantity < 30) AS n_mid, count(*) FILTER (l_quantity >= 30) AS n_high, count(*) FILTER (l_linestatus = 'O') AS n_open FROM lineitem GROUP BY 1",
    "grammar_fractions": """
WITH b AS (SELECT *, CASE WHEN l_discount <= 0 THEN 'none' WHEN l_discount <= 0.03 THEN 'low' WHEN l_discount <= 0.07 THEN 'mid' ELSE 'high' END AS band FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_custkey, count(*) AS n, round(avg((band = 'none')::INT), 6) AS share_none, round(avg((band = 'low')::INT), 6) AS share_low, round(avg((band = 'mid')::INT), 6) AS share_mid, round(avg((band = 'high')::INT), 6) AS share_high,
  min(l_quantity) AS least, max(l_quantity) AS most, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM b GROUP BY 1 HAVING count(*) >= 20""",
    "density_quantile_bins": """
WITH s AS (SELECT list(o_totalprice ORDER BY o_totalprice) AS xs FROM orders), e AS (SELECT [xs[least(len(xs), len(xs) * k // 4 + 1)] FOR k IN [1, 2, 3]] AS edges FROM s)
SELECT len(list_filter(edges, lambda x: x < o_totalprice))::INT AS bin, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders, e GROUP BY 1""",
    "coverage_starvation": "SELECT c_mktsegment, c_nationkey, count(*) AS n, round(avg((c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000))::INT), 6) AS coverage FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), (c_mktsegment, c_nationkey))",
    "platform_pivot": "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view, count(*) AS total, max(value) FILTER (event_type = 'purchase') AS top_purchase FROM events GROUP BY 1",
    "confusion_crosstab": "SELECT quality, count(*) FILTER (toxic = 0) AS toxic_0, count(*) FILTER (toxic = 1) AS toxic_1, round(count(*) FILTER (toxic = 1) / nullif(count(*) FILTER (toxic IN (0, 1)), 0), 6) AS share_toxic FROM labels GROUP BY 1",
    "loss_attribution": """
SELECT cause, n, quantity, mean_quantity, round(quantity / sum(quantity) OVER (), 6) AS share FROM (SELECT CASE WHEN l_tax = 0 THEN 'no_tax' WHEN l_discount > 0.08 THEN 'discount' WHEN l_quantity < 5 THEN 'small' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'none' END AS cause,
  count(*) AS n, sum(l_quantity) AS quantity, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY 1)""",
    "metadata_merge": "SELECT l_partkey, arg_min(l_returnflag, row(l_orderkey, l_linenumber, l_suppkey, l_quantity)) FILTER (l_quantity > 25) AS note, max((l_linestatus = 'F')::INT) AS any_final, max(l_extendedprice) AS top_price, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1",
    "reference_pick": "SELECT o_custkey, o_orderkey, (o_orderpriority LIKE '1%')::INT AS is_reference FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority LIKE '1%')::INT DESC, o_orderdate DESC, o_orderkey) = 1",
    "min_id_pick_join": "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders o ON c_custkey = o_custkey AND o_orderkey = (SELECT min(o_orderkey) FROM orders i WHERE i.o_custkey = c_custkey)",
    "census_funnel": """
SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'no_order' WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') THEN 'no_urgent'
  WHEN NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = c_custkey AND l_quantity >= 49) THEN 'no_large' ELSE 'eligible' END AS state, count(*) AS n FROM customer GROUP BY 1""",
    "slot_resolve_tier": f"WITH {_RESOLVED} SELECT * FROM best",
    "slot_satisfaction": f"""
WITH {_RESOLVED},
states AS (SELECT CASE WHEN tier IS NULL THEN 'MISSING' WHEN tier = 4 OR (tier = 2 AND p_size % 5 = 0) THEN 'WRONG_STEM' WHEN tier = 0 THEN 'SATISFIED' ELSE 'FALLBACK' END AS state FROM part LEFT JOIN best ON p_partkey = l_partkey),
acts(s, action) AS (VALUES ('MISSING', 'acquire'), ('WRONG_STEM', 'separate'), ('WRONG_STEM', 'review'), ('FALLBACK', 'review'))
SELECT state, action, count(*) AS n FROM states LEFT JOIN acts ON s = state GROUP BY 1, 2""",
    "missing_anti": "SELECT c_custkey, c_name FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice >= 450000) ON o_custkey = c_custkey WHERE o_custkey IS NULL",
    "orphan_multi_anti": """
SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 48) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity < 3)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE (o_orderkey = p_partkey AND o_orderstatus = 'P') OR (o_custkey = p_partkey AND o_orderpriority LIKE '1%'))""",
    "scope_semi_or": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50) OR s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -900)",
    "existence_flag": "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')::INT AS has_urgent FROM customer",
    "or_key_left_join": "SELECT s_suppkey, p_partkey FROM supplier LEFT JOIN part ON s_suppkey = p_partkey OR s_suppkey = p_size",
    "set_except": "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45",
    "wanted_union": "SELECT l_partkey AS k FROM lineitem WHERE l_discount >= 0.1 UNION SELECT l_suppkey FROM lineitem WHERE l_quantity = 1",
    "intersect_ext": "SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '5%'",
    "top_ranked_jobs": "SELECT o_orderkey, o_totalprice, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS priority FROM orders ORDER BY priority, o_totalprice DESC, o_orderkey LIMIT 50",
    "cte_pipeline": """
WITH a AS (SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1), b AS (SELECT o_custkey, sum(quantity) AS quantity, count(*) AS n FROM orders JOIN a ON o_orderkey = l_orderkey GROUP BY 1)
SELECT c_mktsegment, sum(quantity) AS quantity, sum(n)::BIGINT AS n_orders, max(n) AS most_orders FROM customer JOIN b ON c_custkey = o_custkey GROUP BY 1""",
    "missing_ids": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "table_scan_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in tables.TABLES),
    "job_select": "SELECT o_orderkey, o_custkey, md5(o_orderkey || '#17') AS draw FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= '1996-01-01' ORDER BY draw, o_orderkey LIMIT 100",
    "append_dedup": "WITH e AS (SELECT event_id, user_id * 1000 + floor(value * 10)::BIGINT % 97 AS k FROM events) SELECT min(event_id) AS event_id, k FROM e WHERE event_id % 2 = 1 AND k NOT IN (SELECT k FROM e WHERE event_id % 2 = 0) GROUP BY k",
    "latest_upsert": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1",
    "ext_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "performer_fraction": "SELECT l_suppkey, round(avg((contains(p_name, ['red', 'blue', 'small', 'large', 'ring', 'bolt', 'widget'][(l_suppkey % 7 + 1)::INT]) OR contains(['red', 'blue', 'small', 'large', 'ring', 'bolt', 'widget'][(l_suppkey % 7 + 1)::INT], split_part(p_name, ' ', 1)))::INT), 6) AS fraction, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "duplicate_identity": "SELECT p_name, p_brand, p_type, count(*) AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS part_keys FROM part GROUP BY ALL HAVING count(*) > 1",
    "order_stats": "SELECT o_orderstatus, count(*) AS n, round(median(o_totalprice), 4) AS median, list(o_totalprice ORDER BY o_totalprice)[count(*) * 9 // 10 + 1] AS p90 FROM orders GROUP BY 1",
    "incidence_norms": "SELECT l_suppkey, l_returnflag, round(n / sqrt(sum(n * n) OVER (PARTITION BY l_suppkey)), 6) AS weight FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)",
    "majority_share": "SELECT user_id, round(max(n) / sum(n), 6) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1",
    "next_generation": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)::INT AS next FROM customer",
}
