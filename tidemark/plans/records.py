"""Records that come with rules: checked contracts, banks of candidates, objects by their hashes, guarded lineage, folded words and wrapped urls."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import graph
from ..sources import tables
from ..sources.tables import table
from .evidence import _EDGES, lineage_edges


def guarded_edges(spark: SparkSession, d: str) -> DataFrame:
    """Proposed lineage edges, one an order, and why some are refused: every third from a region (its key mod 5) to the order, which closes a
    cycle where the order's customer lives there; every third, plus one, from the order to itself; the others from a new node to the order."""
    k = F.col("o_orderkey")
    node = F.concat(F.lit("o"), k)
    child = F.when(k % 3 == 0, F.concat(F.lit("r"), k % 5)).when(k % 3 == 1, node).otherwise(F.concat(F.lit("x"), k))
    asked = table(spark, d, "orders").select(k.alias("proposal"), child.alias("child"), node.alias("parent"))
    return graph.guarded(lineage_edges(spark, d), asked, "child", "parent").select("proposal", "verdict")


def rehash_check(spark: SparkSession, d: str) -> DataFrame:
    """Texts stored under their hashes, some of them (hashes that begin with 0) with a letter more than was hashed: what a second hashing finds."""
    folder = f"{tables.shared(spark)}/objects-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select(F.col("text").cast("binary").alias("content"))
    tables.put_objects(docs, "content", folder)
    stored = spark.read.parquet(folder)
    spoiled = stored.withColumn("content", F.when(F.substring("sha256", 1, 1) == "0", F.concat("content", F.lit(b"x"))).otherwise(F.col("content")))
    return tables.rehashed(spoiled).select("sha256", "byte_size", "intact")


def contract_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events as records under a contract: a number k below 90 in their properties, a positive value, a known type; each with what it breaks."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    rules = {"k_missing": F.col("k").isNull(), "k_range": ~F.col("k").between(0, 89), "value_positive": ~(F.col("value") > 5), "type_known": ~F.col("event_type").isin("click", "view", "purchase", "signup")}
    return tables.checked(e, rules).select("event_id", F.array_join("problems", ",").alias("problems"), (F.size("problems") == 0).alias("valid"))


def candidate_bank(spark: SparkSession, d: str) -> DataFrame:
    """Events written as banks of JSON lines, one a user modulo 16, each led by a line that tells how many follow; banks divisible by 5 tell one too many. Read again and held against what they tell."""
    folder = f"{tables.shared(spark)}/banks-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select((F.col("user_id") % 16).alias("bank"), "event_id", "value")
    tables.write_banks(e, "bank", folder, F.when(F.col("bank") % 5 == 0, 1).otherwise(0))
    return tables.read_banks(spark, folder, "bank", "bank long, event_id long, value double").groupBy("bank", "told").agg(F.count("event_id").alias("found"), F.round(F.sum("value"), 4).alias("value")).select("bank", "told", "found", "value", (F.col("told") == F.col("found")).alias("whole"))


def blob_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as blobs of single-precision numbers in layers of 16, read again: the length of each layer."""
    e = table(spark, d, "embeddings").select("vec_id", vectors.to_blob("embedding").alias("blob"))
    layers = e.select("vec_id", F.posexplode(vectors.from_blob("blob", 16)).alias("layer", "vector"))
    return layers.select("vec_id", "layer", F.round(vectors.norm(F.col("vector")), 5).alias("length"))


def folded_terms(spark: SparkSession, d: str) -> DataFrame:
    """Words of all documents (runs of letters, lower-cased) with their marks taken off by compatibility decomposition, and how many forms and occurrences each has. Each different word is folded once."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.groupBy(text.folded("word").alias("folded")).agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("n"))


def unwrapped_urls(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses that a redirect has wrapped (half of them twice) and percent-encoded, unwrapped again; every seventh isn't wrapped."""
    once = lambda u: F.concat(F.lit("https://out.example/go?id=1&url="), F.url_encode(u), F.lit("&x=%2F"))
    k, u = F.col("page_id"), F.col("url")
    given = table(spark, d, "pages").select("page_id", F.when(k % 7 == 0, u).when(k % 2 == 0, once(once(u))).otherwise(once(u)).alias("given"))
    return given.select("page_id", text.unwrapped(F.col("given"), ("url", "u", "target")).alias("url"))


QUERIES = {f.__name__: f for f in (guarded_edges, rehash_check, contract_rows, candidate_bank, blob_vectors, folded_terms, unwrapped_urls)}

ORACLES = {
    "guarded_edges": f"WITH RECURSIVE {_EDGES}, a AS (SELECT o_orderkey AS proposal, CASE o_orderkey % 3 WHEN 0 THEN 'r' || o_orderkey % 5 WHEN 1 THEN 'o' || o_orderkey ELSE 'x' || o_orderkey END AS child, 'o' || o_orderkey AS parent FROM orders) SELECT proposal, CASE WHEN child = parent THEN 'self' WHEN l.node IS NOT NULL THEN 'cycle' ELSE 'ok' END AS verdict FROM a LEFT JOIN least0 l ON l.node = a.parent AND l.ancestor = a.child",
    "rehash_check": "SELECT sha256(text) AS sha256, strlen(any_value(text))::BIGINT + (sha256(text)[1] = '0')::INT AS byte_size, sha256(text)[1] <> '0' AS intact FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)",
    "contract_rows": "WITH e AS (SELECT *, (props->>'$.k')::INT AS k FROM events), p AS (SELECT event_id, list_filter([CASE WHEN k IS NULL THEN 'k_missing' END, CASE WHEN k NOT BETWEEN 0 AND 89 THEN 'k_range' END, CASE WHEN NOT value > 5 THEN 'value_positive' END, CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'type_known' END], lambda x: x IS NOT NULL) AS p FROM e) SELECT event_id, coalesce(array_to_string(p, ','), '') AS problems, len(p) = 0 AS valid FROM p",
    "candidate_bank": "SELECT user_id % 16 AS bank, count(*) + ((user_id % 16) % 5 = 0)::INT AS told, count(*) AS found, round(sum(value), 4) AS value, (user_id % 16) % 5 <> 0 AS whole FROM events GROUP BY user_id % 16",
    "blob_vectors": "WITH l AS (SELECT vec_id, unnest(range(len(embedding) // 16)) AS layer, embedding FROM embeddings) SELECT vec_id, layer::INT AS layer, round(sqrt(list_sum(list_transform(embedding[layer * 16 + 1:layer * 16 + 16], lambda x: x::DOUBLE * x))), 5) AS length FROM l",
    "folded_terms": r"WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w GROUP BY 1) SELECT strip_accents(word) AS folded, count(*) AS forms, sum(n)::BIGINT AS n FROM c GROUP BY 1",
    "unwrapped_urls": "SELECT page_id, url FROM pages",
}
