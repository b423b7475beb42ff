"""The operators of this package over the given tables, one query each, and SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, fingerprints, language, mixing, negatives, sharding, simhash, suffixes, token_counts, toxicity, urls, vector_copies
from .shared import read, shared_dir, stash

Query = Callable[[SparkSession, str], DataFrame]
N_SHARDS = 24
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def held_by(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null: of nothing)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all documents takes."""
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict for every page's url."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    judged = urls.judge(read(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digest, that of its edited text, and their likenesses."""
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer after four batches: all documents come in under words-1; copies of
    a text with a lesser id go; documents labelled of low quality are counted anew under words-2; the second batch is
    replayed, which changes nothing."""
    docs = read(spark, sf_dir, "documents")
    text = F.col("text")
    slim = stash(docs.select("doc_id", "source", "lang", F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest"), token_counts.word_tokens(text).alias("one"), token_counts.piece_tokens(text).alias("two")), "counted")
    first = slim.withColumns({"tokenizer": F.lit("words-1"), "tokens": F.col("one")})
    least = slim.groupBy("digest").agg(F.min("doc_id").alias("least"))
    judged = first.join(least, "digest")
    original = F.coalesce(F.col("doc_id") == F.col("least"), F.lit(False))
    copies, originals = judged.filter(~original), judged.filter(original)
    poor = read(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct()
    again = originals.join(poor, "doc_id", "left_semi").withColumns({"old_tokenizer": F.col("tokenizer"), "old_tokens": F.col("one"), "tokenizer": F.lit("words-2"), "tokens": F.col("two")})
    rollup = token_counts.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("0-load", token_counts.inserted(first))
    rollup.commit("1-copies", token_counts.deleted(copies))
    rollup.commit("2-recount", token_counts.revised(again))
    rollup.commit("1-copies", token_counts.deleted(copies))
    return rollup.totals()


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item of which it holds 0.8 or more."""
    found = decontamination.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "shared", "item_shingles", "containment")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard among 24, its place there, and its shard among 25."""
    text = F.coalesce("text", F.lit(""))
    slim = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"))
    now = sharding.assign(slim, "doc_id", [1.0] * N_SHARDS)
    grown = sharding.assign(now, "doc_id", [1.0] * (N_SHARDS + 1), "grown_shard")
    return sharding.with_slots(grown, "doc_id").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from three quarters of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", (held_by(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = language.fit(docs.filter(~F.col("held_out")))
    return language.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate group."""
    found = simhash.groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from four fifths of the labels."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").filter(held_by(F.col("doc_id"), 5) != 0)
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs.withColumn("held_out", held_by(F.col("doc_id"), 5) == 0), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 200-byte strings that repeat."""
    return suffixes.without_repeats(read(spark, sf_dir, "documents"), keep_bytes=False)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source is from every other of its language, and the terms that mark it."""
    found = divergence.audit(read(spark, sf_dir, "documents"))
    return found.select("lang", "source", "part", "item", "value", "rank")


def op12_vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's number of links of cosine 0.93 or more within its label, and its group."""
    found = vector_copies.groups(read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of each anchor's positives; every seventh vector has the next label."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    found = negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


WORDS_SQL = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

OP1_SQL = rf"""
WITH slim AS (SELECT doc_id, source, {WORDS_SQL}::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM slim GROUP BY source),
ranked AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS w, row_number() OVER (ORDER BY source IS NULL, source) AS r, 3 * source_size AS cap FROM sources),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER e, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER e, 0))::DOUBLE AS level FROM ranked
  WINDOW e AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap::DOUBLE, w * max(level) OVER ()) AS target FROM levels),
queued AS (SELECT s.*, t.source_size, t.target, sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS served
  FROM slim s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT doc_id, k, size, served, e AS epoch, (e * source_size + served)::DOUBLE / target AS finish FROM queued, unnest([0, 1, 2]) AS u(e) WHERE size > 0 AND target > 0),
ordered AS (SELECT *, sum(size) OVER (ORDER BY finish, k, doc_id, served, epoch ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
taken AS (SELECT doc_id, served, count(*) AS n FROM ordered WHERE upto <= (SELECT sum(size) FROM slim) GROUP BY doc_id, served)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(t.n, 0))::BIGINT AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id IS NOT DISTINCT FROM t.doc_id AND q.served = t.served
"""

OP2_SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM parts JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT parts.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""

#: CRC-32 bit by bit: eight steps of shift and conditional xor make the table, one step of it per byte the sum.
OP6_SQL = r"""
WITH tbl AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(b))),
docs AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
sums AS (SELECT doc_id, size, k, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM docs, tbl),
bids AS (SELECT doc_id, s, 1.0 / -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '#' || s), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS bid FROM (SELECT DISTINCT doc_id FROM docs), range(25) AS r(s)),
won AS (SELECT doc_id, arg_max(s, bid) FILTER (s < 24) AS shard, arg_max(s, bid) AS grown FROM bids GROUP BY doc_id)
SELECT sums.doc_id, size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY k, sums.doc_id) - 1 AS slot, grown::INT AS grown_shard
FROM sums JOIN won ON sums.doc_id IS NOT DISTINCT FROM won.doc_id
"""

OP4_SQL = r"""
WITH slim AS (SELECT doc_id, source, lang, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS one,
  coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]')), 0) AS two FROM documents),
kept AS (SELECT *, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS poor FROM slim QUALIFY doc_id = min(doc_id) OVER (PARTITION BY text))
SELECT source, lang, CASE WHEN poor THEN 'words-2' ELSE 'words-1' END AS tokenizer, count(*) AS documents, sum(CASE WHEN poor THEN two ELSE one END)::BIGINT AS tokens
FROM kept GROUP BY ALL
"""

OP5_SQL = r"""
WITH texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
worded AS (SELECT kind, id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM texts),
shingled AS (SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM worded)),
items AS (SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n FROM shingled WHERE kind = 'b')
SELECT d.id AS doc_id, item_id, count(*)::INT AS shared, any_value(n)::INT AS item_shingles, count(*)::DOUBLE / any_value(n) AS containment
FROM shingled d JOIN items USING (s) WHERE d.kind = 'd' GROUP BY d.id, item_id HAVING count(*)::DOUBLE / any_value(n) >= 0.8
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
g AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS ln FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(ln)::HUGEINT AS total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL),
dense AS (SELECT lang, source, term, coalesce(n, 0) AS n, ln, v, total FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (ln + 1)) // (total + v) AS q FROM dense),
pairs AS (SELECT lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL),
every AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM every
UNION ALL SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms QUALIFY rank <= 200
"""

OP12_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(id, least) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, least FROM reach JOIN l ON l.a = id WHERE least < l.b)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id)::BIGINT AS n_links, min(least) AS component_id, vec_id = min(least) AS kept FROM embeddings JOIN reach ON id = vec_id GROUP BY vec_id
"""

OP13_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS other, a.label = v.label AS alike, list_inner_product(a.e, v.e)::BIGINT AS score FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""

QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_mixing, op2_url_filter, op3_fingerprints, op4_token_counts, op5_decontamination, op6_sharding, op7_language, op8_simhash, op9_toxicity, op10_suffix_dedup, op11_divergence, op12_vector_copies, op13_hard_negatives)
}
#: The others give digests, learned predictions or groups that SQL can't express; tests hold them against brute force.
ORACLES: dict[str, str] = {"op1_mixing": OP1_SQL, "op2_url_filter": OP2_SQL, "op4_token_counts": OP4_SQL, "op5_decontamination": OP5_SQL, "op6_sharding": OP6_SQL, "op11_divergence": OP11_SQL, "op12_vector_copies": OP12_SQL, "op13_hard_negatives": OP13_SQL}
