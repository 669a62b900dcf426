"""The numbered queries over the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestline.llm.secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


@query
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestline.llm.mixing import draws

    mixed = draws(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"),
                        (F.col("size") * F.size("shards")).alias("taken"), "shards")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestline.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestline.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestline.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestline.llm.vector_search import search

    return search(table(spark, sf_dir, "embeddings"))


ORACLES["op9_exact_top_k"] = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM usable q JOIN usable c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM scored)
SELECT * FROM ranked WHERE "rank" <= 10
"""


@query
def op4_warc_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestline.llm.archives import archived
    from harvestline.llm.common import stored

    records = stored(archived(table(spark, sf_dir, "pages")).drop("payload"), "warc-records")
    response = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return records.join(response, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op4_warc_converter"] = """
WITH payloads AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
ranked AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM payloads)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM ranked
"""


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestline.llm.bpe import encode

    return encode(table(spark, sf_dir, "documents"), with_ids=False)


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestline.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


@query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestline.llm.near_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


@query
def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestline.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"), size=5, percent=80).select("doc_id", "n_shingles", "component_id")


@query
def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestline.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_interaction_audit"] = r"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce("text", '') AS t, coalesce(source, '') AS part FROM documents),
counted AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts),
told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
failures AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN counted.doc_id > first_id THEN 16 ELSE 0 END AS mask
  FROM counted LEFT JOIN told ON told.doc_id = counted.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM failures GROUP BY part, mask),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
walk(filter_order, bits) AS (
  SELECT letter, [bit] FROM letters
  UNION ALL
  SELECT filter_order || letter, list_append(bits, bit) FROM walk JOIN letters ON NOT list_contains(bits, bit)),
steps AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
  FROM walk, (SELECT unnest(range(1, 6)) AS step) WHERE len(bits) = 5),
metrics AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit, CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM steps CROSS JOIN cells GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM metrics
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestline.llm.hard_negatives import mine

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


ORACLES["op13_hard_negatives"] = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM usable a JOIN usable c ON c.vec_id <> a.vec_id AND len(c.e) = len(a.e) WHERE a.vec_id % 50 = 0),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE same),
negative AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS place
  FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
  WHERE p.place <= 5)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS "rank", negative_id, positive_score, negative_score FROM negative WHERE place <= 3
"""
