"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays,
secrets are masked, sources are mixed to their weights, and what is left is encoded.

Each stage takes the documents its predecessor wrote and returns all columns of documents, but
for the last, which returns the digests of the encoding. Missing columns besides doc_id, text
and source are not needed; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestline.llm import bpe, mixing, near_dups, secret_scan, toxicity
from harvestline.llm.common import stored, table
from harvestline.llm.membership import without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; every row goes by its own text, whatever its id."""
    return toxicity.not_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more.
    Every row is a document of its own; the one with the smallest id stays, null ids are last."""
    row_key = "__row" + "_" * max(map(len, docs.columns))  # key of a row, longer than any name of docs
    keyed = stored(docs.withColumn(row_key, F.monotonically_increasing_id()), "near-dedup-rows")
    found = near_dups.near_duplicates(keyed.select(F.col(row_key).alias("doc_id"), "text"), size=5, percent=80)
    groups = found.select(F.col("doc_id").alias(row_key), "component_id").join(found.where("not kept").select("component_id").distinct(), "component_id")
    members = stored(groups.join(keyed.select(row_key, "doc_id"), row_key), "near-dedup-members")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", row_key)
    chosen = members.groupBy("component_id").agg(F.min(rank)[row_key].alias(row_key)).select(row_key)
    spare = stored(members.select(row_key).join(chosen, row_key, "left_anti"), "near-dedup-spare")
    return without(keyed, spare, row_key).select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every finding of the secret scan replaced."""
    return secret_scan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy the mix takes, with the columns of docs. Null and wordless texts have size
    0 and come with their block; a null source is one of its own; no documents give none."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every row's tokens: null texts are empty ones, repeated rows are encoded each."""
    return bpe.encode(docs, with_ids=False)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("secrets", mask_secrets),
          ("mixing", mix_sources), ("bpe", encode)]
ORACLE_SQL = None  # a trained score, hash draws and a tokenizer have no SQL; tests replay each stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
