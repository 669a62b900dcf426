"""Audit of how document filters interact, over every order in which they may be applied.

A document's failures are a mask of five bits. One pass over the documents counts them by part and
mask; a part has at most 32 such cells, however many documents there are. A recursive query then
extends filter prefixes by the letters not yet used, over all masks, and carries the bits applied
so far: each level emits what its step keeps, removes and finds removed already. A prefix is
evaluated once, and every order reads its five prefixes.

Filter E compares whole texts across the table, told by SHA-256. The rows of a text are summed by
part and id before they meet, so copies of one text may be any share of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from harvestline.llm.common import WORD, prepared, stored

FILTERS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}


def own_failures(text: Column) -> Column:
    """Bits of the filters that look at one text."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    shape = F.struct(F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("distinct"))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    bit = lambda letter, failed: F.when(failed, FILTERS[letter]).otherwise(0)
    return (bit("A", shape["words"] < 50) + bit("B", 100 * shape["distinct"] < 65 * shape["words"])
            + bit("C", 100 * capitals > 5 * F.length(text)) + bit("D", text.rlike("[#$%&*|]")))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and how many documents, good and toxic ones, have it."""
    text = F.coalesce("text", F.lit(""))
    rows = prepared(docs, "doc_id", "text", "source").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), own_failures(text).alias("own"))
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0)).alias(c)
    told = prepared(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    # rows without an id have no label; the second key spreads them
    spread = F.when(F.col("doc_id").isNull(), F.col("key")).otherwise(F.lit(b""))
    rows = rows.withColumn("spread", spread).join(told.withColumn("spread", F.lit(b"")), ["doc_id", "spread"], "left")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    by_id = rows.groupBy("key", "own", "part", "doc_id").agg(F.count("*").alias("n"), total("quality"), total("toxic"))
    counts = ("n", "quality", "toxic")
    low = F.min_by(F.struct("doc_id", *counts), "doc_id").alias("low")
    by_part = by_id.groupBy("key", "own", "part").agg(*[F.sum(c).alias(c) for c in counts], low, F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without_id"))
    first = F.min("low.doc_id").over(Window.partitionBy("key"))  # a row for each part that has the text
    of_first = F.when(F.col("low.doc_id") == F.col("first"), F.lit(1)).otherwise(0)
    passing = [F.coalesce(F.col(f"low.{c}") * of_first, F.lit(0)) + (F.col("without_id") if c == "n" else 0) for c in counts]
    both = F.array(F.struct(F.col("own").alias("mask"), *[p.alias(c) for p, c in zip(passing, counts)]),
                   F.struct((F.col("own") + FILTERS["E"]).alias("mask"), *[(F.col(c) - p).alias(c) for p, c in zip(passing, counts)]))
    split = by_part.withColumn("first", first).select("part", F.inline(both)).where("n > 0")
    return split.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in counts])


WALK = """
WITH RECURSIVE letters(letter, bit) AS (VALUES {letters}),
walk(prefix, step, letter, bit, before, mask) AS (
  SELECT CAST('' AS STRING), 0, CAST('' AS STRING), 0, 0, mask FROM (SELECT DISTINCT mask FROM {{cells}})
  UNION ALL
  SELECT concat(prefix, l.letter), step + 1, l.letter, l.bit, before | w.bit, mask
  FROM walk w JOIN letters l ON (before | w.bit) & l.bit = 0),
levels AS (
  SELECT prefix, step, letter, mask, (mask & (before | bit)) = 0 AS stays, (mask & bit) <> 0 AND (mask & before) = 0 AS goes,
    (mask & bit) <> 0 AND (mask & before) <> 0 AS gone, mask = bit AS alone
  FROM walk WHERE step > 0)
SELECT c.part, w.prefix, w.step, w.letter, sum(if(stays, n, 0)) AS kept, sum(if(goes, n, 0)) AS removed, sum(if(gone, n, 0)) AS redundant,
  sum(if(alone, n, 0)) AS unique_fails, sum(if(goes, quality, 0)) AS good_lost, sum(if(goes, toxic, 0)) AS toxic_lost
FROM levels w JOIN {{cells}} c ON c.mask = w.mask GROUP BY c.part, w.prefix, w.step, w.letter
"""


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source; null as ''), filter_order and step, zeros included: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost and shapley. A null text is empty. Repeated ids
    are documents each, and none of them the smaller; a null doc_id has no label, is no smaller id
    and never fails E. Labels repeated for an id count if one of them is 1; labels of unknown
    documents are not used. Without documents there are no parts and the result is empty."""
    found = stored(cells(docs, labels), "mask-cells")
    query = WALK.format(letters=", ".join(f"('{letter}', {bit})" for letter, bit in FILTERS.items()))
    levels = stored(docs.sparkSession.sql(query, cells=found), "prefix-levels")
    every = len(FILTERS)
    shapley = levels.groupBy("part", "letter").agg(F.sum(F.col("removed") * F.factorial(every - F.col("step"))).alias("shapley"))
    orders = levels.where(F.col("step") == every).select(F.col("prefix").alias("filter_order")).distinct()
    steps = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(every))).alias("at"))
    steps = steps.select("filter_order", F.substring("filter_order", F.lit(1), F.col("at")).alias("prefix"))
    return levels.join(steps, "prefix").join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
