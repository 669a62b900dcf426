"""Mixing sources to target weights, with DataFrame functions only.

Every document falls in one of ``BLOCKS`` blocks of its source by a hash, and in a sub-block by
further hash bits. A source's target words are whole passes over all its blocks, then whole
blocks in permuted order, then sub-blocks of the next block, so that the words taken miss the
target by less than a sub-block (a millionth of a large source; one document of a small one).
A splitting tree deals the drawn blocks of all sources to the output shards: each node has an
exact quota of blocks per source and splits it into two children by a multivariate
hypergeometric draw, until a leaf is one shard. A shard's copies are ordered by a hash.

A node's draw is an urn of its own row, so the tree costs rows in proportion to shards and
steps in proportion to blocks, never to documents. All draws come from hashes of a seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from harvestline.llm.common import WORD, stored

BITS = 10
BLOCKS = 1 << BITS
WEIGHTS = (5.0, 2.0, 1.0)
ADDED = ("size", "source_size", "target", "shards")


def sizes(docs: DataFrame) -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, share: float = 1.5, limit: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """One row per source (null is a source of its own): rank by code points with null last,
    source_size, weight and target. Targets share ``share`` of all words by weight; one that
    exceeds ``limit`` times its source's words stops there and the rest is shared anew, which
    is the level at which the sources of lowest limit-to-weight ratio are full."""
    names = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = names.withColumn("rank", F.row_number().over(everything) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1))
    full = F.col("source_size") * F.lit(float(limit))
    by_ratio = Window.orderBy((full / F.col("weight")).asc(), F.col("rank").asc())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = ranked.select(
        "*", F.coalesce(F.sum(full).over(before), F.lit(0.0)).alias("filled"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("used"),
        F.sum("weight").over(whole).alias("all_weight"), (F.sum("source_size").over(whole) * share).alias("total"))
    # the level if all sources before this one are full; the first source that it does not fill sets it for all
    rest = (F.col("total") - F.col("filled")) / (F.col("all_weight") - F.col("used"))
    opened = F.struct((full / F.col("weight")).alias("ratio"), "rank", rest.alias("level"))
    open_level = F.min(F.when(rest * F.col("weight") <= full, opened)).over(whole)["level"]
    return levels.withColumn("level", open_level).select(
        "source", "rank", "source_size", "weight",
        F.when(F.col("level").isNull(), full).otherwise(F.least(full, F.col("level") * F.col("weight"))).alias("target"))


def split_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """``quotas`` (rank, blocks) split over 2 ** levels shards: one row per shard and source with
    a positive count. Each level halves a node: half of its blocks, rounded down, go left, drawn
    without replacement over all its sources."""
    nodes = quotas.where("blocks > 0").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("blocks").cast("long").alias("blocks")))).alias("quota")
    ).select(F.lit(0).cast("long").alias("node"), "quota")
    for level in range(levels):
        def urn(node: Column) -> Column:
            total = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda t, x: t + x["blocks"])
            start = F.struct(
                total(F.col("quota")).alias("left_in_urn"), (total(F.col("quota")) / 2).cast("long").alias("to_draw"),
                F.array().cast("array<struct<rank:int,blocks:long>>").alias("drawn"))

            def source_draw(state: Column, item: Column) -> Column:
                # for every block of this source: goes left with chance (still to draw) / (still in the urn)
                def one(s: Column, k: Column) -> Column:
                    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), node, item["rank"], k), F.lit(1 << 40)) / float(1 << 40)
                    hit = (u * s["left_in_urn"] < s["to_draw"]).cast("long")
                    return F.struct((s["left_in_urn"] - 1).alias("left_in_urn"), (s["to_draw"] - hit).alias("to_draw"), (s["n"] + hit).alias("n"))

                done = F.aggregate(
                    F.sequence(F.lit(1).cast("long"), item["blocks"]),
                    F.struct(state["left_in_urn"].alias("left_in_urn"), state["to_draw"].alias("to_draw"), F.lit(0).cast("long").alias("n")), one)
                return F.struct(done["left_in_urn"].alias("left_in_urn"), done["to_draw"].alias("to_draw"),
                                F.concat(state["drawn"], F.array(F.struct(item["rank"].alias("rank"), done["n"].alias("blocks")))).alias("drawn"))

            return F.aggregate(F.col("quota"), start, source_draw)["drawn"]

        drawn = nodes.withColumn("drawn", urn(F.col("node")))
        keep = lambda items: F.filter(items, lambda x: x["blocks"] > 0)
        rest = F.zip_with("quota", "drawn", lambda q, d: F.struct(q["rank"].alias("rank"), (q["blocks"] - d["blocks"]).alias("blocks")))
        nodes = drawn.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), keep(F.col("drawn")).alias("quota")),
            F.struct((F.col("node") * 2 + 1).alias("node"), keep(rest).alias("quota")))).alias("child")).select("child.*")
        nodes = nodes.repartition("node") if level >= 4 else nodes
    return nodes.select(F.col("node").cast("int").alias("shard"), F.explode("quota").alias("q")).select(
        "shard", F.col("q.rank").alias("rank"), F.col("q.blocks").alias("blocks"))


def draws(docs: DataFrame, levels: int = 4, seed: int = 7, share: float = 1.5, limit: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """``docs`` (doc_id, text, source and whatever else) with size, source_size, target and
    ``shards``: one output shard for each copy the mix takes, an empty array for none.

    A null or wordless text has size 0; a null source is one of its own, last in order; a null
    doc_id is a value of its own. Rows equal in doc_id, source and text share their block, so they
    are taken alike. An empty table gives an empty result. Extra columns of whatever name pass
    through; the names this function adds replace equal ones."""
    own = {c: f"__own_{k}" for k, c in enumerate(docs.columns) if c not in ADDED}  # columns of other names cannot clash with inner ones
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], "doc_id", "text", "source")
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text"))
    permuted = F.pmod(F.pmod(F.shiftrightunsigned(key, 20), F.lit(BLOCKS)) * 389, F.lit(BLOCKS)).cast("int")
    inner = F.pmod(F.shiftrightunsigned(key, 44), F.lit(BLOCKS)).cast("int")
    placed = stored(rows.select("source", sizes(rows).alias("size"), permuted.alias("block"), inner.alias("inner")).groupBy("source", "block", "inner").agg(F.sum("size").alias("size")), "mix-blocks")
    targets = stored(source_targets(placed, share, limit, weights), "mix-targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    goals = targets.select("source", "rank", passes.alias("passes"), (F.col("target") - passes * F.col("source_size")).alias("goal"))

    def same_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        right = right.withColumnRenamed("source", "right_source")
        return left.join(right, F.col("source").eqNullSafe(F.col("right_source")), how).drop("right_source")

    # whole blocks in permuted order up to the goal, then sub-blocks of the block that crosses it
    in_order = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("source", "block").agg(F.sum("size").alias("size")).withColumn(
        "before", F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    crossing = same_source(blocks, goals).where("before <= goal and before + size > goal").select(
        "source", F.col("block").alias("edge"), (F.col("goal") - F.col("before")).alias("rest"))
    inner_order = Window.partitionBy("source").orderBy("inner").rowsBetween(Window.unboundedPreceding, 0)
    edges = same_source(placed, crossing).where("block = edge").withColumn("upto", F.sum("size").over(inner_order))
    # the sub-block that crosses goes in if that ends nearer to the goal
    edges = edges.where(F.col("upto") - F.col("size") / 2 <= F.col("rest")).groupBy("source").agg((F.max("inner") + 1).alias("inner_edge"))
    plan = same_source(same_source(goals, crossing.select("source", "edge"), "left"), edges, "left")
    plan = same_source(plan, targets.select("source", "source_size", "target"))
    partial = F.col("goal") > 0  # else whole passes are all that is taken
    plan = stored(plan.select(
        "source", "rank", "passes", "source_size", "target",
        F.when(partial, F.coalesce("edge", F.lit(BLOCKS))).otherwise(0).alias("edge"),
        F.when(partial, F.coalesce("inner_edge", F.lit(0))).otherwise(0).alias("inner_edge")), "mix-plan")

    # a drawn block is (source, pass, block); the block that is taken in part counts as one
    last = F.col("edge") + F.when(F.col("inner_edge") > 0, 1).otherwise(0)
    quotas = plan.select("rank", (F.col("passes") * BLOCKS + last).alias("blocks"))
    dealt = stored(split_tree(quotas, levels, seed), "mix-shards")
    upto = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    spans = dealt.withColumn("end", F.sum("blocks").over(upto)).groupBy("rank").agg(
        F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("spans"))
    # where the n-th drawn block of a source goes: shards own consecutive ranges of a permuted order
    numbers = plan.join(spans, "rank", "left").select(
        "source", "source_size", "target", "passes", "edge", "inner_edge", "rank", "spans",
        (F.col("passes") * BLOCKS + last).alias("count"))

    placed_rows = rows.select(*own.values(), "source", sizes(rows).alias("size"), permuted.alias("_block"), inner.alias("_inner"))
    joined = same_source(placed_rows, numbers, "left")
    copies = F.col("passes") + F.when((F.col("_block") < F.col("edge")) | ((F.col("_block") == F.col("edge")) & (F.col("_inner") < F.col("inner_edge"))), 1).otherwise(0)

    def shard_of(copy: Column) -> Column:
        number = copy * BLOCKS + F.col("_block")
        return F.element_at(F.filter("spans", lambda s: s["end"] > number), 1)["shard"]

    taken = F.when(copies > 0, F.transform(F.sequence(F.lit(0), copies - 1), shard_of)).otherwise(F.array().cast("array<int>"))
    dealt_rows = joined.select(*own.values(), "size", "source_size", "target", taken.alias("shards"))
    return dealt_rows.select(*[F.col(n).alias(c) for c, n in own.items()], *ADDED)


def mixture(docs: DataFrame, levels: int = 4, seed: int = 7, **targets) -> DataFrame:
    """The mix itself: one row per copy with the columns of ``docs``, each shard's copies in one
    run of partitions and in hash order. A shard too large for one task is cut by the same hash."""
    inner = {c: c if c in ("doc_id", "text", "source") else f"__mixed_{k}" for k, c in enumerate(docs.columns)}
    mixed = draws(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()]), levels, seed, **targets)
    exploded = mixed.select(*inner.values(), F.posexplode("shards").alias("_copy", "_shard"))
    order = F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("_copy"), F.col("text"))
    return exploded.withColumn("_order", order).repartitionByRange("_shard", "_order").sortWithinPartitions("_shard", "_order").select(*[F.col(n).alias(c) for c, n in inner.items()])
