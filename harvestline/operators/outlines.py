"""Closed outlines of dissolved regions.

The outer edges of a parent are linked to rings without a walk: every edge finds its successor
at its end, then looks twice as far ahead in each round (pointer doubling), so that a ring of n
edges is in order after log2(n) joins, on edges only, wherever they are stored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from harvestline.functions.ranking import null_safe_join
from harvestline.session import cut_lineage
from harvestline.sources.tables import with_bbox

FIRST = -(1 << 62)  # place of a ring's first edge


def signed_area(xs: str = "xs", ys: str = "ys") -> Column:
    """Twice the area of the rings: positive if outer rings run counterclockwise. Sums start at
    the first corner, so that large coordinates cost no digits; NULL corners part rings."""
    x, y = F.col(xs), F.col(ys)
    px, py = F.get(x, F.lit(0)), F.get(y, F.lit(0))
    term = lambda i: F.coalesce((F.get(x, i) - px) * (F.get(y, i + 1) - py) - (F.get(x, i + 1) - px) * (F.get(y, i) - py), F.lit(0.0))
    return F.aggregate(F.sequence(F.lit(0), F.size(x) - 2), F.lit(0.0), lambda s, i: s + term(i))


def outline_edges(regions: DataFrame, parent: str, digits: int = 7) -> DataFrame:
    """Edges that belong to exactly one member of a parent, as (x0, y0) to (x1, y1) with the
    parent on their left. The rings of a member run either way round, its holes against them.
    Rows without a ring have no edges; a null parent is one of its own."""
    corner = lambda i: F.struct(F.round(F.get("xs", i), digits).alias("x"), F.round(F.get("ys", i), digits).alias("y"))
    a, b = (lambda i: corner(i)), (lambda i: corner(i + 1))
    rings = regions.where((F.size("xs") > 1) & (F.size("xs") == F.size("ys"))).select(parent, "xs", "ys", signed_area().alias("_area"))
    steps = F.sequence(F.lit(0), F.size("xs") - 2)
    pairs = F.transform(steps, lambda i: F.when(F.col("_area") > 0, F.struct(a(i).alias("a"), b(i).alias("b")))
                        .otherwise(F.struct(b(i).alias("a"), a(i).alias("b"))))
    edges = rings.select(parent, F.explode(pairs).alias("_e")).select(parent, "_e.a", "_e.b")
    edges = edges.where("a.x IS NOT NULL AND a.y IS NOT NULL AND b.x IS NOT NULL AND b.y IS NOT NULL AND a <> b")
    once = edges.groupBy(parent, F.least("a", "b").alias("_p"), F.greatest("a", "b").alias("_q")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("a", "b")).alias("_e")).where("_n = 1")
    return once.select(parent, F.col("_e.a.x").alias("x0"), F.col("_e.a.y").alias("y0"), F.col("_e.b.x").alias("x1"), F.col("_e.b.y").alias("y1"))


def _successors(edges: DataFrame, parent: str) -> DataFrame:
    """Every edge with the one that follows it. Where rings touch in a corner, the next edge
    clockwise from the way back follows: it closes the same piece of the parent's inside."""
    back = F.atan2(F.col("y0") - F.col("y1"), F.col("x0") - F.col("x1"))
    arrive = edges.select(parent, F.col("x1").alias("_vx"), F.col("y1").alias("_vy"), "_id", "_place", back.alias("_back"))
    leave = edges.select(parent, F.col("x0").alias("_vx"), F.col("y0").alias("_vy"), F.col("_id").alias("_to"),
                         F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")).alias("_away"))
    turn = F.pmod(F.col("_back") - F.col("_away"), F.lit(2 * math.pi))
    meet = null_safe_join(arrive, leave, [parent, "_vx", "_vy"])
    return meet.groupBy("_id", "_place").agg(F.min_by("_to", turn).alias("_to"))


def outline_rings(regions: DataFrame, parent: str, digits: int = 7) -> DataFrame:
    """Rings of the dissolved parents: parent, xs, ys (closed, from the smallest corner, parent on
    the left), n_edges, and area, which is negative for holes. Members touch or are apart; those
    of a parent do not overlap."""
    place = F.struct("x0", "y0", "x1", "y1")
    identity = F.struct(F.xxhash64(parent, place), F.xxhash64(place, F.lit("outline"), parent))
    edges = cut_lineage(outline_edges(regions, parent, digits).withColumns({"_id": identity, "_place": place}))
    # _first: smallest place among the next ``reach`` edges, _steps: how far ahead it is
    state = cut_lineage(_successors(edges, parent).select("_id", "_to", F.col("_place").alias("_first"), F.lit(0).cast("long").alias("_steps")))
    reach = 1
    while True:
        ahead = state.select(F.col("_id").alias("_to"), F.col("_to").alias("_next"), F.struct("_first", (F.col("_steps") + reach).alias("_steps")).alias("_far"))
        seen = state.join(ahead, "_to").withColumn("_best", F.least(F.struct("_first", "_steps"), F.col("_far")))
        state = cut_lineage(seen.select("_id", F.col("_next").alias("_to"), "_best.*", (F.col("_best._first") != F.col("_first")).alias("_moved")))
        if state.where("_moved").isEmpty():
            break
        state, reach = state.drop("_moved"), reach * 2
    corners = edges.join(state.select("_id", "_first", "_steps"), "_id")
    at = F.when(F.col("_steps") == 0, F.lit(FIRST)).otherwise(-F.col("_steps")).alias("at")
    rings = corners.groupBy(parent, "_first").agg(F.sort_array(F.collect_list(F.struct(at, F.col("x0").alias("x"), F.col("y0").alias("y")))).alias("_c"))
    closed = lambda c: F.concat(F.col(f"_c.{c}"), F.slice(F.col(f"_c.{c}"), 1, 1)).alias(c + "s")
    return rings.select(parent, closed("x"), closed("y"), F.size("_c").cast("long").alias("n_edges")).withColumn("area", signed_area() / 2)


def dissolve(regions: DataFrame, parent: str, digits: int = 7) -> DataFrame:
    """One region per parent, in the form every spatial operator takes: rings in one pair of
    arrays, parted by NULL, with the bounding box."""
    rings = outline_rings(regions, parent, digits).groupBy(parent).agg(F.sort_array(F.collect_list(F.struct("xs", "ys"))).alias("_r"))
    apart = F.array(F.lit(None).cast("double"))
    joined = lambda c: F.flatten(F.transform("_r", lambda r: F.concat(apart, r[c])))
    whole = lambda c: F.slice(joined(c), F.lit(2), F.size(joined(c))).alias(c)
    return with_bbox(rings.select(parent, whole("xs"), whole("ys")))
