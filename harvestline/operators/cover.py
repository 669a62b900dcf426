"""Cell covers: which grid cells a region holds as a whole, and what is left to test in the others.

A ring is cut into its edges and every edge is dealt to the cells it passes, so that no cell
knows more of a ring than the edges in it. What the ray to the right meets beyond the cell is
the same for the whole cell (a parity), but for edges that end within the cell's row of cells;
ends that meet there cancel, and the few heights that do not are kept with the cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from harvestline.functions.scalars import ring_edges

PAD = 1e-6  # of a cell: an edge this close to a cell counts as passing it


def grid_cell(v: Column | str, size: float) -> Column:
    return F.floor((F.col(v) if isinstance(v, str) else v) / F.lit(float(size))).cast("long")


def cell_cover(regions: DataFrame, cell: float, region_id: str = "region_id") -> DataFrame:
    """One row per region and cell it reaches: region_id, ``_cx``, ``_cy``, ``_copies`` (equal rows
    of ``regions``), ``_edges`` (edges that pass the cell; NULL where the cell lies inside as a
    whole), ``_ends`` (heights where edges to the right of the cell end) and ``_right`` (parity of
    the edge ends to the right and above the row of cells). Rings are closed; NULL corners part them."""
    pad = cell * PAD
    key = [region_id, "_ring", "_copies"]
    rings = regions.select(region_id, "xs", "ys", F.xxhash64("xs", "ys").alias("_ring")).groupBy(region_id, "_ring").agg(
        F.count(F.lit(1)).alias("_copies"), F.first("xs").alias("xs"), F.first("ys").alias("ys"))
    edges = rings.select(*key, F.explode(ring_edges("xs", "ys")).alias("_edge"))
    y0, y1 = F.col("_edge.y0"), F.col("_edge.y1")
    low, high = F.least(y0, y1), F.greatest(y0, y1)
    rows = edges.withColumn("_cy", F.explode(F.sequence(grid_cell(low, cell), grid_cell(high, cell))))
    x_at = lambda y: F.col("_edge.k") * (y - y0) + F.col("_edge.x0")
    xa, xz = x_at(F.greatest(low, F.col("_cy") * cell - pad)), x_at(F.least(high, (F.col("_cy") + 1) * cell + pad))
    passed = rows.select(
        *key, "_cy", "_edge", grid_cell(F.least(xa, xz) - pad, cell).alias("_from"), grid_cell(F.greatest(xa, xz) + pad, cell).alias("_upto"),
        sum((grid_cell(y, cell) > F.col("_cy")).cast("int") for y in (y0, y1)).alias("_above"),
        F.filter(F.array(y0, y1), lambda y: grid_cell(y, cell) == F.col("_cy")).alias("_ends"))

    own = passed.withColumn("_cx", F.explode(F.sequence("_from", "_upto"))).select(
        *key, "_cy", "_cx", "_edge", F.lit(None).cast("double").alias("_end"),
        F.when(F.col("_cx") == F.col("_from"), F.col("_above")).otherwise(0).alias("_bit"))
    # an end counts for the cells to the left of its edge: two ends of equal height cancel but for the cells between
    met = passed.select(*key, "_cy", "_from", F.explode("_ends").alias("_end")).groupBy(*key, "_cy", "_end").agg(
        F.sort_array(F.collect_list("_from"), asc=False).alias("_at"))
    between = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_at") - 2, F.lit(0)), F.lit(2)),
                          lambda i: F.struct(F.get("_at", i + 1).alias("a"), (F.get("_at", i) - 1).alias("b")))
    open_ends = met.select(*key, "_cy", "_end", F.explode(F.filter(between, lambda s: s["a"] <= s["b"])).alias("_s"))
    ends = open_ends.select(*key, "_cy", F.explode(F.sequence("_s.a", "_s.b")).alias("_cx"), "_end")
    cells = own.unionByName(ends, allowMissingColumns=True).groupBy(*key, "_cy", "_cx").agg(
        F.collect_list("_edge").alias("_edges"), F.collect_list("_end").alias("_ends"),
        F.coalesce(F.sum("_bit"), F.lit(0)).alias("_bit"))

    from_right = W.partitionBy(*key, "_cy").orderBy(F.desc("_cx"))
    before = from_right.rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumns({"_right": F.coalesce(F.sum("_bit").over(before), F.lit(0)) % 2, "_next": F.lag("_cx").over(from_right)})
    # the cells up to the next one with edges hold none: all of them lie inside, or none does
    last = F.when(F.col("_right") == 1, F.coalesce(F.col("_next") - 1, F.col("_cx"))).otherwise(F.col("_cx"))
    return cells.withColumn("_at", F.explode(F.sequence("_cx", last))).select(
        region_id, F.col("_at").alias("_cx"), "_cy", "_copies", "_ends", "_right",
        F.when(F.col("_at") == F.col("_cx"), F.col("_edges")).alias("_edges"))


def inside_cover(x: str = "x", y: str = "y") -> Column:
    """Whether a point in a cell of ``cell_cover`` lies in the region; cells inside ask no edge."""
    px, py = F.col(x), F.col(y)
    hit = lambda e: ((e["y0"] > py) != (e["y1"] > py)) & (px < e["k"] * (py - e["y0"]) + e["x0"])
    crossed = F.size(F.filter("_edges", hit)) + F.size(F.filter("_ends", lambda end: end > py)) + F.col("_right")
    return F.col("_edges").isNull() | (crossed % 2 == 1)
