"""Joins by location and zonal statistics.

All location joins are equi-joins on grid cells: a region (or a search radius) is
exploded to the cells its box touches, a pixel belongs to one cell, and the exact test
runs on the candidates only. That keeps every join hashable and splittable, whatever the
sizes of the two sides.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from harvestline.functions.quantiles import exact_median, exact_mode
from harvestline.operators.cover import cell_cover, grid_cell, inside_cover
from harvestline.operators.sampling import dedupe_first

NEIGHBOUR_STEPS = (-1, 0, 1)


def _explode_box(df: DataFrame, cell: float, prefix: str = "") -> DataFrame:
    """One row per grid cell the bounding box touches."""
    x0, x1, y0, y1 = (prefix + c for c in ("min_x", "max_x", "min_y", "max_y"))
    df = df.withColumn("_cx", F.explode(F.sequence(grid_cell(x0, cell), grid_cell(x1, cell))))
    return df.withColumn("_cy", F.explode(F.sequence(grid_cell(y0, cell), grid_cell(y1, cell))))


def pixel_in_polygon(pixels: DataFrame, regions: DataFrame, cell: float, region_id: str = "region_id") -> DataFrame:
    """Pixels with the id of every region whose ring holds their centre. Cells that lie inside a
    region ask for no edge, the others for the edges that pass them; ``cell`` should be a fraction
    of a typical region."""
    located = pixels.withColumns({"_cx": grid_cell("x", cell), "_cy": grid_cell("y", cell)})
    hits = located.join(cell_cover(regions, cell, region_id), ["_cx", "_cy"]).where(inside_cover("x", "y"))
    return hits.select(*pixels.columns, region_id, F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy")).drop("_copy")


def bbox_clip(scenes: DataFrame, regions: DataFrame, cell: float, scene_id: str = "scene_id",
              region_id: str = "region_id") -> DataFrame:
    """Pairs of scene and region whose boxes overlap. A pair meets in several cells; the
    one that holds the upper-left corner of the overlap keeps it, so no distinct is needed."""
    box = ["min_x", "max_x", "min_y", "max_y"]
    s = _explode_box(scenes.select(scene_id, *box), cell)
    r = _explode_box(regions.select(region_id, *[F.col(c).alias("r_" + c) for c in box]), cell, "r_")
    pairs = s.join(r, ["_cx", "_cy"])
    overlap = ((F.col("min_x") <= F.col("r_max_x")) & (F.col("max_x") >= F.col("r_min_x"))
               & (F.col("min_y") <= F.col("r_max_y")) & (F.col("max_y") >= F.col("r_min_y")))
    first = ((grid_cell(F.greatest("min_x", "r_min_x"), cell) == F.col("_cx"))
             & (grid_cell(F.greatest("min_y", "r_min_y"), cell) == F.col("_cy")))
    return pairs.where(overlap & first).select(scene_id, region_id)


def centroid(xs: Column | str = "xs", ys: Column | str = "ys") -> tuple[Column, Column]:
    """Mean of the vertices without the repeated last one (and without the NULLs between rings)."""
    def mean(a: str) -> Column:
        corners = F.array_compact(F.slice(F.col(a), 1, F.size(F.col(a)) - 1))
        return F.aggregate(corners, F.lit(0.0), lambda s, v: s + v) / F.size(corners)

    return mean(xs), mean(ys)


def nearest_pixel_fallback(regions: DataFrame, pixels: DataFrame, covered: DataFrame, levels: int = 3,
                           region_id: str = "region_id") -> DataFrame:
    """For regions not in ``covered``: the pixel nearest to the centroid.

    Descent through a pyramid of grid cells (8x8 children each): a cell stays a candidate
    while its nearest possible pixel is not farther than the farthest possible pixel of
    another one. Exact for any distance, and every step is an equi-join on the parent cell."""
    cx, cy = centroid()
    points = (regions.join(covered.select(region_id), region_id, "left_anti")
              .select(region_id, cx.alias("px"), cy.alias("py")))
    # one representative per location: the work is bounded by the raster grid
    grid = pixels.groupBy("x", "y").agg(F.min("value").alias("value"))
    ends = grid.agg(F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"),
                             F.min("y").alias("y0"), F.max("y").alias("y1"))).scalar()
    grid = grid.withColumn("_ends", ends)
    for axis in "xy":
        lo, hi = F.col(f"_ends.{axis}0"), F.col(f"_ends.{axis}1")
        grid = grid.withColumn("_u" + axis, F.coalesce(F.try_divide(F.col(axis) - lo, hi - lo), F.lit(0.0)))
    fine = 8 ** levels
    grid = grid.withColumns({"_cx": F.floor(F.col("_ux") * fine), "_cy": F.floor(F.col("_uy") * fine)}) \
        .drop("_ends", "_ux", "_uy")
    boxes = {levels: grid.groupBy("_cx", "_cy").agg(
        F.min("x").alias("bx0"), F.max("x").alias("bx1"), F.min("y").alias("by0"), F.max("y").alias("by1"))}
    for level in range(levels - 1, 0, -1):
        up = F.floor(F.col("_cx") / 8).alias("_cx"), F.floor(F.col("_cy") / 8).alias("_cy")
        boxes[level] = boxes[level + 1].groupBy(*up).agg(
            F.min("bx0").alias("bx0"), F.max("bx1").alias("bx1"), F.min("by0").alias("by0"), F.max("by1").alias("by1"))
    # the top level has at most 9x9 cells: one array, no join
    top = boxes[1].agg(F.collect_list(F.struct("_cx", "_cy", "bx0", "bx1", "by0", "by1"))).scalar()
    candidates = points.withColumn("_top", top).select(region_id, "px", "py", F.inline("_top"))
    candidates = _prune(candidates, region_id)
    for level in range(2, levels + 1):
        children = boxes[level].withColumns({"_px": F.floor(F.col("_cx") / 8), "_py": F.floor(F.col("_cy") / 8)})
        parents = candidates.select(region_id, "px", "py", F.col("_cx").alias("_px"), F.col("_cy").alias("_py"))
        candidates = _prune(parents.join(children, ["_px", "_py"]).drop("_px", "_py"), region_id)
    dist = F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2))
    pairs = candidates.select(region_id, "px", "py", "_cx", "_cy").join(grid, ["_cx", "_cy"]).withColumn("dist", dist)
    best = F.min_by(F.struct("x", "y", "value", "dist"), F.struct("dist", "x", "y"))
    return pairs.groupBy(region_id).agg(best.alias("_b")).select(region_id, "_b.x", "_b.y", "_b.value", "_b.dist")


def _prune(cells: DataFrame, key: str) -> DataFrame:
    """Drops cells that cannot hold the nearest pixel of their point."""
    px, py = F.col("px"), F.col("py")
    gap = lambda p, lo, hi: F.greatest(F.col(lo) - p, p - F.col(hi), F.lit(0.0))
    far = lambda p, lo, hi: F.greatest(F.abs(p - F.col(lo)), F.abs(p - F.col(hi)))
    low = F.sqrt(F.pow(gap(px, "bx0", "bx1"), 2) + F.pow(gap(py, "by0", "by1"), 2))
    high = F.sqrt(F.pow(far(px, "bx0", "bx1"), 2) + F.pow(far(py, "by0", "by1"), 2))
    bounded = cells.withColumns({"_low": low, "_high": high})
    limit = F.min("_high").over(W.partitionBy(key))  # a point has a few dozen cells at most
    return (bounded.withColumn("_limit", limit).where(F.col("_low") <= F.col("_limit"))
            .drop("_low", "_high", "_limit", "bx0", "bx1", "by0", "by1"))


def rounded_centroid_lookup(regions: DataFrame, cells: DataFrame, digits: int = 0, region_id: str = "region_id") -> DataFrame:
    """Region -> the grid value at its rounded centroid."""
    cx, cy = centroid()
    at = regions.select(region_id, F.round(cx, digits).alias("_gx"), F.round(cy, digits).alias("_gy"))
    grid = cells.groupBy(F.round("x", digits).alias("_gx"), F.round("y", digits).alias("_gy")).agg(F.avg("value").alias("value"))
    return at.join(grid, ["_gx", "_gy"]).select(region_id, "value")


def swath_to_grid_nn(swath: DataFrame, grid: DataFrame, radius: float = 210.0, by: Sequence[str] = ()) -> DataFrame:
    """Nearest swath sample within ``radius`` for every grid cell (``row``, ``col``, ``x``,
    ``y``). Samples are hashed to cells of the radius, grid points look at the 3x3 around."""
    by = list(by)
    steps = F.array(*[F.lit(s).cast("long") for s in NEIGHBOUR_STEPS])
    targets = (grid.select("row", "col", F.col("x").alias("gx"), F.col("y").alias("gy"))
               .withColumn("_cx", F.explode(F.transform(steps, lambda s: s + grid_cell("gx", radius))))
               .withColumn("_cy", F.explode(F.transform(steps, lambda s: s + grid_cell("gy", radius)))))
    samples = swath.withColumns({"_cx": grid_cell("x", radius), "_cy": grid_cell("y", radius)})
    dist = F.sqrt(F.pow(F.col("x") - F.col("gx"), 2) + F.pow(F.col("y") - F.col("gy"), 2))
    pairs = samples.join(targets, ["_cx", "_cy"]).withColumn("dist", dist).where(F.col("dist") <= radius)
    best = F.min_by(F.struct("value", "dist"), F.struct("dist", "x", "y", "value"))
    return pairs.groupBy(*by, "row", "col").agg(best.alias("_b")).select(*by, "row", "col", "_b.value", "_b.dist")


def align_landcover(landcover: DataFrame, *, origin_x: float, origin_y: float, size: float, rows: int, cols: int) -> DataFrame:
    """Categorical raster on another grid by nearest neighbour: every source pixel falls
    into a target cell, the one nearest to the cell's centre gives the class."""
    col = F.floor((F.col("x") - origin_x) / size).cast("int")
    row = F.floor((F.lit(origin_y) - F.col("y")) / size).cast("int")
    df = landcover.withColumns({"row": row, "col": col}).where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    dx = F.col("x") - (F.lit(origin_x) + (F.col("col") + 0.5) * size)
    dy = F.col("y") - (F.lit(origin_y) - (F.col("row") + 0.5) * size)
    best = F.min_by("land_class", F.struct(dx * dx + dy * dy, F.col("land_class")))
    return df.groupBy("row", "col").agg(best.alias("land_class"))


def _edges(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per ring edge."""
    idx = F.sequence(F.lit(0), F.size("xs") - 2)
    edge = F.transform(idx, lambda i: F.struct(F.get("xs", i).alias("x0"), F.get("ys", i).alias("y0"),
                                               F.get("xs", i + 1).alias("x1"), F.get("ys", i + 1).alias("y1")))
    return df.select(*keys, F.explode(edge).alias("_e")).select(*keys, "_e.*").where("x0 is not null and x1 is not null")


def shared_area(xs1: str, ys1: str, xs2: str, ys2: str) -> Column:
    """Area that two closed rings have in common, whatever their direction.

    A ring's inside is the signed sum of the strips below its edges, so the shared area is the
    signed sum, over all pairs of edges, of the area below both: the integral of the lower one of
    two straight lines. Coincident and collinear edges need no special case."""
    ox, oy = F.get(F.col(xs2), F.lit(0)), F.get(F.col(ys2), F.lit(0))  # a near origin keeps the sums small

    def edges(xs: str, ys: str) -> Column:
        def edge(i: Column) -> Column:
            x0, y0 = F.get(F.col(xs), i) - ox, F.get(F.col(ys), i) - oy
            x1, y1 = F.get(F.col(xs), i + 1) - ox, F.get(F.col(ys), i + 1) - oy
            slope = F.try_divide(y1 - y0, x1 - x0)
            return F.struct(F.least(x0, x1).alias("l"), F.greatest(x0, x1).alias("r"), F.signum(x1 - x0).alias("s"), slope.alias("k"), (y0 - slope * x0).alias("c"))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(xs) - 2), edge), lambda e: e["s"] != 0)

    def below_both(e: Column, f: Column) -> Column:
        left, right = F.greatest(e["l"], f["l"]), F.least(e["r"], f["r"])
        at = lambda line, x: line["k"] * x + line["c"]
        dl, dr = at(e, left) - at(f, left), at(e, right) - at(f, right)
        lower = (F.when((dl <= 0) & (dr <= 0), (dl + dr) / 2).when((dl >= 0) & (dr >= 0), 0.0)
                 .when(dl < 0, -dl * dl / (2 * (dr - dl))).otherwise(-dr * dr / (2 * (dl - dr))))
        area = (right - left) * ((at(f, left) + at(f, right)) / 2 + lower)
        return F.when(right > left, e["s"] * f["s"] * area).otherwise(0.0)

    def over_first(total: Column, e: Column) -> Column:
        return total + F.aggregate(edges(xs2, ys2), F.lit(0.0), lambda t, f: t + below_both(e, f))

    return F.abs(F.aggregate(edges(xs1, ys1), F.lit(0.0), over_first))


def ring_area(xs: str, ys: str) -> Column:
    at = lambda c, i: F.get(F.col(c), i) - F.get(F.col(c), F.lit(0))
    step = lambda t, i: t + at(xs, i) * at(ys, i + 1) - at(xs, i + 1) * at(ys, i)
    return F.abs(F.aggregate(F.sequence(F.lit(0), F.size(xs) - 2), F.lit(0.0), step)) / 2


def rings_overlap(xs1: str, ys1: str, xs2: str, ys2: str) -> Column:
    """True if two rings share area. Rings that only touch, along an edge or at a point, do not;
    the tolerance is a billionth of the smaller ring."""
    return shared_area(xs1, ys1, xs2, ys2) > F.least(ring_area(xs1, ys1), ring_area(xs2, ys2)) * 1e-9


def region_overlay(parcels: DataFrame, regions: DataFrame, cell: float, parcel_id: str = "field_id",
                   region_id: str = "region_id") -> DataFrame:
    """Each parcel with the first (smallest id) region it shares area with; touching is not enough."""
    box = ["min_x", "max_x", "min_y", "max_y"]
    p = _explode_box(parcels.select(parcel_id, F.col("xs").alias("pxs"), F.col("ys").alias("pys"), *box), cell)
    r = _explode_box(regions.select(region_id, "xs", "ys", *[F.col(c).alias("r_" + c) for c in box]), cell, "r_")
    overlap = ((F.col("min_x") <= F.col("r_max_x")) & (F.col("max_x") >= F.col("r_min_x"))
               & (F.col("min_y") <= F.col("r_max_y")) & (F.col("max_y") >= F.col("r_min_y")))
    hits = p.join(r, ["_cx", "_cy"]).where(overlap & rings_overlap("pxs", "pys", "xs", "ys"))
    return hits.groupBy(parcel_id).agg(F.min(region_id).alias(region_id))


def queen_neighbors(regions: DataFrame, digits: int = 7, region_id: str = "region_id") -> DataFrame:
    """Directed edges between regions sharing a vertex, weights row-standardised. The
    self-join key is the vertex, which only a few outlines share."""
    vertex = F.arrays_zip(F.transform("xs", lambda v: F.round(v, digits)).alias("x"),
                          F.transform("ys", lambda v: F.round(v, digits)).alias("y"))
    corners = regions.select(F.col(region_id).alias("src"), F.explode(F.array_distinct(vertex)).alias("_v"))
    corners = corners.select("src", F.col("_v").getField("x").alias("vx"), F.col("_v").getField("y").alias("vy"))
    other = corners.withColumnRenamed("src", "dst")
    edges = corners.join(other, ["vx", "vy"]).where("src <> dst").select("src", "dst").distinct()
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_n"))
    return edges.join(degree, "src").select("src", "dst", (1.0 / F.col("_n")).alias("w"))


def dissolve_outline(regions: DataFrame, parent: str, digits: int = 7) -> DataFrame:
    """Outline of merged polygons: the edges that belong to exactly one member."""
    r = lambda c: F.round(c, digits)
    e = _edges(regions, [parent]).select(parent, r("x0").alias("x0"), r("y0").alias("y0"), r("x1").alias("x1"), r("y1").alias("y1"))
    end = lambda i: F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"))
    a, b = end(0), end(1)
    e = e.select(parent, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    once = e.groupBy(parent, "a", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return once.select(parent, F.col("a.x").alias("x0"), F.col("a.y").alias("y0"),
                       F.col("b.x").alias("x1"), F.col("b.y").alias("y1"))


def zonal_median_std(pixels_in_region: DataFrame, by: Sequence[str] = ("region_id", "scene_id", "band"),
                     value: str = "value", nodata: float | None = 0.0) -> DataFrame:
    """Exact median and population sigma; nodata pixels are left out."""
    df = pixels_in_region if nodata is None else pixels_in_region.where(F.col(value) != nodata)
    return exact_median(df, value, by, std="std")


def zonal_median_std_approx(pixels_in_region: DataFrame, by: Sequence[str] = ("region_id", "scene_id", "band"),
                            value: str = "value", nodata: float | None = 0.0, accuracy: int = 10000) -> DataFrame:
    """One shuffle of bounded sketches instead of an exact median."""
    df = pixels_in_region if nodata is None else pixels_in_region.where(F.col(value) != nodata)
    return df.groupBy(*by).agg(F.percentile_approx(value, 0.5, accuracy).alias("median"),
                               F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def zonal_mode(pixels_in_region: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return exact_mode(pixels_in_region, value, by)


def zonal_masked_mean(pixels_in_region: DataFrame, regions: DataFrame, mask: Column, value: str = "value",
                      by: Sequence[str] = ("region_id",)) -> DataFrame:
    """Mean over valid pixels of the mask with their count; regions without one get NULL and 0."""
    stats = pixels_in_region.where(mask & F.col(value).isNotNull()).groupBy(*by) \
        .agg(F.avg(value).alias("mean_value"), F.count(value).alias("pixel_count"))
    keys = regions.select(*by).distinct()
    return keys.join(stats, list(by), "left").withColumn("pixel_count", F.coalesce("pixel_count", F.lit(0)))


def parcels_once(parcels: DataFrame, parcel_id: str = "field_id") -> DataFrame:
    return dedupe_first(parcels, [parcel_id], [F.col("min_x"), F.col("min_y")])
