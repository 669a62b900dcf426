"""Scene catalogue queries."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def regions_extent(regions: DataFrame) -> DataFrame:
    """One row: the bounding box of all regions."""
    return regions.agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"),
                       F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


def _overlaps(extent: Column) -> Column:
    return ((F.col("min_x") <= extent["max_x"]) & (F.col("max_x") >= extent["min_x"])
            & (F.col("min_y") <= extent["max_y"]) & (F.col("max_y") >= extent["min_y"]))


def catalog_search(catalog: DataFrame, start: str, end: str, *, extent: DataFrame | None = None,
                   bbox: Sequence[float] | None = None, max_cloud: float = 80.0) -> DataFrame:
    """Scenes that touch the box, begin within [start, end] and are clear enough. With
    literal limits everything is pushed into the scan; an ``extent`` frame (one row)
    enters as a scalar subquery."""
    df = catalog.where(F.col("begin_ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
                       & (F.col("cloud_cover") < max_cloud))
    if bbox is not None:
        x0, y0, x1, y1 = map(float, bbox)
        df = df.where((F.col("min_x") <= x1) & (F.col("max_x") >= x0) & (F.col("min_y") <= y1) & (F.col("max_y") >= y0))
    if extent is not None:
        row = extent.select(F.struct("min_x", "min_y", "max_x", "max_y")).scalar()
        df = df.withColumn("_extent", row).where(_overlaps(F.col("_extent"))).drop("_extent")
    return df


def catalog_extreme(catalog: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The most clouded scene; the smallest id among equals."""
    best = F.min_by("scene_id", F.struct(-F.col("cloud_cover"), F.col("scene_id")))
    return catalog.groupBy(*by).agg(best.alias("scene_id"), F.max("cloud_cover").alias("cloud_cover"))


def catalog_pair(data_files: DataFrame, geo_files: DataFrame, key: str = "begin_ts") -> DataFrame:
    """Data files with the geolocation file of the same begin time (the smallest id, should
    there be several), at most one row per data file."""
    geo = geo_files.groupBy(key).agg(F.min("scene_id").alias("geo_id"))
    return data_files.join(geo, key)


def catalog_listing(catalog: DataFrame, by: Sequence[str] = ("collection",)) -> DataFrame:
    return (catalog.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n_scenes"), F.min("begin_ts").alias("first_ts"),
                 F.max("begin_ts").alias("last_ts"))
            .orderBy(*by))


def resume_pending(catalog: DataFrame, done: DataFrame, key: str | Sequence[str] = "scene_id") -> DataFrame:
    """Scenes not processed yet."""
    keys = [key] if isinstance(key, str) else list(key)
    return catalog.join(done.select(*keys), keys, "left_anti")
