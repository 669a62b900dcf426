"""Key joins between feature tables, yield panels and lookups.

No broadcast hints: Spark broadcasts a side when its measured size is below the
configured threshold and otherwise shuffles, splitting skewed partitions.
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from harvestline.functions.scalars import admin_key
from harvestline.operators.sampling import dedupe_first


def merge_natural(frames: Sequence[DataFrame]) -> DataFrame:
    """Inner join of N tables, each step on all columns shared so far."""
    def step(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, [c for c in a.columns if c in b.columns])

    return reduce(step, frames)


def merge_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("field_id", "c_year"),
                 predictors: Sequence[str] | None = None) -> DataFrame:
    """Inner join that takes only columns from the right side the left lacks."""
    add = [c for c in (predictors or right.columns) if c not in left.columns]
    return left.join(right.select(*keys, *add), list(keys))


def override_update(base: DataFrame, updates: Sequence[DataFrame], keys: Sequence[str], col: str,
                    factors: Sequence[float] | None = None) -> DataFrame:
    """Panel values overwritten by other sources, later sources first in priority order
    given. Only existing keys change; a missing update keeps the old value."""
    factors = list(factors or [1.0] * len(updates))
    df = base
    for i, (new, factor) in enumerate(zip(updates, factors)):
        side = new.select(*keys, (F.col(col) * F.lit(float(factor))).alias(f"_u{i}"))
        df = df.join(side, list(keys), "left")
    chain = [F.col(f"_u{i}") for i in range(len(updates))]
    return df.withColumn(col, F.coalesce(*chain, F.col(col))).select(*base.columns)


def attach_yield(regions: DataFrame, panel: DataFrame, keys: Sequence[str] = ("region_id",)) -> DataFrame:
    return regions.join(panel, list(keys), "left")


def missing_regions(regions: DataFrame, panel: DataFrame, key: str = "region_id") -> DataFrame:
    """Regions without any yield record."""
    return regions.select(key).distinct().join(panel.select(key), key, "left_anti")


def attach_shape(regions: DataFrame, wide: DataFrame, observed: str, forecast: str, key: str = "region_id") -> DataFrame:
    """Map layer: regions with observation and forecast plus the common colour range."""
    ends = wide.agg(F.struct(F.least(F.min(observed), F.min(forecast)).alias("lo"),
                             F.greatest(F.max(observed), F.max(forecast)).alias("hi"))).scalar()
    df = regions.join(wide.select(key, observed, forecast), key, "left").withColumn("_ends", ends)
    return df.withColumns({"range_min": F.col("_ends.lo"), "range_max": F.col("_ends.hi")}).drop("_ends")


def union_outer_merge(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join of two tables, one row per key on either side."""
    return left.dropDuplicates(list(keys)).join(right.dropDuplicates(list(keys)), list(keys), "full")


def prefer_new_regions(old: DataFrame, new: DataFrame, key: str = "region_id") -> DataFrame:
    """New definitions of regions replace the old ones; others stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def previous_year_crop(df: DataFrame, field: str = "field_id", year: str = "c_year", crop: str = "crop_type",
                       default: str = "unknown") -> DataFrame:
    """Last year's crop on the same field (the smallest name if there were several)."""
    before = df.groupBy(F.col(field), (F.col(year) + 1).alias(year)).agg(F.min(crop).alias("prev_year_crop"))
    joined = df.join(before, [field, year], "left")
    return joined.withColumn("prev_year_crop", F.coalesce("prev_year_crop", F.lit(default)))


def broadcast_region_to_fields(fields: DataFrame, region_year: DataFrame, keys: Sequence[str] = ("c_year",)) -> DataFrame:
    """Yearly weather of one region copied to all its fields: the region side has one row
    per year, so its measured size makes it the broadcast side."""
    return fields.join(region_year, list(keys))


def align_observations(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_semi")


def region_year_skeleton(regions: DataFrame, years: DataFrame, region: str = "region_id", year: str = "c_year") -> DataFrame:
    """Every region with every year. The distinct years (a handful) travel as one array in
    a scalar subquery and are exploded, so there is no cross product of two scans."""
    all_years = years.agg(F.array_sort(F.collect_set(year))).scalar()
    return regions.select(region).distinct().withColumn("_ys", all_years) \
        .select(region, F.explode("_ys").alias(year))


def zone_lookup(df: DataFrame, zones: DataFrame, key: str = "region_id", default: str = "No") -> DataFrame:
    side = dedupe_first(zones, [key], [F.col("status")])
    return df.join(side, key, "left").withColumn("status", F.coalesce("status", F.lit(default)))


def year_pairing(predictors: DataFrame, targets: DataFrame, keys: Sequence[str] = ("region_id", "c_year")) -> DataFrame:
    return predictors.join(targets, list(keys))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: Column | None = None) -> DataFrame:
    """Dictionary recode by a dimension table."""
    joined = df.join(table.select(key, F.col(value).alias("_to")), key, "left")
    return joined.withColumn(key, F.coalesce("_to", F.col(key) if default is None else default)).drop("_to")


def with_country(df: DataFrame, region: str = "region_id", country: str = "country") -> DataFrame:
    return df.withColumn(country, admin_key(region))
