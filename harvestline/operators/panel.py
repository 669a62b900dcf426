"""Yield panels: cleaning, detrending, roll-ups and reshaping.

Panels hold one row per region, crop and year, so windows per region are bounded by the
number of years.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from harvestline.functions.metrics import finite, pearson
from harvestline.functions.quantiles import attach
from harvestline.functions.scalars import admin_key, db_to_linear, linear_to_db, scene_class_mask
from harvestline.operators.timeseries import interpolate_linear


def clean_panel(panel: DataFrame, by: Sequence[str] = ("region_id",), value: str = "yield", digits: int = 2) -> DataFrame:
    """Values <= 0 become NULL, regions left without any value drop out."""
    df = panel.withColumn(value, F.round(F.when(F.col(value) > 0, F.col(value)), digits))
    kept = df.groupBy(*by).agg(F.count(value).alias("_n")).where("_n > 0").drop("_n")
    return df.join(kept, list(by), "left_semi")


def linregress(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept, correlation and means of the pairs with both sides present."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    slope, icpt = F.regr_slope(y, x), F.regr_intercept(y, x)
    return pairs.groupBy(*by).agg(
        finite(slope).alias("slope"), finite(icpt).alias("intercept"), pearson(x, y).alias("r"),
        F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.count(F.lit(1)).alias("n"))


def _trend(x: str, y: str, by: Sequence[str]) -> Column:
    """Fitted line at x, the mean where one point gives no slope."""
    part = W.partitionBy(*by)
    line = F.regr_slope(y, x).over(part) * F.col(x) + F.regr_intercept(y, x).over(part)
    return F.coalesce(line, F.avg(y).over(part))


def detrend_residual(df: DataFrame, x: str = "c_year", y: str = "yield", by: Sequence[str] = ("region_id",),
                     digits: int | None = 2, name: str = "y_detrended") -> DataFrame:
    res = F.col(y) - _trend(x, y, by)
    return df.withColumn(name, F.round(res, digits) if digits is not None else res)


def detrend_keep_mean(df: DataFrame, x: str = "c_year", y: str = "yield", by: Sequence[str] = ("region_id",),
                      name: str = "y_detrended") -> DataFrame:
    """Residual plus the group's mean: the trend goes, the level stays."""
    return df.withColumn(name, F.col(y) - _trend(x, y, by) + F.avg(y).over(W.partitionBy(*by)))


def detrend_gap_filled(df: DataFrame, year: str = "c_year", y: str = "yield", by: Sequence[str] = ("region_id",),
                       digits: int = 2, name: str = "y_detrended") -> DataFrame:
    """Missing years filled linearly, trend fitted on the filled series, mean of the
    original values added; only the original years return."""
    ends = df.groupBy(*by).agg(F.min(year).alias("_a"), F.max(year).alias("_b"), F.avg(y).alias("_mean"))
    spine = ends.withColumn(year, F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")
    full = spine.join(df.withColumn("_orig", F.lit(True)), [*by, year], "left")
    full = interpolate_linear(full.withColumn("_fill", F.col(y)), by, year, "_fill")
    res = F.col("_fill") - _trend(year, "_fill", by) + F.col("_mean")
    return full.withColumn(name, F.round(res, digits)).where("_orig").drop("_orig", "_fill", "_mean")


def center_by_group(df: DataFrame, value: str, by: Sequence[str], name: str = "centered") -> DataFrame:
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"))
    return attach(df, stats, by).withColumn(name, F.col(value) - F.col("_m")).drop("_m")


def region_rollup_mean(df: DataFrame, level: str, values: Sequence[str], by: Sequence[str] = ("c_year",),
                       region: str = "region_id") -> DataFrame:
    """Finer to coarser regions: mean per parent and year."""
    return df.groupBy(admin_key(region, level).alias(region), *by).agg(*[F.avg(v).alias(v) for v in values])


def rollup_mean_first(df: DataFrame, by: Sequence[str], means: Sequence[str], first: str, order: str) -> DataFrame:
    """Mean of the predictors, and the yield of the first row in an explicit order."""
    return df.groupBy(*by).agg(*[F.avg(m).alias(m) for m in means], F.min_by(first, order).alias(first))


def ensemble_mean(cube: DataFrame, by: Sequence[str] = ("region_id", "month"), leads: Sequence[int] = (1, 2, 3, 4),
                  value: str = "value") -> DataFrame:
    """Seasonal forecast: mean over members and cells per month, one column per lead."""
    return cube.groupBy(*by).agg(*[F.avg(F.when(F.col("lead") == n, F.col(value))).alias(f"LT{n}") for n in leads])


def fields_to_region_mean(fields: DataFrame, scene_class: str, by: Sequence[str] = ("region_id", "obs_date", "band"),
                          value: str = "value") -> DataFrame:
    """Mean of the cloud-free field values per region, date and band."""
    masked = fields.withColumn("_v", scene_class_mask(value, scene_class))
    return masked.groupBy(*by).agg(F.avg("_v").alias(value), F.count("_v").alias("n_fields"))


def radar_region_mean(fields: DataFrame, by: Sequence[str] = ("region_id", "obs_date"), value: str = "value") -> DataFrame:
    """Mean over fields in linear units, returned in dB."""
    return fields.groupBy(*by).agg(linear_to_db(F.avg(db_to_linear(value))).alias(value))


def pivot_years(df: DataFrame, years: Sequence[int], by: Sequence[str] = ("region_id",), value: str = "yield",
                year: str = "c_year", agg: str = "avg") -> DataFrame:
    """Long to wide with a known list of years (no extra job to find them)."""
    return df.groupBy(*by).pivot(year, list(years)).agg(F.expr(f"{agg}(`{value}`)"))


def pivot_sum(df: DataFrame, years: Sequence[int], by: Sequence[str] = ("region_id",), value: str = "yield",
              year: str = "c_year") -> DataFrame:
    return pivot_years(df, years, by, value, year, "sum")


def melt(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(cols), name, value)


def explode_scores(df: DataFrame, scores: str, keys: Sequence[str], fold: str = "fold", value: str = "score") -> DataFrame:
    """A list of fold scores per row to one row per fold."""
    return df.select(*keys, F.posexplode(scores).alias(fold, value))


def split_stat_rows(df: DataFrame, keys: Sequence[str], label: str = "band_stat", value: str = "value") -> DataFrame:
    """Rows ``<band>_median`` and ``<band>_std`` to one row with two columns. More than one
    row of a kind stops the job."""
    band = F.regexp_replace(label, "_(median|std)$", "").alias("band")
    stat = F.regexp_extract(label, "_(median|std)$", 1)
    pick = lambda s: F.max(F.when(stat == s, F.col(value))).alias(s)
    twice = (F.count_if(stat == "median") > 1) | (F.count_if(stat == "std") > 1)
    wide = df.groupBy(*keys, band).agg(pick("median"), pick("std"), twice.alias("_twice"))
    checked = F.when(F.col("_twice"), F.raise_error(F.lit("repeated statistics row")).cast("double"))
    return wide.withColumn("median", F.coalesce(checked, F.col("median"))).drop("_twice")


def contingency(df: DataFrame, row: str, col: str, col_values: Sequence, min_count: int = 100) -> DataFrame:
    """Counts row x column, only rows with more than ``min_count`` observations."""
    cells = [F.count_if(F.col(col) == v).alias(str(v)) for v in col_values]
    counts = df.groupBy(row).agg(*cells, F.count(F.lit(1)).alias("total"))
    return counts.where(F.col("total") > min_count)


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *cols)


def coverage_summary(df: DataFrame, by: Sequence[str], region: str = "region_id", ts: str = "obs_date",
                     value: str = "value") -> DataFrame:
    """Rows, distinct regions, date range, non-null count and mean. Regions are reduced
    first, so the distinct count works on group x region rows."""
    per = df.groupBy(*by, region).agg(F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_a"), F.max(ts).alias("_b"),
                                      F.count(value).alias("_c"), F.sum(value).alias("_s"))
    return per.groupBy(*by).agg(
        F.sum("_n").alias("n_rows"), F.count(region).alias("n_regions"), F.min("_a").alias("first_date"),
        F.max("_b").alias("last_date"), F.sum("_c").alias("n_values"),
        F.try_divide(F.sum("_s"), F.sum("_c")).alias("mean_value"))


def apply_recodes(df: DataFrame, recodes: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(recodes))
