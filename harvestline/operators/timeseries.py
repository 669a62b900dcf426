"""Calendar binning, gap filling, smoothing and anomalies of region series.

Order matters for scale: every operator here that needs a window works on series reduced
to at most one row per calendar day or bin (``resample_*``), so a window partition is
bounded by the length of the calendar and not by the number of observations. The
``resample_*`` reductions themselves combine map-side.
"""

from __future__ import annotations

import math
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from harvestline.functions.scalars import db_to_linear, linear_to_db

BY = ("region_id", "param")


def resample_daily(df: DataFrame, by: Sequence[str] = BY, ts: str = "ts", value: str = "value",
                   agg: str = "avg", label: str = "obs_date") -> DataFrame:
    """One row per day: mean (or max, for flags) of the day's observations."""
    return df.groupBy(*by, F.to_date(ts).alias(label)).agg(F.expr(f"{agg}({value})").alias(value))


def _first_bin_end(first: Column) -> Column:
    return F.next_day(F.date_sub(first, 1), "Sun")


def resample_days(df: DataFrame, days: int, by: Sequence[str] = BY, ts: str = "obs_date", value: str = "value",
                  label: str = "label", in_db: bool = False, one_per_day: bool = True) -> DataFrame:
    """Mean per bin of ``days`` (7 or 14), bins closed and labelled on Sundays; the first
    ends on the first Sunday at or after the first day of each series. Series with several
    rows per day (``one_per_day=False``) are first added up per day, map-side."""
    v = db_to_linear(value) if in_db else F.col(value)
    if one_per_day:
        parts = df.select(*by, F.col(ts).alias("_d"), v.alias("_s"), F.col(value).isNotNull().cast("long").alias("_n"))
    else:
        parts = df.groupBy(*by, F.to_date(ts).alias("_d")).agg(F.sum(v).alias("_s"), F.count(value).alias("_n"))
    # one shuffle: the window and the bins share the partitioning by series
    first_end = _first_bin_end(F.min("_d").over(W.partitionBy(*by)))
    step = F.greatest(F.lit(0), F.ceil(F.datediff("_d", "_s0") / days)).cast("int")
    mean = F.try_divide(F.sum("_s"), F.sum("_n"))
    return (parts.withColumn("_s0", first_end).groupBy(*by, F.date_add("_s0", step * days).alias(label))
            .agg((linear_to_db(mean) if in_db else mean).alias(value)))


def resample_weekly(df: DataFrame, **kw) -> DataFrame:
    return resample_days(df, 7, **kw)


def resample_2w(df: DataFrame, **kw) -> DataFrame:
    return resample_days(df, 14, **kw)


def resample_monthly(df: DataFrame, by: Sequence[str] = BY, ts: str = "obs_date", value: str = "value",
                     label: str = "label", one_per_day: bool = True) -> DataFrame:
    """Mean per calendar month, labelled by its last day. Daily rows of a month are gathered before
    they are added up: a task that holds a few days of every month would keep a sum for nearly each
    row, on top of what its daily means take. Series with several rows per day
    (``one_per_day=False``) are added up map-side."""
    dated = df.select(*by, F.last_day(ts).alias(label), F.col(value).alias(value))
    if one_per_day:
        dated = dated.repartition(*by, label)
    return dated.groupBy(*by, label).agg(F.avg(value).alias(value))


def resample_6d(df: DataFrame, by: Sequence[str], ts: str = "obs_date", value: str = "value",
                in_db: bool = True, steps: int | None = 61) -> DataFrame:
    """Six-day means counted from 1 January (radar in linear units); only series with all
    ``steps`` bins are kept."""
    year = F.year(ts)
    step = F.floor((F.dayofyear(ts) - 1) / 6).cast("int")
    v = db_to_linear(value) if in_db else F.col(value)
    mean = linear_to_db(F.avg(v)) if in_db else F.avg(v)
    binned = df.groupBy(*by, year.alias("c_year"), step.alias("step")).agg(mean.alias(value))
    if steps is None:
        return binned
    whole = binned.groupBy(*by, "c_year").agg(F.count(value).alias("_n")).where(F.col("_n") == steps).drop("_n")
    return binned.join(whole, [*by, "c_year"])


def fill_spine(df: DataFrame, by: Sequence[str] = BY, ts: str = "obs_date", value: str = "value",
               start: str | None = None, end: str | None = None, step: str = "1 day",
               fill: float | None = None) -> DataFrame:
    """Regular calendar per series, from its own first to last date unless given; missing
    values NULL or ``fill``."""
    ends = df.groupBy(*by).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    a = F.lit(start).cast("date") if start else F.col("_a")
    b = F.lit(end).cast("date") if end else F.col("_b")
    days = ends.select(*by, F.explode(F.sequence(a, b, F.expr(f"interval {step}"))).alias(ts))
    out = days.join(df.select(*by, ts, value), [*by, ts], "left")
    return out.fillna(float(fill), subset=[value]) if fill is not None else out


spine_align = fill_spine


def interpolate_linear(df: DataFrame, by: Sequence[str] = BY, order: str = "obs_date", value: str = "value") -> DataFrame:
    """Linear by position between the neighbours that exist. A gap at the end repeats the
    last value, a gap at the start stays missing."""
    w = W.partitionBy(*by).orderBy(order)
    past = w.rowsBetween(W.unboundedPreceding, 0)
    # looking ahead by a descending window: a frame up to the end would be quadratic
    future = W.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    pos = F.when(F.col(value).isNotNull(), F.col("_i"))
    df = df.withColumn("_i", F.row_number().over(w))
    df = df.withColumns({
        "_pv": F.last(value, ignorenulls=True).over(past), "_pi": F.last(pos, ignorenulls=True).over(past),
        "_nv": F.last(value, ignorenulls=True).over(future), "_ni": F.last(pos, ignorenulls=True).over(future)})
    slope = F.try_divide(F.col("_nv") - F.col("_pv"), F.col("_ni") - F.col("_pi"))
    filled = F.col("_pv") + F.coalesce(slope, F.lit(0.0)) * (F.col("_i") - F.col("_pi"))
    return df.withColumn(value, F.coalesce(F.col(value), filled)).drop("_i", "_pv", "_pi", "_nv", "_ni")


def rolling_mean_rows(df: DataFrame, by: Sequence[str] = BY, order: str = "obs_date", value: str = "value",
                      n: int = 5, in_db: bool = False, name: str = "smoothed") -> DataFrame:
    """Mean of rows i-n .. i+n-1; the first and last n rows get NULL. The window is 2n rows
    wide, not 2n+1."""
    w = W.partitionBy(*by).orderBy(order)
    v = db_to_linear(value) if in_db else F.col(value)
    mean = F.avg(v).over(w.rowsBetween(-n, n - 1))
    i, size = F.row_number().over(w), F.count(F.lit(1)).over(W.partitionBy(*by))
    return df.withColumn(name, F.when((i > n) & (i <= size - n), linear_to_db(mean) if in_db else mean))


def _near_days(fine: DataFrame, coarse: DataFrame, by: Sequence[str], ts: str, value: str, d: int) -> DataFrame:
    """Pairs of a coarse timestamp and the fine samples within +-d days. Days are cut into
    buckets; the (fewer) coarse timestamps go to every bucket in reach, a sample stays in
    its own: an equi-join on (series, bucket)."""
    day = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 86400)
    size = d + 1
    c = coarse.select(*by, F.col(ts).alias("_t"))
    reach = F.sequence(F.floor((day("_t") - d - 1) / size), F.floor((day("_t") + d + 1) / size))
    c = c.withColumn("_b", F.explode(reach))
    f = fine.select(*by, F.col(ts).alias("_ft"), F.col(value).alias("_fv")).withColumn("_b", F.floor(day("_ft") / size))
    secs = lambda col: F.unix_micros(F.col(col).cast("timestamp")) / 86400e6
    pairs = c.join(f, [*by, "_b"]).withColumn("_dist", F.abs(secs("_ft") - secs("_t")))
    return pairs.where(F.col("_dist") <= d)


def _back_to_coarse(coarse: DataFrame, reduced: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    return coarse.join(reduced.withColumnRenamed("_t", ts), [*by, ts], "left")


def rolling_mean_days(fine: DataFrame, coarse: DataFrame, by: Sequence[str] = BY, ts: str = "ts", value: str = "value",
                      d: int = 6, in_db: bool = True, name: str = "smoothed") -> DataFrame:
    """Mean of the samples within +-d days of every coarse timestamp."""
    v = db_to_linear("_fv") if in_db else F.col("_fv")
    mean = F.avg(v)
    out = _near_days(fine, coarse, by, ts, value, d).groupBy(*by, "_t").agg((linear_to_db(mean) if in_db else mean).alias(name))
    return _back_to_coarse(coarse, out, by, ts)


def rolling_gauss_days(fine: DataFrame, coarse: DataFrame, by: Sequence[str] = BY, ts: str = "ts", value: str = "value",
                       d: int = 6, in_db: bool = True, name: str = "smoothed") -> DataFrame:
    """Same with weights of a normal density with sigma d/3 over whole days of distance."""
    v = db_to_linear("_fv") if in_db else F.col("_fv")
    z = F.floor("_dist") / F.lit(d / 3.0)
    weight = F.when(F.col("_fv").isNotNull(), F.exp(z * z * -0.5))
    mean = F.try_divide(F.sum(weight * v), F.sum(weight))
    out = _near_days(fine, coarse, by, ts, value, d).groupBy(*by, "_t").agg((linear_to_db(mean) if in_db else mean).alias(name))
    return _back_to_coarse(coarse, out, by, ts)


def rolling_op_days(fine: DataFrame, coarse: DataFrame, op: Callable[[Column], Column], by: Sequence[str] = BY,
                    ts: str = "ts", value: str = "value", d: int = 6, name: str = "reduced") -> DataFrame:
    """Any reducer over +-d days: a function from a column to an aggregate column (built-in,
    or a grouped-aggregate pandas UDF)."""
    out = _near_days(fine, coarse, by, ts, value, d).groupBy(*by, "_t").agg(op(F.col("_fv")).alias(name))
    return _back_to_coarse(coarse, out, by, ts)


def ewm_smooth(df: DataFrame, by: Sequence[str] = BY, order: str = "obs_date", value: str = "value",
               alpha: float = 2.0 / 3.0, name: str = "smoothed") -> DataFrame:
    """Exponentially weighted mean (weights normalised) of an interpolated series.

    The recursion unrolled in blocks so long that a weight falls below double precision
    within one: a row needs the running sum of its own block and the sum of the block
    before, both plain window sums."""
    q = 1.0 - alpha
    size = 1 if q <= 0 else max(1, math.ceil(18 * math.log(10) / -math.log(q)))
    q = max(q, 0.0)
    pos = F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1
    df = df.withColumn("_i", pos)
    df = df.withColumns({"_block": F.floor(F.col("_i") / size), "_t": F.col("_i") % size})
    here = W.partitionBy(*by, "_block").orderBy("_t").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*by).orderBy("_block").rangeBetween(-1, -1)

    def weighted(v: Column) -> Column:
        if q == 0.0:
            return v
        grown = F.pow(F.lit(q), -F.col("_t").cast("double"))
        own = F.sum(v * grown).over(here) * F.pow(F.lit(q), F.col("_t").cast("double"))
        last = F.sum(v * grown).over(before) * F.lit(q ** (size - 1))
        return F.coalesce(own, F.lit(0.0)) + F.coalesce(last, F.lit(0.0)) * F.pow(F.lit(q), F.col("_t") + 1.0)

    weight = F.when(F.col(value).isNotNull(), 1.0)
    df = df.withColumns({"_num": weighted(F.col(value)), "_den": weighted(weight)})
    return df.withColumn(name, F.try_divide("_num", "_den")).drop("_i", "_block", "_t", "_num", "_den")


def detrend_series(df: DataFrame, by: Sequence[str] = BY, order: str = "obs_date", value: str = "value",
                   name: str = "detrended") -> DataFrame:
    """Residual of a straight line over the sample number of the non-missing values."""
    w = W.partitionBy(*by).orderBy(order)
    part = W.partitionBy(*by)
    pos = F.sum(F.col(value).isNotNull().cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("_i", F.when(F.col(value).isNotNull(), pos.cast("double")))
    slope, icpt = F.regr_slope(value, "_i").over(part), F.regr_intercept(value, "_i").over(part)
    line = F.coalesce(slope * F.col("_i") + icpt, F.avg(value).over(part))
    return df.withColumn(name, F.col(value) - line).drop("_i")


LEAP_DAY = 60  # day-of-year slot of 29 February in a 366-day calendar


def calendar_slot(date: Column | str) -> Column:
    """Day of year on a 366-day calendar, so that 1 March is 61 in every year."""
    date = F.col(date) if isinstance(date, str) else date
    leap = F.dayofmonth(F.last_day(F.make_date(F.year(date), F.lit(2), F.lit(1)))) == 29
    return F.dayofyear(date) + F.when(~leap & (F.month(date) > 2), 1).otherwise(0)


def climatology(df: DataFrame, by: Sequence[str] = BY, ts: str = "obs_date", value: str = "value",
                w_orig: int = 20, w_clim: int = 30, name: str = "clim") -> DataFrame:
    """Mean yearly course: values smoothed over ``w_orig`` days, averaged per calendar day,
    smoothed again over ``w_clim`` days around the turn of the year."""
    day = F.datediff(F.col(ts), F.lit("1970-01-01").cast("date"))
    near = W.partitionBy(*by).orderBy("_d").rangeBetween(-(w_orig // 2), w_orig // 2)
    smooth = df.where(F.col(value).isNotNull()).withColumn("_d", day).withColumn("_s", F.avg(value).over(near))
    slots = smooth.groupBy(*by, calendar_slot(ts).alias("doy")).agg(F.avg("_s").alias("_m"))
    turns = F.array(F.lit(-366), F.lit(0), F.lit(366))
    wrapped = slots.withColumn("_turn", F.explode(turns)).withColumn("_p", F.col("doy") + F.col("_turn"))
    around = W.partitionBy(*by).orderBy("_p").rangeBetween(-(w_clim // 2), w_clim // 2)
    return wrapped.withColumn(name, F.avg("_m").over(around)).where("_turn = 0").select(*by, "doy", name)


def anomaly(df: DataFrame, by: Sequence[str] = BY, ts: str = "obs_date", value: str = "value", *,
            detrend: bool = False, clim: DataFrame | None = None, name: str = "anom") -> DataFrame:
    """Value minus climatology of its calendar day; series without any value drop out."""
    present = df.groupBy(*by).agg(F.count(value).alias("_n")).where("_n > 0").drop("_n")
    df = df.join(present, list(by), "left_semi")
    source = value
    if detrend:
        source = "_det"
        df = detrend_series(df, by, ts, value, name=source)
    if clim is None:
        clim = climatology(df, by, ts, source)
    joined = df.withColumn("doy", calendar_slot(ts)).join(clim, [*by, "doy"], "left")
    out = joined.withColumn(name, F.col(source) - F.col("clim"))
    return out.drop("doy", "clim", "_det") if detrend else out.drop("doy", "clim")
