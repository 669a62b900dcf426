"""Harvest calendars and features at lead times before harvest."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from harvestline.operators.timeseries import interpolate_linear

# Reference days (month, day) before which features are taken.
_EARLY_JULY = {"AT": (6, 30), "CZ": (7, 16), "DE": (7, 16), "FR": (7, 11), "HR": (6, 30), "HU": (6, 30),
               "PL": (7, 16), "SI": (7, 16), "SK": (7, 16), "UA": (7, 16)}
_AUTUMN = {c: (9, 30) for c in _EARLY_JULY}
HARVEST_DAYS = {"winter_wheat": _EARLY_JULY, "maize": _AUTUMN, "spring_barley": _EARLY_JULY}


def harvest_days(spark: SparkSession, days: dict | None = None) -> DataFrame:
    rows = [(crop, country, m, d) for crop, by_country in (days or HARVEST_DAYS).items()
            for country, (m, d) in by_country.items()]
    return spark.createDataFrame(rows, "crop string, country string, month int, day int")


def harvest_calendar(days: DataFrame, years: DataFrame, days_before: int = 0, year: str = "c_year") -> DataFrame:
    """Reference date per calendar row and year."""
    all_years = years.agg(F.array_sort(F.collect_set(year))).scalar()
    df = days.withColumn("_ys", all_years).withColumn(year, F.explode("_ys")).drop("_ys")
    return df.withColumn("harvest", F.date_sub(F.make_date(year, "month", "day"), days_before)).drop("month", "day")


def in_season(binned: DataFrame, calendar: DataFrame, keys: Sequence[str], label: str = "label", months: int = 4) -> DataFrame:
    """Bins labelled within ``months`` before the reference date, both ends included, once
    for every season they fall in. The season's year is at most one ahead of the bin's, so
    a bin is sent to two years and meets the calendar in an equi-join."""
    years = F.array(F.year(label), F.year(label) + 1)
    spread = binned.withColumn("c_year", F.explode(years))
    joined = spread.join(calendar, [*keys, "c_year"])
    return joined.where((F.col(label) >= F.add_months("harvest", -months)) & (F.col(label) <= F.col("harvest")))


def pivot_leads(long: DataFrame, keys: Sequence[str], params: Sequence[str], k: int, value: str = "value",
                param: str = "param", lead: str = "lead") -> DataFrame:
    """Wide features ``<param>_LT<k>`` .. ``<param>_LT1`` in one aggregation with a known
    list of columns."""
    picks = [F.max(F.when((F.col(param) == p) & (F.col(lead) == n), F.col(value))).alias(f"{p}_LT{n}")
             for n in range(k, 0, -1) for p in params]
    return long.groupBy(*keys).agg(*picks)


def _numbered(df: DataFrame, by: Sequence[str], label: str, newest_first: bool) -> DataFrame:
    order = F.col(label).desc() if newest_first else F.col(label).asc()
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(order)))


def lead_features_head(seasonal: DataFrame, params: Sequence[str], k: int, keys: Sequence[str] = ("region_id", "c_year"),
                       label: str = "label", value: str = "value") -> DataFrame:
    """First k bins of the season; the oldest is lead k."""
    df = _numbered(seasonal, [*keys, "param"], label, newest_first=False).where(F.col("_n") <= k)
    return pivot_leads(df.withColumn("lead", F.lit(k + 1) - F.col("_n")), keys, params, k, value)


def lead_features_tail(seasonal: DataFrame, params: Sequence[str], k: int, keys: Sequence[str] = ("region_id", "c_year"),
                       label: str = "label", value: str = "value", complete: bool = True) -> DataFrame:
    """Last k bins of the season; the newest is lead 1. Incomplete rows drop out."""
    df = _numbered(seasonal, [*keys, "param"], label, newest_first=True).where(F.col("_n") <= k)
    wide = pivot_leads(df.withColumn("lead", F.col("_n")), keys, params, k, value)
    return wide.dropna() if complete else wide


def lead_features_interp(seasonal: DataFrame, params: Sequence[str], k: int, keys: Sequence[str] = ("region_id", "c_year"),
                         label: str = "label", value: str = "value") -> DataFrame:
    """Last k+1 bins, gaps interpolated, the oldest dropped; ``last_label`` is the date the
    forecast could have been made."""
    by = [*keys, "param"]
    df = _numbered(seasonal, by, label, newest_first=True).where(F.col("_n") <= k + 1)
    df = interpolate_linear(df, by, label, value).where(F.col("_n") <= k).withColumn("lead", F.col("_n"))
    wide = pivot_leads(df, keys, params, k, value)
    last = df.groupBy(*keys).agg(F.max(label).alias("last_label"))
    return wide.join(last, list(keys))


def lead_features_blocks(seasonal: DataFrame, params: Sequence[str], k: int, width: int,
                         keys: Sequence[str] = ("region_id", "c_year"), label: str = "label", value: str = "value") -> DataFrame:
    """Means of blocks of ``width`` weekly bins counted back from harvest (4x4 or 8x2)."""
    df = _numbered(seasonal, [*keys, "param"], label, newest_first=True)
    df = df.withColumn("lead", F.ceil(F.col("_n") / width).cast("int")).where(F.col("lead") <= k)
    blocks = df.groupBy(*keys, "param", "lead").agg(F.avg(value).alias(value))
    return pivot_leads(blocks, keys, params, k, value)


def lag_bin_means(series: DataFrame, calendar: DataFrame, keys: Sequence[str] = ("country",), ts: str = "obs_date",
                  value: str = "value", days: int = 14, k: int = 8, prefix: str = "evi") -> DataFrame:
    """Mean of the values days*(i-1)+1 .. days*i before the reference date of the same
    calendar year, i = 1..k; years with data but none in a bin get NULL."""
    dated = series.withColumn("c_year", F.year(ts)).join(calendar, [*keys, "c_year"])
    before = F.datediff(F.col("harvest"), F.col(ts))
    lag = F.ceil(before / days)
    picks = [F.avg(F.when((lag == i) & (before >= 1), F.col(value))).alias(f"{prefix}_LT{i}") for i in range(1, k + 1)]
    return dated.groupBy(*keys, "c_year").agg(*picks)


def cumulative_leads(df: DataFrame, cols: Sequence[str], compounding: bool = False) -> DataFrame:
    """Running sum over ordered lead columns. ``compounding``: each sum includes the sums
    before it."""
    sums: dict[str, Column] = {}
    total = None
    for i, c in enumerate(cols):
        v = F.coalesce(F.col(c), F.lit(0.0))
        if i == 0:
            sums[c], total = F.col(c), v
        else:
            sums[c] = total + v
            total = total + (sums[c] if compounding else v)
    return df.withColumns(sums)


def latest_and_mean(df: DataFrame, bases: Sequence[str], leads: Sequence[int], keys: Sequence[str],
                    include_latest: bool = True, unchanged_up_to: int = 2) -> DataFrame:
    """Latest month and mean of the months per predictor. With ``unchanged_up_to`` leads or fewer
    (0: never) the features stay as they are."""
    if len(leads) <= unchanged_up_to:
        return df
    newest = min(leads)
    used = [n for n in leads if include_latest or n != newest]
    out = []
    for b in bases:
        vals = F.filter(F.array(*[F.col(f"{b}_LT{n}") for n in used]), lambda v: v.isNotNull())
        mean = F.try_divide(F.aggregate(vals, F.lit(0.0), lambda a, v: a + v), F.size(vals))
        out += [F.col(f"{b}_LT{newest}").alias(f"{b}_latest_month"), mean.alias(f"{b}_mean_before")]
    return df.select(*keys, *out)


def to_sequence(df: DataFrame, bases: Sequence[str], leads: Sequence[int], keys: Sequence[str], first: int | None = None,
                name: str = "seq") -> DataFrame:
    """Features as array<array<double>>: one inner array per step, oldest lead first, cut to
    the first steps if asked."""
    steps = [F.array(*[F.col(f"{b}_LT{n}").cast("double") for b in bases]) for n in sorted(leads, reverse=True)]
    seq = F.array(*steps)
    return df.select(*keys, (F.slice(seq, 1, first) if first else seq).alias(name))
