"""Row filters, column selectors, imputation and scaling of feature tables."""

from __future__ import annotations

import re
from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from harvestline.functions.quantiles import attach, exact_quantiles
from harvestline.functions.scalars import LEAD_PATTERN, is_cropland

# Predictors that come from Earth observation; all others are weather.
EO_PREDICTORS = ("evi", "sm", "vodca")


def iqr_outliers(df: DataFrame, by: Sequence[str], value: str = "value", constant: float = 2.0,
                 min_valid: int = 6, fill: float | None = None) -> DataFrame:
    """Values outside [Q1-k*IQR, Q3+k*IQR] of their group become ``fill``; groups with
    fewer than ``min_valid`` values are left as they are."""
    fences = exact_quantiles(df, value, {"_q1": 0.25, "_q3": 0.75}, by).withColumnRenamed("n", "_n")
    iqr = (F.col("_q3") - F.col("_q1")) * constant
    keep = F.col(value).between(F.col("_q1") - iqr, F.col("_q3") + iqr) | (F.col("_n") < min_valid)
    cleaned = F.when(keep, F.col(value)).otherwise(F.lit(fill).cast("double"))
    return attach(df, fences, by).withColumn(value, cleaned).drop("_q1", "_q3", "_n")


def upper_sigma_outliers(df: DataFrame, by: Sequence[str], value: str = "value", k_sigma: float = 1.0,
                         flag: str = "outlier") -> DataFrame:
    """Flags v > mean + k*sigma (population sigma); missing values are flagged too."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    outlier = F.col(value).isNull() | (F.col(value) > F.col("_m") + F.lit(k_sigma) * F.col("_s"))
    return attach(df, stats, by).withColumn(flag, F.coalesce(outlier, F.lit(True))).drop("_m", "_s")


def cropland_share(df: DataFrame, by: Sequence[str], land_class: str) -> DataFrame:
    mask = is_cropland(land_class)
    return df.groupBy(*by).agg(F.count_if(mask).alias("n_cropland"), F.count(F.lit(1)).alias("n_pixels"),
                               F.avg(mask.cast("int")).alias("share"))


def drop_null_rows(df: DataFrame, how: str = "any", subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how=how, subset=list(subset) if subset else None)


def drop_columns_by_prefix(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefixes)])


def rename_prefix(df: DataFrame, prefix: str, cols: Sequence[str], strip_suffix: str = "") -> DataFrame:
    def new(c: str) -> str:
        return prefix + (c[: -len(strip_suffix)] if strip_suffix and c.endswith(strip_suffix) else c)

    return df.withColumnsRenamed({c: new(c) for c in cols})


def feature_columns(df: DataFrame) -> list[str]:
    """Predictor columns: the ones named ``<base>_LT<lead>``."""
    return [c for c in df.columns if re.search(LEAD_PATTERN, c)]


def select_lead_predictors(df: DataFrame, keys: Sequence[str], min_lead: int | None = None,
                           lead: int | None = None, prefixes: Sequence[str] = ()) -> DataFrame:
    """Keys + predictors known at a lead time (``min_lead``), of one lead, or by prefix."""
    def wanted(c: str) -> bool:
        n = int(re.search(LEAD_PATTERN, c).group(1))
        return ((min_lead is None or n >= min_lead) and (lead is None or n == lead)
                and (not prefixes or c.startswith(tuple(prefixes))))

    return df.select(*keys, *[c for c in feature_columns(df) if wanted(c)])


def feature_groups(features: Sequence[str], eo: Sequence[str] = EO_PREDICTORS) -> dict[str, list[str]]:
    """Feature sets of the forecasts: all, Earth observation only, weather only."""
    is_eo = {f: any(e in f.lower() for e in eo) for f in features}
    return {"full": list(features), "eo": [f for f in features if is_eo[f]],
            "meteo": [f for f in features if not is_eo[f]]}


def feature_type(feature: Column, eo: Sequence[str] = EO_PREDICTORS) -> Column:
    hit = reduce(lambda a, b: a | b, [F.lower(feature).contains(e) for e in eo])
    return F.when(hit, "eo").otherwise("meteo")


def feature_dimension(df: DataFrame) -> DataFrame:
    """One row per predictor that occurs in a table: base name, lead, type, non-null count."""
    from harvestline.functions.scalars import base_of, lead_of

    names = feature_columns(df)
    counts = df.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "feature", "n_values")
    return counts.withColumns({"base": base_of("feature"), "lead": lead_of("feature"),
                               "feature_type": feature_type(F.col("feature"))})


def filter_crop_year(df: DataFrame, *, crop: str | None = None, country: str | None = None,
                     after_year: int | None = None, farm: str | None = None, crop_col: str = "crop",
                     country_col: str = "country", year_col: str = "c_year", farm_col: str = "farm_code") -> DataFrame:
    tests = [(crop_col, crop), (country_col, country), (farm_col, farm)]
    for col, wanted in tests:
        if wanted is not None:
            df = df.where(F.col(col) == wanted)
    return df if after_year is None else df.where(F.col(year_col) > after_year)


def exclude_region(df: DataFrame, region: str, excluded: Sequence[str]) -> DataFrame:
    return df.where(~F.col(region).isin(list(excluded)))


def one_hot(df: DataFrame, col: str, values: Sequence[str], prefix: str = "is_") -> DataFrame:
    return df.withColumns({f"{prefix}{v}": (F.col(col) == v).cast("int") for v in values})


def impute_scalar_mean(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str]) -> list[DataFrame]:
    """Missing features become one mean over the whole training matrix."""
    filled = [F.coalesce(F.col(c), F.lit(0.0)) for c in cols]
    present = [F.col(c).isNotNull().cast("long") for c in cols]
    total = reduce(lambda a, b: a + b, filled)
    number = reduce(lambda a, b: a + b, present)
    mean = train.agg(F.try_divide(F.sum(total), F.sum(number)).alias("m")).scalar()
    out = []
    for df in [train, *others]:
        df = df.withColumn("_mean", mean)
        out.append(df.withColumns({c: F.coalesce(F.col(c), F.col("_mean")) for c in cols}).drop("_mean"))
    return out


def impute_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.fillna(0.0, subset=list(cols))


def fit_standard(train: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population sigma of every column, as one row (per group)."""
    aggs = [f(c).alias(f"{p}{c}") for c in cols for f, p in ((F.avg, "_m_"), (F.stddev_pop, "_s_"))]
    return train.groupBy(*by).agg(*aggs)


def standardize(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str],
                by: Sequence[str] = ()) -> list[DataFrame]:
    """z-scores with parameters of the training rows only; a constant column becomes 0."""
    params = fit_standard(train, cols, by)
    sigma = lambda c: F.when(F.col("_s_" + c) == 0, 1.0).otherwise(F.col("_s_" + c))
    out = []
    for df in [train, *others]:
        both = attach(df, params, by)
        out.append(both.withColumns({c: (F.col(c) - F.col("_m_" + c)) / sigma(c) for c in cols})
                   .select(*df.columns))
    return out


def unstandardize(df: DataFrame, train: DataFrame, scaled: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Scaled values back to units; ``scaled`` maps a column to the training column that
    defines its scale."""
    params = fit_standard(train, sorted(set(scaled.values())), by)
    sigma = lambda c: F.when(F.col("_s_" + c) == 0, 1.0).otherwise(F.col("_s_" + c))
    both = attach(df, params, by)
    return both.withColumns({c: F.col(c) * sigma(src) + F.col("_m_" + src) for c, src in scaled.items()}) \
        .select(*df.columns)


def minmax_scale(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str],
                 by: Sequence[str] = ()) -> list[DataFrame]:
    aggs = [f(c).alias(f"{p}{c}") for c in cols for f, p in ((F.min, "_lo_"), (F.max, "_hi_"))]
    params = train.groupBy(*by).agg(*aggs)
    out = []
    for df in [train, *others]:
        both = attach(df, params, by)
        scaled = {c: F.when(F.col(c).isNotNull(), F.coalesce(
            F.try_divide(F.col(c) - F.col("_lo_" + c), F.col("_hi_" + c) - F.col("_lo_" + c)), F.lit(0.0))) for c in cols}
        out.append(both.withColumns(scaled).select(*df.columns))
    return out


def scale_sequence(df: DataFrame, seq: str, train_flag: Column | None = None, per_step: bool = False) -> DataFrame:
    """Scales ``array<array<double>>`` (step x predictor). Default: z-score per predictor
    over all rows and steps. ``per_step``: min-max per (step, predictor). Parameters come
    from rows where ``train_flag`` holds, and return as one small array of structs."""
    train = df if train_flag is None else df.where(train_flag)
    cells = (train.select(F.posexplode(seq).alias("step", "_vec"))
             .select("step", F.posexplode("_vec").alias("pred", "v")))
    keys = ["step", "pred"] if per_step else ["pred"]
    if per_step:
        params = cells.groupBy(*keys).agg(F.min("v").alias("shift"), (F.max("v") - F.min("v")).alias("scale"))
    else:
        params = cells.groupBy(*keys).agg(F.avg("v").alias("shift"), F.stddev_pop("v").alias("scale"))
    scale = F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale"))
    key = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    packed = params.agg(F.map_from_entries(F.collect_list(F.struct(key, F.struct("shift", scale.alias("scale"))))))
    df = df.withColumn("_params", packed.scalar())

    def cell(v: Column, step: Column, pred: Column) -> Column:
        name = F.concat_ws(":", step.cast("string"), pred.cast("string")) if per_step else pred.cast("string")
        p = F.try_element_at(F.col("_params"), name)
        return (v - p["shift"]) / p["scale"]

    scaled = F.transform(F.col(seq), lambda vec, step: F.transform(vec, lambda v, pred: cell(v, step, pred)))
    return df.withColumn(seq, scaled).drop("_params")


def add_year_feature(df: DataFrame, leads: int = 8, year: str = "c_year") -> DataFrame:
    return df.withColumns({f"year_LT{i}": F.col(year) for i in range(1, leads + 1)})


def json_report(df: DataFrame, by: Sequence[str], fields: Sequence[str], name: str = "report") -> DataFrame:
    """Nested report as one JSON text per group row."""
    return df.select(*by, F.to_json(F.struct(*fields)).alias(name))


def json_list(col: Column | str, element: str = "double") -> Column:
    return F.from_json(F.col(col) if isinstance(col, str) else col, f"array<{element}>")
