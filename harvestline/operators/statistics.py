"""Correlations, tests, spatial autocorrelation and density curves."""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from harvestline.functions.metrics import pearson
from harvestline.functions.quantiles import attach, exact_quantiles
from harvestline.functions.ranking import hash_rank, null_safe_join, packed, with_bucket
from harvestline.session import cut_lineage


def average_rank(df: DataFrame, value: str, by: Sequence[str], rank: str) -> DataFrame:
    """Rank with ties averaged. Ranks are built on (value, count) rows per bucket, then
    joined to the rows on group and value."""
    counts = df.groupBy(packed(by).alias("_g"), value).agg(F.count(F.lit(1)).alias("_n"))
    counts = with_bucket(counts, F.col(value), grouped=bool(by))
    coarse = counts.groupBy("_g", "_bucket").agg(F.sum("_n").alias("_bn"))
    coarse = coarse.withColumn("_base", F.sum("_bn").over(W.partitionBy("_g").orderBy("_bucket")) - F.col("_bn")).drop("_bn")
    upto = F.sum("_n").over(W.partitionBy("_g", "_bucket").orderBy(value))
    ranked = counts.join(coarse, ["_g", "_bucket"]).select(
        "_g", value, (F.col("_base") + upto - (F.col("_n") - 1) / 2.0).alias(rank))
    return df.withColumn("_g", packed(by)).join(ranked, ["_g", value]).drop("_g")


def spearman_ci(df: DataFrame, target: str, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of the target with every feature and its 95 % Fisher band. The rows are
    written once, as both ranks and their buckets read them."""
    keys = [*by, "feature"]
    rows = cut_lineage(df.select(*dict.fromkeys([*by, target, *features])))
    long = (rows.unpivot([*by, target], list(features), "feature", "x").withColumnRenamed(target, "_y")
            .where("x is not null and _y is not null"))
    ranked = average_rank(average_rank(long, "x", keys, "_rx"), "_y", keys, "_ry")
    out = ranked.groupBy(*keys).agg(pearson("_rx", "_ry").alias("r"), F.count(F.lit(1)).alias("n"))
    delta = F.when(F.col("n") > 3, F.lit(1.96) / F.sqrt(F.col("n") - 3))
    band = lambda sign: F.when(F.abs("r") < 1, F.tanh(F.atanh("r") + delta * sign))
    out = out.withColumns({"lo": band(-1), "hi": band(1)})
    return out.withColumn("width", F.col("hi") - F.col("lo"))


def pearson_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Lower triangle of the correlation matrix, one row per pair, from one scan."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[:i]]
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), pearson(a, b).alias("r"))
                           for a, b in pairs]).alias("_c"))
    return one.select(F.inline("_c"))


def student_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p of Student's t by the continued fraction of the incomplete beta
    function (the built-in functions have no t distribution)."""
    from math import lgamma

    def one(tv: float, v: float) -> float:
        if not np.isfinite(tv) or v <= 0:
            return np.nan
        x, a, b = v / (v + tv * tv), v / 2.0, 0.5
        if x in (0.0, 1.0):
            return x
        flip = x > (a + 1) / (a + b + 2)
        if flip:
            a, b, x = b, a, 1 - x
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
        c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                        -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 / (1 + num * d)
                c = 1 + num / c
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return 1 - front * h if flip else front * h

    return pd.Series([one(a, b) for a, b in zip(t, dof)], dtype="float64")


def ttest_groups(df: DataFrame, value: str, group: str, by: Sequence[str] = (), with_p: bool = False) -> DataFrame:
    """Equal-variance t-test of each group's rows against all other rows."""
    x = F.col(value)
    part = df.where(x.isNotNull()).groupBy(*by, group).agg(
        F.count(x).alias("n1"), F.avg(x).alias("m1"), F.var_pop(x).alias("v1"))
    all_ = df.where(x.isNotNull()).groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    s = attach(part, all_, by).withColumn("n0", F.col("n") - F.col("n1")).where("n0 > 0")
    s = s.withColumn("m0", (F.col("n") * F.col("m") - F.col("n1") * F.col("m1")) / F.col("n0"))
    # total sum of squares = within both parts + between the means
    between = F.col("n1") * F.col("n0") / F.col("n") * F.pow(F.col("m1") - F.col("m0"), 2)
    s = s.withColumn("dof", F.col("n") - 2)
    pooled = F.try_divide(F.col("n") * F.col("v") - between, F.col("dof"))
    t = F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n0"))))
    out = s.withColumn("t", t).select(*by, group, "n1", "n0", "t", "dof")
    if with_p:
        p = F.pandas_udf(student_p, T.DoubleType())
        out = out.withColumn("p", p("t", F.col("dof").cast("double")))
    return out


def morans_i(values: DataFrame, edges: DataFrame, id_col: str = "region_id", value: str = "value",
             by: Sequence[str] = ()) -> DataFrame:
    """Moran's I over a row-standardised neighbour list: n/s0 * sum(z * mean z of neighbours) / sum z^2."""
    by = list(by)
    stats = values.groupBy(*by).agg(F.avg(value).alias("_m"))
    z = attach(values, stats, by).select(*by, F.col(id_col).alias("_id"), (F.col(value) - F.col("_m")).alias("_z"))
    return _moran(z, edges, by)


def _moran(z: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    neighbour = z.select(*by, F.col("_id").alias("dst"), F.col("_z").alias("_zn"))
    lag = edges.join(neighbour, "dst").groupBy(*by, F.col("src").alias("_id")).agg(F.avg("_zn").alias("_lag"))
    full = z.join(lag, [*by, "_id"], "left")
    # weights are standardised over the neighbours with a value, so s0 counts their regions
    top = F.sum(F.col("_z") * F.col("_lag"))
    return full.groupBy(*by).agg(
        (F.count(F.lit(1)) / F.count("_lag") * F.try_divide(top, F.sum(F.col("_z") * F.col("_z")))).alias("i"),
        F.count(F.lit(1)).alias("n"))


def morans_p(values: DataFrame, edges: DataFrame, permutations: int = 99, seed: int = 42,
             id_col: str = "region_id", value: str = "value") -> DataFrame:
    """Pseudo p by permutation. Each permutation deals the values out anew by the rank of a
    seeded hash; all permutations run in one job."""
    observed = morans_i(values, edges, id_col, value)
    mean = values.agg(F.avg(value)).scalar()
    z = values.select(F.col(id_col).alias("_id"), F.col(value).alias("_v")).withColumn("_m", mean)
    z = hash_rank(z.select("_id", (F.col("_v") - F.col("_m")).alias("_z")), ["_id"], "deal", rank="_k")
    copies = z.select("_id", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm"))
    dealt = hash_rank(copies, ["_id", "perm"], seed, by=["perm"], rank="_k").join(z.select("_k", "_z"), "_k")
    sims = _moran(dealt.select("perm", "_id", "_z"), edges, ["perm"]).withColumn("_obs", observed.select("i").scalar())
    larger = F.count_if(F.col("i") >= F.col("_obs"))
    folded = F.least(larger, F.lit(permutations) - larger)
    return sims.groupBy().agg(F.max("_obs").alias("i"), ((folded + 1) / F.lit(permutations + 1.0)).alias("p_sim"))


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Five-number summary and count: the data behind a box plot."""
    return exact_quantiles(df, value, {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}, by)


def kde_curve(df: DataFrame, value: str, by: Sequence[str], points: int = 50, cut: float = 3.0) -> DataFrame:
    """Gaussian density with Scott's bandwidth on a regular grid per group. Equal values are
    counted first; a task adds up all points of the grid side by side, so that it sends one row
    per group to the shuffle, whatever the number of values."""
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    stats = df.groupBy(*by).agg(F.count(value).alias("_n"), F.stddev_samp(value).alias("_s"),
                                F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    bw = F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    stats = stats.withColumn("_h", bw).where("_h > 0")
    start, stop = F.col("_lo") - cut * F.col("_h"), F.col("_hi") + cut * F.col("_h")
    stats = stats.withColumns({"_x0": start, "_dx": (stop - start) / (points - 1)})
    at = lambda k: F.col("_x0") + k * F.col("_dx")
    u = lambda k: (at(k) - F.col("_v")) / F.col("_h")
    sums = [F.sum(F.col("_c") * F.exp(u(k) * u(k) * -0.5)).alias(f"_{k}") for k in range(points)]
    grid = null_safe_join(counts, stats, by).groupBy(*by).agg(*[F.max(c).alias(c) for c in ("_n", "_h", "_x0", "_dx")], *sums)
    scale = F.col("_n") * F.col("_h") * F.lit(float(np.sqrt(2 * np.pi)))
    long = grid.select(*by, "_x0", "_dx", scale.alias("_scale"), F.posexplode(F.array(*[f"_{k}" for k in range(points)])).alias("point", "_sum"))
    return long.select(*by, "point", at(F.col("point")).alias("x"), (F.col("_sum") / F.col("_scale")).alias("density"))
