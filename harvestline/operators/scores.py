"""Scores of forecasts and reports over them."""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from harvestline.functions.metrics import pearson, score_columns
from harvestline.functions.quantiles import attach, exact_median
from harvestline.functions.ranking import null_safe_join, salt
from harvestline.functions.scalars import base_of, lead_of, recode
from harvestline.operators.rows import feature_type
from harvestline.operators.sampling import top_k_per_group


def _complete(df: DataFrame, obs: str, pred: str) -> DataFrame:
    return df.where(F.col(obs).isNotNull() & F.col(pred).isNotNull())


def regression_metrics(df: DataFrame, obs: str = "y_true", pred: str = "y_pred", by: Sequence[str] = ("setup",),
                       median_bias: bool = True, custom: Mapping[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Every score per group. One aggregation; the exact median of the bias adds a second
    small pass and can be left out. ``custom`` adds own scores: functions of the observed
    and predicted column that return an aggregate."""
    pairs = _complete(df, obs, pred)
    scores = score_columns(obs, pred) | {n: f(F.col(obs), F.col(pred)) for n, f in (custom or {}).items()}
    out = pairs.groupBy(*by).agg(*[c.alias(n) for n, c in scores.items()])
    if not median_bias:
        return out
    bias = exact_median(pairs.select(*by, (F.col(pred) - F.col(obs)).alias("_e")), "_e", by, "med_bias").drop("n")
    return null_safe_join(out, bias, list(by))


def metrics_by_setup(wide: DataFrame, keys: Sequence[str], setups: Sequence[str], obs: str = "observed", min_n: int = 2) -> DataFrame:
    """R2 and n per key and setup of a wide prediction table, pairs with a gap removed."""
    long = wide.unpivot([*keys, obs], list(setups), "setup", "y_pred")
    pairs = _complete(long, obs, "y_pred")
    cols = score_columns(obs, "y_pred")
    return pairs.groupBy(*keys, "setup").agg(cols["r2"].alias("r2"), cols["n"].alias("n")).where(F.col("n") >= min_n)


def cv_summary(scores: DataFrame, by: Sequence[str], metrics: Sequence[str], sample_std: bool = False) -> DataFrame:
    """Mean and spread over folds, and their number."""
    std = F.stddev_samp if sample_std else F.stddev_pop
    aggs = [f(m).alias(f"{m}_{p}") for m in metrics for f, p in ((F.avg, "mean"), (std, "std"))]
    return scores.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("n_folds"))


def setup_leaderboard(scores: DataFrame, metric: str = "rmse") -> DataFrame:
    """Setups, feature types and training modes ranked by mean score, in one pass over
    grouping sets."""
    setup, kind, mode = F.col("setup"), F.col("feature_type"), F.col("mode")
    df = scores.groupingSets([[setup], [kind], [mode]], setup, kind, mode).agg(
        F.avg(metric).alias("mean_score"), F.stddev_pop(metric).alias("std_score"), F.count(metric).alias("n"))
    level = F.when(setup.isNotNull(), "setup").when(kind.isNotNull(), "feature_type").otherwise("mode")
    df = df.select(level.alias("level"), F.coalesce(setup, kind, mode).alias("name"), "mean_score", "std_score", "n")
    w = W.partitionBy("level").orderBy("mean_score", "name")
    return df.withColumn("rank", F.row_number().over(w))


def country_year_score(preds: DataFrame, keys: Sequence[str] = ("setup", "country"), year: str = "year") -> DataFrame:
    """Mean over years of the per-year NRMSE and explained variance."""
    s = score_columns("y_true", "y_pred")
    per = _complete(preds, "y_true", "y_pred").groupBy(*keys, year).agg(s["nrmse"].alias("nrmse"), s["ev"].alias("ev"))
    return per.groupBy(*keys).agg(F.avg("nrmse").alias("nrmse"), F.avg("ev").alias("ev"), F.count(F.lit(1)).alias("n_years"))


def yearly_means(preds: DataFrame, keys: Sequence[str] = ("setup",), year: str = "year") -> DataFrame:
    """Per-year mean and spread of observation and forecast."""
    return _complete(preds, "y_true", "y_pred").groupBy(*keys, year).agg(
        F.avg("y_true").alias("obs_mean"), F.stddev_pop("y_true").alias("obs_std"),
        F.avg("y_pred").alias("pred_mean"), F.stddev_pop("y_pred").alias("pred_std"), F.count(F.lit(1)).alias("n"))


def yearly_mean_score(preds: DataFrame, keys: Sequence[str] = ("setup",), year: str = "year") -> DataFrame:
    """R2 of the yearly means."""
    s = score_columns("obs_mean", "pred_mean")
    return yearly_means(preds, keys, year).groupBy(*keys).agg(s["r2"].alias("r2"), s["n"].alias("n_years"))


def yearly_rmse_band(preds: DataFrame, keys: Sequence[str] = ("setup", "year")) -> DataFrame:
    """Every forecast with a band of +- the year's RMSE."""
    s = score_columns("y_true", "y_pred")
    band = _complete(preds, "y_true", "y_pred").groupBy(*keys).agg(s["rmse"].alias("rmse"))
    out = attach(preds, band, keys)
    return out.withColumns({"lower": F.col("y_pred") - F.col("rmse"), "upper": F.col("y_pred") + F.col("rmse")})


def sample_fraction_curve(scores: DataFrame, fraction: str = "fraction", score: str = "score", crop: str | None = "crop") -> DataFrame:
    """Median, mean and spread of the score per sample fraction, relative to the crop mean
    where a crop column is given. A crop meets its mean in parts: there are few crops."""
    df = scores
    if crop:
        df = df.withColumn("_part", salt(fraction, score))
        whole = W.partitionBy(crop)  # at most SALTS rows
        means = df.groupBy(crop, "_part").agg(F.sum(score).alias("_s"), F.count(score).alias("_n"))
        means = means.select(crop, "_part", F.try_divide(F.sum("_s").over(whole), F.sum("_n").over(whole)).alias("_m"))
        df = attach(df, means, [crop, "_part"]).withColumn(score, F.try_divide(F.col(score), F.col("_m"))).drop("_m", "_part")
    stats = df.groupBy(fraction).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    return exact_median(df, score, [fraction]).join(stats, fraction)


def run_delta(run_a: DataFrame, run_b: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Score of run b minus run a, cell by cell."""
    b = run_b.select(*keys, F.col(score).alias("_b"))
    return run_a.join(b, list(keys)).select(*keys, (F.col("_b") - F.col(score)).alias("delta"))


def score_by_year_long(wide: DataFrame, keys: Sequence[str], setups: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    """Per-year scores as long rows with display names."""
    long = wide.unpivot(list(keys), list(setups), "setup", "score")
    return long.withColumn("setup", recode("setup", names))


def value_range(df: DataFrame, obs: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.least(F.min(obs), F.min(pred)).alias("lo"), F.greatest(F.max(obs), F.max(pred)).alias("hi"))


def setup_year_matrix(scores: DataFrame, years: Sequence[int], metric: str = "rmse", by: Sequence[str] = ("setup",),
                      year: str = "year") -> DataFrame:
    picks = [F.avg(F.when(F.col(year) == y, F.col(metric))).alias(str(y)) for y in years]
    return scores.groupBy(*by).agg(*picks, F.avg(metric).alias("mean"))


def pooled_r2(preds: DataFrame, by: Sequence[str] = ("setup",), year: int | None = None) -> DataFrame:
    df = preds if year is None else preds.where(F.col("year") == year)
    s = score_columns("y_true", "y_pred")
    return _complete(df, "y_true", "y_pred").groupBy(*by).agg(s["r2"].alias("r2"), s["n"].alias("n"))


def confusion_matrix(df: DataFrame, labels: Sequence, truth: str = "label", pred: str = "prediction") -> DataFrame:
    cells = [F.count_if(F.col(pred) == v).alias(f"pred_{v}") for v in labels]
    return df.groupBy(truth).agg(*cells)


def class_report(df: DataFrame, truth: str = "label", pred: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class. Truth and prediction enter as two
    counted rows per observation, so no self-join is needed."""
    sides = F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")),
                    F.struct(F.col(pred).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    hit = (F.col(truth) == F.col(pred)).cast("int")
    rows = df.select(hit.alias("_hit"), F.explode(sides).alias("_s")).select("_hit", "_s.*")
    s = rows.groupBy("label").agg(F.sum(F.col("_hit") * F.col("t")).alias("tp"), F.sum("t").alias("support"), F.sum("p").alias("n_pred"))
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("n_pred")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(precision * recall * 2, precision + recall), F.lit(0.0))
    return s.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


# --- importances ---------------------------------------------------------------------

def importance_stability(imp: DataFrame, k: int, feature: str = "feature", value: str = "importance") -> DataFrame:
    """Spread over folds relative to the mean, for the k most important features."""
    s = imp.groupBy(feature).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    s = s.withColumn("instability", F.try_divide(F.col("std"), F.abs("mean")))
    return s.orderBy(F.desc("mean"), feature).limit(k)


def importance_top_by_year(imp: DataFrame, k: int = 15, year: str = "year") -> DataFrame:
    order = [F.desc("base_mean"), F.col("feature")]
    return top_k_per_group(imp, [year], k, order).select(year, "feature", "base_mean", "finetuned_mean", "rank")


def importance_by_group(imp: DataFrame) -> DataFrame:
    """Mean and spread by predictor type, by lead and by base predictor, in one pass."""
    df = imp.withColumns({"feature_type": feature_type(F.col("feature")), "lead": lead_of("feature").cast("string"),
                          "base": base_of("feature"), "change": F.col("finetuned_mean") - F.col("base_mean")})
    kind, lead, base = F.col("feature_type"), F.col("lead"), F.col("base")
    aggs = [f(c).alias(f"{c}_{p}") for c in ("base_mean", "finetuned_mean", "change") for f, p in ((F.avg, "avg"), (F.stddev_pop, "std"))]
    out = df.groupingSets([[kind], [lead], [base]], kind, lead, base).agg(*aggs)
    level = F.when(kind.isNotNull(), "type").when(lead.isNotNull(), "lead").otherwise("base")
    return out.select(level.alias("level"), F.coalesce(kind, lead, base).alias("name"), *[f"{c}_{p}" for c in ("base_mean", "finetuned_mean", "change") for p in ("avg", "std")])


def importance_topk_normalized(imp: DataFrame, k: int = 7) -> DataFrame:
    """Mean over years, the k largest by fine-tuned importance as shares of their sum."""
    means = imp.groupBy("feature").agg(F.avg("base_mean").alias("base"), F.avg("finetuned_mean").alias("finetuned"))
    top = means.orderBy(F.desc("finetuned"), "feature").limit(k)
    whole = W.partitionBy(F.lit(1))  # k rows
    return top.select("feature", (F.col("base") / F.sum("base").over(whole)).alias("base_share"),
                      (F.col("finetuned") / F.sum("finetuned").over(whole)).alias("finetuned_share"))


def importance_change_top(imp: DataFrame, k: int = 20) -> DataFrame:
    """The k features whose importance changed most by fine-tuning."""
    change = F.col("finetuned_mean") - F.col("base_mean")
    s = imp.groupBy("feature").agg(F.avg(change).alias("mean_change"), F.stddev_pop(change).alias("std_change"))
    return s.orderBy(F.desc(F.abs("mean_change")), "feature").limit(k)


def importance_agreement(imp: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return imp.groupBy(*by).agg(pearson("base_mean", "finetuned_mean").alias("r"))


def importance_rank_change(imp: DataFrame, k: int = 3, by: Sequence[str] = ("year",)) -> DataFrame:
    """Rank before and after fine-tuning, matched by feature, and the k largest rises and falls."""
    by = list(by)
    ranked = lambda c: F.rank().over(W.partitionBy(*by).orderBy(F.desc(c)))
    df = imp.withColumns({"rank_base": ranked("base_mean"), "rank_finetuned": ranked("finetuned_mean"),
                          "change": F.col("finetuned_mean") - F.col("base_mean")})
    df = df.withColumn("rank_change", F.col("rank_base") - F.col("rank_finetuned"))
    order = lambda c: F.row_number().over(W.partitionBy(*by).orderBy(c, "feature"))
    df = df.withColumns({"_up": order(F.desc("change")), "_down": order(F.asc("change"))})
    extreme = F.when(F.col("_up") <= k, "rise").when(F.col("_down") <= k, "fall").otherwise("middle")
    return df.select(*by, "feature", "rank_base", "rank_finetuned", "rank_change", "change", extreme.alias("extreme"))


def hp_leaderboard(runs: DataFrame, params: Sequence[str], score: str, k: int = 3, default: Mapping | None = None) -> DataFrame:
    """The k best settings by mean score over years, best first; ``default`` where there is no run."""
    means = runs.groupBy(*params).agg(F.avg(score).alias("mean_score"), F.count(score).alias("n_runs"))
    best = means.where("mean_score is not null").orderBy(F.desc("mean_score"), *params).limit(k)
    best = best.withColumn("place", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("mean_score"), *params)))
    if default is None:
        return best
    one: list[Column] = [F.lit(default[p]).cast(means.schema[p].dataType).alias(p) for p in params]
    spare = runs.agg(F.count(score).alias("_n")).where("_n = 0").select(
        *one, F.lit(None).cast("double").alias("mean_score"), F.lit(0).cast("long").alias("n_runs"), F.lit(1).alias("place"))
    return best.unionByName(spare)
