"""Scores of predictions as aggregate columns, so any grouping gets them in one pass."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from harvestline.functions.scalars import _c


def score_columns(obs: Column | str, pred: Column | str) -> dict[str, Column]:
    """All scores except the median bias (an exact quantile, see ``quantiles``).
    Pairs with a missing side must be removed before."""
    obs, pred = _c(obs), _c(pred)
    err = pred - obs
    n = F.count(err)
    sse = F.sum(err * err)
    sst = F.var_pop(obs) * n
    rmse = F.sqrt(sse / n)
    return {
        "n": n,
        "mse": sse / n,
        "rmse": rmse,
        "mae": F.avg(F.abs(err)),
        "nrmse": F.try_divide(rmse, F.avg(obs)),
        "mape": F.avg(F.try_divide(F.abs(err), F.abs(obs))),
        "r2": 1 - F.try_divide(sse, sst),
        "ev": 1 - F.try_divide(F.var_pop(err), F.var_pop(obs)),
        "r": pearson(obs, pred),
        "mean_bias": F.avg(err),
    }


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation of the complete pairs, NULL when one side is constant (``corr`` divides
    by zero there, an error in ANSI mode)."""
    x, y = _c(x), _c(y)
    sx, sy = F.stddev_pop(F.when(y.isNotNull(), x)), F.stddev_pop(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_pop(x, y), sx * sy)


def finite(col: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))), col)
