"""MLlib models run over folds, feature sets and parameter grids.

Every job here fits on a feature table, which is written once (``prepare``) so that many
fits do not repeat the work behind it. Fits of different folds run side by side.
"""

from __future__ import annotations

import ast
import itertools
import random
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from harvestline.functions.metrics import score_columns
from harvestline.functions.quantiles import exact_median
from harvestline.operators.rows import feature_columns, one_hot, select_lead_predictors
from harvestline.plans.partials import sum_arrays
from harvestline.plans.validation import folds_kfold
from harvestline.session import cut_lineage

KEYS = ("region_id", "c_year")
ROWS_PER_TASK = 200_000  # of a fit


def linear(**kw) -> Estimator:
    return LinearRegression(featuresCol="features", labelCol="label", predictionCol="y_pred", **kw)


def lasso(reg: float = 1.0, **kw) -> Estimator:
    return linear(elasticNetParam=1.0, regParam=reg, **kw)


def forest(trees: int = 200, depth: int = 10, seed: int = 42, **kw) -> Estimator:
    return RandomForestRegressor(featuresCol="features", labelCol="label", predictionCol="y_pred", numTrees=trees,
                                 maxDepth=depth, seed=seed, **kw)


def boosted(rounds: int = 100, depth: int = 3, rate: float = 0.1, seed: int = 42, **kw) -> Estimator:
    return GBTRegressor(featuresCol="features", labelCol="label", predictionCol="y_pred", maxIter=rounds, maxDepth=depth,
                        stepSize=rate, seed=seed, **kw)


def prepare(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return cut_lineage(df.select(*cols))


def scaled_fit(estimator: Estimator, features: Sequence[str], impute: bool = True) -> Pipeline:
    """Imputer, scaler and model, all fitted on the training rows only."""
    cols = list(features)
    filled = [f"_f_{c}" for c in cols] if impute else cols
    stages = [Imputer(inputCols=cols, outputCols=filled, strategy="mean")] if impute else []
    stages += [VectorAssembler(inputCols=filled, outputCol="_raw", handleInvalid="error"),
               StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True), estimator]
    return Pipeline(stages=stages)


def fit_predict(df: DataFrame, estimator: Estimator, features: Sequence[str], label: str, train: Column, test: Column,
                keys: Sequence[str] = KEYS) -> DataFrame:
    data = df.withColumn("label", F.col(label).cast("double")).where(F.col("label").isNotNull())
    model = scaled_fit(estimator, features).fit(data.where(train))
    return model.transform(data.where(test)).select(*keys, F.col("label").alias("y_true"), F.col("y_pred").cast("double").alias("y_pred"))


def side_by_side(data: DataFrame) -> int:
    """Fits of a prepared table that run at a time: 4, more if its partitions leave cores idle."""
    cores = data.sparkSession.sparkContext.defaultParallelism
    return max(4, cores // max(1, data.rdd.getNumPartitions()))


def few_tasks(data: DataFrame) -> DataFrame:
    """A prepared table with about ``ROWS_PER_TASK`` rows in a partition, if it has less: a fit is hundreds
    of short stages, whose tasks cost more than their rows. All rows stay; partitions are joined, not shuffled."""
    tasks = -(-data.count() // ROWS_PER_TASK)
    return data.coalesce(max(1, tasks)) if tasks < data.rdd.getNumPartitions() else data


def run_jobs(jobs: Sequence[Callable[[], DataFrame]], parallelism: int = 4) -> list[DataFrame]:
    """Fits side by side; the cluster's scheduler shares the executors between them."""
    if not jobs:
        return []
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    with ThreadPool(processes=min(parallelism, len(jobs))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda j: j()) if spark else (lambda j: j()), jobs)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def plain_least_squares(estimator: Estimator) -> bool:
    """Whether sums of products determine the fit: no penalty, squared error, equal weights."""
    return isinstance(estimator, LinearRegression) and estimator.getRegParam() == 0 and estimator.getFitIntercept() \
        and estimator.getLoss() == "squaredError" and not estimator.isSet("weightCol")


def leave_one_group(df: DataFrame, make: Callable[[], Estimator], sets: Mapping[str, Sequence[str]], label: str = "yield",
                    group: str = "c_year", keys: Sequence[str] = KEYS, groups: Sequence | None = None) -> DataFrame:
    """Out-of-fold predictions of every feature set, one fold per group. Plain least squares take
    their sums for all sets and folds from one scan; only where these leave a fit undetermined,
    the estimator is fitted to the rows."""
    used = sorted({f for s in sets.values() for f in s})
    data = prepare(df, list(dict.fromkeys([*keys, group, label, *used])))
    groups = list(groups) if groups is not None else sorted(r[0] for r in data.select(group).distinct().collect())
    done: dict[tuple, tuple] = leave_one_group_sums(data, sets, used, label, group, groups) if plain_least_squares(make()) else {}

    left = [(n, g) for n in sets for g in groups if (n, g) not in done]
    fitted = few_tasks(data) if left else data

    def job(name: str, g) -> Callable[[], DataFrame]:
        return lambda: fit_predict(fitted, make(), sets[name], label, F.col(group) != g, F.col(group) == g, keys) \
            .withColumns({"setup": F.lit(name), "fold": F.lit(g)})

    frames = run_jobs([job(*x) for x in left], side_by_side(fitted))
    if done:
        kind = data.schema[group].dataType.simpleString()
        models = data.sparkSession.createDataFrame([(g, n, *m) for (n, g), m in done.items()], f"fold {kind}, setup string, _icpt double, _mean array<double>, _beta array<double>")
        value = F.col("_icpt")
        for i, c in enumerate(used):  # a missing value stands for the training mean
            x = F.col(c).cast("double")
            value = value + F.when(x.isNotNull() & ~F.isnan(x), F.col("_beta")[i] * (x - F.col("_mean")[i])).otherwise(0.0)
        rows = data.withColumn("y_true", F.col(label).cast("double")).where(F.col("y_true").isNotNull())
        # group by group, so that a join on few groups does not gather their rows
        of = F.map_from_entries(F.array_agg(F.struct("fold", "_models")))
        by_group = models.groupBy("fold").agg(F.array_agg(F.struct("setup", "_icpt", "_mean", "_beta")).alias("_models")).agg(of).scalar()
        rows = rows.withColumn("_of", by_group).select(*dict.fromkeys([*keys, *used]), "y_true", F.col(group).alias("fold"), F.inline(F.col("_of")[F.col(group)]))
        frames = [rows.select(*keys, "y_true", value.alias("y_pred"), "setup", "fold"), *frames]
    return union_all(frames)


WELL_POSED = 1e-9  # least share of the largest eigenvalue of a correlation matrix that normal equations are solved with


def leave_one_group_sums(data: DataFrame, sets: Mapping[str, Sequence[str]], used: Sequence[str], label: str, group: str, groups: Sequence) -> dict[tuple, tuple]:
    """(set, group): intercept, training means and coefficients (by ``used``, 0 outside the set) of
    least squares over the rows of all other groups, with missing values at the training mean. Left
    out are fits whose columns have no values, do not vary or nearly depend on each other."""
    cols = [*used, label]
    p = len(cols)
    data = data.where(F.col(label).cast("double").isNotNull()).select(group, *[F.col(c).cast("double").alias(c) for c in cols])
    first = data.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in cols]).first()
    shift = np.array([first[c] if first[c] is not None else 0.0 for c in cols])  # keeps the products well conditioned
    place = {g: i for i, g in enumerate(groups)}

    def products(batch: pa.RecordBatch) -> dict:
        of = np.array([place.get(g, -1) for g in batch.column(0).to_pylist()])
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns[1:]]) - shift
        has = ~np.isnan(x)
        x[~has] = 0.0
        has = has.astype("float64")
        at = {g: np.flatnonzero(of == g) for g in np.unique(of)}
        return {int(g): np.stack([x[i].T @ x[i], x[i].T @ has[i], has[i].T @ has[i]]).ravel() for g, i in at.items()}

    # rows of other groups (key -1) train every fold, rows without a group none
    sums = {k: a.reshape(3, p, p) for k, a in sum_arrays(data.where(F.col(group).isNotNull()), products).items()}
    out = {}
    for g, k in place.items():
        others = [a for key, a in sums.items() if key != k]
        if not others:
            continue
        xx, xm, mm = sum(others)
        n = np.diag(mm)
        with np.errstate(all="ignore"):
            mean = np.diag(xm) / n
            scatter = xx - xm * mean - (xm * mean).T + np.outer(mean, mean) * mm
            std = np.sqrt(np.diag(scatter))
        for name, chosen in sets.items():
            at = [used.index(f) for f in chosen]
            if not at or len(set(at)) < len(at) or mm[-1, -1] <= len(at) + 1:
                continue
            d, y = std[at], p - 1
            if not (np.isfinite(scatter[np.ix_([*at, y], [*at, y])]).all() and (n[at] > 0).all() and (d > 1e-9 * (1 + np.abs(shift[at])) * np.sqrt(mm[-1, -1])).all()):
                continue
            corr = scatter[np.ix_(at, at)] / np.outer(d, d)
            low, *_, high = [*np.linalg.eigvalsh(corr), len(at)]
            if low < WELL_POSED * high:
                continue
            beta = np.zeros(p - 1)
            beta[at] = np.linalg.solve(corr, scatter[at, y] / d) / d
            means = np.where(np.isfinite(mean), mean, 0.0) + shift
            out[name, g] = (float(means[y]), means[:-1].tolist(), beta.tolist())
    return out


def holdout(df: DataFrame, estimator: Estimator, features: Sequence[str], test: Column, label: str = "yield",
            keys: Sequence[str] = KEYS) -> DataFrame:
    data = prepare(df, list(dict.fromkeys([*keys, label, *features])))
    return fit_predict(data, estimator, features, label, ~test, test, keys)


def model_lasso(df: DataFrame, features: Sequence[str], test: Column, reg: float = 1.0, **kw) -> DataFrame:
    return holdout(df, lasso(reg), features, test, **kw)


def model_forest(df: DataFrame, features: Sequence[str], test: Column, trees: int = 200, **kw) -> DataFrame:
    """Rows keep the nodes they are in, so that a level of hundreds of trees does not start from the roots."""
    return holdout(df, forest(trees, cacheNodeIds=True), features, test, **kw)


def model_boosted(df: DataFrame, features: Sequence[str], test: Column, rounds: int = 100, **kw) -> DataFrame:
    return holdout(df, boosted(rounds), features, test, **kw)


# Boosting parameters by number of training rows (upper limit, parameters).
SIZE_PARAMS = [
    (100, {"rounds": 100, "depth": 3, "rate": 0.1, "row_share": 0.8, "l1": 1.0, "l2": 1.0}),
    (500, {"rounds": 200, "depth": 4, "rate": 0.1, "row_share": 0.8, "l1": 0.5, "l2": 0.5}),
    (None, {"rounds": 300, "depth": 6, "rate": 0.1, "row_share": 0.9, "l1": 0.1, "l2": 0.1}),
]
# Search grids (upper limit of rows, grid).
SIZE_GRIDS = [
    (200, {"rounds": [100, 200], "depth": [3, 4], "rate": [0.1, 0.2]}),
    (None, {"rounds": [100, 200, 300], "depth": [3, 4, 6], "rate": [0.05, 0.1, 0.2]}),
]


def size_adaptive_params(sizes: DataFrame, n: str = "n_train") -> DataFrame:
    """Boosting parameters for each training size."""
    names = list(SIZE_PARAMS[0][1])
    cols = {}
    for name in names:
        expr = None
        for limit, params in SIZE_PARAMS[:-1]:
            hit = F.col(n) < limit
            expr = F.when(hit, F.lit(params[name])) if expr is None else expr.when(hit, F.lit(params[name]))
        cols[name] = expr.otherwise(F.lit(SIZE_PARAMS[-1][1][name]))
    return sizes.withColumns(cols)


def params_for(n: int, table=None) -> dict:
    for limit, params in table or SIZE_PARAMS:
        if limit is None or n < limit:
            return params
    raise ValueError("no entry for this size")


def _search(df: DataFrame, estimator, maps: Sequence[Mapping], features: Sequence[str], label: str, fold: str, n_folds: int, metric: str) -> DataFrame:
    """Mean score of every parameter map over the given folds, best first. Imputer and scaler are
    fitted once per fold; its settings share the prepared rows, and folds run side by side."""
    data = df.withColumn("label", F.col(label).cast("double")).where(F.col("label").isNotNull())
    sizes = {r[0]: r[1] for r in data.groupBy(fold).count().collect()}
    for i in range(n_folds):
        if not sizes.get(i) or sizes[i] == sum(sizes.values()):
            raise ValueError(f"fold {i} leaves no rows to train on or to score")
    evaluator = RegressionEvaluator(labelCol="label", predictionCol="y_pred", metricName=metric)
    grid = [{estimator.getParam(k): v for k, v in m.items()} for m in maps]
    scores = np.zeros((n_folds, len(maps)))

    def job(i: int, own: Estimator, measure: RegressionEvaluator) -> Callable[[], None]:
        def run() -> None:
            train = data.where(F.col(fold) != i)
            scaler = Pipeline(stages=scaled_fit(own, features).getStages()[:-1]).fit(train)
            ready = [scaler.transform(rows).select("features", "label").persist() for rows in (train, data.where(F.col(fold) == i))]
            for k, params in enumerate(grid):
                scores[i, k] = measure.evaluate(own.fit(ready[0], params).transform(ready[1]))
            for rows in ready:
                rows.unpersist()
        return run

    run_jobs([job(i, estimator.copy(), evaluator.copy()) for i in range(n_folds)], side_by_side(df))
    rows = [(i, str(dict(sorted(m.items()))), float(s)) for i, (m, s) in enumerate(zip(maps, scores.mean(axis=0)))]
    return df.sparkSession.createDataFrame(rows, "setting int, params string, score double").orderBy("score", "setting")


def random_search(df: DataFrame, features: Sequence[str], space: Mapping[str, Sequence], estimator: Estimator | None = None, *,
                  draws: int = 50, folds: int = 20, label: str = "yield", keys: Sequence[str] = KEYS, seed: int = 1,
                  metric: str = "rmse") -> DataFrame:
    """Randomly drawn parameter settings scored by k-fold validation."""
    every = [dict(zip(space, combo)) for combo in itertools.product(*space.values())]
    random.Random(seed).shuffle(every)
    data = prepare(folds_kfold(df, keys, folds, seed), [*keys, label, *features, "fold"])
    return _search(data, estimator or forest(), every[:draws], features, label, "fold", folds, metric)


def grid_search(df: DataFrame, features: Sequence[str], grid: Mapping[str, Sequence], make: Callable[[dict], Estimator], roles: DataFrame, *,
                label: str = "yield", keys: Sequence[str] = KEYS) -> DataFrame:
    """All settings over expanding-window folds (``roles`` has the columns fold and role)."""
    data = prepare(roles, [*keys, label, *features, "fold", "role"])
    n_folds = sorted(r[0] for r in data.select("fold").distinct().collect())
    settings = [dict(zip(grid, combo)) for combo in itertools.product(*grid.values())]

    def job(i: int, s: dict, f: int):
        def run() -> DataFrame:
            part = data.where(F.col("fold") == f)
            pred = fit_predict(part, make(s), features, label, F.col("role") == "train", F.col("role") == "test", keys)
            return pred.agg(score_columns("y_true", "y_pred")["mse"].alias("mse")).withColumn("setting", F.lit(i))
        return run

    scores = union_all(run_jobs([job(i, s, f) for i, s in enumerate(settings) for f in n_folds]))
    names = df.sparkSession.createDataFrame([(i, str(s)) for i, s in enumerate(settings)], "setting int, params string")
    return scores.groupBy("setting").agg(F.avg("mse").alias("score")).join(names, "setting").orderBy("score", "setting")


def cross_val_score(df: DataFrame, make: Callable[[], Estimator], features: Sequence[str], *, folds: int = 5, label: str = "yield",
                    keys: Sequence[str] = KEYS, seed: int = 42) -> DataFrame:
    """Explained variance per fold with the median over folds beside it."""
    split = folds_kfold(df, keys, folds, seed, fold="cv_fold")
    preds = leave_one_group(split, make, {"all": features}, label, "cv_fold", keys, range(folds))
    s = score_columns("y_true", "y_pred")
    scores = preds.groupBy("fold").agg(s["ev"].alias("ev"), s["n"].alias("n"))
    median = exact_median(scores, "ev", [], "median_ev").select("median_ev").scalar()
    return scores.withColumn("median_ev", median)


def forecast_by_lead(df: DataFrame, make: Callable[[], Estimator], leads: Sequence[int] = (1, 2, 3, 4), label: str = "yield",
                     group: str = "c_year", keys: Sequence[str] = KEYS) -> DataFrame:
    """Leave-one-year-out forecasts with the predictors known at each lead, one column per lead."""
    lead_sets = {f"LT{n}": feature_columns(select_lead_predictors(df, [], min_lead=n)) for n in leads}
    long = leave_one_group(df, make, lead_sets, label, group, keys)
    wide = long.groupBy(*keys).pivot("setup", list(lead_sets)).agg(F.max("y_pred"))
    return wide.join(long.groupBy(*keys).agg(F.max("y_true").alias("y_true")), list(keys))


def predictor_set_compare(df: DataFrame, make: Callable[[], Estimator], prefixes: Mapping[str, Sequence[str]], leads: Sequence[int], *,
                          label: str = "yield", group: str = "c_year", keys: Sequence[str] = KEYS) -> DataFrame:
    """Scores of sensor subsets at each lead."""
    sets = {f"{name}|{n}": feature_columns(select_lead_predictors(df, [], min_lead=n, prefixes=p)) for name, p in prefixes.items() for n in leads}
    preds = leave_one_group(df, make, sets, label, group, keys)
    s = score_columns("y_true", "y_pred")
    out = preds.groupBy("setup").agg(s["r2"].alias("r2"), s["rmse"].alias("rmse"), s["n"].alias("n"))
    parts = F.split("setup", r"\|")
    return out.select(parts[0].alias("predictors"), parts[1].cast("int").alias("lead"), "r2", "rmse", "n")


def feature_importance(df: DataFrame, features: Sequence[str], estimator: Estimator | None = None, label: str = "yield") -> DataFrame:
    """Model importances with their rank."""
    data = df.withColumn("label", F.col(label).cast("double")).where(F.col("label").isNotNull())
    model = scaled_fit(estimator or forest(), features).fit(data)
    imp = model.stages[-1].featureImportances.toArray()
    order = sorted(range(len(features)), key=lambda i: (-imp[i], features[i]))
    rows = [(features[i], float(imp[i]), r) for r, i in enumerate(order, 1)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, rank int")


def rfe(df: DataFrame, features: Sequence[str], keep: int = 10, make: Callable[[], Estimator] | None = None, label: str = "yield",
        step: int = 1) -> DataFrame:
    """Recursive elimination: refit, drop the least important, until ``keep`` are left.
    Rank 1 are the kept ones, the first one dropped has the highest rank."""
    data = prepare(df, [label, *features])
    left, dropped = list(features), []
    while len(left) > keep:
        imp = {r["feature"]: r["importance"] for r in feature_importance(data, left, (make or forest)(), label).collect()}
        worst = sorted(left, key=lambda f: (imp[f], f))[: min(step, len(left) - keep)]
        dropped = worst[::-1] + dropped if step == 1 else sorted(worst, key=lambda f: -imp[f]) + dropped
        left = [f for f in left if f not in worst]
    rows = [(f, 1, True) for f in left] + [(f, i + 2, False) for i, f in enumerate(dropped)]
    return df.sparkSession.createDataFrame(rows, "feature string, rank int, selected boolean")


def cross_train(source: DataFrame, target: DataFrame, make: Callable[[], Estimator], features: Sequence[str], label: str = "yield",
                keys: Sequence[str] = KEYS) -> DataFrame:
    """Fit on one scale or country, predict the other, both ways."""
    cols = [*keys, label, *features]
    both = prepare(source.select(*cols).withColumn("_d", F.lit("a")).unionByName(target.select(*cols).withColumn("_d", F.lit("b"))), [*cols, "_d"])
    run = lambda tr, te: (lambda: fit_predict(both, make(), features, label, F.col("_d") == tr, F.col("_d") == te, keys)
                          .withColumn("setup", F.lit(f"{tr}_to_{te}")))
    return union_all(run_jobs([run("a", "b"), run("b", "a")]))


def tuning_compare(df: DataFrame, features: Sequence[str], leads: Sequence[int], *, space: Mapping[str, Sequence], draws: int = 50,
                   folds: int = 20, keep: int = 4, make: Callable[[], Estimator] = forest, label: str = "yield", group: str = "c_year",
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Default model, feature selection, tuning, and both, at each lead. Leads run side by side, and so do a lead's
    selection and its fits on all features; where all are selected, these serve for both."""
    data = prepare(df, list(dict.fromkeys([*keys, group, label, *features])))
    s = score_columns("y_true", "y_pred")

    def scored(lead: int, name: str, cols: Sequence[str], tuned: bool) -> DataFrame:
        params = {}
        if tuned:
            best = random_search(data, cols, space, make(), draws=draws, folds=folds, label=label, keys=keys).first()["params"]
            params = ast.literal_eval(best)
        preds = leave_one_group(data, lambda: make().setParams(**params) if params else make(), {name: cols}, label, group, keys)
        return preds.groupBy("setup").agg(s["ev"].alias("ev"), s["n"].alias("n")).withColumn("lead", F.lit(lead))

    def job(lead: int) -> Callable[[], list[DataFrame]]:
        def run() -> list[DataFrame]:
            known = feature_columns(select_lead_predictors(data, [], min_lead=lead))

            def all_known() -> list[DataFrame]:
                return [scored(lead, "default", known, False), scored(lead, "tuned", known, True)]

            def selected() -> list[DataFrame]:
                chosen = [r[0] for r in rfe(data, known, min(keep, len(known)), make, label=label, step=2).where("selected").select("feature").collect()]
                return [] if chosen == known else [scored(lead, "selected", chosen, False), scored(lead, "both", chosen, True)]

            every, some = run_jobs([all_known, selected], 2 if small else 1)
            return [*every, *(some or [out.withColumn("setup", F.lit(name)) for out, name in zip(every, ("selected", "both"))])]
        return run

    small = side_by_side(data) > 4  # a large table fills the cluster with the fits of one lead
    return union_all([out for found in run_jobs([job(lead) for lead in leads], len(leads) if small else 1) for out in found])


def national_matrix(df: DataFrame, countries: Sequence[str], weather: Sequence[str], country: str = "country") -> tuple[DataFrame, list[str]]:
    """Weather predictors plus one column per country."""
    return one_hot(df, country, countries), [*weather, *[f"is_{c}" for c in countries]]
