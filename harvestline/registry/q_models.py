"""Folds, roles, models, transfer and importances."""

from pyspark.sql import functions as F

from harvestline.functions.scalars import admin_key
from harvestline.operators.rows import feature_groups
from harvestline.operators.scores import class_report, regression_metrics
from harvestline.plans import boosting as B, classify, explain, flagship, linear as LM, mlp, transfer as X, trees as M, validation as V
from harvestline.registry.base import query
from harvestline.registry.q_series import PARAMS, TAIL_SQL, calendar
from harvestline.registry.views import FEATURES, Views

KEYS = ["region_id", "c_year"]
TARGET = "03"  # the country that is forecast; all others are sources
TREE_GUARDS = {"target_only": {"train": 5, "test": 1}, "all": {"train": 20, "test": 1}}
ROW_ID = "md5(region_id || '_' || CAST(c_year AS VARCHAR) || '_{seed}')"


def table(v: Views):
    return v.features.withColumn("country", admin_key("region_id"))


def last_year():
    return F.col("c_year") == 2001


# --- folds and roles -----------------------------------------------------------------

@query("split_random", "region_id c_year:i role", f"""SELECT region_id, c_year, CASE WHEN rn <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS role FROM
        (SELECT *, row_number() OVER (ORDER BY {ROW_ID.format(seed=42)}) AS rn, count(*) OVER () AS n FROM panel1)""", "panel1")
def _(v: Views):
    return V.split_random(v.panel1, KEYS)


@query("split_nested", "role n:l", """SELECT 'test' AS role, CAST(floor(n * 0.2 + 0.5) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM panel1) UNION ALL
        SELECT 'valid', CAST(floor((n - floor(n * 0.2 + 0.5)) * 0.2 + 0.5) AS BIGINT) FROM (SELECT count(*) AS n FROM panel1) UNION ALL
        SELECT 'train', CAST(n - floor(n * 0.2 + 0.5) - floor((n - floor(n * 0.2 + 0.5)) * 0.2 + 0.5) AS BIGINT) FROM (SELECT count(*) AS n FROM panel1)""", "panel1")
def _(v: Views):
    return V.split_nested(v.panel1, KEYS).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("folds_kfold", "region_id c_year:i fold:i", f"SELECT region_id, c_year, (row_number() OVER (ORDER BY {ROW_ID.format(seed=42)}) - 1) % 5 AS fold FROM panel1", "panel1")
def _(v: Views):
    return V.folds_kfold(v.panel1, KEYS, 5)


_LOGO = """SELECT p.region_id, p.c_year, g.c_year AS fold, CASE WHEN p.c_year = g.c_year THEN 'test' ELSE 'train' END AS role FROM panel1 p,
    (SELECT c_year FROM panel1 GROUP BY 1 HAVING count(*) >= 5) g"""


@query("folds_leave_one_group", "region_id c_year:i fold:i role", _LOGO, "panel1")
def _(v: Views):
    return V.folds_leave_one_group(v.panel1, "c_year", min_rows=5)


_TS = f"""SELECT region_id, c_year, fold, CASE WHEN rn <= n - s * (3 - fold) THEN 'train' WHEN rn <= n - s * (3 - fold) + s THEN 'test' END AS role FROM
    (SELECT region_id, c_year, n, n // 4 AS s, rn, unnest([0, 1, 2]) AS fold FROM (SELECT *, row_number() OVER (ORDER BY c_year, {ROW_ID.format(seed=42)}) AS rn, count(*) OVER () AS n FROM panel1))"""


@query("folds_time_series", "region_id c_year:i fold:i role", f"SELECT * FROM ({_TS}) WHERE role IS NOT NULL", "panel1")
def _(v: Views):
    return V.folds_time_series(v.panel1, "c_year", KEYS, 3)


@query("fold_guards", "fold n:l", """SELECT substr(region_id, 1, 2) AS fold, count(*) AS n FROM panel WHERE c_year >= 1996 GROUP BY 1
        HAVING count(CASE WHEN c_year < 2001 THEN 1 END) >= 50 AND count(CASE WHEN c_year = 2001 AND "yield" > 5 THEN 1 END) >= 5""", "panel")
def _(v: Views):
    role = F.when(F.col("c_year") < 2001, "train").when(F.col("yield") > 5, "test").otherwise("none")
    df = v.panel.where("c_year >= 1996").withColumns({"fold": admin_key("region_id"), "role": role})
    return V.fold_guards(df, {"train": 50, "test": 5}).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("train_roles", "mode role n:l", """WITH p AS (SELECT *, substr(region_id, 1, 2) = '03' AS t, c_year = 2000 AS y FROM panel1)
        SELECT 'transfer' AS mode, CASE WHEN t AND y THEN 'test' WHEN t AND c_year <> 1999 THEN 'finetune' WHEN NOT y AND NOT t AND c_year <> 1999 THEN 'train' END AS role, count(*) AS n FROM p GROUP BY 2 HAVING role IS NOT NULL
        UNION ALL SELECT 'direct', CASE WHEN t AND y THEN 'test' WHEN NOT t AND NOT y AND c_year <> 1999 THEN 'train' END AS role, count(*) FROM p GROUP BY 2 HAVING role IS NOT NULL
        UNION ALL SELECT 'direct_all', CASE WHEN t AND y THEN 'test' WHEN NOT y AND c_year <> 1999 THEN 'train' END AS role, count(*) FROM p GROUP BY 2 HAVING role IS NOT NULL
        UNION ALL SELECT 'all', CASE WHEN t AND y THEN 'test' WHEN NOT y AND c_year <> 1999 THEN 'train' END AS role, count(*) FROM p GROUP BY 2 HAVING role IS NOT NULL
        UNION ALL SELECT 'target_only', CASE WHEN t AND y THEN 'test' WHEN t AND c_year <> 1999 THEN 'train' END AS role, count(*) FROM p GROUP BY 2 HAVING role IS NOT NULL""", "panel1")
def _(v: Views):
    df = v.panel1.withColumn("country", admin_key("region_id"))
    parts = [V.train_roles(df, TARGET, m, 2000, exclude_years=[1999]).groupBy("role").agg(F.count(F.lit(1)).alias("n")).withColumn("mode", F.lit(m)) for m in V.MODES]
    return M.union_all(parts)


# --- models --------------------------------------------------------------------------

@query("model_baseline_mean", "region_id c_year:i y_pred:d", """SELECT region_id, c_year, ((SELECT sum("yield") FROM panel1) - s) / ((SELECT count(*) FROM panel1) - n) AS y_pred
        FROM panel1 JOIN (SELECT c_year, sum("yield") AS s, count(*) AS n FROM panel1 GROUP BY 1) USING (c_year)""", "panel1")
def _(v: Views):
    return LM.model_baseline_mean(v.panel1)


@query("model_linear", "region_id c_year:i y_pred:d", """SELECT f.region_id, f.c_year, b.icpt + b.slope * f."t2m_LT1" AS y_pred FROM features f JOIN
        (SELECT g.c_year, regr_slope(t."yield", t."t2m_LT1") AS slope, regr_intercept(t."yield", t."t2m_LT1") AS icpt FROM features t JOIN (SELECT DISTINCT c_year FROM features) g ON t.c_year <> g.c_year GROUP BY 1) b
        ON b.c_year = f.c_year""", "features")
def _(v: Views):
    return LM.model_linear(v.features, ["t2m_LT1"])


@query("model_linear_all", "setup n:l r2:d rmse:d")
def _(v: Views):
    preds = LM.model_linear(v.features, FEATURES).withColumn("setup", F.lit("linear"))
    return regression_metrics(preds, "yield", "y_pred", median_bias=False)


PRED = "region_id c_year:i y_true:d y_pred:d"


@query("model_lasso", PRED)
def _(v: Views):
    return M.model_lasso(v.features, FEATURES, last_year(), reg=0.01)


@query("model_forest", PRED)
def _(v: Views):
    return M.model_forest(v.features, FEATURES, last_year(), trees=200)


@query("model_boosted", PRED)
def _(v: Views):
    return M.model_boosted(v.features, FEATURES, last_year(), rounds=50)


@query("size_adaptive_params", "c_year:i n_train:l rounds:i depth:i rate:d row_share:d l1:d l2:d",
       """SELECT c_year, n AS n_train, CASE WHEN n < 100 THEN 100 WHEN n < 500 THEN 200 ELSE 300 END AS rounds, CASE WHEN n < 100 THEN 3 WHEN n < 500 THEN 4 ELSE 6 END AS depth, 0.1 AS rate,
          CASE WHEN n < 500 THEN 0.8 ELSE 0.9 END AS row_share, CASE WHEN n < 100 THEN 1 WHEN n < 500 THEN 0.5 ELSE 0.1 END AS l1, CASE WHEN n < 100 THEN 1 WHEN n < 500 THEN 0.5 ELSE 0.1 END AS l2
          FROM (SELECT c_year, count(*) AS n FROM panel1 GROUP BY 1)""", "panel1")
def _(v: Views):
    return M.size_adaptive_params(v.panel1.groupBy("c_year").agg(F.count(F.lit(1)).alias("n_train")))


@query("scaled_fit", "region_id c_year:i y_true:d y_pred:d role")
def _(v: Views):
    """Scaler and model fitted on a random 80 %, scored on the other 20 %."""
    df = V.split_random(v.features, KEYS)
    return M.holdout(df.withColumn("is_test", F.col("role") == "test"), M.linear(), FEATURES, F.col("role") == "test", keys=[*KEYS, "role"])


@query("cross_val_score", "fold:i ev:d n:l median_ev:d",
       f"""WITH f AS (SELECT "yield" AS y, "t2m_LT1" AS x0, (row_number() OVER (ORDER BY {ROW_ID.format(seed=42)}) - 1) % 5 AS k FROM features),
          m AS (SELECT g.k AS fold, avg(f.x0) AS mx FROM f JOIN (SELECT DISTINCT k FROM f) g ON f.k <> g.k GROUP BY 1),
          b AS (SELECT fold, regr_slope(y, coalesce(x0, mx)) AS slope, regr_intercept(y, coalesce(x0, mx)) AS icpt FROM f JOIN m ON f.k <> m.fold GROUP BY 1),
          s AS (SELECT b.fold, 1 - var_pop(slope * coalesce(x0, mx) + icpt - y) / var_pop(y) AS ev, count(*) AS n FROM f JOIN b ON f.k = b.fold JOIN m ON m.fold = b.fold GROUP BY 1)
          SELECT fold, ev, n, (SELECT median(ev) FROM s) AS median_ev FROM s""", "features")
def _(v: Views):
    return M.cross_val_score(v.features, lambda: M.linear(), ["t2m_LT1"], folds=5)


@query("cross_val_score_all", "fold:i ev:d n:l median_ev:d")
def _(v: Views):
    return M.cross_val_score(v.features, lambda: M.linear(), FEATURES, folds=5)


@query("cross_val_predict_grouped", "region_id c_year:i setup fold:i y_true:d y_pred:d")
def _(v: Views):
    return M.leave_one_group(v.features, lambda: M.boosted(50), feature_groups(FEATURES))


@query("forecast_by_lead", "region_id c_year:i y_true:d LT1:d LT2:d LT3:d LT4:d")
def _(v: Views):
    return M.forecast_by_lead(v.features, lambda: M.linear())


@query("random_search", "setting:i params score:d")
def _(v: Views):
    return M.random_search(v.features, FEATURES, {"maxDepth": [3, 5, 8], "minInstancesPerNode": [1, 2, 5], "numTrees": [5, 10]})


@query("grid_search", "setting:i params score:d")
def _(v: Views):
    roles = V.folds_time_series(v.features, "c_year", KEYS, 3)
    grid = {"rounds": [100, 200, 300], "depth": [3, 4, 6], "rate": [0.05, 0.1, 0.2]}
    return B.grid_search_boosted(v.features, FEATURES, grid, roles)


@query("rfe", "feature rank:i selected:b")
def _(v: Views):
    return M.rfe(v.features, FEATURES, keep=10, make=lambda: M.forest(20, 5))


@query("feature_importance", "feature importance:d rank:i")
def _(v: Views):
    return M.feature_importance(M.prepare(v.features, ["yield", *FEATURES]), FEATURES)


@query("cross_train", "region_id c_year:i setup y_true:d y_pred:d")
def _(v: Views):
    """Regions to countries and back: the same predictors at two scales."""
    from harvestline.operators.panel import region_rollup_mean

    coarse = region_rollup_mean(v.features, "country", ["yield", *FEATURES])
    return M.cross_train(v.features, coarse, lambda: M.linear(), FEATURES)


@query("predictor_set_compare", "predictors lead:i r2:d rmse:d n:l")
def _(v: Views):
    sets = {"evi": ["evi"], "soil": ["sm"], "weather": ["t2m", "tp"], "no_soil": ["evi", "t2m", "tp"], "all": ["evi", "sm", "t2m", "tp"]}
    return M.predictor_set_compare(v.features, lambda: M.linear(), sets, [1, 2, 3, 4])


@query("tuning_compare", "setup lead:i ev:d n:l")
def _(v: Views):
    return M.tuning_compare(v.features, FEATURES, [1, 2, 3, 4], space={"maxDepth": [3, 5], "numTrees": [5, 10]}, keep=6)


# --- networks ------------------------------------------------------------------------

@query("model_mlp", "setup region_id c_year:i y_true:d y_pred:d")
def _(v: Views):
    return mlp.model_mlp(v.features, FEATURES, "yield", "c_year", KEYS)


@query("transfer_learning", "model fold region_id c_year:i y_true:d y_pred:d")
def _(v: Views):
    df = table(v)
    return X.transfer_learning(df.where(F.col("country") != TARGET), df.where(F.col("country") == TARGET), FEATURES, trainable_layers=2)


@query("transfer_learning_random", "model n:l r2:d rmse:d")
def _(v: Views):
    df = table(v)
    preds = X.transfer_learning(df.where(F.col("country") >= "12"), df.where(F.col("country") < "12"), FEATURES, cv="random", folds=5, with_boosted=False)
    return regression_metrics(preds, by=["model"], median_bias=False)


@query("transfer_country_year", "model target fold region_id c_year:i y_true:d y_pred:d")
def _(v: Views):
    df = table(v)
    countries = sorted(r[0] for r in df.select("country").distinct().collect())
    return X.transfer_country_year(df, countries, FEATURES, guards={"train": 50, "finetune": 5, "test": 1})


@query("national_forecast", "cv fold n:l r2:d rmse:d")
def _(v: Views):
    countries = [f"{i:02d}" for i in range(25)]
    df, cols = M.national_matrix(table(v), countries, [f for f in FEATURES if f.startswith(("t2m", "tp"))])
    parts = [X.national_forecast(df, cols, cv=cv) for cv in ("grouped", "random")]
    return regression_metrics(M.union_all(parts), by=["cv", "fold"], median_bias=False)


@query("loyo_grid", "feature_type mode fold mse:d rmse:d mae:d r2:d n:l")
def _(v: Views):
    """Nine network set-ups and two of boosted trees."""
    data = table(v)
    nets = X.loyo_grid(data, TARGET, FEATURES, guards={"train": 50, "finetune": 5, "test": 1})
    boosted, _ = B.boosted_loyo(data, TARGET, FEATURES, guards=TREE_GUARDS)
    parts = F.split("setup", r"\|")
    named = boosted.select(F.lit("full").alias("feature_type"), F.concat(F.lit("boosted_"), parts[0]).alias("mode"), parts[1].alias("fold"), *KEYS, "y_true", "y_pred")
    return X.grid_scores(nets.select(named.columns).unionByName(named))


@query("boosted_loyo", "mode fold region_id c_year:i y_true:d y_pred:d")
def _(v: Views):
    """Out-of-fold predictions of the boosted set-ups, each fold with a search of its own."""
    preds, _ = B.boosted_loyo(table(v), TARGET, FEATURES, guards=TREE_GUARDS)
    parts = F.split("setup", r"\|")
    return preds.select(parts[0].alias("mode"), parts[1].alias("fold"), *KEYS, "y_true", "y_pred")


@query("boosted_choices", "part n_train:l splits:i rounds:i depth:i rate:d mse:d")
def _(v: Views):
    """What each fold's search chose, by the size of its training set."""
    return B.boosted_loyo(table(v), TARGET, FEATURES, guards=TREE_GUARDS)[1]


@query("skipped_pairs", "target fold train:l finetune:l test:l",
       """WITH f AS (SELECT substr(region_id, 1, 2) AS c, c_year AS y FROM features), pairs AS (SELECT c, y FROM (SELECT DISTINCT c FROM f) CROSS JOIN (SELECT DISTINCT y FROM f)),
          s AS (SELECT p.c, p.y, count(CASE WHEN f.c <> p.c AND f.y <> p.y THEN 1 END) AS train, count(CASE WHEN f.c = p.c AND f.y <> p.y THEN 1 END) AS finetune,
          count(CASE WHEN f.c = p.c AND f.y = p.y THEN 1 END) AS test FROM pairs p CROSS JOIN f GROUP BY 1, 2)
          SELECT c AS target, CAST(y AS VARCHAR) AS fold, train, finetune, test FROM s WHERE train < 100 OR finetune < 10 OR test < 10""", "features")
def _(v: Views):
    """Pairs too small for the transfer between countries at its own minimum sizes."""
    df = table(v)
    countries, years = (sorted(r[0] for r in df.select(c).distinct().collect()) for c in ("country", "c_year"))
    return X.skipped_pairs(df, countries, years, V.MIN_ROWS["sequence"])


@query("country_combinations", "tag fold mse:d rmse:d mae:d r2:d n:l")
def _(v: Views):
    combos = {"near": ["00", "01", "02", "04", "05"], "far": [f"{i:02d}" for i in range(10, 25)]}
    return X.country_combinations(table(v), TARGET, combos, FEATURES, guards={"train": 50, "finetune": 5, "test": 1})


@query("hp_sweep", "hp year stage part units:i dropout:d epochs:i trainable:i r2:d mae:d bias:d r:d")
def _(v: Views):
    grid = [{"units": u, "dropout": d, "epochs": 200, "trainable": t} for u in (16, 32, 64) for d in (0.0, 0.2, 0.4) for t in (1, 2)]
    return X.hp_sweep(table(v), TARGET, [2000, 2001], grid, FEATURES)


# --- importances ---------------------------------------------------------------------

@query("permutation_importance", "setup feature importance_mean:d importance_std:d")
def _(v: Views):
    data = M.prepare(v.features, [*KEYS, "yield", *FEATURES])
    nets = mlp.fit_jobs(data, FEATURES, "yield", [mlp.Job("all", range(len(FEATURES)), ~last_year())])
    return explain.permutation_importance(data, nets, {"all": last_year()}, FEATURES, "yield", KEYS, repeats=5)


@query("permutation_importance_cv", "stage feature importance_mean:d importance_std:d n_folds:l")
def _(v: Views):
    return explain.permutation_importance_cv(table(v), TARGET, FEATURES, repeats=5, metric="mse")


@query("importance_over_years", "year:i feature feature_type base_mean:d base_std:d finetuned_mean:d finetuned_std:d")
def _(v: Views):
    return explain.importance_over_years(table(v), TARGET, FEATURES, repeats=5, metric="mse")


# --- classification ------------------------------------------------------------------

def _classes(v: Views, **kw):
    df = v.table("embeddings").withColumn("_part", F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 2), 16, 10).cast("int"))
    return classify.crop_classify(df, "embedding", "label", kw.pop("train"), ["vec_id"], nested=False, **kw)


@query("crop_classify", "vec_id:l label:i prediction:i")
def _(v: Views):
    return _classes(v, train=F.col("_part") < 180)


@query("crop_classify_report", "label:i precision:d recall:d f1:d support:l")
def _(v: Views):
    """Pretrained on one share of the rows, fine-tuned on another, reported on the rest."""
    return class_report(_classes(v, train=F.col("_part") < 120, fine_tune=F.col("_part").between(120, 180)))


# --- the whole chain -----------------------------------------------------------------

@query("forecast_flagship", "setup c_year:i n:l rmse:d mae:d r2:d ev:d med_bias:d")
def _(v: Views):
    return flagship.forecast_scores(flagship.biweekly_features(v.daily, calendar(v), v.panel1, PARAMS))


@query("flagship_features", "region_id c_year:i y_detrended:d evi_LT1:d",
       f"""SELECT t.region_id, t.c_year, y_detrended, "evi_LT1" FROM ({TAIL_SQL}) t JOIN (SELECT region_id, c_year, "yield" - (regr_slope("yield", c_year) OVER (PARTITION BY region_id) * c_year
           + regr_intercept("yield", c_year) OVER (PARTITION BY region_id)) + avg("yield") OVER (PARTITION BY region_id) AS y_detrended FROM panel1) d USING (region_id, c_year)""", "daily panel1")
def _(v: Views):
    return flagship.biweekly_features(v.daily, calendar(v), v.panel1, PARAMS)
