"""Aggregations, statistics, scores and importance reports."""

from pyspark.sql import functions as F

from harvestline.functions.metrics import score_columns
from harvestline.functions.scalars import admin_key
from harvestline.operators import panel as P, scores as S, spatial as G, statistics as T
from harvestline.registry.base import query
from harvestline.registry.q_joins import EDGES_SQL
from harvestline.registry.views import FEATURES, SETUPS, Views

YEARS = list(range(1995, 2002))


@query("ensemble_mean", "region_id month:i LT1:d LT2:d LT3:d LT4:d",
       "SELECT region_id, CAST(month(obs_date) AS INTEGER) AS month, " + ", ".join(f"avg(CASE WHEN l_linenumber = {n} THEN price END) AS \"LT{n}\"" for n in range(1, 5)) + " FROM line GROUP BY 1, 2", "line")
def _(v: Views):
    cube = v.line.select("region_id", F.month("obs_date").alias("month"), F.col("l_linenumber").alias("lead"), F.col("price").alias("value"))
    return P.ensemble_mean(cube)


@query("fields_to_region_mean", "region_id obs_date:t band value:d n_fields:l",
       """SELECT substr(region_id, 1, 2) AS region_id, obs_date, crop AS band, avg(CASE WHEN l_linenumber IN (4, 5, 6) THEN price END) AS value,
          count(CASE WHEN l_linenumber IN (4, 5, 6) THEN price END) AS n_fields FROM line GROUP BY 1, 2, 3""", "line")
def _(v: Views):
    f = v.line.select(admin_key("region_id").alias("region_id"), "obs_date", F.col("crop").alias("band"), F.col("price").alias("value"), "l_linenumber")
    return P.fields_to_region_mean(f, "l_linenumber")


@query("radar_region_mean", "region_id obs_date:t value:d",
       """SELECT param AS region_id, obs_date, 10 * log10(avg(pow(10.0, (value / 10 - 30) / 10))) AS value FROM obs GROUP BY 1, 2""", "obs")
def _(v: Views):
    return P.radar_region_mean(v.obs.select(F.col("param").alias("region_id"), "obs_date", (F.col("value") / 10 - 30).alias("value")))


@query("region_rollup_mean", "region_id c_year:i yield:d", 'SELECT substr(region_id, 1, 2) AS region_id, c_year, avg("yield") AS "yield" FROM panel1 GROUP BY 1, 2', "panel1")
def _(v: Views):
    return P.region_rollup_mean(v.panel1, "country", ["yield"])


@query("rollup_mean_first", "country c_year:i evi_LT1:d t2m_LT1:d yield:d",
       """SELECT substr(region_id, 1, 2) AS country, c_year, avg("evi_LT1") AS "evi_LT1", avg("t2m_LT1") AS "t2m_LT1", min_by("yield", region_id) AS "yield" FROM features GROUP BY 1, 2""", "features")
def _(v: Views):
    df = v.features.withColumn("country", admin_key("region_id"))
    return P.rollup_mean_first(df, ["country", "c_year"], ["evi_LT1", "t2m_LT1"], "yield", "region_id")


def _pivot_sql(agg: str) -> str:
    return "SELECT region_id, " + ", ".join(f'{agg}(CASE WHEN c_year = {y} THEN "yield" END) AS "{y}"' for y in YEARS) + " FROM panel GROUP BY 1"


PIVOT_OUT = "region_id " + " ".join(f"{y}:d" for y in YEARS)


@query("pivot_years", PIVOT_OUT, _pivot_sql("avg"), "panel")
def _(v: Views):
    return P.pivot_years(v.panel, YEARS)


@query("pivot_sum", PIVOT_OUT, _pivot_sql("sum"), "panel")
def _(v: Views):
    return P.pivot_sum(v.panel, YEARS)


@query("explode_scores", "vec_id:l fold:i score:d",
       "SELECT vec_id, CAST(i - 1 AS INTEGER) AS fold, CAST(embedding[i] AS DOUBLE) AS score FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def _(v: Views):
    return P.explode_scores(v.table("embeddings"), "embedding", ["vec_id"])


@query("melt", "region_id c_year:i variable value:d", " UNION ALL ".join(f"SELECT region_id, c_year, '{f}' AS variable, \"{f}\" AS value FROM features" for f in FEATURES), "features")
def _(v: Views):
    return P.melt(v.features, ["region_id", "c_year"], FEATURES)


@query("split_stat_rows", "scene_id band median:d std:d", "SELECT scene_id, band, median(value) AS median, stddev_pop(value) AS std FROM pixels GROUP BY 1, 2", "pixels")
def _(v: Views):
    wide = G.zonal_median_std(v.pixels, ["scene_id", "band"], nodata=None)
    long = P.melt(wide, ["scene_id", "band"], ["median", "std"], "stat", "value")
    labelled = long.select("scene_id", F.concat_ws("_", "band", "stat").alias("band_stat"), "value")
    return P.split_stat_rows(labelled, ["scene_id"])


@query("contingency", "p_type 1:l 7:l 13:l total:l",
       """SELECT p_type, count(CASE WHEN p_size = 1 THEN 1 END) AS "1", count(CASE WHEN p_size = 7 THEN 1 END) AS "7", count(CASE WHEN p_size = 13 THEN 1 END) AS "13",
          count(*) AS total FROM part GROUP BY 1 HAVING count(*) > 100""")
def _(v: Views):
    return P.contingency(v.table("part"), "p_type", "p_size", [1, 7, 13])


@query("value_counts", "p_type n:l", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1")
def _(v: Views):
    return P.value_counts(v.table("part"), "p_type")


@query("coverage_summary", "param n_rows:l n_regions:l first_date:t last_date:t n_values:l mean_value:d",
       """SELECT param, count(*) AS n_rows, count(DISTINCT region_id) AS n_regions, min(obs_date) AS first_date, max(obs_date) AS last_date,
          count(value) AS n_values, avg(value) AS mean_value FROM obs GROUP BY 1""", "obs")
def _(v: Views):
    return P.coverage_summary(v.obs, ["param"])


@query("linregress", "region_id slope:d intercept:d r:d mean_x:d mean_y:d n:l",
       """SELECT region_id, regr_slope("yield", x) AS slope, regr_intercept("yield", x) AS intercept, corr("yield", x) AS r, avg(x) AS mean_x, avg("yield") AS mean_y,
          count(*) AS n FROM (SELECT *, c_year - 1995 AS x FROM panel) GROUP BY 1""", "panel")
def _(v: Views):
    return P.linregress(v.panel.withColumn("x", F.col("c_year") - 1995), "x", "yield", ["region_id"])


_LINE = 'regr_slope("yield", c_year) OVER (PARTITION BY region_id) * c_year + regr_intercept("yield", c_year) OVER (PARTITION BY region_id)'


@query("detrend_residual", "region_id c_year:i y_detrended:d", f'SELECT region_id, c_year, "yield" - ({_LINE}) AS y_detrended FROM panel1', "panel1")
def _(v: Views):
    return P.detrend_residual(v.panel1, digits=None)


@query("detrend_keep_mean", "region_id c_year:i y_detrended:d", f"""SELECT region_id, c_year, "yield" - ({_LINE}) + avg("yield") OVER (PARTITION BY region_id) AS y_detrended FROM panel1""", "panel1")
def _(v: Views):
    return P.detrend_keep_mean(v.panel1)


GAPS = 'SELECT * FROM panel WHERE "yield" > 4.8'


@query("detrend_gap_filled", "region_id crop c_year:i y_detrended:d",
       f"""WITH g AS ({GAPS}), ends AS (SELECT region_id, crop, min(c_year) AS a, max(c_year) AS b, avg("yield") AS m FROM g GROUP BY 1, 2),
          spine AS (SELECT region_id, crop, m, unnest(range(a, b + 1)) AS c_year FROM ends),
          filled AS (SELECT s.region_id, s.crop, s.m, s.c_year, g."yield" AS orig, coalesce(g."yield",
            (SELECT p."yield" + (n."yield" - p."yield") * (s.c_year - p.c_year) / (n.c_year - p.c_year) FROM
              (SELECT * FROM g WHERE g.region_id = s.region_id AND g.crop = s.crop AND g.c_year < s.c_year ORDER BY c_year DESC LIMIT 1) p,
              (SELECT * FROM g WHERE g.region_id = s.region_id AND g.crop = s.crop AND g.c_year > s.c_year ORDER BY c_year LIMIT 1) n)) AS y
            FROM spine s LEFT JOIN g ON g.region_id = s.region_id AND g.crop = s.crop AND g.c_year = s.c_year)
          SELECT region_id, crop, CAST(c_year AS INTEGER) AS c_year, round(y - coalesce(slope * c_year + icpt, my) + m, 2) AS y_detrended FROM (SELECT *, regr_slope(y, c_year) OVER (PARTITION BY region_id, crop) AS slope,
            regr_intercept(y, c_year) OVER (PARTITION BY region_id, crop) AS icpt, avg(y) OVER (PARTITION BY region_id, crop) AS my FROM filled) WHERE orig IS NOT NULL""", "panel")
def _(v: Views):
    return P.detrend_gap_filled(v.panel.where("yield > 4.8"), by=["region_id", "crop"])


@query("center_by_group", "region_id crop c_year:i centered:d", """SELECT region_id, crop, c_year, "yield" - m AS centered FROM panel JOIN (SELECT crop, avg("yield") AS m FROM panel GROUP BY 1) USING (crop)""", "panel")
def _(v: Views):
    return P.center_by_group(v.panel, "yield", ["crop"])


@query("clean_panel", "region_id c_year:i yield:d",
       """WITH p AS (SELECT region_id, crop, c_year, CASE WHEN "yield" - 6.4 > 0 THEN round("yield" - 6.4, 2) END AS y FROM panel)
          SELECT region_id, c_year, y AS "yield" FROM p WHERE region_id IN (SELECT region_id FROM p GROUP BY 1 HAVING count(y) > 0)""", "panel")
def _(v: Views):
    return P.clean_panel(v.panel.withColumn("yield", F.col("yield") - 6.4))


# --- statistics ----------------------------------------------------------------------

_SPEARMAN = " UNION ALL ".join(f"SELECT '{f}' AS feature, floor(\"{f}\" * 7.3) AS x, \"yield\" AS y FROM features WHERE \"{f}\" IS NOT NULL" for f in FEATURES)
_AVG_RANK = "rank() OVER (PARTITION BY feature ORDER BY {c}) + (count(*) OVER (PARTITION BY feature, {c}) - 1) / 2.0"


@query("spearman_ci", "feature r:d lo:d hi:d width:d n:l",
       f"""SELECT feature, r, tanh(atanh(r) - 1.96 / sqrt(n - 3)) AS lo, tanh(atanh(r) + 1.96 / sqrt(n - 3)) AS hi,
           tanh(atanh(r) + 1.96 / sqrt(n - 3)) - tanh(atanh(r) - 1.96 / sqrt(n - 3)) AS width, n FROM (SELECT feature, corr(rx, ry) AS r, count(*) AS n FROM
           (SELECT feature, {_AVG_RANK.format(c='x')} AS rx, {_AVG_RANK.format(c='y')} AS ry FROM ({_SPEARMAN})) GROUP BY 1)""", "features")
def _(v: Views):
    return T.spearman_ci(v.features.withColumns({c: F.floor(F.col(c) * 7.3).cast("double") for c in FEATURES}), "yield", FEATURES)


@query("pearson_matrix", "feature_a feature_b r:d",
       " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr(\"{a}\", \"{b}\") AS r FROM features" for i, a in enumerate(FEATURES[-8:]) for b in FEATURES[-8:][:i]), "features")
def _(v: Views):
    return T.pearson_matrix(v.features, FEATURES[-8:])


@query("ttest_groups", "c_year:i t:d dof:l n1:l n0:l",
       """SELECT a.c_year, (m0 - m1) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)) AS t, n1 + n0 - 2 AS dof, n1, n0 FROM
          (SELECT c_year, count(*) AS n1, avg("yield") AS m1, var_samp("yield") AS v1 FROM panel GROUP BY 1) a JOIN
          (SELECT y.c_year, count(*) AS n0, avg("yield") AS m0, var_samp("yield") AS v0 FROM panel p JOIN (SELECT DISTINCT c_year FROM panel) y ON p.c_year <> y.c_year GROUP BY 1) b USING (c_year)""", "panel")
def _(v: Views):
    return T.ttest_groups(v.panel, "yield", "c_year")


@query("ttest_groups_p", "c_year:i t:d p:d")
def _(v: Views):
    return T.ttest_groups(v.panel, "yield", "c_year", with_p=True)


def nation_values(v: Views):
    name = F.concat(F.lit("NATION_"), F.substring("region_id", 1, 2).cast("int").cast("string"))
    return v.line.groupBy(name.alias("region_id"), "c_year").agg(F.avg("price").alias("value"))


@query("morans_i", "c_year:i i:d n:l",
       f"""WITH e AS ({EDGES_SQL}), val AS (SELECT 'NATION_' || CAST(CAST(substr(region_id, 1, 2) AS INTEGER) AS VARCHAR) AS region_id, c_year, avg(price) AS value FROM line GROUP BY 1, 2),
          z AS (SELECT region_id, c_year, value - avg(value) OVER (PARTITION BY c_year) AS z FROM val),
          lag_ AS (SELECT e.src AS region_id, z.c_year, avg(z.z) AS lag FROM e JOIN z ON e.dst = z.region_id GROUP BY 1, 2)
          SELECT c_year, count(*) / count(lag) * sum(z * lag) / sum(z * z) AS i, count(*) AS n FROM z LEFT JOIN lag_ USING (region_id, c_year) GROUP BY 1""", "line regions")
def _(v: Views):
    return T.morans_i(nation_values(v), G.queen_neighbors(v.regions), by=["c_year"])


@query("morans_p", "i:d p_sim:d")
def _(v: Views):
    values = nation_values(v).groupBy("region_id").agg(F.avg("value").alias("value"))
    return T.morans_p(values, G.queen_neighbors(v.regions))


@query("box_stats", "crop c_year:i min:d q1:d median:d q3:d max:d n:l",
       """SELECT crop, c_year, min(price) AS min, quantile_cont(price, 0.25) AS q1, median(price) AS median, quantile_cont(price, 0.75) AS q3, max(price) AS max,
          count(price) AS n FROM line GROUP BY 1, 2""", "line")
def _(v: Views):
    return T.box_stats(v.line, "price", ["crop", "c_year"])


@query("kde_curve", "crop point:i x:d density:d",
       """WITH s AS (SELECT crop, count(*) AS n, stddev_samp("yield") * pow(count(*), -0.2) AS h, min("yield") AS lo, max("yield") AS hi FROM panel GROUP BY 1),
          g AS (SELECT *, lo - 3 * h + i * ((hi + 3 * h) - (lo - 3 * h)) / 49 AS x FROM (SELECT *, unnest(range(0, 50)) AS i FROM s))
          SELECT g.crop, CAST(i AS INTEGER) AS point, x, sum(exp(-0.5 * pow((x - "yield") / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())) AS density
          FROM g JOIN panel p ON p.crop = g.crop GROUP BY g.crop, i, x""", "panel")
def _(v: Views):
    return T.kde_curve(v.panel, "yield", ["crop"])


# --- scores --------------------------------------------------------------------------

_E = "(y_pred - y_true)"


@query("regression_metrics", "setup crop n:l mse:d rmse:d mae:d nrmse:d mape:d r2:d ev:d r:d mean_bias:d med_bias:d",
       f"""SELECT setup, crop, count(*) AS n, avg({_E} * {_E}) AS mse, sqrt(avg({_E} * {_E})) AS rmse, avg(abs{_E}) AS mae, sqrt(avg({_E} * {_E})) / avg(y_true) AS nrmse,
           avg(abs{_E} / abs(y_true)) AS mape, 1 - sum({_E} * {_E}) / (var_pop(y_true) * count(*)) AS r2, 1 - var_pop{_E} / var_pop(y_true) AS ev, corr(y_true, y_pred) AS r,
           avg{_E} AS mean_bias, median{_E} AS med_bias FROM preds GROUP BY 1, 2""", "preds")
def _(v: Views):
    return S.regression_metrics(v.preds, by=["setup", "crop"])


@query("custom_metric", "setup worst:d n:l", f"SELECT setup, max(abs{_E}) AS worst, count(*) AS n FROM preds GROUP BY 1", "preds")
def _(v: Views):
    """A user's own score as a function of two columns."""
    return S.regression_metrics(v.preds, median_bias=False, custom={"worst": lambda obs, pred: F.max(F.abs(pred - obs))})


_WIDE_PREDS = "(SELECT region, crop, year, max(y_true) AS observed, " + ", ".join(f"max(CASE WHEN setup = '{s}' AND y_pred > 4 THEN y_pred END) AS {s}" for s in SETUPS) + " FROM preds GROUP BY 1, 2, 3)"


@query("metrics_by_setup", "crop year:i setup r2:d n:l",
       "SELECT crop, year, setup, 1 - sum((p - observed) * (p - observed)) / (var_pop(observed) * count(*)) AS r2, count(*) AS n FROM (" + " UNION ALL ".join(
           f"SELECT crop, year, observed, '{s}' AS setup, {s} AS p FROM {_WIDE_PREDS}" for s in SETUPS) + ") WHERE p IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2", "preds")
def _(v: Views):
    wide = v.preds.groupBy("region", "crop", "year").agg(F.max("y_true").alias("observed"), *[
        F.max(F.when((F.col("setup") == s) & (F.col("y_pred") > 4), F.col("y_pred"))).alias(s) for s in SETUPS])
    return S.metrics_by_setup(wide, ["crop", "year"], list(SETUPS))


@query("cv_summary", "setup rmse_mean:d rmse_std:d r2_mean:d r2_std:d n_folds:l",
       "SELECT setup, avg(rmse) AS rmse_mean, stddev_pop(rmse) AS rmse_std, avg(r2) AS r2_mean, stddev_pop(r2) AS r2_std, count(*) AS n_folds FROM scores GROUP BY 1", "scores")
def _(v: Views):
    return S.cv_summary(v.scores, ["setup"], ["rmse", "r2"])


@query("setup_leaderboard", "level name mean_score:d std_score:d n:l rank:i",
       """SELECT *, row_number() OVER (PARTITION BY level ORDER BY mean_score, name) AS rank FROM (
          SELECT 'setup' AS level, setup AS name, avg(rmse) AS mean_score, stddev_pop(rmse) AS std_score, count(rmse) AS n FROM scores GROUP BY 2
          UNION ALL SELECT 'feature_type', feature_type, avg(rmse), stddev_pop(rmse), count(rmse) FROM scores GROUP BY 2
          UNION ALL SELECT 'mode', mode, avg(rmse), stddev_pop(rmse), count(rmse) FROM scores GROUP BY 2)""", "scores")
def _(v: Views):
    return S.setup_leaderboard(v.scores)


@query("country_year_score", "setup country nrmse:d ev:d n_years:l",
       f"""SELECT setup, country, avg(nrmse) AS nrmse, avg(ev) AS ev, count(*) AS n_years FROM (SELECT setup, substr(region, 1, 2) AS country, year, sqrt(avg({_E} * {_E})) / avg(y_true) AS nrmse,
           1 - var_pop{_E} / nullif(var_pop(y_true), 0) AS ev FROM preds GROUP BY 1, 2, 3) GROUP BY 1, 2""", "preds")
def _(v: Views):
    return S.country_year_score(v.preds.withColumn("country", admin_key("region")))


@query("yearly_mean_score", "setup r2:d n_years:l",
       """SELECT setup, 1 - sum((p - o) * (p - o)) / (var_pop(o) * count(*)) AS r2, count(*) AS n_years FROM (SELECT setup, year, avg(y_true) AS o, avg(y_pred) AS p
          FROM preds GROUP BY 1, 2) GROUP BY 1""", "preds")
def _(v: Views):
    return S.yearly_mean_score(v.preds)


@query("yearly_means", "setup year:i obs_mean:d obs_std:d pred_mean:d pred_std:d n:l",
       "SELECT setup, year, avg(y_true) AS obs_mean, stddev_pop(y_true) AS obs_std, avg(y_pred) AS pred_mean, stddev_pop(y_pred) AS pred_std, count(*) AS n FROM preds GROUP BY 1, 2", "preds")
def _(v: Views):
    return S.yearly_means(v.preds)


@query("yearly_rmse_band", "region crop year:i setup lower:d upper:d",
       f"""SELECT region, crop, year, setup, y_pred - rmse AS lower, y_pred + rmse AS upper FROM preds JOIN (SELECT setup, year, sqrt(avg({_E} * {_E})) AS rmse FROM preds GROUP BY 1, 2)
           USING (setup, year)""", "preds")
def _(v: Views):
    return S.yearly_rmse_band(v.preds)


@query("sample_fraction_curve", "fraction:i median:d mean:d std:d n:l",
       """SELECT fraction, median(s) AS median, avg(s) AS mean, stddev_pop(s) AS std, count(*) AS n FROM (SELECT l_linenumber AS fraction, price / avg(price) OVER (PARTITION BY crop) AS s FROM line) GROUP BY 1""", "line")
def _(v: Views):
    return S.sample_fraction_curve(v.line.select(F.col("l_linenumber").alias("fraction"), "crop", F.col("price").alias("score")))


@query("run_delta", "setup crop year:i delta:d",
       """SELECT setup, crop, year, b.s - a.s AS delta FROM (SELECT setup, crop, year, avg(y_pred) AS s FROM preds WHERE region < '12' GROUP BY 1, 2, 3) a JOIN
          (SELECT setup, crop, year, avg(y_pred) AS s FROM preds WHERE region >= '12' GROUP BY 1, 2, 3) b USING (setup, crop, year)""", "preds")
def _(v: Views):
    keys = ["setup", "crop", "year"]
    run = lambda cond: v.preds.where(cond).groupBy(*keys).agg(F.avg("y_pred").alias("score"))
    return S.run_delta(run("region < '12'"), run("region >= '12'"), keys)


@query("score_by_year_long", "year:i setup score:d", "SELECT year, CASE setup WHEN 'full_transfer' THEN 'TL' WHEN 'full_direct' THEN 'no TL' ELSE setup END AS setup, r2 AS score FROM scores", "scores")
def _(v: Views):
    wide = v.scores.groupBy("year").pivot("setup", list(SETUPS)).agg(F.max("r2"))
    return S.score_by_year_long(wide, ["year"], list(SETUPS), {"full_transfer": "TL", "full_direct": "no TL"})


@query("value_range", "setup lo:d hi:d", "SELECT setup, least(min(y_true), min(y_pred)) AS lo, greatest(max(y_true), max(y_pred)) AS hi FROM preds GROUP BY 1", "preds")
def _(v: Views):
    return S.value_range(v.preds, "y_true", "y_pred", ["setup"])


@query("setup_year_matrix", "setup " + " ".join(f"{y}:d" for y in YEARS) + " mean:d",
       "SELECT setup, " + ", ".join(f'avg(CASE WHEN year = {y} THEN rmse END) AS "{y}"' for y in YEARS) + ", avg(rmse) AS mean FROM scores GROUP BY 1", "scores")
def _(v: Views):
    return S.setup_year_matrix(v.scores, YEARS)


@query("pooled_r2", "setup crop r2:d n:l", f"SELECT setup, crop, 1 - sum({_E} * {_E}) / (var_pop(y_true) * count(*)) AS r2, count(*) AS n FROM preds GROUP BY 1, 2", "preds")
def _(v: Views):
    return S.pooled_r2(v.preds, ["setup", "crop"])


_CLASS = "SELECT CAST(l_linenumber AS INTEGER) AS label, CAST(1 + floor(l_quantity / 8) AS INTEGER) AS prediction FROM lineitem"


def classes(v: Views):
    return v.table("lineitem").select(F.col("l_linenumber").alias("label"), (1 + F.floor(F.col("l_quantity") / 8)).cast("int").alias("prediction"))


@query("confusion_matrix", "label:i " + " ".join(f"pred_{c}:l" for c in range(1, 8)),
       "SELECT label, " + ", ".join(f"count(CASE WHEN prediction = {c} THEN 1 END) AS pred_{c}" for c in range(1, 8)) + f" FROM ({_CLASS}) GROUP BY 1")
def _(v: Views):
    return S.confusion_matrix(classes(v), list(range(1, 8)))


@query("class_report", "label:i precision:d recall:d f1:d support:l",
       f"""SELECT label, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, support FROM (
           SELECT c AS label, coalesce(count(CASE WHEN label = c AND prediction = c THEN 1 END) / nullif(count(CASE WHEN prediction = c THEN 1 END), 0)::DOUBLE, 0) AS p,
           coalesce(count(CASE WHEN label = c AND prediction = c THEN 1 END) / nullif(count(CASE WHEN label = c THEN 1 END), 0)::DOUBLE, 0) AS r, count(CASE WHEN label = c THEN 1 END) AS support
           FROM ({_CLASS}) JOIN (SELECT DISTINCT label AS c FROM ({_CLASS})) ON c IN (label, prediction) GROUP BY 1)""")
def _(v: Views):
    return S.class_report(classes(v))


# --- importances ---------------------------------------------------------------------

@query("importance_stability", "feature mean:d std:d instability:d",
       """SELECT feature, avg(base_mean) AS mean, stddev_pop(base_mean) AS std, stddev_pop(base_mean) / abs(avg(base_mean)) AS instability FROM imp GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", "imp")
def _(v: Views):
    return S.importance_stability(v.imp, 10, value="base_mean")


@query("importance_top_by_year", "year:i feature base_mean:d finetuned_mean:d rank:i",
       "SELECT * FROM (SELECT year, feature, base_mean, finetuned_mean, row_number() OVER (PARTITION BY year ORDER BY base_mean DESC, feature) AS rank FROM imp) WHERE rank <= 15", "imp")
def _(v: Views):
    return S.importance_top_by_year(v.imp)


_IMP_AGG = ", ".join(f"avg({c}) AS {n}_avg, stddev_pop({c}) AS {n}_std" for c, n in (("base_mean", "base_mean"), ("finetuned_mean", "finetuned_mean"), ("finetuned_mean - base_mean", "change")))


@query("importance_by_group", "level name base_mean_avg:d base_mean_std:d finetuned_mean_avg:d finetuned_mean_std:d change_avg:d change_std:d",
       f"""SELECT 'type' AS level, CASE WHEN feature LIKE 'evi%' OR feature LIKE 'sm%' THEN 'eo' ELSE 'meteo' END AS name, {_IMP_AGG} FROM imp GROUP BY 2
           UNION ALL SELECT 'lead', right(feature, 1), {_IMP_AGG} FROM imp GROUP BY 2 UNION ALL SELECT 'base', split_part(feature, '_', 1), {_IMP_AGG} FROM imp GROUP BY 2""", "imp")
def _(v: Views):
    return S.importance_by_group(v.imp)


@query("importance_topk_normalized", "feature base_share:d finetuned_share:d",
       """SELECT feature, b / sum(b) OVER () AS base_share, f / sum(f) OVER () AS finetuned_share FROM (SELECT feature, avg(base_mean) AS b, avg(finetuned_mean) AS f FROM imp
          GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 7)""", "imp")
def _(v: Views):
    return S.importance_topk_normalized(v.imp)


@query("importance_change_top", "feature mean_change:d std_change:d",
       """SELECT feature, avg(finetuned_mean - base_mean) AS mean_change, stddev_pop(finetuned_mean - base_mean) AS std_change FROM imp GROUP BY 1 ORDER BY abs(avg(finetuned_mean - base_mean)) DESC, 1 LIMIT 20""", "imp")
def _(v: Views):
    return S.importance_change_top(v.imp)


@query("importance_agreement", "year:i r:d", "SELECT year, corr(base_mean, finetuned_mean) AS r FROM imp GROUP BY 1", "imp")
def _(v: Views):
    return S.importance_agreement(v.imp, ["year"])


@query("importance_rank_change", "year:i feature rank_base:i rank_finetuned:i rank_change:i change:d extreme",
       """SELECT *, CASE WHEN row_number() OVER (PARTITION BY year ORDER BY change DESC, feature) <= 3 THEN 'rise' WHEN row_number() OVER (PARTITION BY year ORDER BY change, feature) <= 3 THEN 'fall' ELSE 'middle' END AS extreme
          FROM (SELECT *, rank_base - rank_finetuned AS rank_change FROM (SELECT year, feature, finetuned_mean - base_mean AS change, rank() OVER (PARTITION BY year ORDER BY base_mean DESC) AS rank_base,
          rank() OVER (PARTITION BY year ORDER BY finetuned_mean DESC) AS rank_finetuned FROM imp))""", "imp")
def _(v: Views):
    return S.importance_rank_change(v.imp)


_RUNS = "SELECT c_year AS year, l_linenumber AS hp, avg(l_quantity) / 50 AS score FROM line GROUP BY 1, 2"


@query("hp_leaderboard", "hp:i mean_score:d n_runs:l place:i",
       f"SELECT *, row_number() OVER (ORDER BY mean_score DESC, hp) AS place FROM (SELECT hp, avg(score) AS mean_score, count(score) AS n_runs FROM ({_RUNS}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)", "line")
def _(v: Views):
    runs = v.line.groupBy(F.col("c_year").alias("year"), F.col("l_linenumber").alias("hp")).agg((F.avg("l_quantity") / 50).alias("score"))
    return S.hp_leaderboard(runs, ["hp"], "score", default={"hp": 1})
