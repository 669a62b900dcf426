import numpy as np
import pytest
from hypothesis import Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from harvestline.functions.scalars import db_to_linear, linear_to_db, parse_decimal_comma, parse_scene_date
from harvestline.operators import panel as P, rows as R, scores as S, statistics as T
from harvestline.sources import tables as B
from harvestline.session import scratch_path


def test_decibel_round_trip(spark):
    df = spark.range(-50, 50).select(F.col("id").cast("double").alias("x"))
    worst = df.select(F.max(F.abs(linear_to_db(db_to_linear("x")) - F.col("x")))).first()[0]
    assert worst < 1e-9


def test_scene_dates(spark):
    names = ["2020061", "S2A_20200301_B04.tif", "2020-03-01_evi", "MOD13Q1.A2020061.h18v04.hdf", "field_42"]
    got = [str(r[0]) for r in spark.createDataFrame([(n,) for n in names], "n string").select(parse_scene_date("n")).collect()]
    assert got == ["2020-03-01"] * 4 + ["None"]


@pytest.mark.parametrize("text, value", [("12,5", 12.5), ("1.234,5", 1234.5), ("-0,25", -0.25), ("n/a", None), ("7", 7.0)])
def test_decimal_comma(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(parse_decimal_comma("t")).first()[0] == value


def test_regression_fixture(spark):
    df = spark.createDataFrame([(2000, 5.0), (2001, 6.0), (2002, None), (2003, 9.0)], "c_year int, yield double")
    r = P.linregress(df, "c_year", "yield").first()
    assert abs(r.slope - 1.3571428571) < 1e-9 and abs(r.intercept + 2709.4285714) < 1e-6 and r.n == 3


def test_constant_series_gives_null_not_nan(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "x int, y double")
    assert P.linregress(df, "x", "y").first().r is None


def test_detrended_panel_has_no_slope_and_keeps_its_mean(spark):
    df = spark.createDataFrame([("r", y, 2.0 + 0.3 * (y - 2000) + (y % 3)) for y in range(2000, 2020)], "region_id string, c_year int, yield double")
    r = P.detrend_keep_mean(df).select(F.regr_slope("y_detrended", "c_year"), F.avg("y_detrended") - F.avg("yield")).first()
    assert abs(r[0]) < 1e-9 and abs(r[1]) < 1e-9


def test_t_test_fixture(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 4.0)] + [("b", v) for v in (3.0, 7.0, 8.0, 6.0)], "g string, v double")
    for r in T.ttest_groups(df, "v", "g", with_p=True).collect():
        assert abs(abs(r.t) - 2.4846467330) < 1e-9 and abs(r.p - 0.0555) < 5e-5


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (2.0, 5.0), (4.0, 3.0), (7.0, 9.0)], "x double, y double")
    assert abs(T.spearman_ci(df, "y", ["x"]).first().r - 0.7631578947) < 1e-9


def test_moran_sign(spark):
    n = 20
    edges = spark.createDataFrame([(str(i), str(j), 0.5 if 0 < i < n - 1 else 1.0) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n], "src string, dst string, w double")
    smooth = spark.createDataFrame([(str(i), float(i)) for i in range(n)], "region_id string, value double")
    checker = spark.createDataFrame([(str(i), float(i % 2)) for i in range(n)], "region_id string, value double")
    assert T.morans_i(smooth, edges).first().i > 0.7 and T.morans_i(checker, edges).first().i < -0.9
    assert T.morans_p(smooth, edges, permutations=49).first().p_sim <= 0.04


def test_density_integrates_to_one(spark):
    df = spark.createDataFrame([("g", float(v)) for v in np.random.default_rng(0).normal(size=200)], "g string, v double")
    c = T.kde_curve(df, "v", ["g"], points=200).toPandas().sort_values("x")
    assert abs(np.trapezoid(c.density, c.x) - 1) < 0.01


def test_outlier_fence_fixture(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 5, 9, 11, 4, 17, 60]], "value double")
    kept = [r.value for r in R.iqr_outliers(df, []).collect()]
    assert kept.count(None) == 1 and 60.0 not in kept
    few = spark.createDataFrame([(1.0,), (2.0,), (999.0,)], "value double")
    assert 999.0 in [r.value for r in R.iqr_outliers(few, []).collect()]


def test_scaling_uses_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "a double, b double")
    test = spark.createDataFrame([(5.0, 8.0)], "a double, b double")
    z, zt = R.standardize(train, [test], ["a", "b"])
    assert sorted(r.a for r in z.collect()) == [-1.0, 1.0] and tuple(zt.first()) == (3.0, 1.0)
    back = R.unstandardize(zt, train, {"a": "a"}).first()
    assert back.a == 5.0


@settings(max_examples=4, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(st.tuples(st.floats(1, 100), st.floats(1, 100)), min_size=3, max_size=30))
def test_metrics_equal_numpy(spark, pairs):
    y, p = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
    r = S.regression_metrics(spark.createDataFrame([("s", float(a), float(b)) for a, b in pairs], "setup string, y_true double, y_pred double")).first()
    assert np.isclose(r.rmse, np.sqrt(((y - p) ** 2).mean())) and np.isclose(r.mae, np.abs(y - p).mean()) and np.isclose(r.med_bias, np.median(p - y))
    if np.var(y) > 1e-6:
        assert np.isclose(r.r2, 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rtol=1e-6, atol=1e-6)


def test_missing_pairs_do_not_count(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0), ("s", None, 2.0), ("s", 1.0, None)], "setup string, y_true double, y_pred double")
    assert S.regression_metrics(df).first().n == 1


def test_repeated_stat_row_stops(spark):
    df = spark.createDataFrame([("k", "B04_median", 1.0), ("k", "B04_median", 2.0), ("k", "B04_std", 1.0)], "k string, band_stat string, value double")
    with pytest.raises(Exception, match="repeated statistics row"):
        P.split_stat_rows(df, ["k"]).collect()


def test_hp_default_when_no_run(spark):
    runs = spark.createDataFrame([], "hp int, year int, score double")
    assert S.hp_leaderboard(runs, ["hp"], "score", default={"hp": 16}).first().hp == 16


def test_manifest_numbers_runs(spark):
    path = scratch_path(spark, "manifest")
    assert [B.append_manifest(spark, path, {"lead": i}) for i in range(3)] == [1, 2, 3]


def test_own_score_next_to_the_built_in_ones(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0), ("s", 3.0, 7.0)], "setup string, y_true double, y_pred double")
    r = S.regression_metrics(df, custom={"worst": lambda o, p: F.max(F.abs(p - o))}).first()
    assert r.worst == 4.0 and r.mae == 2.5


def test_conformed_tables_hold_no_nan(spark):
    from harvestline.schemas import SERIES

    df = spark.createDataFrame([(1, "p", "2020-01-01", float("nan")), (2, "p", "2020-01-02", 1.5)], "region_id int, param string, obs_date string, value double")
    out = B.conform(df, SERIES)
    assert out.schema == SERIES and [r.value for r in out.orderBy("region_id").collect()] == [None, 1.5]


def test_registered_rank_correlation_has_every_predictor(spark, tmp_path):
    """One row for each of the 16 predictors, as in the query's SQL."""
    import duckdb

    import __spark_entry__ as registry
    from harvestline.registry.views import FEATURES

    rng = np.random.default_rng(5)
    n = 900
    rows = [(int(i), int(i % 40), int(i % 30), 1, float(q), float(p), float(d) / 100, float(t) / 100, "R", "2000-%02d-05" % (i % 12 + 1))
            for i, (q, p, d, t) in enumerate(zip(rng.integers(1, 50, n), rng.uniform(900, 90000, n).round(2), rng.integers(0, 10, n), rng.integers(0, 8, n)))]
    cols = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, day string"
    table = spark.createDataFrame(rows, cols).withColumn("l_shipdate", F.to_timestamp("day")).drop("day")
    table.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = registry.queries()["spearman_ci"](spark, str(tmp_path)).collect()
    assert sorted(r.feature for r in got) == sorted(FEATURES)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    wanted = {r[0]: r[1:] for r in con.execute(registry.oracle_sql()["spearman_ci"]).fetchall()}
    assert wanted == {r.feature: tuple(r)[1:] for r in got}
