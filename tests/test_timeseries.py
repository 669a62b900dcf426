import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harvestline.operators import leads as L, timeseries as S


def series(spark, values, start="2020-01-01", region="r", param="p"):
    first = dt.date.fromisoformat(start)
    rows = [(region, param, first + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "region_id string, param string, obs_date date, value double")


@pytest.mark.parametrize("start, first", [("2020-01-01", "2020-01-05"), ("2020-01-04", "2020-01-05"), ("2020-01-06", "2020-01-12")])
def test_two_week_bins_start_at_first_sunday(spark, start, first):
    out = S.resample_2w(series(spark, [1.0] * 60, start)).orderBy("label").toPandas()
    labels = [str(d) for d in out.label]
    assert labels[0] == first
    gaps = {(b - a).days for a, b in zip(out.label, out.label[1:])}
    assert gaps == {14}


def test_two_week_means_match_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"d": pd.date_range("2019-03-05", periods=200)[rng.random(200) < 0.6]})
    pdf["v"] = rng.normal(size=len(pdf))
    df = spark.createDataFrame([("r", "p", d.date(), float(v)) for d, v in zip(pdf.d, pdf.v)], "region_id string, param string, obs_date date, value double")
    got = S.resample_2w(df).toPandas().set_index("label").value.sort_index()
    want = pdf.set_index("d").v.resample("2W").mean().dropna()
    assert np.allclose(got.to_numpy(), want.to_numpy())
    assert [str(d) for d in got.index] == [str(d.date()) for d in want.index]


def test_several_rows_per_day_bin_like_their_mean(spark):
    df = series(spark, [1.0, 2.0, 6.0]).union(series(spark, [3.0, 4.0, 8.0]))
    whole = S.resample_weekly(df, one_per_day=False).collect()
    assert [(r.value) for r in whole] == [4.0]


def test_interpolation_by_position(spark):
    out = S.interpolate_linear(series(spark, [None, 1.0, None, None, 4.0, None])).orderBy("obs_date").toPandas()
    assert math.isnan(out.value[0])
    assert list(out.value[1:]) == [1.0, 2.0, 3.0, 4.0, 4.0]


@pytest.mark.parametrize("alpha", [0.05, 2 / 3, 1.0])
def test_ewm_equals_pandas(spark, alpha):
    values = [float(v) for v in np.random.default_rng(1).normal(size=900)]
    got = S.ewm_smooth(series(spark, values), alpha=alpha).orderBy("obs_date").toPandas().smoothed
    assert np.allclose(got, pd.Series(values).ewm(alpha=alpha).mean(), rtol=1e-9)


def test_rolling_mean_rows_is_two_n_wide(spark):
    out = S.rolling_mean_rows(series(spark, [float(i) for i in range(10)]), n=2).orderBy("obs_date").toPandas().smoothed
    assert out[:2].isna().all() and out[8:].isna().all()
    assert list(out[2:8]) == [np.mean([i - 2, i - 1, i, i + 1]) for i in range(2, 8)]


def test_rolling_days_take_samples_of_both_sides(spark):
    fine = series(spark, [float(i) for i in range(20)]).withColumn("ts", F.col("obs_date").cast("timestamp"))
    coarse = fine.where("obs_date = '2020-01-10'").select("region_id", "param", "ts")
    out = S.rolling_mean_days(fine, coarse, d=3, in_db=False).collect()
    assert out[0].smoothed == 9.0
    gauss = S.rolling_gauss_days(fine, coarse, d=3, in_db=False).collect()
    assert abs(gauss[0].smoothed - 9.0) < 1e-9


def test_detrended_series_has_no_slope(spark):
    values = [3 + 0.5 * i + (-1) ** i for i in range(50)]
    out = S.detrend_series(series(spark, values))
    slope = out.select(F.regr_slope("detrended", F.datediff("obs_date", F.lit("2020-01-01")))).first()[0]
    assert abs(slope) < 1e-9


def test_anomaly_of_a_pure_cycle_is_small(spark):
    values = [math.sin(2 * math.pi * i / 365.25) for i in range(4 * 365)]
    out = S.anomaly(series(spark, values, "2001-01-01")).select(F.max(F.abs("anom"))).first()[0]
    assert out < 0.05


def test_leap_years_share_calendar_slots(spark):
    rows = spark.createDataFrame([("2019-03-01",), ("2020-03-01",), ("2020-02-29",)], "d string").select(F.to_date("d").alias("d"))
    assert [r[0] for r in rows.select(S.calendar_slot("d")).collect()] == [61, 61, 60]


def test_lead_windows_head_tail_and_blocks(spark):
    df = series(spark, [float(i) for i in range(200)], "2020-01-01", param="evi")
    weekly = S.resample_weekly(df)
    days = spark.createDataFrame([("r", 7, 1)], "region_id string, month int, day int")
    years = spark.createDataFrame([(2020,)], "c_year int")
    cal = L.harvest_calendar(days, years, days_before=1)
    assert str(cal.first().harvest) == "2020-06-30"
    season = L.in_season(weekly, cal, ["region_id"])
    labels = sorted(str(r.label) for r in season.collect())
    assert labels[0] == "2020-03-01" and labels[-1] == "2020-06-28"
    ordered = [r.value for r in season.orderBy("label").collect()]
    head = L.lead_features_head(season, ["evi"], 4).first()
    assert [head[f"evi_LT{k}"] for k in (4, 3, 2, 1)] == ordered[:4]
    tail = L.lead_features_tail(season, ["evi"], 4).first()
    assert [tail[f"evi_LT{k}"] for k in (4, 3, 2, 1)] == ordered[-4:]
    blocks = L.lead_features_blocks(season, ["evi"], 4, 4).first()
    assert blocks["evi_LT1"] == np.mean(ordered[-4:]) and blocks["evi_LT4"] == np.mean(ordered[-16:-12])


def test_cumulative_leads(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    assert tuple(L.cumulative_leads(df, ["a", "b", "c"]).first()) == (1.0, 3.0, 6.0)
    assert tuple(L.cumulative_leads(df, ["a", "b", "c"], compounding=True).first()) == (1.0, 3.0, 7.0)


def test_months_are_gathered_before_they_are_added_up(spark, capsys):
    rows = [("r", "evi", f"2020-01-{d:02d}", float(d)) for d in range(1, 32)] + [("r", "evi", "2020-02-29", None), (None, "evi", "2020-02-01", 3.0)]
    daily = spark.createDataFrame(rows, "region_id string, param string, d string, value double").withColumn("obs_date", F.to_date("d"))
    means = lambda **kw: sorted((str(r.region_id), str(r.label), r.value) for r in S.resample_monthly(daily, **kw).collect())
    assert means() == means(one_per_day=False) == [("None", "2020-02-29", 3.0), ("r", "2020-01-31", 16.0), ("r", "2020-02-29", None)]
    capsys.readouterr()
    S.resample_monthly(daily).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and plan.index("partial_avg") < plan.index("Exchange"), plan
