import glob
import os

import duckdb
import pytest

import __spark_entry__ as registry

SF = "/root/testdata/sf0.001"
QUICK = ["catalog_search", "zonal_median_std", "lead_features_tail", "detrend_gap_filled", "regression_metrics", "morans_i", "folds_time_series"]


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) > 200


def test_entry_runs(spark):
    df = registry.entry(spark)
    assert df.count() > 0 and "rmse" in df.columns


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = registry.queries()[name](spark, SF)
    got = sorted(map(str, (tuple(r) for r in df.collect())))
    cur = con.execute(registry.oracle_sql()[name])
    assert [d[0] for d in cur.description] == df.columns
    assert got == sorted(map(str, cur.fetchall()))


@pytest.mark.parametrize("name", ["catalog_search_box", "pixel_in_polygon", "zonal_median_std", "lead_features_tail", "queen_neighbors", "region_year_skeleton", "lowest_fraction"])
def test_plans_have_no_cross_join_and_read_few_columns(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    for line in plan.splitlines():
        if "FileScan" in line and "lineitem" in line:
            assert "l_linestatus" not in line


def test_filters_reach_the_scan(spark):
    plan = registry.queries()["catalog_search_box"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "o_orderdate" in plan.split("PushedFilters: [")[1].split("]")[0]
