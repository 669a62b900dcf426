"""Sorts, limits, samples, set operations, folds and roles."""

from pyspark.sql import functions as F

from harvestline.functions.scalars import admin_key
from harvestline.operators import sampling as P, sets as U
from harvestline.registry.base import query
from harvestline.registry.views import Views


@query("sort_by", "year:i region crop setup y_pred:d", "SELECT year, region, crop, setup, y_pred FROM preds ORDER BY year, region, crop, setup", "preds")
def _(v: Views):
    return P.sort_by(v.preds, "year", "region", "crop", "setup")


@query("top_k", "region year:i crop setup err:d", """SELECT region, year, crop, setup, y_pred - y_true AS err FROM preds
        ORDER BY abs(y_pred - y_true) DESC, region, year, crop, setup LIMIT 10""", "preds")
def _(v: Views):
    df = v.preds.withColumn("err", F.col("y_pred") - F.col("y_true"))
    return P.top_k(df, 10, F.desc(F.abs("err")), ["region", "year", "crop", "setup"])


@query("cap_per_group", "nation:i field_id:l", """SELECT nation, field_id FROM (SELECT *, row_number() OVER (PARTITION BY nation
        ORDER BY md5(CAST(field_id AS VARCHAR) || '_7'), field_id) AS rn FROM parcels WHERE area >= 0.1) WHERE rn <= 3""", "parcels")
def _(v: Views):
    return P.cap_per_group(v.parcels, ["nation"], "field_id", 3, 7, area="area")


ORDER_ID = "md5(CAST(o_orderkey AS VARCHAR) || '_42')"


@query("lowest_fraction", "o_orderkey:l yield:d", f"""SELECT o_orderkey, "yield" FROM (SELECT o_orderkey, round(o_totalprice / 1000) AS "yield",
        row_number() OVER (ORDER BY round(o_totalprice / 1000), {ORDER_ID}) AS rn, count(*) OVER () AS n FROM orders) WHERE rn <= floor(n * 0.3 + 0.5)""")
def _(v: Views):
    df = v.table("orders").select("o_orderkey", F.round(F.col("o_totalprice") / 1000).alias("yield"))
    return P.lowest_fraction(df, "yield", "o_orderkey", 0.3)


@query("random_fraction", "o_orderkey:l", f"""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {ORDER_ID}, o_orderkey) AS rn,
        count(*) OVER () AS n FROM orders) WHERE rn <= floor(n * 0.1 + 0.5)""")
def _(v: Views):
    return P.random_fraction(v.table("orders"), ["o_orderkey"], 0.1)


@query("every_nth", "region_id obs_date:t n:l", """SELECT region_id, obs_date, count(*) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY region_id ORDER BY obs_date) AS k
        FROM line) WHERE (k - 1) % 5 = 0 GROUP BY 1, 2""", "line")
def _(v: Views):
    return P.every_nth(v.line, ["region_id"], "obs_date", 5).groupBy("region_id", "obs_date").agg(F.count(F.lit(1)).alias("n"))


@query("dedupe_first", "region_id obs_date:t event_id:l", """SELECT region_id, obs_date, min_by(event_id, (ts, event_id)) AS event_id FROM
        (SELECT *, CAST(ts AS TIMESTAMP) AS t0 FROM obs) GROUP BY 1, 2""", "obs")
def _(v: Views):
    return P.dedupe_first(v.obs, ["region_id", "obs_date"], [F.col("ts"), F.col("event_id")])


# --- set operations ------------------------------------------------------------------

@query("union_labelled", "crop region_id yield:d", """SELECT 'wheat' AS crop, region_id, "yield" FROM panel WHERE crop = 'A'
        UNION ALL SELECT 'maize', region_id, "yield" FROM panel WHERE crop = 'N'""", "panel")
def _(v: Views):
    cols = ["region_id", "yield"]
    return U.union_labelled({"wheat": v.panel.where("crop = 'A'").select(*cols), "maize": v.panel.where("crop = 'N'").select(*cols)}, "crop")


@query("union_common_columns", "region_id c_year:i yield:d", 'SELECT region_id, c_year, "yield" FROM panel UNION ALL SELECT region_id, c_year, "yield" FROM features', "panel features")
def _(v: Views):
    return U.union_common_columns([v.panel, v.features])


@query("intersect_years", "c_year:i", "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS c_year FROM orders INTERSECT SELECT CAST(year(l_shipdate) AS INTEGER) FROM lineitem WHERE l_returnflag = 'A'")
def _(v: Views):
    return U.intersect_years(v.table("orders").select(F.year("o_orderdate").alias("c_year")), v.line.where("crop = 'A'"))


@query("except_rows", "region_id c_year:i yield:d", "SELECT * FROM panel1 WHERE c_year <> 1999", "panel1")
def _(v: Views):
    return U.except_rows(v.panel1, v.panel1.where("c_year = 1999"), ["region_id", "c_year"])


@query("distinct_values", "region_id c_year:i", "SELECT DISTINCT region_id, c_year FROM panel", "panel")
def _(v: Views):
    return U.distinct_values(v.panel, "region_id", "c_year")
