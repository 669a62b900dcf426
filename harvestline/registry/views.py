"""The given tables seen as tables of the yield-forecasting domain.

Every view exists twice: as a Spark DataFrame (``Views``) and as SQL (``CTES``).

=============  ======================================================================
series         order lines as observations of a supplier's region: quantity as ``evi``,
               price as ``t2m``, tax as ``tp``
daily          series reduced to one value per region, parameter and day
obs / odaily   events as irregular observations of a user's plot, and their daily means
panel          yield per region, crop (return flag) and year: mean price
features       yield and quarterly means ``<param>_LT<k>`` per region and year
preds          observed yield and five sets of "forecasts" mixed from other columns
scores         RMSE, MAE and R2 per setup and year
imp            importances: correlation with the yield in two groups of regions
pixels         order lines as pixels; polygons are built from nations and suppliers
catalog        orders as scenes
=============  ======================================================================
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestline.functions.metrics import pearson, score_columns
from harvestline.functions.scalars import admin_key
from harvestline.operators.timeseries import resample_daily
from harvestline.session import ship_package
from harvestline.sources.tables import to_region_series, with_bbox

FEATURES = [f"{p}_LT{k}" for k in (4, 3, 2, 1) for p in ("evi", "sm", "t2m", "tp")]
SOURCES = {"evi": "l_quantity / 50", "sm": "l_discount * 10", "t2m": "price", "tp": "tax"}
# forecasts: y_pred = a * yield + b * mean quantity + c * mean tax
SETUPS = {"full_transfer": (0.9, 0.02, 0.0), "full_direct": (0.7, 0.06, 0.01), "eo_transfer": (0.5, 0.1, 0.02),
          "eo_direct": (0.4, 0.12, -0.01), "meteo_direct": (0.2, 0.16, 0.03)}
CELL_W, CELL_H, SHEAR = 21.0, 20.5, 0.05

REGION_SQL = "lpad(cast({k} % 25 AS varchar), 2, '0') || reverse(lpad(cast({k} AS varchar), 6, '0'))"


def region_code(key: str):
    k = F.col(key)
    return F.concat(F.lpad((k % 25).cast("string"), 2, "0"), F.reverse(F.lpad(k.cast("string"), 6, "0")))


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship_package(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def line(self) -> DataFrame:
        return self.table("lineitem").select(
            region_code("l_suppkey").alias("region_id"), F.to_date("l_shipdate").alias("obs_date"),
            F.year("l_shipdate").alias("c_year"), F.col("l_returnflag").alias("crop"), "l_quantity",
            (F.col("l_extendedprice") / 1000).alias("price"), (F.col("l_tax") * 100).alias("tax"),
            "l_discount", "l_linenumber", "l_partkey", "l_orderkey", "l_suppkey")

    @cached_property
    def series(self) -> DataFrame:
        params = F.array(*[F.struct(F.lit(p).alias("param"), F.expr(SOURCES[p]).alias("value")) for p in ("evi", "t2m", "tp")])
        return self.line.select("region_id", "obs_date", F.inline(params))

    @cached_property
    def daily(self) -> DataFrame:
        """All parameters are averaged in one shuffle, then unpivoted."""
        return self._daily_means(F.col("region_id"))

    def _daily_means(self, region) -> DataFrame:
        means = [F.avg(F.expr(SOURCES[p])).alias(p) for p in ("evi", "t2m", "tp")]
        wide = self.line.groupBy(region.alias("region_id"), "obs_date").agg(*means)
        return to_region_series(wide, ["region_id", "obs_date"], ["evi", "t2m", "tp"])

    @cached_property
    def country_daily(self) -> DataFrame:
        """One daily series per country and parameter: dense over seven years."""
        return self._daily_means(admin_key("region_id"))

    @cached_property
    def obs(self) -> DataFrame:
        return self.table("events").select(
            "event_id", F.col("user_id").cast("string").alias("region_id"), F.col("event_type").alias("param"),
            F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("obs_date"), "value",
            F.get_json_object("props", "$.k").cast("int").alias("flag"))

    @cached_property
    def odaily(self) -> DataFrame:
        return resample_daily(self.obs)

    @cached_property
    def panel(self) -> DataFrame:
        return self.line.groupBy("region_id", "crop", "c_year").agg((F.avg("price") / 10).alias("yield"))

    @cached_property
    def panel1(self) -> DataFrame:
        return self.line.groupBy("region_id", "c_year").agg((F.avg("price") / 10).alias("yield"))

    @cached_property
    def features(self) -> DataFrame:
        quarter = F.quarter("obs_date")
        cells = [F.avg(F.when(quarter == 5 - int(f[-1]), F.expr(SOURCES[f[:-4]]))).alias(f) for f in FEATURES]
        return self.line.groupBy("region_id", "c_year").agg((F.avg("price") / 10).alias("yield"), *cells)

    @cached_property
    def preds(self) -> DataFrame:
        base = self.line.groupBy(F.col("region_id").alias("region"), F.col("crop"), F.col("c_year").alias("year")).agg(
            (F.avg("price") / 10).alias("y_true"), F.avg("l_quantity").alias("_q"), F.avg("tax").alias("_t"))
        sets = F.array(*[F.struct(F.lit(s).alias("setup"), F.expr(f"{a} * y_true + {b} * _q + {c} * _t").alias("y_pred"))
                         for s, (a, b, c) in SETUPS.items()])
        df = base.select("region", "crop", "year", "y_true", F.inline(sets))
        return df.withColumns({"feature_type": F.split("setup", "_")[0], "mode": F.split("setup", "_")[1]})

    @cached_property
    def scores(self) -> DataFrame:
        s = score_columns("y_true", "y_pred")
        return self.preds.groupBy("setup", "feature_type", "mode", "year").agg(
            s["rmse"].alias("rmse"), s["mae"].alias("mae"), s["r2"].alias("r2"))

    @cached_property
    def imp(self) -> DataFrame:
        long = self.features.unpivot(["region_id", "c_year", "yield"], FEATURES, "feature", "value")
        group = F.substring("region_id", 1, 2) < "12"
        r = lambda flag: F.abs(pearson(F.when(flag, F.col("value")), "yield"))
        return long.groupBy(F.col("c_year").alias("year"), "feature").agg(
            r(group).alias("base_mean"), r(~group).alias("finetuned_mean"))

    @cached_property
    def pixels(self) -> DataFrame:
        return self.line.select(
            F.date_format("obs_date", "yyyy-MM").alias("scene_id"), "obs_date", F.col("crop").alias("band"),
            F.col("l_quantity").cast("int").alias("row"), F.floor("price").cast("int").alias("col"),
            F.col("price").alias("x"), (F.col("l_quantity") * 2 + F.col("l_discount") * 10).alias("y"),
            F.round("tax").alias("value"), F.col("l_linenumber").alias("scl"))

    @cached_property
    def regions(self) -> DataFrame:
        """Nations as a 5x5 mosaic of sheared cells with shared corners."""
        i, j = F.col("n_nationkey") % 5, F.floor(F.col("n_nationkey") / 5)
        corners = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
        x = lambda a, b: (i + a) * F.lit(CELL_W) + (j + b) * F.lit(SHEAR * CELL_H)
        y = lambda a, b: (j + b) * F.lit(CELL_H)
        df = self.table("nation").select(
            F.col("n_name").alias("region_id"), "n_nationkey", "n_regionkey",
            F.array(*[x(a, b) for a, b in corners]).alias("xs"), F.array(*[y(a, b) for a, b in corners]).alias("ys"))
        return with_bbox(df)

    @cached_property
    def parcels(self) -> DataFrame:
        """Suppliers as small triangles."""
        cx = (F.col("s_acctbal") + 1000) / 110
        cy = (F.col("s_suppkey") * 37 % 1000) / F.lit(10.0)
        df = self.table("supplier").select(
            F.col("s_suppkey").alias("field_id"), F.col("s_nationkey").alias("nation"),
            F.array(cx, cx + 1.5, cx + 0.5, cx).alias("xs"), F.array(cy, cy + 0.25, cy + 1.25, cy).alias("ys"),
            (F.abs("s_acctbal") / 5000).alias("area"))
        return with_bbox(df)

    @cached_property
    def catalog(self) -> DataFrame:
        x, y = (F.col("o_custkey") * 7919 % 1000) / F.lit(10.0), (F.col("o_orderkey") * 31 % 1000) / F.lit(10.0)
        return self.table("orders").select(
            F.col("o_orderkey").alias("scene_id"), F.col("o_orderpriority").alias("collection"),
            F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("begin_ts"),
            x.alias("min_x"), y.alias("min_y"), (x + 5).alias("max_x"), (y + 5).alias("max_y"),
            (F.col("o_totalprice") / 5000).alias("cloud_cover"))


def _series_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT region_id, obs_date, '{p}' AS param, {SOURCES[p]} AS value FROM line" for p in ("evi", "t2m", "tp"))


def _features_sql() -> str:
    cells = ", ".join(
        f'avg(CASE WHEN quarter(obs_date) = {5 - int(f[-1])} THEN {SOURCES[f[:-4]]} END) AS "{f}"' for f in FEATURES)
    return f'SELECT region_id, c_year, avg(price) / 10 AS "yield", {cells} FROM line GROUP BY 1, 2'


def _preds_sql() -> str:
    base = ("(SELECT region_id AS region, crop, c_year AS year, avg(price) / 10 AS y_true, avg(l_quantity) AS q,"
            " avg(tax) AS t FROM line GROUP BY 1, 2, 3)")
    return " UNION ALL ".join(
        f"SELECT region, crop, year, y_true, '{s}' AS setup, {a} * y_true + {b} * q + {c} * t AS y_pred,"
        f" '{s.split('_')[0]}' AS feature_type, '{s.split('_')[1]}' AS mode FROM {base}" for s, (a, b, c) in SETUPS.items())


def _imp_sql() -> str:
    long = " UNION ALL ".join(
        f"SELECT region_id, c_year, \"yield\", '{f}' AS feature, \"{f}\" AS value FROM features" for f in FEATURES)
    first = "substr(region_id, 1, 2) < '12'"
    return (f"SELECT c_year AS year, feature, abs(corr(CASE WHEN {first} THEN value END, \"yield\")) AS base_mean,"
            f" abs(corr(CASE WHEN NOT {first} THEN value END, \"yield\")) AS finetuned_mean FROM ({long}) GROUP BY 1, 2")


def _ring_sql() -> tuple[str, str]:
    corners = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    xs = ", ".join(f"(i + {a}) * {CELL_W}::DOUBLE + (j + {b}) * {SHEAR * CELL_H}::DOUBLE" for a, b in corners)
    ys = ", ".join(f"(j + {b}) * {CELL_H}::DOUBLE" for a, b in corners)
    return f"[{xs}]", f"[{ys}]"


_BOX = "list_min(xs) AS min_x, list_max(xs) AS max_x, list_min(ys) AS min_y, list_max(ys) AS max_y"

# name: (views it reads, SQL)
CTES: dict[str, tuple[str, str]] = {
    "line": ("", f"""SELECT {REGION_SQL.format(k='l_suppkey')} AS region_id, CAST(l_shipdate AS DATE) AS obs_date,
        CAST(year(l_shipdate) AS INTEGER) AS c_year, l_returnflag AS crop, l_quantity, l_extendedprice / 1000 AS price,
        l_tax * 100 AS tax, l_discount, l_linenumber, l_partkey, l_orderkey, l_suppkey FROM lineitem"""),
    "series": ("line", _series_sql()),
    "daily": ("series", "SELECT region_id, param, obs_date, avg(value) AS value FROM series GROUP BY 1, 2, 3"),
    "country_daily": ("series", """SELECT substr(region_id, 1, 2) AS region_id, param, obs_date, avg(value) AS value
        FROM series GROUP BY 1, 2, 3"""),
    "obs": ("", """SELECT event_id, CAST(user_id AS VARCHAR) AS region_id, event_type AS param, ts, CAST(ts AS DATE) AS obs_date,
        value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS flag FROM events"""),
    "odaily": ("obs", "SELECT region_id, param, obs_date, avg(value) AS value FROM obs GROUP BY 1, 2, 3"),
    "panel": ("line", 'SELECT region_id, crop, c_year, avg(price) / 10 AS "yield" FROM line GROUP BY 1, 2, 3'),
    "panel1": ("line", 'SELECT region_id, c_year, avg(price) / 10 AS "yield" FROM line GROUP BY 1, 2'),
    "features": ("line", _features_sql()),
    "preds": ("line", _preds_sql()),
    "scores": ("preds", """SELECT setup, feature_type, mode, year, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse,
        avg(abs(y_pred - y_true)) AS mae, 1 - sum((y_pred - y_true) * (y_pred - y_true)) / (var_pop(y_true) * count(*)) AS r2
        FROM preds GROUP BY 1, 2, 3, 4"""),
    "imp": ("features", _imp_sql()),
    "pixels": ("line", """SELECT strftime(obs_date, '%Y-%m') AS scene_id, obs_date, crop AS band, CAST(l_quantity AS INTEGER) AS "row",
        CAST(floor(price) AS INTEGER) AS col, price AS x, l_quantity * 2 + l_discount * 10 AS y, round(tax) AS value,
        l_linenumber AS scl FROM line"""),
    "regions": ("", f"""SELECT *, {_BOX} FROM (SELECT n_name AS region_id, n_nationkey, n_regionkey, {_ring_sql()[0]} AS xs, {_ring_sql()[1]} AS ys
        FROM (SELECT *, n_nationkey % 5 AS i, n_nationkey // 5 AS j FROM nation))"""),
    "parcels": ("", f"""SELECT *, {_BOX} FROM (SELECT s_suppkey AS field_id, s_nationkey AS nation, [cx, cx + 1.5, cx + 0.5, cx] AS xs,
        [cy, cy + 0.25, cy + 1.25, cy] AS ys, abs(s_acctbal) / 5000 AS area
        FROM (SELECT *, (s_acctbal + 1000) / 110 AS cx, (s_suppkey * 37 % 1000) / 10.0::DOUBLE AS cy FROM supplier))"""),
    "catalog": ("", """SELECT *, min_x + 5 AS max_x, min_y + 5 AS max_y FROM (SELECT o_orderkey AS scene_id, o_orderpriority AS collection,
        o_orderstatus AS status, o_orderdate AS begin_ts, (o_custkey * 7919 % 1000) / 10.0::DOUBLE AS min_x,
        (o_orderkey * 31 % 1000) / 10.0::DOUBLE AS min_y, o_totalprice / 5000 AS cloud_cover FROM orders)"""),
}
