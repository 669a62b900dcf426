"""Sources, sinks and catalogue queries."""

from pyspark.sql import functions as F, types as T

from harvestline.registry.base import query
from harvestline.registry.views import SETUPS, Views
from harvestline.session import scratch_path
from harvestline.sources import catalog as C, tables as S

PANEL_SQL = 'SELECT region_id, crop, c_year, "yield" FROM panel'
PANEL_OUT = "region_id crop c_year:i yield:d"


@query("scan_delimited", PANEL_OUT, PANEL_SQL, "panel")
def _(v: Views):
    """Panel written as semicolon text with decimal commas and a null token, then scanned."""
    path = scratch_path(v.spark, "delimited")
    text = F.coalesce(F.regexp_replace(F.col("yield").cast("string"), r"\.", ","), F.lit("none"))
    (v.panel.withColumn("yield", text).write.option("sep", ";").option("header", True)
     .option("encoding", "ISO-8859-1").csv(path))
    schema = T.StructType.fromDDL("region_id string, crop string, c_year int, yield double")
    return S.scan_delimited(v.spark, path, schema, null_token="none")


@query("scan_columnar", PANEL_OUT, PANEL_SQL, "panel")
def _(v: Views):
    path = scratch_path(v.spark, "columnar")
    S.sink_columnar(v.panel, path)
    return S.scan_columnar(v.spark, path, ["region_id", "crop", "c_year", "yield"])


@query("sink_columnar", "crop n:l mean_yield:d", 'SELECT crop, count(*) AS n, avg("yield") AS mean_yield FROM panel GROUP BY 1', "panel")
def _(v: Views):
    path = scratch_path(v.spark, "columnar")
    S.sink_columnar(v.panel, path)
    return S.scan_columnar(v.spark, path).groupBy("crop").agg(F.count(F.lit(1)).alias("n"), F.avg("yield").alias("mean_yield"))


@query("scan_many_union", "region_id obs_date:t median:d cloud:d",
       """SELECT region_id, obs_date, min(a) AS median, CASE WHEN bool_or(src = 'A') THEN NULL ELSE min(c) END AS cloud FROM (
            SELECT region_id, obs_date, 'A' AS src, max(price) AS a, NULL AS c FROM line WHERE crop = 'A' GROUP BY 1, 2
            UNION ALL SELECT region_id, obs_date, 'N', max(price), max(tax) FROM line WHERE crop = 'N' GROUP BY 1, 2) t
          WHERE src = 'A' OR NOT EXISTS (SELECT 1 FROM line l WHERE l.crop = 'A' AND l.region_id = t.region_id AND l.obs_date = t.obs_date)
          GROUP BY 1, 2""", "line")
def _(v: Views):
    """Two extraction tables with different columns; repeated dates come from the first."""
    key = ["region_id", "obs_date"]
    a = v.line.where("crop = 'A'").groupBy(*key).agg(F.max("price").alias("median")).withColumn("src", F.lit("A"))
    n = v.line.where("crop = 'N'").groupBy(*key).agg(F.max("price").alias("median"), F.max("tax").alias("cloud")).withColumn("src", F.lit("N"))
    return S.scan_many_union([a, n], key, prefer=["src"])


@query("sink_partitioned", "crop c_year:i n:l", "SELECT crop, c_year, count(*) AS n FROM panel GROUP BY 1, 2", "panel")
def _(v: Views):
    path = scratch_path(v.spark, "partitioned")
    S.sink_partitioned(v.panel, path, ["crop", "c_year"])
    return v.spark.read.parquet(path).groupBy("crop", "c_year").agg(F.count(F.lit(1)).alias("n"))


@query("sink_region_series", "param region_id n_values:l mean_value:d",
       "SELECT param, region_id, count(value) AS n_values, avg(value) AS mean_value FROM daily GROUP BY 1, 2", "daily")
def _(v: Views):
    wide = v.line.groupBy("region_id", "obs_date").agg(
        F.avg(F.col("l_quantity") / 50).alias("evi"), F.avg("price").alias("t2m"), F.avg("tax").alias("tp"))
    path = scratch_path(v.spark, "series")
    S.sink_region_series(S.to_region_series(wide, ["region_id", "obs_date"], ["evi", "t2m", "tp"]), path)
    return v.spark.read.parquet(path).groupBy("param", "region_id").agg(
        F.count("value").alias("n_values"), F.avg("value").alias("mean_value"))


@query("empty_regions", "region_id param n_rows:l",
       """SELECT region_id, param, count(*) AS n_rows FROM (SELECT region_id, param, CASE WHEN value < 40 THEN value END AS value FROM obs)
          GROUP BY 1, 2 HAVING count(value) = 0""", "obs")
def _(v: Views):
    masked = v.obs.withColumn("value", F.when(F.col("value") < 40, F.col("value")))
    return S.empty_regions(masked, ["region_id", "param"])


@query("scan_pixels", "row:i col:i x:d y:d n:l mean_value:d",
       """SELECT "row", col, (col + 0.5) * 30 + 1000 AS x, ("row" + 0.5) * -30 + 9000 AS y, count(*) AS n, avg(value) AS mean_value
          FROM pixels GROUP BY 1, 2""", "pixels")
def _(v: Views):
    path = scratch_path(v.spark, "pixels")
    S.sink_columnar(v.pixels.drop("x", "y"), path)
    px = S.scan_pixels(v.spark, path, a=30.0, c=1000.0, e=-30.0, f=9000.0)
    return px.groupBy("row", "col", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


@query("scan_regions", "region_id min_x:d max_x:d min_y:d max_y:d n_points:i",
       "SELECT region_id, min_x, max_x, min_y, max_y, len(xs) AS n_points FROM regions", "regions")
def _(v: Views):
    """Outlines pass through WKT text; every region comes twice and is kept once."""
    pairs = F.transform(F.arrays_zip("xs", "ys"), lambda p: F.concat_ws(" ", p["xs"].cast("string"), p["ys"].cast("string")))
    wkt = v.regions.select("region_id", F.concat(F.lit("POLYGON (("), F.array_join(pairs, ", "), F.lit("))")).alias("wkt"))
    return S.scan_regions(wkt.union(wkt)).withColumn("n_points", F.size("xs"))


@query("points_to_regions", "region_id x:d y:d",
       "SELECT s_name AS region_id, CAST(s_acctbal AS DOUBLE) AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier")
def _(v: Views):
    return S.points_to_regions(v.table("supplier"), "s_name", "s_acctbal", "s_nationkey")


SEARCH = "scene_id:l cloud_cover:d"


@query("catalog_search", SEARCH, """SELECT scene_id, cloud_cover FROM catalog WHERE begin_ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-31'
         AND cloud_cover < 30 AND min_x <= (SELECT max(max_x) FROM parcels WHERE area < 0.5) AND max_x >= (SELECT min(min_x) FROM parcels WHERE area < 0.5)
         AND min_y <= (SELECT max(max_y) FROM parcels WHERE area < 0.5) AND max_y >= (SELECT min(min_y) FROM parcels WHERE area < 0.5)""", "catalog parcels")
def _(v: Views):
    extent = C.regions_extent(v.parcels.where("area < 0.5"))
    return C.catalog_search(v.catalog, "1997-01-01", "1999-12-31", extent=extent, max_cloud=30.0)


@query("catalog_search_box", SEARCH, """SELECT scene_id, cloud_cover FROM catalog WHERE begin_ts BETWEEN TIMESTAMP '1996-04-01' AND TIMESTAMP '1996-09-30'
         AND cloud_cover < 80 AND min_x <= 60 AND max_x >= 40 AND min_y <= 50 AND max_y >= 20""", "catalog")
def _(v: Views):
    return C.catalog_search(v.catalog, "1996-04-01", "1996-09-30", bbox=(40, 20, 60, 50))


@query("catalog_extreme", "collection scene_id:l cloud_cover:d",
       """SELECT collection, scene_id, cloud_cover FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY cloud_cover DESC, scene_id) AS rn
          FROM catalog) WHERE rn = 1""", "catalog")
def _(v: Views):
    return C.catalog_extreme(v.catalog, ["collection"])


@query("catalog_pair", "scene_id:l geo_id:l",
       """SELECT a.scene_id, min(b.scene_id) AS geo_id FROM catalog a JOIN catalog b USING (begin_ts)
          WHERE a.status = 'P' AND b.status = 'F' GROUP BY 1""", "catalog")
def _(v: Views):
    """Two kinds of files, told apart by their status."""
    return C.catalog_pair(v.catalog.where("status = 'P'"), v.catalog.where("status = 'F'")).select("scene_id", "geo_id")


@query("catalog_listing", "collection status n_scenes:l first_ts:t last_ts:t",
       """SELECT collection, status, count(*) AS n_scenes, strftime(min(begin_ts), '%Y-%m-%d') AS first_ts,
          strftime(max(begin_ts), '%Y-%m-%d') AS last_ts FROM catalog GROUP BY 1, 2""", "catalog")
def _(v: Views):
    df = C.catalog_listing(v.catalog, ["collection", "status"])
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_ts", "last_ts")})


@query("resume_pending", "scene_id:l", """SELECT scene_id FROM catalog c WHERE NOT EXISTS (
         SELECT 1 FROM lineitem l WHERE l.l_orderkey = c.scene_id)""", "catalog")
def _(v: Views):
    done = v.table("lineitem").select(F.col("l_orderkey").alias("scene_id"))
    return C.resume_pending(v.catalog, done).select("scene_id")


@query("run_manifest", "run_id:i", "SELECT max(l_linenumber) + 1 AS run_id FROM lineitem")
def _(v: Views):
    return S.next_run_id(v.table("lineitem").select(F.col("l_linenumber").alias("run_id")))


WIDE = " ".join(f"{s}:d" for s in [*SETUPS, "gru_direct"])


@query("export_predictions_wide", f"year:i region crop observed:d {WIDE}",
       "SELECT year, region, crop, max(y_true) AS observed, " + ", ".join(
           f"max(CASE WHEN setup = '{s}' THEN y_pred END) AS {s}" for s in [*SETUPS, "gru_direct"]) +
       " FROM preds GROUP BY 1, 2, 3", "preds")
def _(v: Views):
    return S.export_predictions_wide(v.preds, [*SETUPS, "gru_direct"], keys=["year", "region", "crop"])
