"""Key joins, spatial joins and zonal statistics."""

from pyspark.sql import functions as F

from harvestline.functions.scalars import admin_key
from harvestline.operators import joins as J, outlines as O, spatial as G
from harvestline.registry.base import query
from harvestline.registry.views import Views

CELL = 20.0
COVER = 4.0  # cells of a region's cover, a fraction of it

# even-odd ray cast over the edges of region r, pixel (x, y)
INSIDE = """list_sum(list_transform(range(1, len(xs)), lambda i: CASE WHEN (ys[i] > {y}) <> (ys[i + 1] > {y})
  AND {x} < (xs[i + 1] - xs[i]) * ({y} - ys[i]) / nullif(ys[i + 1] - ys[i], 0) + xs[i] THEN 1 ELSE 0 END)) % 2 = 1"""
IN_BOX = "x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y"
LOCATED = f"SELECT p.*, r.region_id FROM pixels p JOIN regions r ON {IN_BOX} AND {INSIDE.format(x='x', y='y')}"


def located(v: Views):
    return G.pixel_in_polygon(v.pixels, v.regions, COVER)


@query("pixel_in_polygon", "region_id n:l mean_value:d sum_x:d", f"SELECT region_id, count(*) AS n, avg(value) AS mean_value, avg(x) AS sum_x FROM ({LOCATED}) GROUP BY 1", "pixels regions")
def _(v: Views):
    return located(v).groupBy("region_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.avg("x").alias("sum_x"))


@query("bbox_clip", "scene_id:l region_id", """SELECT scene_id, region_id FROM catalog c JOIN regions r
        ON c.min_x <= r.max_x AND c.max_x >= r.min_x AND c.min_y <= r.max_y AND c.max_y >= r.min_y""", "catalog regions")
def _(v: Views):
    return G.bbox_clip(v.catalog, v.regions, CELL)


NEAR_SQL = """SELECT region_id, x, y, value, dist FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY dist, x, y) AS rn FROM (
    SELECT r.field_id AS region_id, p.x, p.y, p.value, sqrt(pow(p.x - r.px, 2) + pow(p.y - r.py, 2)) AS dist FROM
    (SELECT field_id, (xs[1] + xs[2] + xs[3]) / 3 AS px, (ys[1] + ys[2] + ys[3]) / 3 AS py FROM parcels
     WHERE field_id NOT IN (SELECT s.s_suppkey FROM supplier s WHERE s.s_acctbal < 0)) r,
    (SELECT x, y, min(value) AS value FROM pixels GROUP BY 1, 2) p)) WHERE rn = 1"""


@query("nearest_pixel_fallback", "region_id:l x:d y:d value:d dist:d", NEAR_SQL, "pixels parcels")
def _(v: Views):
    covered = v.table("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("region_id"))
    fields = v.parcels.withColumnRenamed("field_id", "region_id")
    return G.nearest_pixel_fallback(fields, v.pixels, covered)


@query("rounded_centroid_lookup", "region_id:l value:d",
       """SELECT field_id AS region_id, value FROM (SELECT field_id, round((xs[1] + xs[2] + xs[3]) / 3) AS gx, round((ys[1] + ys[2] + ys[3]) / 3) AS gy FROM parcels)
          JOIN (SELECT round(x) AS gx, round(y) AS gy, avg(value) AS value FROM pixels GROUP BY 1, 2) USING (gx, gy)""", "pixels parcels")
def _(v: Views):
    return G.rounded_centroid_lookup(v.parcels.withColumnRenamed("field_id", "region_id"), v.pixels)


GRID_SQL = """(SELECT "row", col, min(x) AS gx, min(y) AS gy FROM pixels WHERE band = 'N' GROUP BY 1, 2)"""


@query("swath_to_grid_nn", "row:i col:i value:d dist:d",
       f"""SELECT "row", col, value, dist FROM (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY dist, x, y, value) AS rn FROM (
           SELECT g."row", g.col, s.value, s.x, s.y, sqrt(pow(s.x - gx, 2) + pow(s.y - gy, 2)) AS dist FROM {GRID_SQL} g
           JOIN (SELECT x, y, value FROM pixels WHERE band = 'R') s ON s.x BETWEEN gx - 0.5 AND gx + 0.5 AND s.y BETWEEN gy - 0.5 AND gy + 0.5
           AND sqrt(pow(s.x - gx, 2) + pow(s.y - gy, 2)) <= 0.5)) WHERE rn = 1""", "pixels")
def _(v: Views):
    grid = v.pixels.where("band = 'N'").groupBy("row", "col").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return G.swath_to_grid_nn(v.pixels.where("band = 'R'").select("x", "y", "value"), grid, radius=0.5)


@query("align_landcover", "row:i col:i land_class:i",
       """SELECT "row", col, land_class FROM (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY d, land_class) AS rn FROM (
          SELECT *, pow(x - (col + 0.5) * 4.0, 2) + pow(y - (104.0 - ("row" + 0.5) * 4.0), 2) AS d FROM (
          SELECT x, y, scl AS land_class, CAST(floor(x / 4.0) AS INTEGER) AS col, CAST(floor((104.0 - y) / 4.0) AS INTEGER) AS "row" FROM pixels)
          WHERE "row" BETWEEN 0 AND 25 AND col BETWEEN 0 AND 25)) WHERE rn = 1""", "pixels")
def _(v: Views):
    cover = v.pixels.select("x", "y", F.col("scl").alias("land_class"))
    return G.align_landcover(cover, origin_x=0.0, origin_y=104.0, size=4.0, rows=26, cols=26)


# pairs of parcel and region with a proper crossing of edges or a first corner in the other one
OVERLAPS = f"""WITH pe AS (SELECT field_id, xs[i] AS ax, ys[i] AS ay, xs[i + 1] AS bx, ys[i + 1] AS by_ FROM (SELECT *, unnest(range(1, len(xs))) AS i FROM parcels)),
          re AS (SELECT region_id, xs[i] AS cx, ys[i] AS cy, xs[i + 1] AS dx, ys[i + 1] AS dy FROM (SELECT *, unnest(range(1, len(xs))) AS i FROM regions)),
          cut AS (SELECT DISTINCT field_id, region_id FROM pe, re WHERE
            ((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) * ((bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax)) < 0
            AND ((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * ((dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx)) < 0),
          p_in AS (SELECT field_id, region_id FROM (SELECT field_id, xs[1] AS px, ys[1] AS py FROM parcels) JOIN regions ON {INSIDE.format(x='px', y='py')}),
          r_in AS (SELECT field_id, region_id FROM (SELECT region_id, xs[1] AS px, ys[1] AS py FROM regions) JOIN parcels ON {INSIDE.format(x='px', y='py')}),
          hits AS (SELECT * FROM cut UNION SELECT * FROM p_in UNION SELECT * FROM r_in)"""


@query("region_overlay", "field_id:l region_id", f"{OVERLAPS} SELECT field_id, min(region_id) AS region_id FROM hits GROUP BY 1", "parcels regions")
def _(v: Views):
    return G.region_overlay(v.parcels, v.regions, CELL)


EDGES_SQL = """SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM (SELECT DISTINCT a.region_id AS src, b.region_id AS dst FROM
    (SELECT region_id, round(unnest(xs), 7) AS x, round(unnest(ys), 7) AS y FROM regions) a JOIN
    (SELECT region_id, round(unnest(xs), 7) AS x, round(unnest(ys), 7) AS y FROM regions) b USING (x, y) WHERE a.region_id <> b.region_id)"""


@query("queen_neighbors", "src dst w:d", EDGES_SQL, "regions")
def _(v: Views):
    return G.queen_neighbors(v.regions)


@query("dissolve_outline", "n_regionkey:i x0:d y0:d x1:d y1:d",
       """SELECT n_regionkey, ax AS x0, ay AS y0, bx AS x1, by_ AS y1 FROM (SELECT n_regionkey,
            CASE WHEN (x0, y0) <= (x1, y1) THEN x0 ELSE x1 END AS ax, CASE WHEN (x0, y0) <= (x1, y1) THEN y0 ELSE y1 END AS ay,
            CASE WHEN (x0, y0) <= (x1, y1) THEN x1 ELSE x0 END AS bx, CASE WHEN (x0, y0) <= (x1, y1) THEN y1 ELSE y0 END AS by_
          FROM (SELECT n_regionkey, round(xs[i], 7) AS x0, round(ys[i], 7) AS y0, round(xs[i + 1], 7) AS x1, round(ys[i + 1], 7) AS y1
                FROM (SELECT n_nationkey // 5 AS n_regionkey, xs, ys, unnest(range(1, len(xs))) AS i FROM regions))) GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = 1""", "regions")
def _(v: Views):
    """Parents are rows of the mosaic, so members share edges."""
    rows = v.regions.withColumn("n_regionkey", F.floor(F.col("n_nationkey") / 5).cast("int"))
    return G.dissolve_outline(rows, "n_regionkey")


RINGS_SQL = """WITH RECURSIVE sides AS (SELECT n_regionkey, round(xs[i], 7) AS x0, round(ys[i], 7) AS y0, round(xs[i + 1], 7) AS x1, round(ys[i + 1], 7) AS y1
          FROM (SELECT n_regionkey, xs, ys, unnest(range(1, len(xs))) AS i FROM regions)),
        e AS (SELECT *, row_number() OVER (ORDER BY n_regionkey, x0, y0, x1, y1) AS id FROM sides s WHERE NOT EXISTS (SELECT 1 FROM sides t
          WHERE t.n_regionkey = s.n_regionkey AND t.x0 = s.x1 AND t.y0 = s.y1 AND t.x1 = s.x0 AND t.y1 = s.y0)),
        turns AS (SELECT a.id, b.id AS follows, atan2(a.y0 - a.y1, a.x0 - a.x1) - atan2(b.y1 - b.y0, b.x1 - b.x0) AS turn
          FROM e a JOIN e b ON a.n_regionkey = b.n_regionkey AND a.x1 = b.x0 AND a.y1 = b.y0),
        nxt AS (SELECT id, arg_min(follows, CASE WHEN turn < 0 THEN turn + 2 * pi() ELSE turn END) AS follows FROM turns GROUP BY 1),
        walk AS (SELECT id AS first_id, id AS here FROM e UNION ALL SELECT first_id, follows FROM walk JOIN nxt ON nxt.id = here WHERE follows <> first_id),
        rings AS (SELECT first_id, count(*) AS n_edges, sum(x0 * y1 - x1 * y0) / 2 AS area FROM walk JOIN e ON e.id = here GROUP BY 1 HAVING min(here) = first_id)
        SELECT n_regionkey, x0, y0, n_edges, area FROM rings JOIN e ON e.id = first_id"""


@query("outline_rings", "n_regionkey:i x0:d y0:d n_edges:l area:d", RINGS_SQL, "regions")
def _(v: Views):
    """Regions are scattered over the mosaic: several rings, some with holes, some touching in a corner."""
    rings = O.outline_rings(v.regions, "n_regionkey")
    return rings.select("n_regionkey", F.get("xs", F.lit(0)).alias("x0"), F.get("ys", F.lit(0)).alias("y0"), "n_edges", "area")


@query("dissolved_overlay", "field_id:l n_regionkey:i",
       f"{OVERLAPS} SELECT field_id, min(n_regionkey) AS n_regionkey FROM hits JOIN regions USING (region_id) GROUP BY 1", "parcels regions")
def _(v: Views):
    """Parcels by the dissolved regions instead of their members."""
    return G.region_overlay(v.parcels, O.dissolve(v.regions, "n_regionkey"), CELL, region_id="n_regionkey")


@query("zonal_median_std", "region_id scene_id band median:d std:d n:l",
       f"""SELECT region_id, scene_id, band, median(value) AS median, stddev_pop(value) AS std, count(value) AS n FROM ({LOCATED})
           WHERE value <> 0 GROUP BY 1, 2, 3""", "pixels regions")
def _(v: Views):
    return G.zonal_median_std(located(v))


@query("zonal_median_std_approx", "region_id n:l std:d",
       f"SELECT region_id, count(value) AS n, stddev_pop(value) AS std FROM ({LOCATED}) WHERE value <> 0 GROUP BY 1", "pixels regions")
def _(v: Views):
    return G.zonal_median_std_approx(located(v), ["region_id"])


@query("zonal_mode", "region_id scene_id mode:i",
       f"""SELECT region_id, scene_id, scl AS mode FROM (SELECT region_id, scene_id, scl, row_number() OVER (PARTITION BY region_id, scene_id ORDER BY count(*) DESC, scl) AS rn
           FROM ({LOCATED}) GROUP BY 1, 2, 3) WHERE rn = 1""", "pixels regions")
def _(v: Views):
    return G.zonal_mode(located(v), ["region_id", "scene_id"], "scl")


@query("zonal_masked_mean", "region_id mean_value:d pixel_count:l",
       f"""SELECT region_id, mean_value, coalesce(n, 0) AS pixel_count FROM regions LEFT JOIN (SELECT region_id, avg(value) AS mean_value, count(value) AS n
           FROM ({LOCATED}) WHERE "row" BETWEEN 30 AND 45 AND value >= 1 GROUP BY 1) USING (region_id)""", "pixels regions")
def _(v: Views):
    return G.zonal_masked_mean(located(v), v.regions, F.col("row").between(30, 45) & (F.col("value") >= 1))


# --- key joins -----------------------------------------------------------------------

@query("merge_natural", "region_id c_year:i yield:d a:d b:d",
       """SELECT region_id, c_year, "yield", a, b FROM panel1 JOIN (SELECT region_id, c_year, "evi_LT1" AS a FROM features WHERE "evi_LT1" > 0.4) USING (region_id, c_year)
          JOIN (SELECT region_id, c_year, "tp_LT1" AS b FROM features WHERE "tp_LT1" > 3) USING (region_id, c_year)""", "panel1 features")
def _(v: Views):
    a = v.features.where("evi_LT1 > 0.4").select("region_id", "c_year", F.col("evi_LT1").alias("a"))
    b = v.features.where("tp_LT1 > 3").select("region_id", "c_year", F.col("tp_LT1").alias("b"))
    return J.merge_natural([v.panel1, a, b])


@query("merge_by_key", "region_id c_year:i yield:d evi_LT1:d",
       'SELECT region_id, c_year, p."yield", "evi_LT1" FROM panel1 p JOIN features USING (region_id, c_year)', "panel1 features")
def _(v: Views):
    return J.merge_by_key(v.panel1, v.features, ["region_id", "c_year"], ["yield", "evi_LT1"])


@query("override_update", "region_id c_year:i yield:d",
       """SELECT p.region_id, p.c_year, coalesce(a."yield" / 10, b."yield", p."yield") AS "yield" FROM panel1 p
          LEFT JOIN (SELECT * FROM panel WHERE crop = 'A' AND region_id < '05') a USING (region_id, c_year)
          LEFT JOIN (SELECT * FROM panel WHERE crop = 'R' AND region_id < '12') b USING (region_id, c_year)""", "panel panel1")
def _(v: Views):
    a = v.panel.where("crop = 'A' and region_id < '05'")
    b = v.panel.where("crop = 'R' and region_id < '12'")
    return J.override_update(v.panel1, [a, b], ["region_id", "c_year"], "yield", [0.1, 1.0])


@query("attach_yield", "field_id:l c_year:i yield:d",
       """SELECT field_id, coalesce(c_year, 0) AS c_year, "yield" FROM parcels LEFT JOIN (SELECT l_suppkey AS field_id, c_year, avg(price) AS "yield" FROM line
          WHERE price < 2 GROUP BY 1, 2) USING (field_id)""", "parcels line")
def _(v: Views):
    y = v.line.where("price < 2").groupBy(F.col("l_suppkey").alias("field_id"), "c_year").agg(F.avg("price").alias("yield"))
    return J.attach_yield(v.parcels.select("field_id"), y, ["field_id"]).fillna(0, ["c_year"])


@query("missing_regions", "field_id:l", "SELECT field_id FROM parcels WHERE field_id NOT IN (SELECT l_suppkey FROM line WHERE price < 1)", "parcels line")
def _(v: Views):
    return J.missing_regions(v.parcels, v.line.where("price < 1").select(F.col("l_suppkey").alias("field_id")), "field_id")


@query("attach_shape", "region_id n_points:i observed:d forecast:d range_min:d range_max:d",
       """WITH w AS (SELECT 'NATION_' || CAST(CAST(substr(region, 1, 2) AS INTEGER) AS VARCHAR) AS region_id, avg(y_true) AS observed, avg(y_pred) AS forecast
          FROM preds WHERE year = 1999 AND setup = 'full_direct' GROUP BY 1)
          SELECT region_id, len(xs) AS n_points, observed, forecast, (SELECT least(min(observed), min(forecast)) FROM w) AS range_min,
          (SELECT greatest(max(observed), max(forecast)) FROM w) AS range_max FROM regions LEFT JOIN w USING (region_id)""", "preds regions")
def _(v: Views):
    name = F.concat(F.lit("NATION_"), F.substring("region", 1, 2).cast("int").cast("string"))
    wide = v.preds.where("year = 1999 and setup = 'full_direct'").groupBy(name.alias("region_id")).agg(
        F.avg("y_true").alias("observed"), F.avg("y_pred").alias("forecast"))
    return J.attach_shape(v.regions, wide, "observed", "forecast").withColumn("n_points", F.size("xs"))


@query("union_outer_merge", "region_id c_year:i a:d b:d",
       """SELECT region_id, c_year, a, b FROM (SELECT region_id, c_year, avg("yield") AS a FROM panel WHERE crop = 'A' AND "yield" > 5 GROUP BY 1, 2)
          FULL JOIN (SELECT region_id, c_year, avg("yield") AS b FROM panel WHERE crop = 'N' AND "yield" < 5 GROUP BY 1, 2) USING (region_id, c_year)""", "panel")
def _(v: Views):
    keys = ["region_id", "c_year"]
    a = v.panel.where("crop = 'A' and yield > 5").groupBy(*keys).agg(F.avg("yield").alias("a"))
    b = v.panel.where("crop = 'N' and yield < 5").groupBy(*keys).agg(F.avg("yield").alias("b"))
    return J.union_outer_merge(a, b, keys)


@query("prefer_new_regions", "region_id c_year:i yield:d",
       """SELECT region_id, c_year, "yield" FROM panel WHERE crop = 'N' AND c_year = 2000 UNION ALL SELECT region_id, c_year, "yield" FROM panel1 WHERE c_year = 2001
          AND region_id NOT IN (SELECT region_id FROM panel WHERE crop = 'N' AND c_year = 2000)""", "panel panel1")
def _(v: Views):
    return J.prefer_new_regions(v.panel1.where("c_year = 2001"), v.panel.where("crop = 'N' and c_year = 2000").drop("crop"))


@query("previous_year_crop", "field_id:l c_year:i crop_type prev_year_crop",
       """WITH f AS (SELECT o_custkey AS field_id, CAST(year(o_orderdate) AS INTEGER) AS c_year, max(o_orderpriority) AS crop_type FROM orders GROUP BY 1, 2)
          SELECT f.field_id, f.c_year, f.crop_type, coalesce(p.crop_type, 'unknown') AS prev_year_crop FROM f LEFT JOIN f p ON p.field_id = f.field_id AND p.c_year = f.c_year - 1""")
def _(v: Views):
    f = v.table("orders").groupBy(F.col("o_custkey").alias("field_id"), F.year("o_orderdate").alias("c_year")).agg(F.max("o_orderpriority").alias("crop_type"))
    return J.previous_year_crop(f)


@query("broadcast_region_to_fields", "region_id c_year:i yield:d t2m:d",
       """SELECT region_id, c_year, "yield", t2m FROM panel1 JOIN (SELECT c_year, avg(price) AS t2m FROM line GROUP BY 1) USING (c_year)""", "panel1 line")
def _(v: Views):
    return J.broadcast_region_to_fields(v.panel1, v.line.groupBy("c_year").agg(F.avg("price").alias("t2m")))


@query("align_observations", "event_id:l value:d",
       """SELECT event_id, value FROM obs WHERE (region_id, obs_date) IN (SELECT region_id, obs_date FROM obs WHERE param = 'error')""", "obs")
def _(v: Views):
    return J.align_observations(v.obs, v.obs.where("param = 'error'"), ["region_id", "obs_date"])


@query("region_year_skeleton", "region_id c_year:i", "SELECT region_id, c_year FROM (SELECT DISTINCT region_id FROM panel), (SELECT DISTINCT c_year FROM panel)", "panel")
def _(v: Views):
    return J.region_year_skeleton(v.panel, v.panel)


@query("zone_lookup", "status n:l",
       """SELECT coalesce(status, 'No') AS status, count(*) AS n FROM panel1 LEFT JOIN (SELECT region_id, CASE WHEN avg(tax) > 4 THEN 'Occupied' ELSE 'Regained' END AS status
          FROM line WHERE c_year = 2001 AND crop = 'A' AND l_discount < 0.02 GROUP BY 1) USING (region_id) GROUP BY 1""", "panel1 line")
def _(v: Views):
    zones = v.line.where("c_year = 2001 and crop = 'A' and l_discount < 0.02").groupBy("region_id").agg(
        F.when(F.avg("tax") > 4, "Occupied").otherwise("Regained").alias("status"))
    return J.zone_lookup(v.panel1, zones).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("year_pairing", "region_id c_year:i evi_LT1:d target:d",
       """SELECT f.region_id, f.c_year, "evi_LT1", p."yield" AS target FROM features f JOIN panel p ON p.region_id = f.region_id AND p.c_year = f.c_year AND p.crop = 'R'""", "features panel")
def _(v: Views):
    targets = v.panel.where("crop = 'R'").select("region_id", "c_year", F.col("yield").alias("target"))
    return J.year_pairing(v.features.select("region_id", "c_year", "evi_LT1"), targets)


@query("spine_align", "region_id param obs_date:t value:d",
       """SELECT s.region_id, s.param, s.obs_date, o.value FROM (SELECT region_id, param, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS obs_date
          FROM (SELECT DISTINCT region_id, param FROM odaily)) s LEFT JOIN odaily o USING (region_id, param, obs_date)""", "odaily")
def _(v: Views):
    from harvestline.operators.timeseries import spine_align

    return spine_align(v.odaily, start="2024-01-01", end="2024-01-31")


@query("dimension_lookup", "o_orderstatus n:l",
       """SELECT CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1""")
def _(v: Views):
    names = v.spark.createDataFrame([("O", "open"), ("F", "filled")], "o_orderstatus string, label string")
    return J.lookup(v.table("orders"), names, "o_orderstatus", "label").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("with_country", "country n:l", "SELECT substr(region_id, 1, 2) AS country, count(*) AS n FROM panel1 GROUP BY 1", "panel1")
def _(v: Views):
    return v.panel1.groupBy(admin_key("region_id").alias("country")).agg(F.count(F.lit(1)).alias("n"))
