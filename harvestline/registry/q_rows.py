"""Projections, filters and scalar functions."""

from pyspark.sql import functions as F

from harvestline.functions import scalars as S
from harvestline.operators import rows as R
from harvestline.registry.base import query
from harvestline.registry.views import FEATURES, Views

WIDE = "region_id c_year:i yield:d " + " ".join(f"{f}:d" for f in FEATURES)


@query("parse_scene_date", "event_id:l ordinal:t compact:t dashed:t swath:t none:t",
       """SELECT event_id, CAST(ts AS DATE) AS ordinal, CAST(ts AS DATE) AS compact, CAST(ts AS DATE) AS dashed, CAST(ts AS DATE) AS swath,
          CAST(NULL AS DATE) AS "none" FROM events""")
def _(v: Views):
    fmt = lambda pre, f, post: S.parse_scene_date(F.concat(F.lit(pre), F.date_format("ts", f), F.lit(post)))
    return v.obs.select("event_id", fmt("", "yyyyDDD", "").alias("ordinal"), fmt("S2_", "yyyyMMdd", "_B04").alias("compact"),
                        fmt("", "yyyy-MM-dd", "_evi").alias("dashed"), fmt("MOD13Q1.A", "yyyyDDD", ".h18v04.hdf").alias("swath"),
                        S.parse_scene_date(F.concat(F.lit("plot_"), F.col("param"))).alias("none"))


@query("admin_key", "country nuts1 nuts2 nuts3 n:l",
       """SELECT substr(region_id, 1, 2) AS country, substr(region_id, 1, 3) AS nuts1, substr(region_id, 1, 4) AS nuts2,
          substr(region_id, 1, 5) AS nuts3, count(*) AS n FROM panel GROUP BY 1, 2, 3, 4""", "panel")
def _(v: Views):
    return v.panel.groupBy(*[S.admin_key("region_id", k).alias(k) for k in ("country", "nuts1", "nuts2", "nuts3")]).agg(F.count(F.lit(1)).alias("n"))


@query("field_year_key", "key yield:d", """SELECT region_id || '_' || CAST(c_year AS VARCHAR) AS "key", "yield" FROM panel1""", "panel1")
def _(v: Views):
    return v.panel1.select(S.field_year_key("region_id", "c_year").alias("key"), "yield")


@query("recode", "segment status n:l",
       """SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Cars' WHEN 'MACHINERY' THEN 'Machines' ELSE c_mktsegment END AS segment,
          CASE WHEN c_nationkey = 3 THEN 'Three' WHEN c_nationkey = 4 THEN 'Four' ELSE 'other' END AS status, count(*) AS n
          FROM customer GROUP BY 1, 2""")
def _(v: Views):
    df = v.table("customer")
    return df.groupBy(S.recode("c_mktsegment", {"AUTOMOBILE": "Cars", "MACHINERY": "Machines"}).alias("segment"),
                      S.recode("c_nationkey", {3: "Three", 4: "Four"}, F.lit("other")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("normalize_label", "label n:l",
       """SELECT upper(substr(t, 1, 1)) || lower(substr(t, 2)) AS label, count(*) AS n
          FROM (SELECT replace(replace(o_orderpriority || '_' || o_orderstatus, '-', ' '), '_', ' ') AS t FROM orders) GROUP BY 1""")
def _(v: Views):
    raw = F.concat_ws("_", "o_orderpriority", "o_orderstatus")
    return v.table("orders").groupBy(S.normalize_label(raw).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("rename_prefix", "region_id s2_evi:d s2_t2m:d",
       'SELECT region_id, "evi_LT1" AS s2_evi, "t2m_LT1" AS s2_t2m FROM features', "features")
def _(v: Views):
    df = v.features.select("region_id", "evi_LT1", "t2m_LT1")
    return R.rename_prefix(df, "s2_", ["evi_LT1", "t2m_LT1"], "_LT1")


@query("scale_units", "region_id c_year:i tenth:d offset_scaled:d checked:d",
       """SELECT region_id, c_year, "yield" / 10 AS tenth, "yield" * 0.0001 + 0.5 AS offset_scaled, "yield" * 0.02 + 1 AS checked FROM panel1""", "panel1")
def _(v: Views):
    df = v.panel1.withColumns({"scale": F.lit(0.02), "offset": F.lit(1.0)})
    return df.select("region_id", "c_year", S.scale_units("yield", 0.1).alias("tenth"), S.scale_units("yield", 0.0001, 0.5).alias("offset_scaled"),
                     S.scale_checked("yield", "scale", "offset", [0.02, 0.01]).alias("checked"))


@query("null_sentinels", "part:l nulled:d exported:d",
       """SELECT l_partkey AS part, avg(CASE WHEN l_tax > 0 THEN l_tax END) AS nulled, avg(CASE WHEN l_tax > 0 THEN l_tax ELSE -9999 END) AS exported
          FROM lineitem GROUP BY 1""")
def _(v: Views):
    clean = S.null_sentinels("l_tax", (-9999.0,), at_most=0.0)
    return v.table("lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.avg(clean).alias("nulled"), F.avg(S.fill_sentinel(clean)).alias("exported"))


@query("valid_range", "region_id lst:l evi:l sig0:l sig40:l mean_lst:d",
       """SELECT region_id, count(CASE WHEN k > 260 AND k < 310 THEN 1 END) AS lst, count(CASE WHEN e >= -1 AND e <= 1 THEN 1 END) AS evi,
          count(CASE WHEN d < 0 THEN 1 END) AS sig0, count(CASE WHEN d < -3.5 THEN 1 END) AS sig40, avg(CASE WHEN k > 260 AND k < 310 THEN k END) AS mean_lst
          FROM (SELECT region_id, value + 250 AS k, value / 100 AS e, value - 40 AS d FROM obs) GROUP BY 1""", "obs")
def _(v: Views):
    val = F.col("value")
    src = {"lst": val + 250, "evi": val / 100, "sig0": val - 40, "sig40": val - 40}
    ok = {k: S.valid_range(c, *S.VALID_RANGES[k]) for k, c in src.items()}
    return v.obs.groupBy("region_id").agg(*[F.count(c).alias(k) for k, c in ok.items()], F.avg(ok["lst"]).alias("mean_lst"))


@query("daytime_only", "event_id:l value:d", "SELECT event_id, value FROM events WHERE hour(ts) > 11 AND hour(ts) < 18")
def _(v: Views):
    return v.obs.where(S.is_daytime("ts")).select("event_id", "value")


@query("offset_since", "event_id:l value:d",
       "SELECT event_id, CASE WHEN CAST(ts AS DATE) >= DATE '2024-01-15' THEN value - 1000 ELSE value END AS value FROM events")
def _(v: Views):
    return v.obs.select("event_id", S.offset_since("value", "obs_date", "2024-01-15").alias("value"))


@query("scene_class_mask", "scene_id band n_clear:l mean_value:d",
       """SELECT scene_id, band, count(CASE WHEN scl IN (4, 5, 6) THEN value END) AS n_clear, avg(CASE WHEN scl IN (4, 5, 6) THEN value END) AS mean_value
          FROM pixels GROUP BY 1, 2""", "pixels")
def _(v: Views):
    masked = S.scene_class_mask("value", "scl")
    return v.pixels.groupBy("scene_id", "band").agg(F.count(masked).alias("n_clear"), F.avg(masked).alias("mean_value"))


@query("cropland_mask", "scene_id n_cropland:l n_pixels:l share:d",
       """SELECT scene_id, count(CASE WHEN "row" BETWEEN 10 AND 40 THEN 1 END) AS n_cropland, count(*) AS n_pixels,
          avg(CASE WHEN "row" BETWEEN 10 AND 40 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share FROM pixels GROUP BY 1""", "pixels")
def _(v: Views):
    return R.cropland_share(v.pixels, ["scene_id"], "row")


@query("flag_bit", "event_id:l bit0:i bit3:i", "SELECT event_id, flag & 1 AS bit0, (flag >> 3) & 1 AS bit3 FROM obs", "obs")
def _(v: Views):
    return v.obs.select("event_id", S.flag_bit("flag", 0).alias("bit0"), S.flag_bit("flag", 3).alias("bit3"))


@query("db_to_linear", "event_id:l linear:d", "SELECT event_id, pow(10.0, (value / 10 - 30) / 10) AS linear FROM events")
def _(v: Views):
    return v.obs.select("event_id", S.db_to_linear(F.col("value") / 10 - 30).alias("linear"))


@query("linear_to_db", "event_id:l db:d", "SELECT event_id, 10 * log10(value + 0.5) AS db FROM events")
def _(v: Views):
    return v.obs.select("event_id", S.linear_to_db(F.col("value") + 0.5).alias("db"))


@query("spectral_indices", "line:s ndvi:d evi:d ndwi:d nmdi:d",
       """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line, (n - r) / nullif(n + r, 0) AS ndvi,
          2.5 * (n - r) / nullif(n + 6 * r - 7.5 * b + 1, 0) AS evi, (n - s2) / nullif(n + s2, 0) AS ndwi, (n - (s1 - s2)) / nullif(n + (s1 - s2), 0) AS nmdi
          FROM (SELECT *, l_tax * 1000 / 10000 AS b, CASE WHEN l_linenumber <> 7 THEN l_quantity * 20 / 10000 END AS r, price * 50 / 10000 AS n,
                l_quantity * 30 / 10000 AS s1, l_quantity * 10 / 10000 AS s2 FROM (SELECT *, l_extendedprice / 1000 AS price FROM lineitem))""")
def _(v: Views):
    df = v.table("lineitem")
    red = F.when(F.col("l_linenumber") != 7, F.col("l_quantity") * 20).otherwise(F.lit(-9999.0))
    idx = S.spectral_indices(F.col("l_tax") * 1000, red, F.col("l_extendedprice") / 1000 * 50, F.col("l_quantity") * 30, F.col("l_quantity") * 10)
    return df.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line"), *[c.alias(n) for n, c in idx.items()])


@query("iqr_outliers", "event_id:l value:d",
       """SELECT o.event_id, CASE WHEN n < 6 OR o.value BETWEEN q1 - 2 * (q3 - q1) AND q3 + 2 * (q3 - q1) THEN o.value ELSE -9999 END AS value
          FROM obs o JOIN (SELECT region_id, param, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM obs GROUP BY 1, 2) s
          USING (region_id, param)""", "obs")
def _(v: Views):
    return R.iqr_outliers(v.obs, ["region_id", "param"], fill=-9999.0).select("event_id", "value")


@query("upper_sigma_outliers", "event_id:l outlier:b",
       """SELECT event_id, value IS NULL OR value > m + 1.5 * s AS outlier FROM obs JOIN
          (SELECT param, avg(value) AS m, stddev_pop(value) AS s FROM obs GROUP BY 1) USING (param)""", "obs")
def _(v: Views):
    return R.upper_sigma_outliers(v.obs, ["param"], k_sigma=1.5).select("event_id", "outlier")


GAPPY = 'SELECT region_id, c_year, CASE WHEN "evi_LT1" > 0.5 THEN "evi_LT1" END AS a, CASE WHEN "t2m_LT1" > 50 THEN "t2m_LT1" END AS b FROM features'


def gappy(v: Views):
    cut = lambda c, at: F.when(F.col(c) > at, F.col(c))
    return v.features.select("region_id", "c_year", cut("evi_LT1", 0.5).alias("a"), cut("t2m_LT1", 50).alias("b"))


@query("drop_null_rows", "rule region_id c_year:i", f"""SELECT 'any' AS rule, region_id, c_year FROM ({GAPPY}) WHERE a IS NOT NULL AND b IS NOT NULL
         UNION ALL SELECT 'all', region_id, c_year FROM ({GAPPY}) WHERE a IS NOT NULL OR b IS NOT NULL""", "features")
def _(v: Views):
    df = gappy(v)
    some = R.drop_null_rows(df, "any").withColumn("rule", F.lit("any"))
    return some.unionByName(R.drop_null_rows(df, "all", ["a", "b"]).withColumn("rule", F.lit("all")))


@query("drop_columns_by_prefix", WIDE.replace("tp_LT4:d", "").replace("tp_LT3:d", "").replace("tp_LT2:d", "").replace("tp_LT1:d", ""),
       "SELECT * FROM features", "features")
def _(v: Views):
    return R.drop_columns_by_prefix(v.features, "tp_")


@query("select_lead_predictors", "region_id c_year:i evi_LT4:d evi_LT3:d t2m_LT4:d t2m_LT3:d", "SELECT * FROM features", "features")
def _(v: Views):
    return R.select_lead_predictors(v.features, ["region_id", "c_year"], min_lead=3, prefixes=["evi", "t2m"])


@query("feature_groups", "feature base lead:i feature_type n_values:l",
       " UNION ALL ".join(f"SELECT '{f}' AS feature, '{f[:-4]}' AS base, {f[-1]} AS lead, '{'eo' if f[:-4] in ('evi', 'sm') else 'meteo'}' AS feature_type,"
                          f" count(\"{f}\") AS n_values FROM features" for f in FEATURES), "features")
def _(v: Views):
    return R.feature_dimension(v.features)


@query("filter_crop_year", "region_id crop c_year:i yield:d",
       """SELECT * FROM panel WHERE crop = 'A' AND substr(region_id, 1, 2) = '03' AND c_year > 1996""", "panel")
def _(v: Views):
    df = v.panel.withColumn("country", S.admin_key("region_id"))
    return R.filter_crop_year(df, crop="A", country="03", after_year=1996)


@query("exclude_region", "region_id n:l", """SELECT region_id, count(*) AS n FROM panel WHERE substr(region_id, 1, 2) NOT IN ('00', '07') GROUP BY 1""", "panel")
def _(v: Views):
    df = R.exclude_region(v.panel.withColumn("country", S.admin_key("region_id")), "country", ["00", "07"])
    return df.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))


@query("one_hot", "event_id:l is_click:i is_view:i is_error:i",
       """SELECT event_id, CAST(event_type = 'click' AS INTEGER) AS is_click, CAST(event_type = 'view' AS INTEGER) AS is_view,
          CAST(event_type = 'error' AS INTEGER) AS is_error FROM events""")
def _(v: Views):
    return R.one_hot(v.obs, "param", ["click", "view", "error"])


@query("impute_scalar_mean", "region_id c_year:i a:d b:d",
       f"""SELECT region_id, c_year, coalesce(a, m) AS a, coalesce(b, m) AS b FROM ({GAPPY}), (SELECT (sum(coalesce(a, 0)) + sum(coalesce(b, 0))) / (count(a) + count(b)) AS m
           FROM ({GAPPY}) WHERE c_year < 2001)""", "features")
def _(v: Views):
    df = gappy(v)
    train, test = R.impute_scalar_mean(df.where("c_year < 2001"), [df.where("c_year >= 2001")], ["a", "b"])
    return train.unionByName(test)


@query("impute_zero", "region_id c_year:i a:d b:d", f"SELECT region_id, c_year, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM ({GAPPY})", "features")
def _(v: Views):
    return R.impute_zero(gappy(v), ["a", "b"])


def _z(c: str) -> str:
    return f'("{c}" - (SELECT avg("{c}") FROM features WHERE c_year < 2001)) / (SELECT stddev_pop("{c}") FROM features WHERE c_year < 2001)'


@query("standardize", "region_id c_year:i evi_LT1:d t2m_LT1:d",
       f'SELECT region_id, c_year, {_z("evi_LT1")} AS "evi_LT1", {_z("t2m_LT1")} AS "t2m_LT1" FROM features', "features")
def _(v: Views):
    cols = ["evi_LT1", "t2m_LT1"]
    df = v.features.select("region_id", "c_year", *cols)
    train, test = R.standardize(df.where("c_year < 2001"), [df.where("c_year >= 2001")], cols)
    return train.unionByName(test)


@query("unstandardize", "region_id c_year:i y:d",
       """SELECT region_id, c_year, ("yield" / 10) * (SELECT stddev_pop("yield") FROM panel1 WHERE c_year < 2001)
          + (SELECT avg("yield") FROM panel1 WHERE c_year < 2001) AS y FROM panel1""", "panel1")
def _(v: Views):
    df = v.panel1.withColumn("y", F.col("yield") / 10)
    return R.unstandardize(df, df.where("c_year < 2001"), {"y": "yield"})


@query("minmax_scale", "region_id c_year:i yield:d",
       """SELECT region_id, c_year, ("yield" - lo) / (hi - lo) AS "yield" FROM panel1 JOIN (SELECT c_year, min("yield") AS lo, max("yield") AS hi FROM panel1 GROUP BY 1)
          USING (c_year)""", "panel1")
def _(v: Views):
    return R.minmax_scale(v.panel1, [], ["yield"], by=["c_year"])[0]


@query("scale_sequence", "region_id c_year:i a:d b:d mm:d",
       """WITH l AS (SELECT "evi_LT2" AS v FROM features UNION ALL SELECT "evi_LT1" FROM features)
          SELECT region_id, c_year, ("evi_LT2" - (SELECT avg(v) FROM l)) / (SELECT stddev_pop(v) FROM l) AS a,
          ("evi_LT1" - (SELECT avg(v) FROM l)) / (SELECT stddev_pop(v) FROM l) AS b,
          ("evi_LT1" - (SELECT min("evi_LT1") FROM features)) / (SELECT max("evi_LT1") - min("evi_LT1") FROM features) AS mm FROM features""", "features")
def _(v: Views):
    from harvestline.operators.leads import to_sequence

    seq = to_sequence(v.features, ["evi", "t2m"], [2, 1], ["region_id", "c_year"])
    both = R.scale_sequence(R.scale_sequence(seq.withColumn("seq2", F.col("seq")), "seq"), "seq2", per_step=True)
    return both.select("region_id", "c_year", F.col("seq")[0][0].alias("a"), F.col("seq")[1][0].alias("b"), F.col("seq2")[1][0].alias("mm"))


@query("polygon_to_pixels", "field_id:l cols rows",
       """SELECT field_id, array_to_string(list_transform(xs, lambda x: printf('%.3f', (x - min_x) / 10)), ',') AS cols,
          array_to_string(list_transform(ys, lambda y: printf('%.3f', abs(y - max_y) / 10)), ',') AS "rows" FROM parcels""", "parcels")
def _(v: Views):
    cols, rows = S.polygon_to_pixels("xs", "ys")
    text = lambda a: F.array_join(F.transform(a, lambda x: F.format_string("%.3f", x)), ",")
    return v.parcels.select("field_id", text(cols).alias("cols"), text(rows).alias("rows"))


@query("json_report", "label:i report n_back:i",
       """SELECT label, '{"n":' || count(*) || ',"first":' || min(vec_id) || ',"dims":[' || min(len(embedding)) || ',' || max(len(embedding)) || ']}' AS report, 2 AS n_back
          FROM embeddings GROUP BY 1""")
def _(v: Views):
    s = v.table("embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"),
                                                   F.array(F.min(F.size("embedding")), F.max(F.size("embedding"))).alias("dims"))
    df = R.json_report(s, ["label"], ["n", "first", "dims"])
    return df.withColumn("n_back", F.size(R.json_list(F.get_json_object("report", "$.dims"), "int")))


@query("add_year_feature", "region_id c_year:i year_LT1:i year_LT2:i", 'SELECT region_id, c_year, c_year AS "year_LT1", c_year AS "year_LT2" FROM panel1', "panel1")
def _(v: Views):
    return R.add_year_feature(v.panel1, 2)
