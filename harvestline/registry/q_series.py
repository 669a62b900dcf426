"""Time series, harvest windows and lead-time features."""

from pyspark.sql import functions as F, types as T

from harvestline.functions.scalars import admin_key
from harvestline.operators import leads as L, timeseries as S
from harvestline.registry.base import query
from harvestline.registry.views import Views

PARAMS = ["evi", "t2m", "tp"]
KEYS = "region_id param"


@query("resample_daily", f"{KEYS} obs_date:t value:d", "SELECT region_id, param, obs_date, avg(value) AS value FROM obs GROUP BY 1, 2, 3", "obs")
def _(v: Views):
    return S.resample_daily(v.obs)


@query("resample_daily_flags", f"{KEYS} obs_date:t flag:i", "SELECT region_id, param, obs_date, max(flag) AS flag FROM obs GROUP BY 1, 2, 3", "obs")
def _(v: Views):
    return S.resample_daily(v.obs, value="flag", agg="max")


def _bins(days: int, src: str = "daily", value: str = "avg(value)") -> str:
    """First Sunday at or after the first day, later bins every ``days``."""
    return f"""SELECT region_id, param, CAST(s0 + {days} * CAST(greatest(0, ceil((obs_date - s0) / {days}.0)) AS INTEGER) AS DATE) AS label, {value} AS value
        FROM (SELECT d.*, f + CAST((7 - isodow(f)) % 7 AS INTEGER) AS s0 FROM {src} d JOIN (SELECT region_id, param, min(obs_date) AS f FROM {src} GROUP BY 1, 2) USING (region_id, param))
        GROUP BY 1, 2, 3"""


@query("resample_weekly", f"{KEYS} label:t value:d", _bins(7), "daily")
def _(v: Views):
    return S.resample_weekly(v.daily)


@query("resample_2w", f"{KEYS} label:t value:d", _bins(14), "daily")
def _(v: Views):
    return S.resample_2w(v.daily)


@query("resample_monthly", f"{KEYS} label:t value:d", "SELECT region_id, param, last_day(obs_date) AS label, avg(value) AS value FROM daily GROUP BY 1, 2, 3", "daily")
def _(v: Views):
    return S.resample_monthly(v.daily)


@query("resample_6d", f"{KEYS} c_year:i step:i value:d",
       """WITH b AS (SELECT region_id, param, CAST(year(obs_date) AS INTEGER) AS c_year, CAST(floor((dayofyear(obs_date) - 1) / 6.0) AS INTEGER) AS step, 10 * log10(avg(pow(10.0, (value / 10) / 10))) AS value
          FROM country_daily GROUP BY 1, 2, 3, 4) SELECT * FROM b WHERE (region_id, param, c_year) IN (SELECT (region_id, param, c_year) FROM b GROUP BY region_id, param, c_year HAVING count(value) = 61)""", "country_daily")
def _(v: Views):
    series = v.country_daily.withColumn("value", F.col("value") / 10)
    return S.resample_6d(series, ["region_id", "param"])


@query("fill_spine", f"{KEYS} obs_date:t value:d",
       """SELECT s.region_id, s.param, s.obs_date, coalesce(o.value, -9999) AS value FROM (SELECT region_id, param, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS obs_date
          FROM (SELECT region_id, param, min(obs_date) AS a, max(obs_date) AS b FROM odaily GROUP BY 1, 2)) s LEFT JOIN odaily o USING (region_id, param, obs_date)""", "odaily")
def _(v: Views):
    return S.fill_spine(v.odaily, fill=-9999.0)


SPINE = """(SELECT s.region_id, s.param, s.obs_date, o.value FROM (SELECT region_id, param, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS obs_date
    FROM (SELECT DISTINCT region_id, param FROM odaily)) s LEFT JOIN odaily o USING (region_id, param, obs_date))"""


def _interpolated(src: str, by: str, order: str) -> str:
    """Linear by position; the end repeats, the start stays empty."""
    w = f"PARTITION BY {by} ORDER BY {order}"
    return f"""(SELECT * EXCLUDE (value, i, pv, pi_, nv, ni), coalesce(value, pv + coalesce((nv - pv) / nullif(ni - pi_, 0), 0) * (i - pi_)) AS value FROM (
        SELECT *, last_value(value IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
        last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pi_,
        first_value(value IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
        first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni
        FROM (SELECT *, row_number() OVER ({w}) AS i FROM {src})))"""


def spine(v: Views):
    return S.fill_spine(v.odaily, start="2024-01-01", end="2024-01-31")


@query("interpolate_linear", f"{KEYS} obs_date:t value:d", f"SELECT region_id, param, obs_date, value FROM {_interpolated(SPINE, 'region_id, param', 'obs_date')}", "odaily")
def _(v: Views):
    return S.interpolate_linear(spine(v))


_W = "PARTITION BY region_id, param ORDER BY obs_date"


@query("rolling_mean_rows", f"{KEYS} obs_date:t smoothed:d",
       f"""SELECT region_id, param, obs_date, CASE WHEN i > 3 AND i <= n - 3 THEN 10 * log10(m) END AS smoothed FROM (SELECT *, row_number() OVER ({_W}) AS i, count(*) OVER (PARTITION BY region_id, param) AS n,
           avg(pow(10.0, value / 100)) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS m FROM {SPINE})""", "odaily")
def _(v: Views):
    df = spine(v).withColumn("value", F.col("value") / 10)
    return S.rolling_mean_rows(df, n=3, in_db=True)


COARSE = "(SELECT DISTINCT region_id, param, CAST(obs_date AS TIMESTAMP) AS t FROM odaily WHERE dayofmonth(obs_date) IN (1, 7, 13, 19, 25))"
PAIRS = f"""(SELECT c.region_id, c.param, c.t, o.value, floor(abs(epoch_us(o.ts) - epoch_us(c.t)) / 86400e6) AS dist FROM {COARSE} c LEFT JOIN obs o
    ON o.region_id = c.region_id AND o.param = c.param AND o.ts BETWEEN c.t - INTERVAL 6 DAY AND c.t + INTERVAL 6 DAY)"""


def coarse(v: Views):
    return v.odaily.where(F.dayofmonth("obs_date").isin(1, 7, 13, 19, 25)).select("region_id", "param", F.col("obs_date").cast("timestamp").alias("ts")).distinct()


def daily_label(df, name: str):
    return df.select("region_id", "param", F.date_format("ts", "yyyy-MM-dd").alias("ts"), name)


@query("rolling_mean_days", f"{KEYS} ts smoothed:d",
       f"SELECT region_id, param, strftime(t, '%Y-%m-%d') AS ts, 10 * log10(avg(pow(10.0, value / 100))) AS smoothed FROM {PAIRS} GROUP BY 1, 2, 3", "obs odaily")
def _(v: Views):
    return daily_label(S.rolling_mean_days(v.obs.withColumn("value", F.col("value") / 10), coarse(v)), "smoothed")


@query("rolling_gauss_days", f"{KEYS} ts smoothed:d",
       f"""SELECT region_id, param, strftime(t, '%Y-%m-%d') AS ts, sum(exp(-0.5 * pow(dist / 2, 2)) * value) / sum(CASE WHEN value IS NOT NULL THEN exp(-0.5 * pow(dist / 2, 2)) END) AS smoothed
           FROM {PAIRS} GROUP BY 1, 2, 3""", "obs odaily")
def _(v: Views):
    return daily_label(S.rolling_gauss_days(v.obs, coarse(v), in_db=False), "smoothed")


@query("rolling_op_days", f"{KEYS} ts reduced:d", f"SELECT region_id, param, strftime(t, '%Y-%m-%d') AS ts, max(value) AS reduced FROM {PAIRS} GROUP BY 1, 2, 3", "obs odaily")
def _(v: Views):
    return daily_label(S.rolling_op_days(v.obs, coarse(v), F.max), "reduced")


@query("rolling_op_days_custom", f"{KEYS} ts reduced:d",
       f"SELECT region_id, param, strftime(t, '%Y-%m-%d') AS ts, max(value) - min(value) AS reduced FROM {PAIRS} GROUP BY 1, 2, 3", "obs odaily")
def _(v: Views):
    """A user's own reducer as a grouped-aggregate pandas UDF."""
    import pandas as pd

    @F.pandas_udf(T.DoubleType())
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return daily_label(S.rolling_op_days(v.obs, coarse(v), lambda c: spread(c)), "reduced")


@query("ewm_smooth", f"{KEYS} obs_date:t smoothed:d",
       f"""WITH f AS (SELECT *, row_number() OVER ({_W}) AS k FROM {_interpolated(SPINE, 'region_id, param', 'obs_date')})
           SELECT a.region_id, a.param, a.obs_date, sum(b.value * pow(1.0 / 3, a.k - b.k)) / sum(CASE WHEN b.value IS NOT NULL THEN pow(1.0 / 3, a.k - b.k) END) AS smoothed
           FROM f a JOIN f b ON a.region_id = b.region_id AND a.param = b.param AND b.k <= a.k GROUP BY 1, 2, 3""", "odaily")
def _(v: Views):
    return S.ewm_smooth(S.interpolate_linear(spine(v)))


DETRENDED = """(SELECT *, value - coalesce(regr_slope(value, i) OVER (PARTITION BY region_id, param) * i + regr_intercept(value, i) OVER (PARTITION BY region_id, param),
    avg(value) OVER (PARTITION BY region_id, param)) AS det FROM (SELECT *, row_number() OVER (PARTITION BY region_id, param ORDER BY obs_date) AS i FROM country_daily))"""


@query("detrend_series", f"{KEYS} obs_date:t detrended:d", f"SELECT region_id, param, obs_date, det AS detrended FROM {DETRENDED}", "country_daily")
def _(v: Views):
    return S.detrend_series(v.country_daily)


def _clim(src: str, value: str) -> str:
    slot = "dayofyear(obs_date) + CASE WHEN dayofmonth(last_day(make_date(year(obs_date), 2, 1))) <> 29 AND month(obs_date) > 2 THEN 1 ELSE 0 END"
    return f"""(SELECT region_id, param, doy, clim FROM (SELECT *, avg(m) OVER (PARTITION BY region_id, param ORDER BY p RANGE BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS clim FROM
        (SELECT region_id, param, doy, m, turn, doy + turn AS p FROM (SELECT region_id, param, {slot} AS doy, avg(s) AS m FROM
          (SELECT *, avg({value}) OVER (PARTITION BY region_id, param ORDER BY CAST(obs_date - DATE '1970-01-01' AS INTEGER) RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS s FROM {src} WHERE {value} IS NOT NULL)
          GROUP BY 1, 2, 3), (VALUES (-366), (0), (366)) t(turn))) WHERE turn = 0)"""


_SLOT = "dayofyear(d.obs_date) + CASE WHEN dayofmonth(last_day(make_date(year(d.obs_date), 2, 1))) <> 29 AND month(d.obs_date) > 2 THEN 1 ELSE 0 END"


@query("climatology", f"{KEYS} doy:i clim:d", f"SELECT region_id, param, doy, clim FROM {_clim('country_daily', 'value')}", "country_daily")
def _(v: Views):
    return S.climatology(v.country_daily)


@query("anomaly", f"{KEYS} obs_date:t anom:a",
       f"""WITH slotted AS MATERIALIZED (SELECT region_id, param, obs_date, value, {_SLOT} AS doy FROM country_daily d),
           clims AS MATERIALIZED (SELECT * FROM {_clim('country_daily', 'value')})
           SELECT region_id, param, obs_date, value - clim AS anom FROM slotted LEFT JOIN clims USING (region_id, param, doy)""", "country_daily")
def _(v: Views):
    return S.anomaly(v.country_daily)


@query("anomaly_detrended", f"{KEYS} obs_date:t anom:a",
       f"SELECT d.region_id, d.param, d.obs_date, d.det - c.clim AS anom FROM {DETRENDED} d LEFT JOIN {_clim(DETRENDED, 'det')} c ON c.region_id = d.region_id AND c.param = d.param AND c.doy = {_SLOT}", "country_daily")
def _(v: Views):
    return S.anomaly(v.country_daily, detrend=True)


# --- harvest windows -----------------------------------------------------------------
# Proxy calendar: five reference days, dealt to the countries by code.

HARVEST = [(r, *d) for r, d in enumerate([(6, 30), (7, 16), (9, 30), (7, 11), (10, 10)])]
_CAL = f"""(SELECT region_id, c_year, make_date(c_year, month, day) - 2 AS harvest FROM (SELECT DISTINCT region_id, CAST(substr(region_id, 1, 2) AS INTEGER) % 5 AS k FROM daily)
    JOIN (VALUES {', '.join(map(str, HARVEST))}) h(k, month, day) USING (k), (SELECT DISTINCT c_year FROM panel1))"""


def calendar(v: Views):
    days = v.spark.createDataFrame(HARVEST, "k int, month int, day int")
    regions = v.line.select("region_id").distinct().withColumn("k", F.col("region_id").substr(1, 2).cast("int") % 5)
    return L.harvest_calendar(regions.join(days, "k").drop("k"), v.panel1, days_before=2)


@query("harvest_calendar", "region_id c_year:i harvest:t", f"SELECT * FROM {_CAL}", "daily panel1")
def _(v: Views):
    return calendar(v)


@query("harvest_days", "crop country month:i day:i n:l",
       """SELECT crop, country, month, day, count(*) AS n FROM (VALUES """ + ", ".join(
           f"('{crop}', '{c}', {m}, {d})" for crop, by in L.HARVEST_DAYS.items() for c, (m, d) in by.items()) +
       """) h(crop, country, month, day), orders WHERE month(o_orderdate) = h.month AND dayofmonth(o_orderdate) = h.day GROUP BY 1, 2, 3, 4""")
def _(v: Views):
    """Orders placed on the reference days."""
    days = L.harvest_days(v.spark)
    orders = v.table("orders").groupBy(F.month("o_orderdate").alias("month"), F.dayofmonth("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(orders, ["month", "day"])


def _season(bins: str) -> str:
    return f"""(SELECT b.*, c.c_year, c.harvest FROM ({bins}) b JOIN {_CAL} c ON c.region_id = b.region_id AND b.label BETWEEN CAST(c.harvest - INTERVAL 4 MONTH AS DATE) AND c.harvest)"""


def _leads(src: str, k: int) -> str:
    return "SELECT region_id, c_year, " + ", ".join(
        f"max(CASE WHEN param = '{p}' AND lead = {n} THEN value END) AS \"{p}_LT{n}\"" for n in range(k, 0, -1) for p in PARAMS) + f" FROM {src} GROUP BY 1, 2"


def _lead_out(k: int) -> str:
    return "region_id c_year:i " + " ".join(f"{p}_LT{n}:d" for n in range(k, 0, -1) for p in PARAMS)


_BINS2W = _bins(14)
_RANK = "row_number() OVER (PARTITION BY region_id, c_year, param ORDER BY label {d})"
_MONTHLY = "SELECT region_id, param, last_day(obs_date) AS label, avg(value) AS value FROM daily GROUP BY 1, 2, 3"


def season(v: Views, binned):
    return L.in_season(binned, calendar(v), ["region_id"])


@query("lead_features_head", _lead_out(4), _leads(f"(SELECT *, 5 - {_RANK.format(d='ASC')} AS lead FROM {_season(_MONTHLY)})", 4), "daily panel1")
def _(v: Views):
    return L.lead_features_head(season(v, S.resample_monthly(v.daily)), PARAMS, 4)


_FILLED2W = f"SELECT region_id, param, label, value FROM {_interpolated('(' + _BINS2W + ')', 'region_id, param', 'label')}"


TAIL_SQL = "SELECT * FROM (" + _leads(f"(SELECT *, {_RANK.format(d='DESC')} AS lead FROM {_season(_FILLED2W)})", 8) + ") WHERE " + " AND ".join(
    f'"{p}_LT{n}" IS NOT NULL' for p in PARAMS for n in range(1, 9))


@query("lead_features_tail", _lead_out(8), TAIL_SQL, "daily panel1")
def _(v: Views):
    filled = S.interpolate_linear(S.resample_2w(v.daily), order="label")
    return L.lead_features_tail(season(v, filled), PARAMS, 8)


_THIN = f"SELECT region_id, param, label, CASE WHEN value > 0.4003 THEN value END AS value FROM ({_BINS2W})"
_LAST5 = f"(SELECT * FROM (SELECT *, {_RANK.format(d='DESC')} AS lead FROM {_season(_THIN)}) WHERE lead <= 5)"


@query("lead_features_interp", _lead_out(4) + " last_label:t",
       f"""SELECT w.*, last_label FROM ({_leads(_interpolated(_LAST5, 'region_id, c_year, param', 'label'), 4)}) w JOIN
           (SELECT region_id, c_year, max(label) AS last_label FROM {_LAST5} GROUP BY 1, 2) USING (region_id, c_year)""", "daily panel1")
def _(v: Views):
    thin = S.resample_2w(v.daily).withColumn("value", F.when(F.col("value") > 0.4003, F.col("value")))
    return L.lead_features_interp(season(v, thin), PARAMS, 4)


@query("lead_features_blocks", _lead_out(4),
       _leads(f"""(SELECT region_id, c_year, param, lead, avg(value) AS value FROM (SELECT *, CAST(ceil({_RANK.format(d='DESC')} / 4.0) AS INTEGER) AS lead FROM {_season(_bins(7))}) WHERE lead <= 4 GROUP BY 1, 2, 3, 4)""", 4), "daily panel1")
def _(v: Views):
    return L.lead_features_blocks(season(v, S.resample_weekly(v.daily)), PARAMS, 4, 4)


@query("lag_bin_means", "region_id c_year:i " + " ".join(f"evi_LT{i}:d" for i in range(1, 9)),
       "SELECT d.region_id, c.c_year, " + ", ".join(f"avg(CASE WHEN c.harvest - d.obs_date BETWEEN {14 * (i - 1) + 1} AND {14 * i} THEN value END) AS \"evi_LT{i}\"" for i in range(1, 9))
       + f" FROM daily d JOIN {_CAL} c ON c.region_id = d.region_id AND c.c_year = year(d.obs_date) WHERE d.param = 'evi' GROUP BY 1, 2", "daily panel1")
def _(v: Views):
    return L.lag_bin_means(v.daily.where("param = 'evi'"), calendar(v), ["region_id"])


EVI = [f"evi_LT{k}" for k in (4, 3, 2, 1)]


@query("cumulative_leads", "region_id c_year:i " + " ".join(f"{c}:d" for c in EVI),
       'SELECT region_id, c_year, "evi_LT4", ' + ", ".join(" + ".join(f'coalesce("{c}", 0)' for c in EVI[: i + 1]) + f' AS "{EVI[i]}"' for i in range(1, 4)) + " FROM features", "features")
def _(v: Views):
    return L.cumulative_leads(v.features, EVI)


@query("cumulative_leads_compounding", "region_id c_year:i " + " ".join(f"{c}:d" for c in EVI),
       """SELECT region_id, c_year, a AS "evi_LT4", a0 + b AS "evi_LT3", a0 + (a0 + b) + c AS "evi_LT2", a0 + (a0 + b) + (a0 + (a0 + b) + c) + d AS "evi_LT1" FROM
          (SELECT region_id, c_year, "evi_LT4" AS a, coalesce("evi_LT4", 0) AS a0, coalesce("evi_LT3", 0) AS b, coalesce("evi_LT2", 0) AS c, coalesce("evi_LT1", 0) AS d FROM features)""", "features")
def _(v: Views):
    return L.cumulative_leads(v.features, EVI, compounding=True)


@query("latest_and_mean", "region_id c_year:i evi_latest_month:d evi_mean_before:d t2m_latest_month:d t2m_mean_before:d",
       "SELECT region_id, c_year, " + ", ".join(
           f"\"{b}_LT1\" AS {b}_latest_month, ({' + '.join(f'coalesce(\"{b}_LT{n}\", 0)' for n in range(1, 5))}) / ({' + '.join(f'(\"{b}_LT{n}\" IS NOT NULL)::INTEGER' for n in range(1, 5))}) AS {b}_mean_before"
           for b in ("evi", "t2m")) + " FROM features", "features")
def _(v: Views):
    return L.latest_and_mean(v.features, ["evi", "t2m"], [1, 2, 3, 4], ["region_id", "c_year"])


@query("to_sequence", "region_id c_year:i steps:i s0_evi:d s0_t2m:d s2_evi:d s2_t2m:d",
       'SELECT region_id, c_year, 3 AS steps, "evi_LT4" AS s0_evi, "t2m_LT4" AS s0_t2m, "evi_LT2" AS s2_evi, "t2m_LT2" AS s2_t2m FROM features', "features")
def _(v: Views):
    seq = L.to_sequence(v.features, ["evi", "t2m"], [1, 2, 3, 4], ["region_id", "c_year"], first=3)
    at = lambda i, j: F.col("seq")[i][j]
    return seq.select("region_id", "c_year", F.size("seq").alias("steps"), at(0, 0).alias("s0_evi"), at(0, 1).alias("s0_t2m"), at(2, 0).alias("s2_evi"), at(2, 1).alias("s2_t2m"))


@query("country_lag_means", "country c_year:i evi_LT1:d evi_LT2:d",
       """SELECT country, c_year, avg(CASE WHEN b BETWEEN 1 AND 14 THEN value END) AS "evi_LT1", avg(CASE WHEN b BETWEEN 15 AND 28 THEN value END) AS "evi_LT2" FROM (SELECT substr(region_id, 1, 2) AS country,
          CAST(year(obs_date) AS INTEGER) AS c_year, value, make_date(year(obs_date), 7, 16) - obs_date AS b FROM daily WHERE param = 'evi') GROUP BY 1, 2""", "daily")
def _(v: Views):
    df = v.daily.where("param = 'evi'").withColumn("country", admin_key("region_id"))
    days = df.select("country").distinct().withColumns({"month": F.lit(7), "day": F.lit(16)})
    return L.lag_bin_means(df, L.harvest_calendar(days, v.panel1), ["country"], k=2)


