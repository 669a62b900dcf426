"""Schemas of the domain tables. Missing values are always NULL, never NaN."""

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


SCENE_CATALOG = _schema(
    "scene_id string, collection string, begin_ts timestamp, min_x double, min_y double,"
    " max_x double, max_y double, cloud_cover double")
PIXELS = _schema(
    "scene_id string, band string, obs_date date, `row` int, col int, x double, y double,"
    " value double")
REGIONS = _schema("region_id string, xs array<double>, ys array<double>")
ZONAL = _schema(
    "region_id string, obs_date date, band string, median double, std double,"
    " cloud_cover double")
SERIES = _schema("region_id string, param string, obs_date date, value double")
OBSERVATIONS = _schema("region_id string, param string, ts timestamp, value double")
YIELD_PANEL = _schema("region_id string, crop string, c_year int, yield double")
HARVEST_CALENDAR = _schema("crop string, country string, month int, day int")
PREDICTIONS = _schema(
    "setup string, crop string, year int, region string, y_true double, y_pred double")
IMPORTANCES = _schema(
    "year int, feature string, feature_type string, base_mean double, base_std double,"
    " finetuned_mean double, finetuned_std double")
NEIGHBORS = _schema("src string, dst string, w double")
MANIFEST = _schema("run_id int, settings string")
