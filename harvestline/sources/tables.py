"""Readers and writers of observation tables, predictions and run records."""

from __future__ import annotations

import json
from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from harvestline.functions.scalars import parse_decimal_comma


def scan_delimited(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, *, sep: str = ";",
                   encoding: str = "ISO-8859-1", null_token: str = "", decimal: str = ",",
                   header: bool = True) -> DataFrame:
    """Typed table from delimited text. With a decimal comma the numeric columns are
    read as text and converted in the plan."""
    doubles = {f.name for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    raw = schema
    if decimal == ",":
        raw = T.StructType([T.StructField(f.name, T.StringType() if f.name in doubles else f.dataType)
                            for f in schema.fields])
    df = (spark.read.schema(raw).option("sep", sep).option("encoding", encoding).option("header", header)
          .option("nullValue", null_token).option("mode", "FAILFAST").csv(path))
    if decimal == ",":
        df = df.withColumns({name: parse_decimal_comma(name) for name in doubles})
    return df


def scan_columnar(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Table in a domain schema: named columns in order and type, NaN turned into NULL."""
    def column(f: T.StructField):
        c = F.col(f"`{f.name}`").cast(f.dataType)
        return (F.when(~F.isnan(c), c) if isinstance(f.dataType, T.DoubleType) else c).alias(f.name)

    return df.select(*[column(f) for f in schema.fields])


def sink_columnar(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def sink_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite",
                     max_records: int = 5_000_000) -> None:
    """One folder per key. The rebalance hint gathers the rows of a key, so a folder gets
    few files, and lets adaptive execution split a hot key over several tasks."""
    (df.hint("rebalance", *by).write.mode(mode).option("maxRecordsPerFile", max_records).partitionBy(*by).parquet(path))


def scan_many_union(frames: Sequence[DataFrame], key: Sequence[str], prefer: Sequence[str] = ()) -> DataFrame:
    """Tables of the same kind with differing columns in one; rows repeated on ``key``
    appear once, the first in the order of ``prefer``."""
    from harvestline.operators.sampling import dedupe_first

    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if not prefer:
        return merged.dropDuplicates(list(key))
    return dedupe_first(merged, key, [F.col(c) for c in prefer])


def to_region_series(wide: DataFrame, keys: Sequence[str], params: Sequence[str]) -> DataFrame:
    """Extraction table with one column per band to the long series table."""
    return wide.unpivot(list(keys), list(params), "param", "value")


def sink_region_series(series: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Long series store, partitioned by parameter so that a reader of one parameter
    lists one folder."""
    sink_partitioned(series, path, ["param"], mode)


def empty_regions(series: DataFrame, by: Sequence[str] = ("region_id",), value: str = "value") -> DataFrame:
    """Coverage note: groups whose values are all missing."""
    return (series.groupBy(*by).agg(F.count(value).alias("n_values"), F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_values") == 0))


def pixel_table(raster_rows: DataFrame, *, a: float, c: float, e: float, f: float) -> DataFrame:
    """Coordinates of pixel centres from row, column and the raster's affine terms."""
    from harvestline.functions.scalars import pixel_center

    x, y = pixel_center(a, c, e, f, "row", "col")
    return raster_rows.withColumns({"x": x, "y": y})


def scan_pixels(spark: SparkSession, path: str, bands: Sequence[str] | None = None, **affine: float) -> DataFrame:
    df = spark.read.parquet(path)
    if bands:
        df = df.where(F.col("band").isin(list(bands)))
    return pixel_table(df, **affine) if affine else df


def scan_regions(wkt_rows: DataFrame, id_col: str = "region_id", wkt: str = "wkt") -> DataFrame:
    """Region outlines as coordinate arrays with their bounding box, one row per id."""
    from harvestline.functions.scalars import ring_from_wkt
    from harvestline.operators.sampling import dedupe_first

    once = dedupe_first(wkt_rows, [id_col], [F.col(wkt)])
    xs, ys = ring_from_wkt(wkt)
    return with_bbox(once.withColumns({"xs": xs, "ys": ys}).drop(wkt))


def with_bbox(regions: DataFrame) -> DataFrame:
    return regions.withColumns({
        "min_x": F.array_min("xs"), "max_x": F.array_max("xs"),
        "min_y": F.array_min("ys"), "max_y": F.array_max("ys")})


def points_to_regions(df: DataFrame, id_col: str, x: str, y: str) -> DataFrame:
    return df.select(F.col(id_col).alias("region_id"), F.col(x).cast("double").alias("x"),
                     F.col(y).cast("double").alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def next_run_id(manifest: DataFrame) -> DataFrame:
    return manifest.agg((F.coalesce(F.max("run_id"), F.lit(0)) + 1).cast("int").alias("run_id"))


def append_manifest(spark: SparkSession, path: str, settings: Mapping) -> int:
    """Record the settings of a run under the next free number."""
    from harvestline.schemas import MANIFEST

    try:
        current = spark.read.schema(MANIFEST).parquet(path)
        run_id = next_run_id(current).first()[0]
    except Exception as missing:  # first run: no table yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        run_id = 1
    row = [(run_id, json.dumps(dict(settings), sort_keys=True, default=str))]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").parquet(path)
    return run_id


def export_predictions_wide(preds: DataFrame, setups: Sequence[str], keys: Sequence[str] = ("year", "region"),
                            observed: str = "y_true") -> DataFrame:
    """One column per setup in a fixed list (missing ones NULL), sorted by the keys. The
    known list makes it one aggregation."""
    picks = [F.max(F.when(F.col("setup") == s, F.col("y_pred"))).alias(s) for s in setups]
    return preds.groupBy(*keys).agg(F.max(observed).alias("observed"), *picks).orderBy(*keys)
