"""Set operations between tables."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def union_labelled(frames: Mapping[str, DataFrame], label: str = "source") -> DataFrame:
    parts = [df.withColumn(label, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_common_columns(frames: Sequence[DataFrame]) -> DataFrame:
    shared = [c for c in frames[0].columns if all(c in df.columns for df in frames[1:])]
    return reduce(lambda a, b: a.unionByName(b), [df.select(*shared) for df in frames])


def intersect_years(left: DataFrame, right: DataFrame, year: str = "c_year") -> DataFrame:
    """Years of both sides, null among them. Each side is reduced to its years before they meet: an
    intersection of the rows would sort all rows of a year in one task."""
    return left.select(year).distinct().intersect(right.select(year).distinct())


def except_rows(all_rows: DataFrame, held_out: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Training rows: everything that is not held out (by key, or as whole rows)."""
    if key is None:
        return all_rows.exceptAll(held_out)
    return all_rows.join(held_out.select(*key), list(key), "left_anti")


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct().orderBy(*cols)
