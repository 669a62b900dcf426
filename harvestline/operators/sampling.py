"""Sorts, limits, de-duplication and seeded samples."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from harvestline.functions.ranking import hash_order, hash_rank, value_rank


def sort_by(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.orderBy(*order)


def top_k(df: DataFrame, k: int, order: Column, tie: Sequence[str] = ()) -> DataFrame:
    """k first rows of an ordering; each task keeps only its own k."""
    return df.orderBy(order, *tie).limit(k)


def top_k_per_group(df: DataFrame, by: Sequence[str], k: int, order: Sequence[Column], rank: str = "rank", slices: int = 64) -> DataFrame:
    """k first rows per group. A first round ranks within hash slices of a group, so a hot group
    is ordered by many tasks; it only removes rows that cannot be among the first, and leaves
    the last round k rows per slice at most."""
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(slices)))
    first = W.partitionBy(*by, "_slice").orderBy(*order)
    kept = sliced.withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= k).drop("_slice", rank)
    w = W.partitionBy(*by).orderBy(*order)
    return kept.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def cap_per_group(df: DataFrame, by: Sequence[str], id_col: str, n: int = 1000, seed: int = 42, *,
                  area: str | None = None, min_area: float = 0.1) -> DataFrame:
    """At most n random rows per group, after dropping slivers below ``min_area``."""
    if area:
        df = df.where(F.col(area) >= min_area)
    ordered = [hash_order([id_col], seed), F.col(id_col)]
    return top_k_per_group(df, by, n, ordered, rank="_rank").drop("_rank")


def _share(total: str, p: float) -> Column:
    return F.floor(F.col(total) * F.lit(float(p)) + 0.5)


def lowest_fraction(df: DataFrame, value: str, id_col: str, p: float, seed: int = 42) -> DataFrame:
    """The round(n*p) rows with the lowest value: a deliberately biased sample."""
    ranked = value_rank(df, value, [id_col], seed, rank="_rank", total="_total")
    return ranked.where(F.col("_rank") <= _share("_total", p)).drop("_rank", "_total")


def random_fraction(df: DataFrame, id_cols: Sequence[str], p: float, seed: int = 42) -> DataFrame:
    """Exactly round(n*p) rows, picked by a seeded hash."""
    ranked = hash_rank(df, id_cols, seed, rank="_rank", total="_total")
    return ranked.where(F.col("_rank") <= _share("_total", p)).drop("_rank", "_total")


def every_nth(df: DataFrame, by: Sequence[str], order: str, n: int = 5) -> DataFrame:
    """Every n-th distinct date (or file) of each group, starting with the first. Only
    the distinct keys are numbered, the rows follow by a join."""
    keys = df.select(*by, order).distinct()
    w = W.partitionBy(*by).orderBy(order)
    kept = keys.withColumn("_i", F.row_number().over(w)).where((F.col("_i") - 1) % n == 0).drop("_i")
    return df.join(kept, [*by, order], "left_semi")


def dedupe_first(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in an explicit order."""
    return top_k_per_group(df, key, 1, list(order), rank="_rank").drop("_rank")
