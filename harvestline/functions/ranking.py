"""Exact ranks without one-task windows.

A window without a partition key, or over one hot group, puts every row into a single
task. The helpers here split a group by a prefix of a row hash (uniform whatever the
data looks like) or by value buckets, count rows per slice, and add the slice offset to
the rank inside the slice. Offset tables have a fixed number of rows per group.

Group keys travel packed in one struct: unlike plain columns, structs with equal NULL
fields are equal, so ordinary equi-joins keep NULL groups and share the partitioning of
the windows after them.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from harvestline.session import cut_lineage

PREFIX = 3  # hex digits: 4096 slices of every group
BUCKETS = 4096
SALTS = 64  # parts of a group that get its aggregates each for themselves


def hash_order(id_cols: Sequence[str], seed: int | str) -> Column:
    """Seeded pseudo-random order of rows; the same text as ``md5(concat_ws('_', ids..., seed))``."""
    return F.md5(F.concat_ws("_", *[F.col(c).cast("string") for c in id_cols], F.lit(str(seed))))


def packed(by: Sequence[str]) -> Column:
    """Group key as one never-null column."""
    return F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))


def hash_rank(df: DataFrame, id_cols: Sequence[str], seed: int | str, by: Sequence[str] = (),
              rank: str = "rank", total: str | None = None) -> DataFrame:
    """1..n in seeded random order inside each ``by`` group (or overall)."""
    hashed = df.withColumns({"_g": packed(by), "_h": hash_order(id_cols, seed)})
    hashed = hashed.withColumn("_slice", F.substring("_h", 1, PREFIX))
    slices = hashed.groupBy("_g", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    # one row per slice: at most 16**PREFIX rows per group
    upto = W.partitionBy("_g").orderBy("_slice")
    slices = slices.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
    if total:
        slices = slices.withColumn(total, F.sum("_n").over(W.partitionBy("_g")))
    inside = W.partitionBy("_g", "_slice").orderBy("_h", *id_cols)
    joined = hashed.join(slices.drop("_n"), ["_g", "_slice"])
    out = joined.withColumn(rank, F.col("_before") + F.row_number().over(inside))
    return out.select(*df.columns, rank, *([total] if total else []))


def value_rank(df: DataFrame, value: str, id_cols: Sequence[str], seed: int | str, by: Sequence[str] = (),
               rank: str = "rank", total: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """1..n by ascending value, ties in seeded random order. Values are cut into
    monotone buckets; inside a bucket only the distinct (value, hash slice) pairs are
    ordered, so neither a hot group nor a hot value meets one task."""
    hashed = df.withColumns({"_g": packed(by), "_h": hash_order(id_cols, seed), "_v": F.struct(F.col(value).alias("v"))})
    hashed = hashed.withColumn("_slice", F.substring("_h", 1, PREFIX))
    counts = cut_lineage(hashed.groupBy("_g", "_v", "_slice").agg(F.count(F.lit(1)).alias("_n")))
    counts = with_part(with_bucket(counts, F.col("_v.v"), buckets, grouped=bool(by)), F.col("_v.v"), buckets)
    coarse = counts.groupBy("_g", "_bucket").agg(F.sum("_n").alias("_bn"))
    coarse = coarse.withColumn("_base", F.sum("_bn").over(W.partitionBy("_g").orderBy("_bucket")) - F.col("_bn"))
    if total:
        coarse = coarse.withColumn(total, F.sum("_bn").over(W.partitionBy("_g")))
    parts = counts.groupBy("_g", "_bucket", "_part").agg(F.sum("_n").alias("_pn"))
    upto = W.partitionBy("_g", "_bucket").orderBy("_part")  # at most ``buckets`` rows
    parts = parts.join(coarse.drop("_bn"), ["_g", "_bucket"]).withColumn("_base", F.col("_base") + F.sum("_pn").over(upto) - F.col("_pn")).drop("_pn")
    fine = W.partitionBy("_g", "_bucket", "_part").orderBy("_v", "_slice")
    offsets = counts.join(parts, ["_g", "_bucket", "_part"])
    offsets = offsets.withColumn("_before", F.col("_base") + F.sum("_n").over(fine) - F.col("_n")).drop("_base", "_n", "_bucket", "_part")
    inside = W.partitionBy("_g", "_v", "_slice").orderBy("_h", *id_cols)
    joined = hashed.join(offsets, ["_g", "_v", "_slice"])
    out = joined.withColumn(rank, F.col("_before") + F.row_number().over(inside))
    return out.select(*df.columns, rank, *([total] if total else []))


def magnitude(value: Column) -> Column:
    """Monotone compression, so that a few huge values do not flatten the buckets."""
    return F.signum(value) * F.log1p(F.abs(value))


def salt(*cols: Column | str) -> Column:
    """Part of a group that a row belongs to, by the hash of some of its values."""
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS))


def with_bucket(counts: DataFrame, value: Column, buckets: int = BUCKETS, sums: Mapping[str, Column] | None = None, grouped: bool = True) -> DataFrame:
    """Adds ``_bucket``: a monotone function of the value inside its group ``_g``, computed
    from the group's exact minimum and maximum (so a recomputation gives the same).
    ``sums`` are more columns: the group's sums of these values. A group meets its
    aggregates in ``SALTS`` parts, so that few groups do not mean few tasks."""
    numeric = magnitude(value.cast("double"))
    ends = [F.min(numeric).alias("_lo"), F.max(numeric).alias("_hi"), *[F.sum(c).alias(n) for n, c in (sums or {}).items()]]
    share = F.try_divide(numeric - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    bucket = F.coalesce(F.floor(share * (buckets - 1)).cast("int"), F.lit(0))
    if grouped:
        counts = counts.withColumn("_salt", salt(value))
        whole = W.partitionBy("_g")  # at most SALTS rows
        parts = counts.groupBy("_g", "_salt").agg(*ends)
        parts = parts.select("_g", "_salt", F.min("_lo").over(whole).alias("_lo"), F.max("_hi").over(whole).alias("_hi"),
                             *[F.sum(n).over(whole).alias(n) for n in sums or {}])
        joined = counts.join(parts, ["_g", "_salt"]).drop("_salt")
    else:  # one group: its aggregates are one row, read as a scalar subquery
        joined = null_safe_join(counts, counts.groupBy("_g").agg(*ends).drop("_g"), [])
    return joined.withColumn("_bucket", bucket).drop("_lo", "_hi")


def with_part(counts: DataFrame, value: Column, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``_part``: cuts every bucket again, evenly between its own minimum and maximum. One
    far value leaves a group's other values in a few buckets; this takes those apart."""
    numeric = magnitude(value.cast("double"))
    ends = counts.groupBy("_g", "_bucket").agg(F.min(numeric).alias("_lo"), F.max(numeric).alias("_hi"))
    share = F.try_divide(numeric - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    part = F.coalesce(F.floor(share * (buckets - 1)).cast("int"), F.lit(0))
    return counts.join(ends, ["_g", "_bucket"]).withColumn("_part", part).drop("_lo", "_hi")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on same-named keys where NULL equals NULL; no keys means a one-row right side."""
    if not keys:
        row = right.select(F.struct(*right.columns).alias("_row")).scalar()
        joined = left.withColumn("_row", row)
        return joined.select(*left.columns, *[F.col("_row")[c].alias(c) for c in right.columns])
    renamed = right.select(*[F.col(c).alias("_r_" + c) if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col("_r_" + k))
        cond = term if cond is None else cond & term
    return left.join(renamed, cond, how).drop(*["_r_" + k for k in keys])
