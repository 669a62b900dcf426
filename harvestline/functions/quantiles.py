"""Exact quantiles, medians and modes that survive a hot group.

``percentile``/``median`` keep every distinct value of a group in one task. Here values
are first counted (hash on group *and* value) and the counts written once, so the input is read
once. They are cut into monotone buckets; those that hold a wanted rank are cut again between
their own ends, so that an outlier that crowds a group into a few buckets does not leave these
whole; and only the small buckets that then hold a wanted rank are ordered.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from harvestline.functions.ranking import BUCKETS, null_safe_join, packed, with_bucket, with_part
from harvestline.session import cut_lineage


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (),
                    std: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``by`` + one column per name in ``probs`` (linear interpolation between the two
    nearest ranks) + ``n``, the count of non-null values, and the population sigma if a name
    for it is given. Groups without any value are left out."""
    counts = (df.where(F.col(value).isNotNull()).groupBy(packed(by).alias("_g"), F.col(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n")))
    counts = cut_lineage(counts)
    sums = {"_sv": F.col("_v") * F.col("_n"), "_sn": F.col("_n")} if std else {}
    counts = with_bucket(counts, F.col("_v"), buckets, sums, grouped=bool(by))
    if std:
        counts = counts.withColumn("_mean", F.col("_sv") / F.col("_sn")).drop("_sv", "_sn")
    spread = [F.sum(F.pow(F.col("_v") - F.col("_mean"), 2) * F.col("_n")).alias("_bss")] if std else []
    hist = counts.groupBy("_g", "_bucket").agg(F.sum("_n").alias("_bn"), *spread)
    whole = W.partitionBy("_g")  # at most ``buckets`` rows
    hist = hist.withColumns({"_base": F.sum("_bn").over(whole.orderBy("_bucket")) - F.col("_bn"), "_total": F.sum("_bn").over(whole)})
    if std:
        hist = hist.withColumn("_ss", F.sum("_bss").over(whole)).drop("_bss")
    # every probability needs the ranks just below and above (total-1)*p
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("_total") - 1) * F.lit(float(p))).alias("pos"))
                       for name, p in probs.items()])
    inside = lambda n: lambda w: (F.floor(w["pos"]) < F.col("_base") + F.col(n)) & (F.ceil(w["pos"]) >= F.col("_base"))
    hist = hist.withColumn("_want", F.filter(wanted, inside("_bn"))).where(F.size("_want") > 0).drop("_bn")
    picked = with_part(counts.drop("_mean").join(hist, ["_g", "_bucket"]), F.col("_v"), buckets)
    shared = ["_base", "_total", "_want"] + (["_ss"] if std else [])
    parts = picked.groupBy("_g", "_bucket", "_part").agg(F.sum("_n").alias("_pn"), *[F.first(c).alias(c) for c in shared])
    upto = W.partitionBy("_g", "_bucket").orderBy("_part")  # at most ``buckets`` rows
    parts = parts.withColumn("_base", F.col("_base") + F.sum("_pn").over(upto) - F.col("_pn"))
    parts = parts.withColumn("_want", F.filter("_want", inside("_pn"))).where(F.size("_want") > 0).drop("_pn")
    picked = picked.drop(*shared).join(parts, ["_g", "_bucket", "_part"])
    order = W.partitionBy("_g", "_bucket", "_part").orderBy("_v")
    picked = picked.withColumn("_to", F.col("_base") + F.sum("_n").over(order)) \
                   .withColumn("_from", F.col("_to") - F.col("_n"))
    kept = ["_g", "_v", "_from", "_to", "_total"] + (["_ss"] if std else [])
    picked = picked.select(*kept, F.explode("_want").alias("_w"))
    low, high = F.floor(F.col("_w.pos")), F.ceil(F.col("_w.pos"))
    holds = lambda r: (F.col("_from") <= r) & (r < F.col("_to"))
    aggs = []
    for name in probs:
        here = F.col("_w.name") == name
        lo = F.max(F.when(here & holds(low), F.col("_v")))
        hi = F.max(F.when(here & holds(high), F.col("_v")))
        frac = F.max(F.when(here, F.col("_w.pos") - low))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    if std:
        aggs.append(F.sqrt(F.max("_ss") / F.max("_total")).alias(std))
    out = picked.groupBy("_g").agg(*aggs, F.max("_total").alias("n"))
    return out.select(*[F.col("_g")[c].alias(c) for c in by], *probs, *([std] if std else []), "n")


def exact_median(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "median", std: str | None = None) -> DataFrame:
    return exact_quantiles(df, value, {name: 0.5}, by, std)


def exact_mode(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "mode") -> DataFrame:
    """Most frequent value, the smallest among equals."""
    by = list(by)
    counts = (df.where(F.col(value).isNotNull()).groupBy(*by, value)
              .agg(F.count(F.lit(1)).alias("_n")))
    best = F.max_by(F.col(value), F.struct(F.col("_n"), -F.col(value)))
    return counts.groupBy(*by).agg(best.alias(name))


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Group statistics back to the rows. A join, not a window: the statistics are
    reduced map-side and a hot group is split by the adaptive skew join."""
    return null_safe_join(df, stats, list(by), "left")
