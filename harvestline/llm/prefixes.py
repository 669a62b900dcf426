"""Prefix filtering for set similarity: which members of a token's list may be similar at all.

All sets are sorted by one global order of tokens. If two sets of na and nb tokens have a Jaccard
similarity of ``percent`` or more, they share ``needed(na, nb)`` tokens at least; the first shared
one then stands at position na - needed + 1 or before in the one and nb - needed + 1 or before in
the other, since that many tokens must still follow. A posting is (token, node, n, pos): the place,
from 1, of a token in the set of a node with n tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def needed(na: Column, nb: Column, percent: int) -> Column:
    """Tokens that sets of na and nb tokens share at least, if they are similar."""
    return -F.floor(-percent * (na + nb) / F.lit(100 + percent))


def least_partner(n: Column, percent: int) -> Column:
    """Tokens of the smallest set that may be similar to one of n; as many are shared at least."""
    return -F.floor(-percent * n / F.lit(100))


def useful(postings: DataFrame, percent: int) -> DataFrame:
    """The postings (token, node, n, pos, ...) that may be the first shared token with some other
    member of their list, judged by the sizes in it, where at least two are left."""
    sizes = postings.groupBy("token").agg(F.count("*").alias("_members"), F.min("n").alias("_low"), F.max("n").alias("_high")).where("_members > 1")
    n = F.col("n")
    partner = F.greatest("_low", least_partner(n, percent))
    kept = postings.join(sizes.drop("_members"), "token").where((partner <= F.col("_high")) & (F.col("pos") <= n - needed(n, partner, percent) + 1))
    return kept.drop("_low", "_high")


def stars(postings: DataFrame) -> DataFrame:
    """Pairs (a, b) of every member with its list's pivot: the member with the most company over
    all its lists, which a text that copies were made from is. As many pairs as postings at most."""
    members = postings.groupBy("token").agg(F.count("*").alias("members")).where("members > 1")
    met = postings.select("token", "node").join(members, "token")
    central = met.join(met.groupBy("node").agg(F.sum("members").alias("company")), "node")
    pivots = central.groupBy("token").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("pivot"))
    return met.join(pivots, "token").where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()


def pairs_across(postings: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may be similar and are not in one component yet. ``labels`` (node, component)
    names the component of nodes that are in one. Members outside a list's main component meet the
    members of other components at the positions where a first shared token can be; members of one
    component never meet."""
    placed = postings.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = placed.groupBy("token", "component").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("token").agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    open_ = placed.join(mixed.select("token", "main"), "token")
    tell = lambda c: [F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("pos").alias(f"pos_{c}"), F.col("component").alias(f"part_{c}")]
    outside = open_.where("component <> main").select("token", "main", *tell("a"))
    need = needed(F.col("na"), F.col("nb"), percent)
    near = (F.col("na") - F.col("pos_a") + 1 >= need) & (F.col("nb") - F.col("pos_b") + 1 >= need)
    return outside.join(open_.select("token", *tell("b")), "token").where("part_a <> part_b and (part_b = main or a < b)").where(near).select("a", "b").distinct()
